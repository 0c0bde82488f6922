"""DuckDB SQL for fuzzy ratios, scores and whole flows, written from their definitions and the inputs' slips."""

from __future__ import annotations

from . import inputs as I


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence, by rows of the table, each a running maximum."""
    row = f"list_transform(range(1, len(acc) + 1), lambda i: list_max(list_transform(range(1, i + 1), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(acc[j], acc[j - 1] + CASE WHEN substr({b}, CAST(j - 1 AS INTEGER), 1) = ch[1] THEN 1 ELSE 0 END) END)))"
    steps = f"list_prepend(list_transform(range(0, length({b}) + 1), lambda z: CAST(0 AS INTEGER)), list_transform(range(1, length({a}) + 1), lambda p: [CAST(p AS INTEGER)]))"
    row = row.replace("ch[1]", f"substr({a}, ch[1], 1)")
    return f"list_extract(list_reduce({steps}, lambda acc, ch: list_transform({row}, lambda q: CAST(q AS INTEGER))), -1)"


def ratio(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 100e0 ELSE 200e0 * {lcs(a, b)} / (length({a}) + length({b})) END"


def _tokens(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


def _sorted(tokens: str) -> str:
    return f"array_to_string(list_sort({tokens}), ' ')"


def _less(a: str, b: str) -> str:
    return _sorted(f"list_filter(list_distinct({_tokens(a)}), lambda v: NOT list_contains({_tokens(b)}, v))")


def fuzzy(pairs: str, n: str) -> str:
    """Tables for the pairs (a, b) of a relation; the last, fz{n}, has all ratios."""
    return f"""tk{n} AS (SELECT a, b, {_sorted(_tokens("a"))} AS sa, {_sorted(_tokens("b"))} AS sb, {_less("a", "b")} AS l, {_less("b", "a")} AS r,
      {_sorted(f"list_filter(list_distinct({_tokens('a')}), lambda v: list_contains({_tokens('b')}, v))")} AS s FROM (SELECT DISTINCT a, b FROM {pairs})
    ), pp{n} AS (SELECT a AS x, b AS y FROM tk{n} UNION SELECT sa, sb FROM tk{n} UNION SELECT l, r FROM tk{n}
    ), po{n} AS (
      SELECT x, y, x AS s, y AS t FROM pp{n} WHERE x <> '' AND length(x) <= length(y) AND x <> y
      UNION ALL SELECT x, y, y, x FROM pp{n} WHERE y <> '' AND length(y) <= length(x) AND x <> y
    ), pw{n} AS (SELECT DISTINCT x, y, s, unnest(list_transform(range(1, length(t) + length(s)), lambda e: substr(t, CAST(greatest(0, e - length(s)) + 1 AS INTEGER), CAST(e - greatest(0, e - length(s)) AS INTEGER)))) AS part FROM po{n}
    ), pr{n} AS (SELECT x, y, CASE WHEN x = y THEN 100e0 WHEN x = '' OR y = '' THEN 0e0 ELSE best END AS part
      FROM pp{n} LEFT JOIN (SELECT x, y, max({ratio("s", "part")}) AS best FROM pw{n} GROUP BY x, y) USING (x, y)
    ), fr{n} AS (SELECT k.*, {ratio("a", "b")} AS whole, {ratio("sa", "sb")} AS by_token,
      CASE WHEN a = '' OR b = '' THEN 0e0 WHEN s <> '' AND (l = '' OR r = '') THEN 100e0 WHEN s = '' THEN {ratio("l", "r")}
        ELSE greatest({ratio("(s || ' ' || l)", "(s || ' ' || r)")}, {ratio("s", "(s || ' ' || l)")}, {ratio("s", "(s || ' ' || r)")}) END AS by_set,
      p.part, CASE WHEN s <> '' THEN 100e0 ELSE greatest(q.part, o.part) END AS part_token
      FROM tk{n} k JOIN pr{n} p ON p.x = a AND p.y = b JOIN pr{n} q ON q.x = sa AND q.y = sb JOIN pr{n} o ON o.x = l AND o.y = r
    ), fz{n} AS (SELECT *, CASE WHEN a = '' OR b = '' THEN 0e0 WHEN times < 1.5e0 THEN greatest(whole, 0.95e0 * greatest(by_token, by_set))
        ELSE greatest(whole, scale * part, 0.95e0 * scale * part_token) END AS weighted
      FROM (SELECT *, CASE WHEN times <= 8 THEN 0.9e0 ELSE 0.6e0 END AS scale
        FROM (SELECT *, greatest(length(a), length(b)) / CAST(greatest(1, least(length(a), length(b))) AS DOUBLE) AS times FROM fr{n})))"""


def name_scores(n: str) -> str:
    """Table ns{n} (a, b, score) of fz{n}."""
    return f"""nt{n} AS (SELECT a, b, greatest(whole, by_token, part) / 100e0 AS f, {_tokens("a")} AS ta, {_tokens("b")} AS tb,
      least(length(replace(a, ' ', '')), length(replace(b, ' ', ''))) AS short, greatest(length(replace(a, ' ', '')), length(replace(b, ' ', ''))) AS long FROM fz{n}
    ), ns{n} AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0e0 ELSE greatest(
      CASE WHEN long / CAST(greatest(1, short) AS DOUBLE) >= 2.5e0 THEN 0.6e0 ELSE 1e0 END * CASE WHEN short <= 2 AND long >= 4 THEN least(f, 0.35e0) ELSE f END,
      CASE WHEN len(ta) = len(tb) AND list_sort(list_distinct(ta)) = list_sort(list_distinct(tb)) THEN 0.95e0 ELSE 0e0 END,
      CASE WHEN len(ta) = len(tb) - 1 AND ta[1:len(ta) - 1] = tb[1:len(ta) - 1] AND starts_with(tb[-1], ta[-1]) THEN 0.87e0 ELSE 0e0 END,
      CASE WHEN len(ta) = 2 AND len(tb) = 2 AND ta[1] = tb[1] AND (starts_with(ta[2], tb[2]) OR starts_with(tb[2], ta[2])) THEN 0.87e0 ELSE 0e0 END,
      CASE WHEN len(ta) = 3 AND len(tb) = 3 AND ta[1] = tb[1] AND ta[3] = tb[3] AND left(ta[2], 1) = left(tb[2], 1) THEN 0.9e0 ELSE 0e0 END) END AS score FROM nt{n})"""


def address_scores(n: str) -> str:
    """Table ads{n} (a, b, score) of fz{n}."""
    numbers = "len(list_intersect(regexp_extract_all(a, '\\b\\d+\\b'), regexp_extract_all(b, '\\b\\d+\\b')))"
    return f"""ad{n} AS (SELECT a, b, greatest(by_token, by_set, weighted, part) / 100e0 AS f, list_distinct({_tokens("a")}) AS ta, list_distinct({_tokens("b")}) AS tb FROM fz{n}
    ), ads{n} AS (SELECT a, b, CASE WHEN a = '' OR b = '' THEN 0e0 ELSE least(1e0,
      f * greatest(0.5e0, CASE WHEN f >= 0.9e0 THEN 1e0 ELSE len(list_intersect(ta, tb)) / CAST(greatest(1, len(ta), len(tb)) AS DOUBLE) END)
      + least(0.08e0, least(0.05e0, 0.02e0 * {numbers}) + least(0.05e0, 0.05e0 * (len(list_intersect(ta, tb)) / CAST(greatest(1, len(list_distinct(list_concat(ta, tb)))) AS DOUBLE))))) END AS score FROM ad{n})"""


def verified(pairs: str, generic, phone: str) -> str:
    """Table done: scores, confidence, decision and notes of a relation (application_id, dn, fn, dd, da, fa, dp, fp, dg), '' for what isn't there.

    dd is the date's score or null; dg whether both sides give a gender, which then agrees.
    """
    fields = ("name", "dob", "phone", "address", "gender")
    weights = (0.35, 0.30, 0.15, 0.15, 0.05)
    total = " + ".join(f"CASE WHEN has_{f} THEN {w}e0 ELSE 0e0 END" for f, w in zip(fields, weights))
    raw = " + ".join(f"CASE WHEN has_{f} THEN {w}e0 / total * s_{f} ELSE 0e0 END" for f, w in zip(fields, weights))
    notes = ", ".join(f"CASE WHEN has_{f} AND s_{f} < 0.6e0 THEN '{f} low_score(' || printf('%.2f', s_{f}) || ')' END" for f in fields)
    return f"""vp AS (SELECT * FROM {pairs}
    ), np AS (SELECT application_id, lower(dn) AS a, lower(fn) AS b FROM vp), {fuzzy("np", "n")}, {name_scores("n")}
    , ap AS (SELECT application_id, {generic("da")} AS a, {generic("fa")} AS b FROM vp), {fuzzy("ap", "a")}, {address_scores("a")}
    , hp AS (SELECT application_id, CAST({phone} AS DOUBLE) AS score FROM (SELECT application_id, regexp_replace(dp, '[^0-9]', '', 'g') AS a, regexp_replace(fp, '[^0-9]', '', 'g') AS b FROM vp)
    ), sc AS (SELECT vp.application_id, vp.dn <> '' AND vp.fn <> '' AS has_name, vp.dd IS NOT NULL AS has_dob, vp.dp <> '' AND vp.fp <> '' AS has_phone, vp.da <> '' AND vp.fa <> '' AS has_address, vp.dg AS has_gender,
      nsn.score AS s_name, coalesce(vp.dd, 0e0) AS s_dob, hp.score AS s_phone, adsa.score AS s_address, CASE WHEN vp.dg THEN 1e0 ELSE 0e0 END AS s_gender
      FROM vp JOIN np ON np.application_id = vp.application_id JOIN nsn ON nsn.a = np.a AND nsn.b = np.b JOIN ap ON ap.application_id = vp.application_id JOIN adsa ON adsa.a = ap.a AND adsa.b = ap.b JOIN hp ON hp.application_id = vp.application_id
    ), rw AS (SELECT *, {raw} AS raw FROM (SELECT *, {total} AS total FROM sc)
    ), done AS (SELECT application_id, round(raw, 4) AS overall_confidence, CASE WHEN raw >= 0.85e0 THEN 'MATCH' WHEN raw >= 0.6e0 THEN 'REVIEW' ELSE 'MISMATCH' END AS decision,
      {", ".join(f"round(s_{f}, 4) AS f_{f}" for f in fields)}, list_filter([{notes}], lambda m: m IS NOT NULL) AS notes FROM rw)"""


#: Records of people against their forms, all five scored fields on both sides.
PEOPLE = (
    "(SELECT p.application_id, p.first || ' ' || p.last AS dn, f.name AS fn, CASE WHEN p.application_id % 5 = 0 THEN 0e0 ELSE 1e0 END AS dd, p.house || ' ' || p.road AS da, f.address AS fa, "
    "'91' || p.phone AS dp, f.phone AS fp, TRUE AS dg FROM people p JOIN forms f USING (application_id))"
)

#: The same, each kind of document with what it vouches for; without a kind, or handwritten, all five.
RESTRICTED = f"""(SELECT v.application_id, CASE WHEN free OR k IN ('aadhar', 'voter') THEN dn ELSE '' END AS dn, CASE WHEN free OR k IN ('aadhar', 'voter') THEN fn ELSE '' END AS fn,
  CASE WHEN free OR k IN ('birth', 'slc') THEN dd END AS dd, CASE WHEN free OR k IN ('dl', 'passport') THEN da ELSE '' END AS da, CASE WHEN free OR k IN ('dl', 'passport') THEN fa ELSE '' END AS fa,
  CASE WHEN free THEN dp ELSE '' END AS dp, CASE WHEN free THEN fp ELSE '' END AS fp, free AS dg
  FROM {PEOPLE} v JOIN (SELECT application_id, document_type AS k, document_type IS NULL OR document_type = 'handwritten' AS free FROM docs) d USING (application_id))"""

NAME_PAIRS = I.SQL + ", pairs AS (SELECT p.application_id, lower(p.first || ' ' || p.last) AS a, lower(f.name) AS b FROM people p JOIN forms f USING (application_id))"
