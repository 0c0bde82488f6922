"""Registered queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .alignment import op13_alignment
from .gridjoin import op1_grid_join
from .htmltext import op9_html_text
from .licences import op2_licences
from .lmscore import op7_lm_score
from .minhash import op6_fingerprints
from .mixing import op8_mix
from .pieces import op3_pieces
from .quality import op10_quality
from .repeats import op11_repeats
from .simhash import op4_simhash
from .tokenfiles import op5_token_files
from .whitening import op12_whitening

QUERIES = {
    "op1_grid_join": op1_grid_join,
    "op2_licences": op2_licences,
    "op3_pieces": op3_pieces,
    "op4_simhash": op4_simhash,
    "op5_token_files": op5_token_files,
    "op6_fingerprints": op6_fingerprints,
    "op7_lm_score": op7_lm_score,
    "op8_mix": op8_mix,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op11_repeats": op11_repeats,
    "op12_whitening": op12_whitening,
    "op13_alignment": op13_alignment,
}

OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding FROM embeddings
), ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM v
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS id, vec_id AS seen FROM v
  UNION
  SELECT r.id, l.b FROM reach r JOIN links l ON r.seen = l.a
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_links, min(r.seen) AS component_id, min(r.seen) = v.vec_id AS kept
FROM v JOIN reach r ON r.id = v.vec_id LEFT JOIN n ON n.a = v.vec_id GROUP BY v.vec_id
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    coalesce(0.5 + CAST(length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g')) AS DOUBLE) / nullif(length(text), 0), 0.5) AS w,
    (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, source_size * 3 AS cap,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS all_size FROM s
), p AS (
  SELECT *, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(weight) OVER o, 0) AS weight_before
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), q AS (
  SELECT *, min(CASE WHEN (all_size - cap_before) * weight > cap * (all_weight - weight_before) THEN 1 ELSE 0 END)
    OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS capped FROM p
), g AS (
  SELECT source, source_size, CASE WHEN capped = 1 THEN CAST(cap AS DOUBLE) ELSE
    CAST((all_size - sum(CASE WHEN capped = 1 THEN cap ELSE 0 END) OVER ()) * weight AS DOUBLE) / CAST(sum(CASE WHEN capped = 1 THEN 0 ELSE weight END) OVER () AS DOUBLE) END AS target
  FROM q
), h AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g
), r AS (
  SELECT d.doc_id, d.size, h.source_size, h.target, h.epochs, CAST(round(h.target) AS BIGINT) - h.epochs * h.source_size AS budget,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken FROM r
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS pos FROM d WHERE len(w) >= 35
), h AS (
  SELECT doc_id, pos, md5(array_to_string(w[pos:pos + 34], ' ')) AS words FROM s
), r AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY words) AS places FROM h) WHERE places > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM r
), word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op1_grid_join": OP1_SQL, "op8_mix": OP8_SQL, "op11_repeats": OP11_SQL}
