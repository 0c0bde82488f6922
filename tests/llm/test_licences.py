import random

from fieldloom.llm import licences as li


def words(text):
    return [w for line in li.normal_lines(text) for w in line]


def brute(text, threshold=0.8):
    """Every template against the whole text, all lines and all windows of its length, without any pruning."""
    lines, out = li.normal_lines(text or ""), {}
    flat = [w for line in lines for w in line]
    for name, template in li.TEMPLATES.items():
        t = words(template)
        spans, at = {(0, len(flat))}, 0
        for line in lines:
            spans.add((at, at + len(line)))
            at += len(line)
        spans |= {(a, a + len(t)) for a in range(max(0, len(flat) - len(t)) + 1)}
        best = max((li.dice(li.bigrams(flat[a:b]), li.bigrams(t)) for a, b in spans), default=0)
        if best >= threshold:
            out[name] = round(best, 12)
    return out


def noisy(rng, text, share):
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < share / 2 else [w, "zz"] if r < share else [w]
    return rng.choice([" ", "\n", "  "]).join(out) if rng.random() < 0.3 else " ".join(out)


def test_scan_is_brute_force():
    rng, scanner = random.Random(3), li.Scanner()
    filler = ["the", "software", "and", "of", "lorem", "ipsum", "under", "license"]
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 3)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 30))))
            parts.append(noisy(rng, rng.choice(list(li.TEMPLATES.values())), rng.choice([0, 0.05, 0.2, 0.5])))
        text = rng.choice(["\n", " "]).join(parts)
        assert {m["licence"]: round(m["dice"], 12) for m in scanner.scan(text)} == brute(text)


def test_operator(spark):
    rows = [(1, "Some prose.\nReleased under the MIT License.", 1), (2, None, 1), (3, "", 1), (None, "all RIGHTS reserved", 1), (5, "the license of the software", 1), (5, "inline text released under the mit license, and more", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, licence int")
    got = sorted(((r.doc_id, r.licence, r.dice) for r in li.scan(df).collect()), key=str)
    want = [(1, "MIT-notice", 1.0), (2, None, None), (3, None, None), (None, "all-rights-reserved", 1.0), (5, None, None), (5, "MIT-notice", 1.0)]
    assert got == sorted(want, key=str)
    assert li.scan(df.limit(0)).count() == 0


def brute_windows(text, templates, threshold=0.8):
    """Every template against all windows of all lengths."""
    flat, out = words(text), {}
    for name, template in templates.items():
        t = li.bigrams(words(template))
        best = max(((li.dice(li.bigrams(flat[a:b]), t), -a, a - b) for a in range(len(flat)) for b in range(a + 2, len(flat) + 1)), default=(0,))
        if best[0] >= threshold:
            out[name] = (round(best[0], 12), -best[1], -best[2])
    return out


def test_search_is_brute_force_over_all_lengths():
    rng = random.Random(5)
    templates = {k: v for k, v in li.TEMPLATES.items() if len(v) < 300} | {"odd": "a a a b a a of the of the"}
    scanner = li.Scanner(templates)
    filler = ["the", "software", "and", "of", "lorem", "a", "b", "under", "license"]
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(1, 2)):
            parts.append(" ".join(rng.choice(filler) for _ in range(rng.randint(0, 20))))
            parts.append(noisy(rng, rng.choice(list(templates.values())), rng.choice([0, 0.05, 0.2, 0.5])))
        text = rng.choice(["\n", " "]).join(parts)
        assert {m["licence"]: (round(m["dice"], 12), m["place"], m["length"]) for m in scanner.search(text)} == brute_windows(text, templates)


def test_shortened_and_extended_inside_a_document(spark):
    rows = []
    for name in ("MIT", "ISC", "BSD-2-Clause", "Apache-2.0-header", "GPL-3.0-header"):
        w = li.TEMPLATES[name].split()
        for k, part in enumerate((w[: len(w) * 3 // 4], w[: len(w) // 2] + ["zz"] * (len(w) * 35 // 100) + w[len(w) // 2 :])):
            body = ["other"] * 500 + part + ["other"] * 500
            rows.append((k, "\n".join(" ".join(body[i : i + 9]) for i in range(0, len(body), 9)), name))
    got = li.scan(spark.createDataFrame(rows, "doc_id long, text string, name string")).collect()
    assert len(got) == len(rows) and all(r.licence for r in got)
    assert {(r.doc_id, m.licence) for r in got for m in r.matches} >= {(k, name) for k, _, name in rows}
