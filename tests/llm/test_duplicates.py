import random
import re
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import common, fingerprints, lines, near_dedup

from .conftest import SCHEMA, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def groups(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_duplicates_match_brute_force(spark, corpus):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in corpus]
    base = prose(rng, 120).split(" ")
    for k in range(60):  # a family around the threshold: some linked directly, some only through others
        w = list(base)
        for _ in range(k % 6):
            w[rng.randrange(len(w))] = "edit%d" % rng.randrange(1000)
        rows.append((1000 + k, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a, b in combinations(sets, 2) if (n := len(sets[a] & sets[b])) and 100 * n >= 85 * len(sets[a] | sets[b])]
    want = groups(sets, links)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert len(got) == len(rows)
    for i, s in sets.items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s), want[i], want[i] == i)


def test_super_minhash_equals_the_sequential_algorithm():
    rng = np.random.default_rng(1)
    m = 24
    for n in (1, 3, 40, 500):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        h = np.full(m, np.iinfo(np.uint64).max, np.uint64)
        for e in x:
            p = list(range(m))
            for j in range(m):
                r = int(common.mix64(np.array([e], np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (2 * j + 1)) & 0xFFFFFFFFFFFFFFFF))[0])
                k = j + (((r & 0xFFFFFFFF) * (m - j)) >> 32)
                p[j], p[k] = p[k], p[j]
                h[p[j]] = min(int(h[p[j]]), (j << 32) | (r >> 32))
        assert (near_dedup.super_minhash([x], m)[0] == h).all()


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**63, 1500).astype(np.uint64)
    a, b = near_dedup.super_minhash([x[:1000], x[500:]])
    assert abs((a == b).mean() - 1 / 3) < 0.12


def test_near_duplicate_edges(empty, odd):
    assert near_dedup.near_duplicates(empty).count() == 0
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    assert near_dedup.keep_one(odd).columns == odd.columns


def test_rows_that_share_an_id_are_linked_by_their_own_text(spark):
    rng = random.Random(8)
    a, b = prose(rng, 100), prose(rng, 100)
    rows = [(1, a), (1, b), (2, b + " more"), (2, b + " more"), (None, b), (3, None), (4, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("1", 96, 1, True), ("1", 96, 1, True), ("2", 97, 1, False), ("2", 97, 1, False), ("3", 0, 3, True), ("4", 0, 4, True), ("None", 96, None, True)]
    rows = [(5, a), (5, b), (2, b + " more")]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(5, 5), (5, 2), (2, 2)}
    left = near_dedup.keep_one(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(2, b + " more"), (5, a)]


def test_links_hold_at_every_threshold(spark):
    w = prose(random.Random(12), 2000).split(" ")
    pairs = {99: (2000, 0, near_dedup.super_minhash), 50: (120, 6, fingerprints._full_signature), 10: (60, 8, near_dedup.super_minhash)}
    for percent, (n, edits, signature) in pairs.items():
        a = [f"{x}{k}" for k, x in enumerate(w[:n])]
        b = [*a, "tail"]
        for k in range(edits):
            b[(k * n) // max(1, edits)] = f"edit{k}"
        x, y = shingle_set(" ".join(a)), shingle_set(" ".join(b))
        assert 100 * len(x & y) >= percent * len(x | y)
        df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id long, text string")
        assert {r.component_id for r in near_dedup.near_duplicates(df, percent=percent, signature=signature).collect()} == {1}


def test_connected_components_of_paths_and_stars(spark):
    e = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.component for r in common.connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == groups(sorted({x for p in e for x in p} - set()), [p for p in e])


# --- 4: fingerprints
def test_fingerprints_with_next(docs, corpus):
    import hashlib

    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(docs).collect()}
    assert len(got) == len(corpus)
    by_text = {}
    for k, (i, t, *_) in enumerate(corpus):
        t, u, r = t or "", corpus[(k + 1) % len(corpus)][1] or "", got[i]
        half = len(t) // 2
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert abs(got[24].near_edited - 0.5) < 0.15 and got[24].near_next < 0.05
    plain = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}


def test_likeness_matches_brute_force(docs, corpus):
    def grams(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def agree(a, b):
        return sum(a[k : k + 4] == b[k : k + 4] for k in range(0, len(a), 4)) / (len(a) // 4)

    got = {r.doc_id: r for r in fingerprints.fingerprint_with_next(docs).collect()}
    for k, (i, t, *_) in enumerate(corpus):
        j, u, *_ = corpus[(k + 1) % len(corpus)]
        t, u = t or "", u or ""
        half = len(t) // 2
        a, b, e = grams(t), grams(u), grams(t[: len(t) - half] + u[:half])
        for near, other, fp in ((got[i].near_next, b, got[j].fingerprint), (got[i].near_edited, e, got[i].edited_fingerprint)):
            if a and other:
                assert near == agree(got[i].fingerprint, fp)
                assert abs(near - len(a & other) / len(a | other)) < 0.2  # 4.5 standard deviations at the most


def test_minhash_equals_brute_force():
    x = np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    starts = np.array([0, 1, 5, 120])
    a, b = fingerprints.coefficients(8)
    got = fingerprints.minhash(x, starts, a, b)
    for i, (s, e) in enumerate(zip(starts, [*starts[1:], len(x)], strict=True)):
        for k in range(8):
            assert int(got[i, k]) == min((int(v) * int(a[k]) + int(b[k])) % 2**64 for v in x[s:e])


def test_similar_uses_the_same_links(docs, corpus):
    got = {r.doc_id: r.component_id for r in fingerprints.similar(docs, 80).collect()}
    assert got[10] == 3 and got[12] == 5


def test_fingerprint_edges(spark, empty, odd):
    assert fingerprints.fingerprint_with_next(empty).count() == 0
    assert fingerprints.fingerprint_with_next(odd).count() == odd.count()
    one = fingerprints.fingerprint_with_next(spark.createDataFrame([(5, "ab")], "doc_id long, text string")).first()
    assert one.near_next == 1.0 and one.n_chars == 2


# --- 10: lines
def line_set(line):
    """The 12-character shingles at every position of a line in lower case."""
    line = line.lower()
    return {line[k : k + 12] for k in range(max(1, len(line) - 11))} if line else set()


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(9)
    texts = []
    for _ in range(40):
        texts.append([prose(rng, rng.randint(10, 40)) for _ in range(rng.randint(1, 6))])
    common_line = prose(rng, 14)
    for k in range(0, 40, 3):
        texts[k].append(common_line)
    near = prose(rng, 60).split(" ")
    for k in range(1, 40, 4):
        w = list(near)
        w[rng.randrange(60)] = "other"
        texts[k].insert(0, " ".join(w))
    texts[5].append("short one")
    texts[6].append("short one")
    rows = [(i, "\n".join(t)) for i, t in enumerate(texts)]
    every = [(i, p, line.strip()) for i, t in rows for p, line in enumerate(t.split("\n"))]
    sets = {(i, p): line_set(x) for i, p, x in every}
    sets = {k: s for k, s in sets.items() if s}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if 100 * len(sets[a] & sets[b]) >= lines.PERCENT * len(sets[a] | sets[b])]
    root = groups(sorted(sets), links)
    want = {}
    for (i, p), r in root.items():
        if r != (i, p):
            want.setdefault(i, []).append(p)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in lines.line_report(df).collect()}
    assert {i: r.dropped for i, r in got.items() if r.n_dropped} == {i: sorted(v) for i, v in want.items()}
    assert all(got[i].n_lines == len(t) for i, t in enumerate(texts))
    out = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], SCHEMA)).collect()}
    assert out == {i: x for i, t in rows if (x := "\n".join(y for p, y in enumerate(t.split("\n")) if p not in want.get(i, []))).strip() or i not in want}


def test_line_recall_near_the_threshold(spark):
    """Pairs from 0.8 to 0.9, where banding is weakest: recall against brute force is 0.99 at least."""
    rng, texts = random.Random(17), []
    for k in range(400):
        base = "".join(rng.choices("abcdefghijklmnop ", k=rng.randint(40, 400))).strip()
        edit = list(base)
        for _ in range(1 + len(base) // 160):
            edit[rng.randrange(len(edit))] = "é"
        texts += [base, "".join(edit)]
    sets = [line_set(t) for t in texts]
    near = [i for i in range(0, len(texts), 2) if 0.8 <= len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.9]
    assert len(near) > 100
    got = {r.doc_id: r.n_dropped for r in lines.line_report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    far = [i for i in range(0, len(texts), 2) if len(sets[i] & sets[i + 1]) / len(sets[i] | sets[i + 1]) < 0.8]
    assert sum(got[i + 1] for i in near) >= 0.99 * len(near) and not any(got[i + 1] for i in far)


def test_line_components_hold_with_repeated_rows_null_ids_and_long_lines(spark):
    rng = random.Random(21)
    long, hot = "".join(rng.choices("abcdefgh ", k=300_000)), prose(rng, 20)
    rows = [(None, hot), (3, hot), (3, hot), (4, f"{hot}\n{hot}"), (5, long), (6, "x" + long), (None, long), (2, "only " + prose(rng, 30)), (2, None)]
    rows += [(100 + k, hot) for k in range(200)]
    got = lines.line_report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.dropped)
    assert len(got) == len(rows) and by[3] == [[], []] and by[4] == [[0, 1]] and by[5] == [[]] and by[6] == [[0]]
    assert by[None] == [[0], [0]] and by[2] == [[], []] and all(by[100 + k] == [[0]] for k in range(200))


def test_line_links_from_80_percent_whatever_the_case(spark):
    rng = random.Random(1)
    w = ["".join(rng.choices("abcdefgh", k=8)) for _ in range(20)]
    a, b = " ".join(w), " ".join([*w[:10], "wxyz" + w[10][4:], *w[11:]])
    s, t = line_set(a), line_set(b)
    assert 80 <= 100 * len(s & t) / len(s | t) < 85
    c = prose(random.Random(2), 30)
    rows = [(1, a), (2, b), (3, c), (4, c.upper())]
    got = {r.doc_id: r.dropped for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [], 4: [0]}


def test_line_links_are_those_of_shingles_at_every_position(spark):
    rng = random.Random(3)

    def run(n):
        return "".join(rng.choices("一二三四五六七八九十百千万", k=n))

    a, b, url = run(150), run(150), "https://" + "".join(rng.choices("abcdef0123456789", k=200))
    long = [a, "初" + a, b, b[:75] + "中🎉" + b[75:], url, "x" + url, run(150)]
    w = ["".join(rng.choices("abcdefgh", k=30)) for _ in range(10)]
    # 41 of 298 positions touch the word that differs: below 0.8
    long += [" ".join(w), " ".join([*w[:5], "".join(rng.choices("stuvwxyz", k=30)), *w[6:]])]
    sets = {i: {t[k : k + 12] for k in range(len(t) - 11)} for i, t in enumerate(long)}
    links = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert links == [(0, 1), (2, 3), (4, 5)]
    got = {r.doc_id: r.n_dropped for r in lines.line_report(spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")).collect()}
    assert {i for i, n in got.items() if n} == {b for _, b in links}


def test_short_lines_take_part_and_blank_ones_stay(spark):
    rows = [(1, "two words\n\n}\r\nonly here"), (2, "Two words \r\n\r\n \t\n}\nfour words of it"), (3, "four words of it\n\n日本\n日本\n日本語")]
    got = {r.doc_id: r.dropped for r in lines.line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 3], 3: [0, 3]}


def test_line_signatures_equal_brute_force(spark):
    texts = ["a", "日本語", "twelve chars", "thirteen char", "ümlaut ▁ 執 🎉 " * 9, "x" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string")
    sets = {r.id: [v % 2**64 for v in r.g] for r in df.select("id", lines.shingles("line").alias("g")).collect()}
    units = [t.encode("utf-16-be") for t in texts]
    want = [{u[k : k + 24] for k in range(0, max(1, len(u) - 22), 2)} for u in units]
    assert [(len(sets[i]), len(set(sets[i]))) for i in range(len(texts))] == [(max(1, len(u) // 2 - 11), len(w)) for u, w in zip(units, want, strict=True)]
    for r in lines.minima(df).collect():
        assert [x % 2**64 for x in r[1:]] == [min((v ^ p) - 2**64 * ((v ^ p) >> 63) for v in sets[r.id]) % 2**64 for p in (x % 2**64 for x in lines._points())]


def test_tables_of_lines_go_as_soon_as_nothing_reads_them(spark, corpus, monkeypatch):
    real, old, there = common.materialize, {p for _, p in common._written}, {}

    def spy(df, tag):
        there.setdefault(tag, [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for _, p in common._written if p not in old])
        return real(df, tag)

    monkeypatch.setattr(common, "materialize", spy)
    monkeypatch.setattr(lines, "materialize", spy)
    lines.line_report(spark.createDataFrame(corpus[:30], SCHEMA))
    assert "lines" in there["signed"] and "star" in there["contents"]
    assert "signed" not in there["contents"]  # signatures go once their buckets are known
    assert "lines" not in there["pairs"]  # the text goes once that of the candidates is set apart
    assert there["sketches"].count("star") > 1  # bands are shuffled a few at a time


def test_lines_are_cut_without_lambdas_and_as_defined(spark):
    texts = [" \tΑΣ\r\nΣΑΣ  \n\n \x0b\x0c\nİI x", "ΑΣ\nΑ\u00a0\n\u3000B ", None, "", "\n", "One\r\none", "A" + " " * 50]
    found = lines._lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.did, r.pos, r.line) for r in found.collect())
    cut = [(i, k, x.strip(" \t\n\x0b\x0c\r").lower()) for i, t in enumerate(texts) for k, x in enumerate((t or "").split("\n"))]
    assert got == sorted(x for x in cut if x[2])


def test_written_tables_hand_native_memory_back(spark, monkeypatch):
    said, trim = [], common.trim_native
    monkeypatch.setattr(common, "trim_native", lambda s: said.append(trim(s)))
    common.discard(common.materialize(spark.range(10), "trim"))
    assert len(said) == 1 and (said[0] is None or "rim" in said[0])


def test_line_dedup_is_native(docs, spark):
    from millrace.sources.files import explain

    found = lines.distinct_lines(docs)
    pairs = found.select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("line").alias("a_c"), F.col("line").alias("b_c"))
    for df in (lines.line_report(docs), found, lines.minima(found.select("id", "line")), lines.overlap(pairs), lines.as_sets(found.select("id", F.col("line").alias("c")))):
        plan = explain(df)
        assert not [n for n in ("EvalPython", "MapInArrow", "MapInPandas", "PythonUDF", "FlatMapGroups") if n in plan]


def test_line_edges(empty, odd):
    assert lines.line_report(empty).count() == 0
    assert lines.line_report(odd).count() == odd.count()
    assert lines.dedup_lines(odd).columns == odd.columns
