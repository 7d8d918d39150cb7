import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from millrace.llm import mixing, pieces, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- 1: pieces
def test_pieces_are_lossless_and_repeatable(docs, corpus):
    a = {r.doc_id: r for r in pieces.encode(docs).collect()}
    b = {r.doc_id: r.ids for r in pieces.encode(docs.repartition(7)).collect()}
    assert len(a) == len(corpus) and all(r.lossless for r in a.values())
    assert all(a[k].ids == b[k] for k in a)
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs)).collect()}
    assert all(back[i] == (t or "") for i, t, *_ in corpus)
    other = {r.doc_id: r.ids for r in pieces.encode(docs, seed=9).collect()}
    assert other[24] != a[24].ids and a[20].n_pieces == 0 and a[21].ids == []


def test_ids_decode_like_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for r in pieces.encode(docs).filter("doc_id in (0, 1, 22)").join(docs.select("doc_id", "text"), "doc_id").collect():
        assert sp.decode(r.ids) == r.text


def test_sampling_follows_the_lattice():
    """Segmentations of a tiny vocabulary come with their exact posterior probabilities."""
    vocab = [b" ", b"a", b"b", b" a", b"ab", b" ab"]
    logp = np.log(np.array([0.1, 0.2, 0.2, 0.2, 0.2, 0.1]))
    v = pieces.Vocabulary([*vocab, *[bytes([i]) for i in range(128) if bytes([i]) not in vocab]], [*logp, *[-20.0] * 125], list(range(131)), list(range(131, 387)), 387)
    coder = pieces.Coder(v)
    n = 40_000
    data, at = np.frombuffer(b"ab" * n, np.uint8), np.arange(0, 2 * n + 1, 2)
    ids, counts = coder.encode(data, at, np.arange(n).astype(np.uint64) * np.uint64(7919), 1)
    got, pos = Counter(), 0
    for c in counts:
        got[tuple(ids[pos : pos + c].tolist())] += 1
        pos += c
    want = {(0, 1, 2): 0.1 * 0.2 * 0.2, (3, 2): 0.2 * 0.2, (0, 4): 0.1 * 0.2, (5,): 0.1}
    total = sum(want.values())
    assert set(got) == set(want)
    for seg, p in want.items():
        assert abs(got[seg] / n - p / total) < 0.01


def test_pieces_edges(empty, odd):
    assert pieces.encode(empty).count() == 0
    assert pieces.encode(odd).filter("lossless").count() == odd.count()


# --- 2: mixing
def test_mix_reaches_targets(docs, corpus):
    got = mixing.mix_sizes(docs).collect()
    assert sorted(r.doc_id for r in got) == [r[0] for r in corpus]
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in corpus}
    source = {i: s for i, _, _, s, _ in corpus}
    names = sorted({s for s in source.values() if s}) + [None]
    weight = {n: (3, 1, 2)[k % 3] for k, n in enumerate(names)}
    total = {n: sum(sizes[i] for i in sizes if source[i] == n) for n in names}
    left, open_, target = 1.5 * sum(total.values()), set(names), {}
    while open_:
        w = sum(weight[n] for n in open_)
        full = [n for n in open_ if left * weight[n] / w >= 2 * total[n]]
        if not full:
            target |= {n: left * weight[n] / w for n in open_}
            break
        for n in full:
            target[n] = 2 * total[n]
        left -= sum(target[n] for n in full)
        open_ -= set(full)
    taken = defaultdict(int)
    for r in got:
        n = source[r.doc_id]
        assert r["size"] == sizes[r.doc_id] and r.source_size == total[n] and abs(r.target - target[n]) < 1e-6 * max(1, target[n])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[n] += r.taken
    assert all(abs(taken[n] - target[n]) <= mixing.BLOCK for n in names)
    again = {r.doc_id: r.taken for r in mixing.mix_sizes(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_mixed_documents_hold_the_taken_words(docs):
    mix = {r.doc_id: r.taken for r in mixing.mix_sizes(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
    assert dict(words) == {k: v for k, v in mix.items() if v}


def test_slots_and_blocks_of_a_mix_do_not_pass_through_the_driver(docs):
    got = mixing.mix_documents(docs)
    assert got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]  # as it ran
    assert re.search(r"Join \[s#\d+, block#", plan)
    assert not re.search(r"BroadcastHashJoin \[s#\d+, block#", plan)


def test_permutation_and_draws():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    q = np.array([100, 0, 7, 1])
    d = mixing.shard_draws(q, 9)
    assert (d.sum(axis=0) == q).all() and d.sum(axis=1).max() - d.sum(axis=1).min() <= 1


def test_mix_edges(empty, odd):
    assert mixing.mix_sizes(empty).count() == 0 and mixing.mix_documents(empty).count() == 0
    assert mixing.mix_sizes(odd).count() == odd.count()
    assert mixing.mix_documents(odd).columns == odd.columns


# --- 3: shards
def jump(key_hashes, n):
    b, j, i = -1, 0, 0
    while j < n:
        b = j
        j = int((b + 1) * (2147483648.0 / ((key_hashes[i] >> 33) + 1)))
        i += 1
    return b


def test_jump_hash_matches_the_loop(spark):
    from pyspark.sql import functions as F

    ids = spark.range(500).select("id", *[sharding.jump_hash(F.col("id"), n).alias(f"n{n}") for n in (1, 2, 16, 17)], F.array(*[F.xxhash64("id", F.lit(i)) for i in range(1, 20)]).alias("h"))
    for r in ids.collect():
        h = [x % (1 << 64) for x in r.h]
        for n in (1, 2, 16, 17):
            assert r[f"n{n}"] == jump(h, n)


def test_shards(docs, corpus):
    got = sharding.shard(docs).collect()
    assert len(got) == len(corpus)
    text = {i: t for i, t, *_ in corpus}
    slots = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw) and r.law == "key"
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {r.doc_id: r.shard for r in sharding.shard(docs.limit(40)).collect()}
    assert all(again[r.doc_id] == r.shard for r in got if r.doc_id in again)


def test_shard_edges(empty, odd):
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(odd).count() == odd.count()


def test_a_very_long_text_is_coded_in_bounded_pieces(spark):
    """50 MB in one text: the same pieces as when it is coded at once, and lossless."""
    coder = pieces.Coder(pieces.Vocabulary.load())
    text = ("Lorem ipsum  dolor\nsit ämet 執 ▁ " * 40_000).encode()
    data, key = np.frombuffer(text, np.uint8), np.array([7], np.uint64)
    assert len(data) > 2 * pieces.CHUNK
    ids, same = coder.encode_long(data, key, 3)
    assert same and ids.tolist() == coder.encode(data, np.array([0, len(data)]), key, 3)[0].tolist()
    big = "word and more words \n" * 2_500_000
    got = pieces.encode(spark.createDataFrame([(1, big), (None, "x" * 10), (2, None)], "doc_id long, text string")).select("doc_id", "lossless", "n_pieces").collect()
    assert sorted((str(r.doc_id), r.lossless, r.n_pieces > 0) for r in got) == [("1", True, True), ("2", True, False), ("None", True, True)]
