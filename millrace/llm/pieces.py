"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has a node per byte boundary and an edge per vocabulary piece that matches.  Forward
filtering sums, from left to right, the probability of all segmentations that end at a node; backward
sampling walks from the last node, choosing each edge with its share of that sum, so that a segmentation
is drawn with exactly its probability given the text.  Draws come from a counter-based generator keyed by
(seed, row key, word of the row, step): the same row gives the same pieces on any partitioning.

No piece holds a space after another character or a line feed, so the lattice falls into independent
pieces at those places ("words" below).  Equal words of a batch share one filtered lattice; all their
occurrences are sampled together in numpy.

The vocabulary is a public SentencePiece model, not trained here.  A unigram model's scores are log
probabilities; a BPE model ranks its pieces by merge order, which is taken as a Zipf law (p ~ 1 / rank).
Characters outside the vocabulary, and a literal U+2581, become byte pieces, so decoding restores any text.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _U, _powers, chunks, mix64, text_buffers

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED, SHARPNESS = 20240501, 1.0
#: Bytes of text whose lattices are held at once by a worker (about 60 times as much memory).  Longer texts
#: are cut between words; only a single word, a run without blank or line feed, is never cut.
CHUNK = 1 << 19
_SPACE, _LF = 32, 10


class Vocabulary:
    """What sampling needs of a model: piece bytes, log probabilities and ids of the byte pieces."""

    def __init__(self, pieces: list[bytes], logp: list[float], ids: list[int], byte_ids: list[int], size: int):
        self.pieces, self.logp, self.ids, self.byte_ids, self.size = pieces, logp, ids, byte_ids, size

    @staticmethod
    def load(path: str = MODEL, sharpness: float = SHARPNESS) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError(f"{path}: lossless coding needs a model with byte pieces")
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        text = [sp.id_to_piece(i).replace("▁", " ") for i in plain]
        scores = np.array([sp.get_score(i) for i in plain])
        have = set(text)
        extra = [b for b in range(128) if chr(b) not in have]  # ASCII that only byte pieces cover
        if scores.min() < -1e3:  # merge ranks, not log probabilities
            rank = np.empty(len(plain))
            rank[np.argsort(-scores, kind="stable")] = np.arange(1, len(plain) + 1)
            scores = -np.log(rank)
        scores = scores * sharpness
        scores -= scores.max() + np.log(np.exp(scores - scores.max()).sum())
        least = float(scores.min()) - 1.0
        pieces = [t.encode() for t in text] + [bytes([b]) for b in extra]
        return Vocabulary(pieces, scores.tolist() + [least] * len(extra), plain + [byte_ids[b] for b in extra], byte_ids, n)


class Trie:
    """A byte trie as an open-addressed table of its edges: (state, byte) to state, 0 being both the root and none."""

    def __init__(self, pieces: list[bytes]):
        size = np.array([len(p) for p in pieces])
        text = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint32)
        at = np.cumsum(size) - size
        state, edges, states = np.zeros(len(pieces), np.uint32), [], 1
        for depth in range(int(size.max())):
            on = np.flatnonzero(size > depth)
            key, which = np.unique(state[on] * np.uint32(256) + text[at[on] + depth], return_inverse=True)
            edges.append(key)
            state[on] = (states + which).astype(np.uint32)
            states += len(key)
        self.piece = np.full(states, -1, np.int32)
        self.piece[state[::-1]] = np.arange(len(pieces), dtype=np.int32)[::-1]
        keys = np.concatenate(edges)
        self.bits = int(4 * len(keys)).bit_length()
        self.key, self.to = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.uint32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):  # the first of those that want a free slot takes it, the others try the next
            free = np.flatnonzero(self.key[slot[todo]] == 0)
            at_, one = np.unique(slot[todo[free]], return_index=True)
            won = todo[free[one]]
            self.key[at_], self.to[at_] = keys[won] + np.uint32(1), (won + 1).astype(np.uint32)
            todo = np.setdiff1d(todo, won, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = state * np.uint32(256) + byte
        slot = self._slot(key)
        key += np.uint32(1)
        have, out = self.key[slot], self.to[slot]
        out = np.where(have == key, out, np.uint32(0))
        open_ = np.flatnonzero((have != key) & (have != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            have = self.key[slot[open_]]
            hit = have == key[open_]
            out[open_[hit]] = self.to[slot[open_[hit]]]
            open_ = open_[~hit & (have != 0)]
        return out


class Coder:
    """Encoder and decoder of one vocabulary: a few arrays, about 4 MB, built once and sent to the workers."""

    def __init__(self, v: Vocabulary):
        if any(b" " in p.lstrip(b" ") or (b"\n" in p and p != b"\n") for p in v.pieces):
            raise ValueError("a piece crosses a word boundary")
        self.trie = Trie(v.pieces)
        self.piece, self.logp, self.ids = self.trie.piece, np.array(v.logp), np.array(v.ids, np.int32)
        self.byte_ids, self.byte_logp = np.array(v.byte_ids, np.int32), float(min(v.logp)) - 1.0
        self.longest = max(map(len, v.pieces))
        raw = [b""] * v.size
        for i, p in zip(v.ids, v.pieces, strict=True):
            raw[i] = p
        for b, i in enumerate(v.byte_ids):
            raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_len = np.array([len(r) for r in raw], np.int64)
        self.raw_at = np.cumsum(self.raw_len) - self.raw_len

    # ------------------------------------------------------------------ encoding
    def encode(self, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text) of the texts data[offsets[i]:offsets[i+1]]."""
        return self.encode_words(*prefixed(data, offsets), keys, seed)[:2]

    def encode_long(self, data: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, bool]:
        """(ids, whether they decode to the text) of one text, a bounded number of words at a time."""
        feed, space = data == _LF, data == _SPACE
        cut = feed.copy()
        cut[1:] |= feed[:-1] | (space[1:] & ~space[:-1])
        cuts, ids, same, a, words = np.append(np.flatnonzero(cut), len(data)), [], True, 0, 0
        while a < len(data):
            k = max(int(np.searchsorted(cuts, a + CHUNK, side="right")) - 1, int(np.searchsorted(cuts, a, side="right")))
            b = int(cuts[k])
            part = data[a:b] if a else np.concatenate([[np.uint8(_SPACE)], data[a:b]])
            got, _, n = self.encode_words(part, np.array([0, len(part)]), key, seed, words)
            ids.append(got)
            same, words, a = same and np.array_equal(self.spell(got), part), words + n, b
        return np.concatenate(ids), same

    def encode_words(self, text: np.ndarray, at: np.ndarray, keys: np.ndarray, seed: int, before: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, number of ids of each text, words) of texts that have their leading space; `before` counts
        the words of the first text that were coded already."""
        if len(text) == 0:
            return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64), 0
        space, feed = text == _SPACE, text == _LF
        start = feed.copy()
        start[0] = True
        start[1:] |= (space[1:] & ~space[:-1]) | feed[:-1]
        start[at[:-1][at[:-1] < at[1:]]] = True
        starts = np.flatnonzero(start)
        spans = np.diff(np.append(starts, len(text)))
        pos = np.arange(len(text)) - np.repeat(starts, spans)
        vals = (text.astype(np.uint64) + _U(1)) * _powers(int(spans.max()) + 1)[pos]
        hashes = mix64(np.add.reduceat(vals, starts) + spans.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        _, one, word = np.unique(hashes, return_index=True, return_inverse=True)

        u_len = spans[one]
        u_at = np.cumsum(u_len) - u_len
        words = text[np.arange(u_len.sum()) + np.repeat(starts[one] - u_at, u_len)]
        edges = self._lattice(words, u_at, u_len)

        first = np.searchsorted(starts, at)
        of = np.repeat(np.arange(len(at) - 1), np.diff(first))
        ordinal = np.arange(len(starts)) - first[of] + before * (of == 0)
        stream = mix64(mix64(keys[of] + _U((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) + ordinal.astype(np.uint64) * _U(0xD1B54A32D192ED03))
        return *self._sample(edges, (u_at + u_len + np.arange(len(u_at)))[word], stream, first, words), len(starts)

    def _lattice(self, words: np.ndarray, u_at: np.ndarray, u_len: np.ndarray):
        """Edges by end node, with each node's backward probabilities.  Nodes: byte boundaries of words."""
        n, token = len(words), np.repeat(np.arange(len(u_at), dtype=np.int32), u_len)
        end_of = (u_at + u_len).astype(np.int32)[token]
        begins = np.flatnonzero((words & 0xC0) != 0x80).astype(np.int32)
        step, piece = self.trie.step, self.piece
        from_, to, what = [], [], []
        p, state, depth = begins, step(np.zeros(len(begins), np.uint32), words[begins]), 1
        while len(p):
            alive = state != 0
            p, state = p[alive], state[alive]
            k = piece[state]
            hit = k >= 0
            from_.append(p[hit])
            to.append(p[hit] + depth)
            what.append(k[hit])
            more = p + depth < end_of[p]
            p, state = p[more], state[more]
            state = step(state, words[p + depth])
            depth += 1
        size = np.diff(np.append(begins, n))  # bytes of each character
        single = np.zeros(n + 1, bool)
        width = np.zeros(n, np.int32)
        width[begins] = size
        for f, t in zip(from_, to, strict=True):
            single[f[t - f == width[f]]] = True
        lone = begins[~single[begins]]
        from_.append(lone)
        to.append(lone + width[lone])
        what.append(np.full(len(lone), -1, np.int32))
        f, t, k = np.concatenate(from_), np.concatenate(to), np.concatenate(what)
        del from_, to, what
        weight = np.where(k >= 0, self.logp[k], self.byte_logp * (t - f))
        tok = token[f]
        f, t = f + tok, t + tok  # bytes to nodes: every word has one node more than bytes
        order = np.argsort(t, kind="stable")
        f, t, k, weight, tok = f[order], t[order], k[order], weight[order], tok[order]
        rel = t - u_at.astype(np.int32)[tok] - tok
        by = np.argsort(rel.astype(np.uint16) if rel.max() < 65536 else rel, kind="stable")
        cuts = np.flatnonzero(np.diff(rel[by])) + 1
        alpha = np.zeros(n + len(u_at))
        share = np.empty(len(f))
        for a, b in zip(np.concatenate([[0], cuts]), np.append(cuts, len(by)), strict=True):  # forward filtering
            e = by[a:b]
            la, node = alpha[f[e]] + weight[e], t[e]
            new = np.concatenate([[True], node[1:] != node[:-1]])
            seg = np.flatnonzero(new)
            which = np.cumsum(new) - 1
            top = np.maximum.reduceat(la, seg)
            total = np.log(np.add.reduceat(np.exp(la - top[which]), seg)) + top
            alpha[node[seg]] = total
            share[e] = np.exp(la - total[which])
        new = np.concatenate([[True], t[1:] != t[:-1]])
        seg = np.flatnonzero(new)
        run = np.cumsum(share)
        upto = run - (run[seg] - share[seg])[np.cumsum(new) - 1]
        upto[np.append(seg[1:], len(t)) - 1] = 2.0  # the last edge of a node takes what rounding leaves
        first = np.zeros(n + len(u_at) + 1, np.int64)
        first[t[seg]] = seg
        return f, t, k, upto, first, u_at + np.arange(len(u_at))

    def _sample(self, edges, node: np.ndarray, stream: np.ndarray, first: np.ndarray, words: np.ndarray):
        f, t, k, upto, incoming, begin = edges
        is_begin = np.zeros(int(t.max()) + 1, bool)
        is_begin[begin] = True
        count = np.zeros(len(node), np.int64)
        steps, occ, step = [], np.arange(len(node)), 0
        cost = np.where(k >= 0, 1, t - f)
        while len(occ):  # backward sampling, all words at once
            u = (mix64(stream[occ] + _U((step * 0xA0761D6478BD642F) & 0xFFFFFFFFFFFFFFFF)) >> _U(11)).astype(np.float64) * 2.0**-53
            e = incoming[node]
            miss = np.flatnonzero(u >= upto[e])
            while len(miss):
                e[miss] += 1
                miss = miss[u[miss] >= upto[e[miss]]]
            steps.append((occ, e))
            count[occ] += cost[e]
            node = f[e]
            on = ~is_begin[node]
            occ, node = occ[on], node[on]
            step += 1
        place = np.cumsum(count)
        total = int(place[-1]) if len(place) else 0
        ids = np.empty(total, np.int32)
        at = place.copy()
        for occ, e in steps:
            at[occ] -= cost[e]
            known = k[e] >= 0
            ids[at[occ[known]]] = self.ids[k[e[known]]]
            for o, x in zip(occ[~known].tolist(), e[~known].tolist(), strict=True):  # byte pieces
                token = int(np.searchsorted(begin, f[x], side="right")) - 1
                ids[at[o] : at[o] + cost[x]] = self.byte_ids[words[f[x] - token : t[x] - token]]
        ends = np.concatenate([[0], place])[first]
        return ids, np.diff(ends)

    # ------------------------------------------------------------------ decoding
    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the pieces one after the other."""
        size = self.raw_len[ids]
        return self.raw[np.arange(int(size.sum())) + np.repeat(self.raw_at[ids] - (np.cumsum(size) - size), size)]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that the ids of each row spell, without the leading space."""
        size = self.raw_len[ids]
        at = np.cumsum(size) - size
        out = self.spell(ids)
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.append(at, len(out))[ends]
        lead = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep = np.ones(len(out), bool)
        keep[lead] = False
        return out[keep], offsets - np.concatenate([[0], np.cumsum(offsets[:-1] < offsets[1:])])


def prefixed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every non-empty text with the leading space that SentencePiece adds."""
    size = np.diff(offsets)
    some = size > 0
    add = np.cumsum(some)
    text = np.full(len(data) + int(add[-1]) if len(add) else 0, _SPACE, np.uint8)
    text[np.arange(len(data)) + np.repeat(add, size)] = data
    return text, offsets + np.concatenate([[0], add])


def encode(docs: DataFrame, model: str = MODEL, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_pieces long, ids array<int>, lossless boolean) for every row of `docs`.

    lossless says that decoding the ids gave back exactly the text.  A null or empty text has no pieces;
    rows with a null id draw from one fixed key; repeated rows are encoded alike; further columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Coder(Vocabulary.load(model)))  # bounded by the vocabulary

    def run(batches):
        import pyarrow as pa

        coder = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            keys = mix64(batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            for i, j in chunks(offsets, CHUNK):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                if j - i == 1 and len(part) > CHUNK:
                    ids, whole = coder.encode_long(part, keys[i:j], seed)
                    n, same = np.array([len(ids)]), np.array([whole])
                    yield coded_rows(batch, i, j, n, ids, same)
                    continue
                ids, n = coder.encode(part, at, keys[i:j], seed)
                back, b_at = coder.decode(ids, n)
                same = np.array([x == y for x, y in zip(np.diff(b_at), np.diff(at), strict=True)], bool)
                if not (same.all() and np.array_equal(back, part)):
                    same &= np.array([np.array_equal(back[b_at[q] : b_at[q + 1]], part[at[q] : at[q + 1]]) for q in range(j - i)], bool)
                yield coded_rows(batch, i, j, n, ids, same)
            pa.default_memory_pool().release_unused()

    def coded_rows(batch, i, j, n, ids, same):
        import pyarrow as pa

        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids)), pa.array(same)], names=["id", "n_pieces", "ids", "lossless"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces long, ids array<int>, lossless boolean").withColumnRenamed("id", id_col)


def decode(coded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text) for every row of `coded`; null or empty ids give an empty text, null ids within count as none."""
    shared = coded.sparkSession.sparkContext.broadcast(Coder(Vocabulary.load(model)))

    def run(batches):
        import pandas as pd

        coder = shared.value
        for batch in batches:
            lists = [np.zeros(0, np.int32) if x is None else np.array([v for v in x if v == v and v is not None], np.int32) for x in batch["ids"]]
            n = np.array([len(x) for x in lists], np.int64)
            out, at = coder.decode(np.concatenate([*lists, np.zeros(0, np.int32)]), n)
            raw = out.tobytes()
            yield pd.DataFrame({"id": batch["id"], "text": [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]})

    rows = coded.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)
