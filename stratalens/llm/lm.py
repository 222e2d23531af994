"""Language-model scores from an n-gram trie in Elias-Fano form.

The model is a bigram model with Dirichlet smoothing towards add-one unigrams:
p(w|v) = (c(vw) + MU p(w)) / (c(v) + MU). It factors into A(v,w) = c(vw) / MU + p(w), which is p(w) when vw was never
seen, and a back-off weight B(v) = MU / (c(v) + MU), so a text's score is a sum of terms that each belong to one word
or one pair and can be looked up apart.

The trie has words as its first level and, below each, the words that were seen before it. Both levels are monotone
sequences in Elias-Fano form: the low bytes in a plain array, the high parts in unary, which are also the pointers from
a word to its predecessors. A pair is found by searching the range that belongs to its word, by an identifier that need
only tell that word's predecessors apart. Probabilities are quantised. The trie is cut into shards by word; a shard is
built in a memory-mapped file without a name in one task and asked by blocks of documents, which send their distinct
pairs with lists of the documents that hold them and get back sums. Between tasks a shard travels as many small rows.

A word with more than HEAVY of all tokens is frequent, at many shards one with more than a shard's tokens or RAREST of all. There are at
most 2 / RAREST frequent words; they are found before anything is counted, their counts are broadcast, and the pairs of a word that would
fill a good part of a shard are dealt to several by both words, so that no shard holds all that goes before a common word. Pairs of more than HEAVY of all tokens are broadcast too and looked up by the blocks themselves.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalens.llm.common import batches_of, cut

MU = 300.0
HEAVY, RAREST = 2e-5, 1e-6
BLOCK_TOKENS = 3 << 17
COUNT_TOKENS = 1 << 19
ROWS = 256  # texts that are turned into Python objects at a time
SHARD_BYTES = 12 << 20
BATCH_BYTES = 2 << 20  # of texts or of a shard's rows that Spark hands to a worker at a time
PART = 1 << 12  # words and pairs in a row of a shard: rows of many MB would each be copied whole, several times, on the executor's heap
PARTS = 32  # such rows that a worker hands back at a time
FOLD, HELD = 7, 2
TAIL = 40  # bits by which the predecessors of one word are told apart
#: White space cannot be part of a word, so these two are nobody's.
START, END = (xxhash.xxh64_intdigest(x) for x in (b"\n<s>", b"\n</s>"))


#: Of every byte: at which bit its zero number 1, 2, ... is (8 without such a zero; the lowest bit is 0).
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
ZERO_AT = (np.cumsum(_BITS == 0, axis=1)[:, None, :] < np.arange(9)[None, :, None]).sum(axis=2)
#: The same byte eight times in a word.
EACH = {x: np.uint64(0x0101010101010101 * x) for x in (0x01, 0x0F, 0x33, 0x55, 0x80)}


def _nth_zero(words: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The bit at which each 64-bit word has its zero number `rank` (from 1): zeros are counted up to each byte, then one byte is looked up."""
    u, rank = np.uint64, rank.astype(np.uint64)
    n = ~words
    n = n - (n >> u(1) & EACH[0x55])
    n = (n & EACH[0x33]) + (n >> u(2) & EACH[0x33])
    upto = (n + (n >> u(4)) & EACH[0x0F]) * EACH[0x01]
    byte = np.minimum(8 - np.bitwise_count((upto | EACH[0x80]) - rank * EACH[0x01] & EACH[0x80]), 7).astype(np.uint64)
    at = u(8) * byte
    return at.astype(np.int64) + ZERO_AT[words >> at & u(255), np.minimum(rank - ((upto << u(8)) >> at & u(255)), u(8))]


class EliasFano:
    """A monotone sequence of unsigned numbers: whole low bytes, and the rest in unary with a directory of zeros."""

    def __init__(self, values: np.ndarray, low_bytes: int, store):
        self.n, self.low_bits = len(values), np.uint64(8 * low_bytes)
        low = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low_bytes]
        high = (values >> self.low_bits).astype(np.int64) if low_bytes < 8 else np.zeros(self.n, np.int64)
        self.top = int(high[-1]) if self.n else -1
        bits = np.zeros((self.n + self.top + 2 + 63) // 64 * 64, np.uint8)
        bits[high + np.arange(self.n)] = 1
        packed = np.packbits(bits, bitorder="little").reshape(-1, 8)
        zeros = 64 - np.unpackbits(packed, axis=1).sum(axis=1, dtype=np.int64)
        self.low, self.unary, self.zeros = store(low), store(packed), store(np.concatenate(([0], np.cumsum(zeros))).astype(np.int64))

    def _after(self, k: np.ndarray) -> np.ndarray:
        """How many members have a high part below k (k from 0 to top + 1): ones before the zero number k - 1."""
        word = np.searchsorted(self.zeros, k.astype(np.int64), side="left") - 1
        word = np.maximum(word, 0)
        rank = k - self.zeros[word].astype(np.int64)  # the zero's number within its word, from 1
        at = _nth_zero(self.unary.reshape(-1).view("<u8")[word], rank)
        return np.where(k > 0, word * 64 + at - (k - 1), 0)

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros((len(i), 8), np.uint8)
        out[:, : self.low.shape[1]] = self.low[i]
        return out.view("<u8")[:, 0]

    def find(self, values: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
        """The index of each value, or -1: a successor search within the members of the same high part."""
        out = np.full(len(values), -1, np.int64)
        for at in range(0, len(values) if self.n else 0, chunk):
            x = values[at : at + chunk]
            high = (x >> self.low_bits).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
            ok = high <= self.top
            high = np.minimum(high, self.top)
            lo, hi = self._after(high), self._after(high + 1)
            end, want = hi.copy(), x & np.uint64((1 << int(self.low_bits)) - 1)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                less = open_ & (self._low(np.minimum(mid, self.n - 1)) < want)
                lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
            hit = ok & (lo < end)
            hit[hit] = self._low(lo[hit]) == want[hit]
            out[at : at + chunk][hit] = lo[hit]
        return out


def _quantise(logs: np.ndarray) -> tuple[np.ndarray, float, float]:
    """16-bit codes of logarithms, with the lowest value and the step."""
    low, high = (float(logs.min()), float(logs.max())) if len(logs) else (0.0, 0.0)
    step = (high - low) / 65535 or 1.0
    return np.rint((logs - low) / step).astype(np.uint16), low, step


class Trie:
    """One shard: words with their counts and quantised log p and log B, and below them pairs with quantised log A."""

    def __init__(self, words, counts, heads, tails, pairs, total: int, distinct: int, mu: float):
        self.file = tempfile.TemporaryFile()  # noqa: SIM115  closed with the trie; it has no name, so nothing is left behind
        self.counts = self._store(counts.astype(np.uint64))
        n = max(1, len(words))
        wide = max(1, int(np.ceil(max(0.0, 64 - np.log2(n)) / 8)))
        self.words = EliasFano(words, min(wide, 7), self._store)
        p = (counts + 1) / (total + distinct + 1)
        self.p, self.b, self.a = (self._codes(np.log10(x)) for x in (p, mu / (counts + mu), pairs / mu + p[heads]))
        self.pairs = EliasFano(heads.astype(np.uint64) << np.uint64(TAIL) | tails, TAIL // 8, self._store)
        self.unseen = np.log10(1 / (total + distinct + 1))

    def _store(self, a: np.ndarray) -> np.ndarray:
        if not a.size:
            return a
        at = -(-self.file.seek(0, 2) // 64) * 64
        self.file.seek(at)
        self.file.write(np.ascontiguousarray(a).tobytes())
        self.file.flush()
        return np.memmap(self.file, a.dtype, "r", at, a.shape)

    def _codes(self, logs):
        codes, low, step = _quantise(logs)
        return self._store(codes), low, step

    @staticmethod
    def _value(codes, i):
        return codes[1] + codes[2] * codes[0][i]

    def look_up(self, words: np.ndarray, heads: np.ndarray, tails: np.ndarray, given: np.ndarray):
        """For words: count, log p (given for frequent words, else not a number), log B; for pairs (index into words, predecessor): log A."""
        at = self.words.find(words)
        count, logp, logb = np.zeros(len(words), np.int64), np.full(len(words), self.unseen), np.zeros(len(words))
        seen = at >= 0
        if seen.any():
            count[seen], logp[seen], logb[seen] = self.counts[at[seen]], self._value(self.p, at[seen]), self._value(self.b, at[seen])
        logp = np.where(np.isnan(given), logp, given)
        loga = logp[heads]
        may = np.flatnonzero(seen[heads])
        pair = self.pairs.find(at[heads[may]].astype(np.uint64) << np.uint64(TAIL) | tails[may])
        loga[may[pair >= 0]] = self._value(self.a, pair[pair >= 0]) if (pair >= 0).any() else 0
        return count, logp, logb, loga


class Hashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word):
        if len(self) > 120_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def held_out(doc_id) -> bool:
    """By the id's decimal digits; a null id counts as an empty string."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLD == HELD


def _blocks(batches, hashes, most: int):
    """Blocks of documents of about `most` tokens: ids, tokens per document, and all tokens' hashes with END."""
    ids, sizes, tokens, n = [], [], [], 0
    for part in (b.slice(at, ROWS) for b in batches for at in range(0, len(b), ROWS)):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            found = (text or b"").lower().split()
            tokens.append(np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found)))
            tokens.append(np.array([END], np.uint64))
            ids.append(doc_id)
            sizes.append(len(found) + 1)
            n += len(found) + 1
            if n >= most or len(ids) >= 1 << 15:
                yield ids, np.array(sizes), np.concatenate(tokens)
                ids, sizes, tokens, n = [], [], [], 0
    if ids:
        yield ids, np.array(sizes), np.concatenate(tokens)


def _paired(sizes, tokens):
    """Distinct words, and for each token its word's and its predecessor's place among them."""
    words, at = np.unique(np.concatenate((tokens, np.array([START], np.uint64))), return_inverse=True)
    at = at.astype(np.int32)
    places = at[:-1]
    previous = np.empty_like(places)
    previous[1:] = places[:-1]
    previous[np.cumsum(sizes) - sizes] = at[-1]
    return words, places, previous


def _tail(words: np.ndarray) -> np.ndarray:
    return words >> np.uint64(64 - TAIL)


def _shard(words: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, so sorted words fall into runs."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _small(counts: np.ndarray) -> bytes:
    """Counts by one byte each if all of them fit, else by four or eight."""
    most = counts.max(initial=0)
    return counts.astype("<u1" if most < 1 << 8 else "<u4" if most < 1 << 32 else "<u8").tobytes()


def _unsmall(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n if n else 1}")


def _pack_tails(tails: np.ndarray) -> bytes:
    return tails.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : TAIL // 8].tobytes()


def _unpack_tails(blob: bytes) -> np.ndarray:
    rows = np.frombuffer(blob, np.uint8).reshape(-1, TAIL // 8)
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : TAIL // 8] = rows
    return out.view("<u8")[:, 0]


def _among(sorted_words: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among sorted ones, or -1."""
    if not len(sorted_words):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(sorted_words, words), len(sorted_words) - 1)
    return np.where(sorted_words[at] == words, at, -1)


def _frequent(batches, share: float):
    """Per block the training words that make up at least `share` of its tokens, with their counts, and under word 0 all tokens."""
    hashes = Hashes()
    for ids, sizes, tokens in _blocks(batches, hashes, COUNT_TOKENS):
        words, n = np.unique(tokens[np.repeat([not held_out(i) for i in ids], sizes)], return_counts=True)
        often = n >= share * n.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words[often], np.uint64(0)).view(np.int64)), pa.array(np.append(n[often], n.sum()))], ["w", "n"])


def frequent_words(base: DataFrame, share: float, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """All words that make up `share` of the training tokens, and none of under half as many, sorted; over how many shards each is dealt.

    A block leaves out words of less than half the share, so what is left out of a word that reaches the share is less than
    half of its count. There are at most 2 / share such words. A word is dealt to four times as many shards as
    its tokens would fill, so that it adds little to any of them, and small tables have few pieces.
    """
    sums = cut(base.mapInArrow(partial(_frequent, share=share / 2), "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")))
    total = (sums.where("w = 0").first() or [0, 0])[1]
    rows = sums.where((F.col("w") != 0) & (F.col("n") >= share / 2 * total)).collect()
    words, n = np.array([r["w"] for r in rows], np.int64).view(np.uint64), np.array([r["n"] for r in rows], np.int64)
    order = np.argsort(words)
    return words[order], np.clip(np.ceil(4 * shards * n[order] / max(1, total)), 1, shards).astype(np.uint64)


def _routes(words, head, previous, routed, shards: int):
    """The shard of each pair (places of word and predecessor): the word's own, or for frequent words one of several, by both words."""
    own, (often, spread) = _shard(words, shards), routed
    at = _among(often, words)
    pieces = np.where(at >= 0, spread[at], np.uint64(1)) if len(often) else np.ones(len(words), np.uint64)
    both = (words[head] ^ (words[previous] << np.uint64(1) | np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    piece = (both ^ both >> np.uint64(32)) >> np.uint64(32)
    return (own[head] + (piece * pieces[head] >> np.uint64(32)).astype(np.int64)) % shards


def _entries(shard, head, also_shard=(), also_head=()):
    """Keys (shard, head), sorted, of pairs and of further words; the pairs' order by them; pairs per key; the further words' places."""
    key = shard << 32 | head
    more = np.asarray(also_shard, np.int64) << 32 | np.asarray(also_head, np.int64)
    keys = np.unique(np.concatenate((key, more)))
    order = np.argsort(key, kind="stable")
    fan = np.bincount(np.searchsorted(keys, key), minlength=len(keys))
    return keys, order, fan, np.searchsorted(keys, more)


_COUNTS = "shard int, words binary, counts binary, fan binary, tails binary, pairs binary"


def _count(batches, shards: int, routed):
    """Per block and shard: the training tokens' words and pairs with their counts. A word is counted in its own shard alone."""
    hashes, routed = Hashes(), routed.value
    for ids, sizes, tokens in _blocks(batches, hashes, COUNT_TOKENS):
        train = np.repeat([not held_out(i) for i in ids], sizes)
        words, place, previous = _paired(sizes, tokens)
        place, previous = place[train], previous[train]
        pairs, n = np.unique(place.astype(np.int64) << 32 | previous, return_counts=True)
        head, before = pairs >> 32, pairs & 0xFFFFFFFF
        single = np.bincount(place, minlength=len(words))
        found = np.flatnonzero(single)
        keys, order, fan, at = _entries(_routes(words, head, before, routed, shards), head, _shard(words, shards)[found], found)
        counts = np.zeros(len(keys), np.int64)
        counts[at] = single[found]
        tail, n = _tail(words[before[order]]), n[order]
        words, edge = words[keys & 0xFFFFFFFF], np.searchsorted(keys >> 32, np.arange(shards + 1))
        below = np.concatenate(([0], np.cumsum(fan)))[edge]
        rows = []
        for s in np.flatnonzero(np.diff(edge)):
            w, p = slice(edge[s], edge[s + 1]), slice(below[s], below[s + 1])
            rows.append((int(s), words[w].tobytes(), counts[w].astype("<u4").tobytes(), fan[w].astype("<u4").tobytes(), _pack_tails(tail[p]), _small(n[p])))
        yield _batch(rows, ["shard", "words", "counts", "fan", "tails", "pairs"])


def _batch(rows, names):
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(columns)], names)


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's blocks to one, in parts of whole words in order: words, counts, heads (as counts per word), tails, pairs."""
    rows = [r for b in batches for r in b.to_pylist()]
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    fans = [np.frombuffer(r["fan"], "<u4") for r in rows]
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(at, np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]), len(every)).astype("<i8")
    heads = np.repeat(at.astype(np.uint64), np.concatenate(fans))
    keys = heads << np.uint64(TAIL) | np.concatenate([_unpack_tails(r["tails"]) for r in rows])
    keys, where = np.unique(keys, return_inverse=True)
    pairs = np.bincount(where, np.concatenate([_unsmall(r["pairs"], len(r["tails"]) // (TAIL // 8)) for r in rows]), len(keys)).astype("<i8")
    fan = np.bincount((keys >> np.uint64(TAIL)).astype(np.int64), minlength=len(every))
    tails, shard = keys & np.uint64((1 << TAIL) - 1), rows[0]["shard"]
    del rows, words, fans, at, heads, keys, where
    edge = np.append(np.flatnonzero(np.diff((np.cumsum(fan + 1) - 1) // PART, prepend=-1)), len(every))
    below = np.concatenate(([0], np.cumsum(fan)))[edge]
    for first in range(0, len(edge) - 1, PARTS):
        out = []
        for k in range(first, min(first + PARTS, len(edge) - 1)):
            w, p = slice(edge[k], edge[k + 1]), slice(below[k], below[k + 1])
            starts = int(counts[w][every[w] == np.uint64(END)].sum())  # each text has one end, and so one start
            sums = {"total": int(counts[w].sum()), "distinct": int((counts[w] > 0).sum()), "starts": starts}
            out.append({"shard": shard, "part": k, "words": every[w].tobytes(), "counts": _small(counts[w]), "fan": _small(fan[w]), "tails": _pack_tails(tails[p]), "pairs": _small(pairs[p]), **sums})
        yield pa.RecordBatch.from_pylist(out, _MERGED_TYPES)


_MERGED = "shard int, part int, words binary, counts binary, fan binary, tails binary, pairs binary, total bigint, distinct bigint, starts bigint"
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def _types(columns: str) -> pa.Schema:
    return pa.schema([(name, _KINDS[kind]) for name, kind in map(str.split, columns.split(", "))])


_MERGED_TYPES = _types(_MERGED)


def _arrays(*rows):
    """Words, counts, heads, tails and pairs of parts in order."""
    words = [np.frombuffer(r["words"], "<u8") for r in rows]
    counts, fan = (np.concatenate([_unsmall(r[c], len(w)) for r, w in zip(rows, words)]).astype("<i8") for c in ("counts", "fan"))
    tails = [_unpack_tails(r["tails"]) for r in rows]
    pairs = np.concatenate([_unsmall(r["pairs"], len(t)) for r, t in zip(rows, tails)]).astype("<i8")
    words = np.concatenate(words)
    return words, counts, np.repeat(np.arange(len(words)), fan), np.concatenate(tails), pairs


def _heavy(batches, least: float, routed):
    """The frequent words' counts and all pairs that are as frequent."""
    for batch in batches:
        for r in batch.to_pylist():
            words, counts, heads, tails, pairs = _arrays(r)
            w, p = np.flatnonzero((_among(routed.value[0], words) >= 0) & (counts > 0)), np.flatnonzero(pairs >= least)
            cols = [np.concatenate((words[w], words[heads[p]])), np.concatenate((np.zeros(len(w), np.uint64), tails[p])), np.concatenate((counts[w], pairs[p])), np.repeat([False, True], [len(w), len(p)])]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0].astype("<i8", copy=False).view("<i8")), pa.array(cols[1].astype("<i8")), pa.array(cols[2]), pa.array(cols[3])], ["w", "tail", "n", "pair"])


class Heavy:
    """The broadcast part: heavy words and pairs with their counts, sorted for look-ups."""

    def __init__(self, rows, total: int, distinct: int, starts: int, mu: float):
        self.total, self.distinct, self.starts, self.mu = total, distinct, starts, mu
        words = sorted((r["w"] % (1 << 64), r["n"]) for r in rows if not r["pair"])
        self.words, self.counts = np.array([w for w, _ in words], np.uint64), np.array([n for _, n in words], np.int64)
        place = {w: i for i, (w, _) in enumerate(words)}
        pairs = sorted(((place[r["w"] % (1 << 64)] << TAIL) | r["tail"], r["n"]) for r in rows if r["pair"])
        self.pairs, self.pair_counts = np.array([k for k, _ in pairs], np.uint64), np.array([n for _, n in pairs], np.int64)

    find = staticmethod(_among)


_ASKED = ["shard", "block", "words", "fan", "tails", "times", "docs", "ids", "held", "sizes", "base", "lm", "known"]
_ASKED_TYPES = "shard int, block bigint, words binary, fan binary, tails binary, times binary, docs binary, ids array<string>, held binary, sizes binary, base binary, lm binary, known binary"


def _ask(batches, shards: int, heavy, routed):
    """Per block: a row about its documents with the sums over heavy words and pairs, and a row for each shard that it asks."""
    from pyspark import TaskContext

    h, hashes, first = heavy.value, Hashes(), TaskContext.get().partitionId() << 24
    scale = h.total + h.distinct + 1
    for number, (ids, sizes, tokens) in enumerate(_blocks(batches, hashes, BLOCK_TOKENS)):
        block, n = first + number, len(ids)
        words, place, previous = _paired(sizes, tokens)
        doc = np.repeat(np.arange(n, dtype=np.int32), sizes)
        base, lm, known = np.zeros(n), np.full(n, np.log10(h.mu / (h.starts + h.mu))), np.zeros(n)
        mine = h.find(h.words, words)
        p = np.where(mine >= 0, (h.counts[mine] if len(h.counts) else 0) + 1, 1) / scale
        local = mine[place] >= 0
        base += np.bincount(doc[local], np.log10(p)[place[local]], n)
        known += np.bincount(doc[local], minlength=n)
        follows = local & (tokens != END)
        if len(h.counts):
            lm += np.bincount(doc[follows], np.log10(h.mu / (h.counts + h.mu))[mine[place[follows]]], n)
        key = place.astype(np.int64) << 32 | previous
        order = np.argsort(key, kind="stable")  # documents stay in order within a pair
        key, place, previous, doc = key[order], place[order], previous[order], doc[order]
        new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times = np.diff(np.append(new, len(key)))
        head, tail = place[new], _tail(words[previous[new]])
        pair = np.where(mine[head] >= 0, h.find(h.pairs, mine[head].clip(0).astype(np.uint64) << np.uint64(TAIL) | tail), -1)
        own = np.repeat(pair >= 0, times)
        if own.any():
            loga = np.log10(h.pair_counts[pair.clip(0)] / h.mu + p[head])
            lm += np.bincount(doc[own], np.repeat(loga, times)[own], n)
        asked = pair < 0
        head, before, times, doc = head[asked], previous[new][asked], times[asked], doc[~own]
        keys, order, fan, _ = _entries(_routes(words, head, before, routed.value, shards), head.astype(np.int64))
        start = (np.cumsum(times) - times)[order]  # a pair's documents move along with it
        tail, times = _tail(words[before[order]]), times[order]
        doc = doc[np.repeat(start - (np.cumsum(times) - times), times) + np.arange(len(doc))]
        words, edge = words[keys & 0xFFFFFFFF], np.searchsorted(keys >> 32, np.arange(shards + 1))
        below = np.concatenate(([0], np.cumsum(fan)))[edge]
        at = np.concatenate(([0], np.cumsum(times)))[below]
        rows = [(block % shards, block, None, None, None, None, None, [None if i is None else str(i) for i in ids], np.array([held_out(i) for i in ids]).tobytes(), sizes.astype("<i8").tobytes(), base.tobytes(), lm.tobytes(), known.tobytes())]
        for s in np.flatnonzero(np.diff(edge)):
            w, t, d = slice(edge[s], edge[s + 1]), slice(below[s], below[s + 1]), slice(at[s], at[s + 1])
            rows.append((int(s), block, words[w].tobytes(), fan[w].astype("<u4").tobytes(), _pack_tails(tail[t]), _small(times[t]), doc[d].astype("<u2").tobytes(), None, None, None, None, None, None))
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5, pa.list_(pa.string()), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], _ASKED)


_ANSWER = "block bigint, docs binary, ids array<string>, held binary, sizes binary, base binary, lm binary, known binary"
_ANSWER_TYPES = _types(_ANSWER)


def _answer(asked: pa.Table, shard: pa.Table, total: int, distinct: int, heavy, mu: float) -> pa.Table:
    """One shard: build its trie and answer the blocks' questions with sums by document."""
    h = heavy.value
    if len(shard):
        words, counts, *pairs = _arrays(*sorted(shard.to_pylist(), key=lambda r: r["part"]))
        known = _among(h.words, words)
        trie = Trie(words, np.where(known >= 0, h.counts[known], counts) if len(h.words) else counts, *pairs, total, distinct, mu)
    else:
        none = np.array([], np.int64)
        trie = Trie(none.astype(np.uint64), none, none, none.astype(np.uint64), none, total, distinct, mu)
    out = []
    for r in (r for b in asked.to_batches() for r in b.to_pylist()):
        if r["words"] is None:
            out.append({c: r[c] for c in _ANSWER_TYPES.names})
            continue
        words, fan, times = np.frombuffer(r["words"], "<u8"), np.frombuffer(r["fan"], "<u4"), _unsmall(r["times"], len(r["tails"]) // (TAIL // 8))
        heads = np.repeat(np.arange(len(words)), fan)
        known = _among(h.words, words)
        given = np.where(known >= 0, np.log10((h.counts[known] + 1) / (total + distinct + 1)), np.nan) if len(h.words) else np.full(len(words), np.nan)
        count, logp, logb, loga = trie.look_up(words, heads, _unpack_tails(r["tails"]), given)
        docs, doc = np.unique(np.frombuffer(r["docs"], "<u2"), return_inverse=True)
        word = np.repeat(heads, times)
        light = known < 0  # what is frequent was added by the block
        follows = light & (words != END)
        base = np.bincount(doc, np.where(light, np.log10((count + 1) / (total + distinct + 1)), 0)[word], len(docs))
        seen = np.bincount(doc, (light & (count > 0)).astype(float)[word], len(docs))
        lm = np.bincount(doc, np.repeat(loga, times) + np.where(follows, logb, 0)[word], len(docs))
        out.append({"block": r["block"], "docs": docs.astype("<u2").tobytes(), "base": base.tobytes(), "lm": lm.astype("<f4").tobytes(), "known": seen.astype("<u4").tobytes()})
    return pa.Table.from_pylist(out, _ANSWER_TYPES)


def _gather(rows: pd.DataFrame) -> pd.DataFrame:
    """One block: add up the answers."""
    own = rows[rows["docs"].isnull()].iloc[0]
    sums = {c: np.frombuffer(own[c]).copy() for c in ("base", "lm", "known")}
    for r in rows[rows["docs"].notnull()].itertuples():
        docs = np.frombuffer(r.docs, "<u2")
        for (c, s), kind in zip(sums.items(), ("<f8", "<f4", "<u4")):
            s[docs] += np.frombuffer(getattr(r, c), kind)
    return pd.DataFrame({"id": own["ids"], "held_out": np.frombuffer(own["held"], bool), "n_tokens": np.frombuffer(own["sizes"], "<i8"), "n_known": np.rint(sums["known"]).astype(np.int64), "base_score": sums["base"], "score": sums["lm"]})


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mu: float = MU, heavy_share: float = HEAVY) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and has its end token alone. A null id is scored like any other and counts as training text;
    rows that repeat an id are documents of their own. Without training text every token is unknown. An empty table
    gives no rows. Other columns are not read. The scores are computed at once and returned as a scratch table.
    """
    with batches_of(docs.sparkSession, BATCH_BYTES):
        return _scored(docs, id_col, text_col, mu, heavy_share)


def _scored(docs: DataFrame, id_col: str, text_col: str, mu: float, heavy_share: float) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    volume = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(4, volume // SHARD_BYTES)
    # At many shards fewer tokens make a word too many for one; at most 2 / RAREST words are broadcast.
    heavy_share = max(min(heavy_share, RAREST), min(heavy_share, 1 / shards))
    routed = spark.sparkContext.broadcast(frequent_words(base, heavy_share, shards))
    merged = base.mapInArrow(partial(_count, shards=shards, routed=routed), _COUNTS).groupBy("shard").applyInArrow(_merge, _MERGED)
    merged = cut(merged, {"parquet.block.size": BATCH_BYTES})  # a row group is read as a whole
    total, distinct, starts = (x or 0 for x in merged.agg(F.sum("total"), F.sum("distinct"), F.sum("starts")).first())
    least = max(2.0, heavy_share * total)
    # No more than total / least pairs can be as frequent, and twice as many words are routed.
    heavy = merged.mapInArrow(partial(_heavy, least=least, routed=routed), "w bigint, tail bigint, n bigint, pair boolean").collect()
    shared = spark.sparkContext.broadcast(Heavy(heavy, total, distinct, starts, mu))
    asked = base.mapInArrow(partial(_ask, shards=shards, heavy=shared, routed=routed), _ASKED_TYPES)
    answers = asked.groupBy("shard").cogroup(merged.groupBy("shard")).applyInArrow(partial(_answer, total=total, distinct=distinct, heavy=shared, mu=mu), _ANSWER)
    scored = answers.groupBy("block").applyInPandas(_gather, "id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
    scored = scored.select(F.col("id").cast(kind).alias("id"), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")
    return cut(scored)  # runs here, where the size of batches is set
