"""Benchmark decontamination with suffix arrays over the training texts.

Executors cut the documents into shards of a few megabytes and sort the word suffixes of each
shard (prefix doubling over word hashes). ``find``, which the query and the pipeline use, looks
up the first suffix of each distinct window of the benchmark in every shard by binary search:
the range of suffixes that share the window gives all its places, whose words are then compared
as text, not by hash alone. It doesn't look up the other suffixes and gives no longest matches;
``longest_matches``, which no query uses, looks up every suffix and gives its longest verbatim
match with one place. Words are runs of ASCII letters, digits and all non-ASCII characters, A-Z
lower-cased; a window is ``width`` consecutive words of an item, or all of a shorter item.

The benchmark is a query set: it is read in blocks of a bounded size, one pass over the
documents for each block; what earlier blocks hit travels with the rows, so nothing is
shuffled. Null and wordless texts have no words, no windows and no hits. Repeated documents
get equal results, repeated items count once by id, items with a null id hit words but have
no id to list. Documents may have any extra columns; only named ones are read or kept.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .shared import by_bytes, in_batches, masked, per_worker, unmasked, whole

BLOCK_BYTES = 16 << 20
SHARD_BYTES = 2 << 20
PIECE_BYTES = 1 << 17
_MASK = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_STEP, -1, 1 << 64)
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out)


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, end, hash) of the words in UTF-8 text."""
    a = _FOLD[np.frombuffer(raw, np.uint8)]
    edge = np.diff(np.concatenate(([False], _IN_WORD[a], [False])).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A word's hash is a sum of powers times bytes; sums up to each place give it at once. A piece
    # of the text at a time: sums and powers take 32 times the bytes they are made of.
    h, lo = np.empty(len(start), np.uint64), 0
    while lo < len(start):
        first = start[lo]
        hi = max(lo + 1, int(np.searchsorted(end, first + PIECE_BYTES, "right")))
        piece = a[first:end[hi - 1]]
        upto = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * _powers(_STEP, len(piece)), out=upto[1:])
        h[lo:hi] = ((upto[end[lo:hi] - first] - upto[start[lo:hi] - first])
                    * _powers(_INVERSE, len(piece) + 1)[start[lo:hi] - first])
        lo = hi
    h ^= h >> np.uint64(29)
    return a, start, end, h * np.uint64(0xBF58476D1CE4E5B9)


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of ``ids`` in order of their first ``depth`` ids at least.

    Each round sorts by pairs of the ranks so far, which doubles the length compared.
    """
    order = np.argsort(ids, kind="stable")
    rank = np.empty(len(ids), np.int64)
    ranked = ids[order]
    rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
    length = 1
    while length < depth and rank.max(initial=0) < len(ids):
        later = np.zeros(len(ids), np.int64)
        later[:-length] = rank[length:]
        pair = rank * np.int64(len(ids) + 1) + later
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        rank[order] = np.cumsum(np.concatenate(([1], ranked[1:] != ranked[:-1])))
        length *= 2
    return order


class Block:
    """A block of the benchmark: all its suffixes and its windows."""

    def __init__(self, items: list[tuple], width: int):
        raw, ids, at, windows = [], [], 0, defaultdict(set)
        self.item_ids = [i for i, _ in items]
        length = []
        for n, (_, text) in enumerate(items):
            raw.append((text or "").encode("utf-8", "replace"))
        for n, r in enumerate(raw):
            _, _, _, h = words_of(r)
            ids.append(h)
            size = min(width, len(h))
            for k in range(len(h) - size + 1 if size else 0):
                windows[tuple(h[k:k + size].tolist())].add(n)
            length.append(np.arange(len(h), 0, -1))
        self.text = [_WORD.findall(r.lower()) for r in raw]
        self.hashes = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
        self.left = np.concatenate(length) if ids else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(raw)), [len(x) for x in ids])
        self.place = np.concatenate([np.arange(len(x)) for x in ids]) if ids else self.left
        # Of each window: the first suffix that begins with it, and the items that hold it.
        first, holders = {}, {}
        for k in range(len(self.hashes)):
            size = min(width, len(ids[self.owner[k]]))
            if self.left[k] >= size:
                w = tuple(self.hashes[k:k + size].tolist())
                if w not in first:
                    first[w], holders[w] = k, sorted(windows[w])
        self.window = np.array(list(first.values()), np.int64)
        self.size = np.array([len(w) for w in first], np.int64)
        self.holders = list(holders.values())

    def words(self, suffix: int, size: int) -> list[bytes]:
        k = self.place[suffix]
        return self.text[self.owner[suffix]][k:k + size]


def _below(shard: np.ndarray, order: np.ndarray, pattern: np.ndarray, start: np.ndarray,
           size: np.ndarray, or_equal: bool) -> np.ndarray:
    """For every pattern pattern[start:start+size]: how many suffixes come before it
    (with ``or_equal``: begin with it or come before it). All searches step together."""
    lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(order), np.int64)
    deepest = int(size.max(initial=0))
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        at, before, open_ = order[mid], np.full(len(live), or_equal), np.arange(len(live))
        for k in range(deepest):
            open_ = open_[size[live[open_]] > k]
            if not open_.size:
                break
            p, s = pattern[start[live[open_]] + k], np.minimum(at[open_] + k, len(shard) - 1)
            inside = at[open_] + k < len(shard)
            differ = ~inside | (shard[s] != p)
            before[open_[differ]] = (~inside | (shard[s] < p))[differ]
            open_ = open_[~differ]
        lo[live] = np.where(before, mid + 1, lo[live])
        hi[live] = np.where(before, hi[live], mid)
    return lo


class Shard:
    """A few documents' words in one array, a mark that matches nothing after each document."""

    def __init__(self, raws: list[bytes], width: int):
        self.folded, self.begin, self.end, hashes, doc = [], [], [], [], []
        # Words never run over the newline put between documents.
        a, start, end, h = words_of(b"\n".join(raws))
        self.bytes = a.tobytes()
        offsets = np.cumsum([0, *(len(r) + 1 for r in raws)])
        owner = np.searchsorted(offsets, start, "right") - 1
        self.counts = np.bincount(owner, minlength=len(raws))
        shift = owner + np.arange(len(start))       # one mark after each document
        self.first = np.concatenate(([0], np.cumsum(self.counts + 1)))
        n = len(start) + len(raws)
        self.hashes = np.zeros(n, np.uint64)
        self.hashes[shift] = h
        marks = self.first[1:] - 1
        self.hashes[marks] = np.arange(1, len(raws) + 1, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(raws)), self.counts + 1)
        self.at = np.full(n, -1)
        self.at[shift] = np.arange(len(start))
        self.start, self.stop = start, end
        self.order = suffix_order(self.hashes, width)

    def words(self, place: int, size: int) -> list[bytes]:
        return [self.bytes[self.start[i]:self.stop[i]]
                for i in self.at[place:place + size].tolist() if i >= 0]

    def hits(self, block: Block) -> dict[int, tuple[list, set]]:
        """document -> ([(first word, words)], items) of the windows of a block."""
        out: dict[int, tuple[list, set]] = {}
        if not len(block.window) or not len(self.order):
            return out
        args = (self.hashes, self.order, block.hashes, block.window, block.size)
        lo, hi = _below(*args, False), _below(*args, True)
        for w in np.flatnonzero(hi > lo):
            size, items = int(block.size[w]), block.holders[w]
            want = block.words(block.window[w], size)
            for place in self.order[lo[w]:hi[w]].tolist():
                if self.words(place, size) != want:
                    continue
                d = int(self.owner[place])
                spans, found = out.setdefault(d, ([], set()))
                spans.append((place - int(self.first[d]), size))
                found.update(items)
        return out

    def longest(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest match in the shard of every suffix of a block."""
        n = len(block.hashes)
        best, where = np.zeros(n, np.int64), np.full(n, -1)
        if not n or not len(self.order):
            return best, where
        all_ = np.arange(n)
        cut = _below(self.hashes, self.order, block.hashes, all_, block.left, False)
        for side in (cut - 1, cut):
            ok = (side >= 0) & (side < len(self.order))
            at = self.order[np.clip(side, 0, len(self.order) - 1)]
            size, open_ = np.zeros(n, np.int64), np.flatnonzero(ok)
            while open_.size:
                k = size[open_]
                inside = (k < block.left[open_]) & (at[open_] + k < len(self.hashes))
                open_, k = open_[inside], k[inside]
                same = self.hashes[at[open_] + k] == block.hashes[open_ + k]
                open_ = open_[same]
                size[open_] += 1
            better = size > best
            best[better], where[better] = size[better], at[better]
        return best, where


def _blocks(benchmark: DataFrame, text: str, key: str, block_bytes: int):
    """The items in blocks of about ``block_bytes``: numbers by Spark, one block at a time
    to the driver, whose size is what bounds it."""
    size = F.octet_length(whole(F.col(text))) + 64
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    mine = benchmark.select(F.col(key).alias("i"), F.col(text).alias("t"))
    for k in range(n):
        here = mine if n == 1 else mine.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in here.distinct().collect()]


def _shared(sc, items: list[tuple], width: int):
    """A block of bounded size for the tasks; a worker indexes it once."""
    sent, name = sc.broadcast(items), uuid.uuid4().hex
    return lambda: per_worker(("block", name), lambda: Block(sent.value, width))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted (first, after) without overlap, of (first, words)."""
    out: list[tuple[int, int]] = []
    for first, size in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + size))
        else:
            out.append((first, first + size))
    return out


def find(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text",
         key: str = "doc_id", item: str = "item_id", item_text: str = "text",
         keep: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per document: ``key``, ``keep`` columns, n_words, n_hit, hits (array of first word and
    word after the last, merged) and items (array of the ids found there, as strings)."""
    carry = [key, *keep]
    sc = docs.sparkSession.sparkContext
    state = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carry)),
                        whole(F.col(text)).alias("text"), F.lit(0).cast("long").alias("n_words"),
                        F.expr("cast(array() as array<struct<first:bigint,after:bigint>>)")
                        .alias("hits"),
                        F.expr("cast(array() as array<string>)").alias("items"))
    schema, done = state.schema, 0

    def search(shared):
        def run(batches):
            block = shared()
            for b in by_bytes(batches, "text", shard_bytes):
                texts = [t.encode("utf-8", "replace") for t in b.column("text").to_pylist()]
                shard = Shard(texts, width)
                hits, items = b.column("hits").to_pylist(), b.column("items").to_pylist()
                for d, (spans, found) in shard.hits(block).items():
                    old = [(h["first"], h["after"] - h["first"]) for h in hits[d]]
                    hits[d] = [{"first": x, "after": y} for x, y in _merged(old + spans)]
                    named = {str(block.item_ids[n]) for n in found
                             if block.item_ids[n] is not None}
                    items[d] = sorted(named | set(items[d]))
                names = b.schema.names
                cols = {n: b.column(n) for n in names} | {
                    "n_words": pa.array(shard.counts.tolist(), pa.int64()),
                    "hits": pa.array(hits, b.schema.field("hits").type),
                    "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)
        return run

    for items in _blocks(benchmark, item_text, item, block_bytes):
        if done:
            state = stored(state, "decontaminate")
        state = in_batches(state, search(_shared(sc, items, width)), schema)
        done += 1
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["after"] - h["first"])
    return state.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carry)),
                        "n_words", n_hit.alias("n_hit"), "hits", "items")


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 2, text: str = "text",
                    key: str = "doc_id", item: str = "item_id", item_text: str = "text",
                    block_bytes: int = BLOCK_BYTES,
                    shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The longest verbatim match of every benchmark suffix over all shards, with its place:
    (item, item_word, words, key, doc_word), suffixes of ``least`` matched words or more."""
    sc = docs.sparkSession.sparkContext
    asked = docs.select(F.col(key).alias("key"), whole(F.col(text)).alias("text"))
    key_kind, item_kind = docs.schema[key].dataType, benchmark.schema[item].dataType
    out = None

    def search(shared):
        def run(batches):
            block = shared()
            for b in by_bytes(batches, "text", shard_bytes):
                shard = Shard([t.encode("utf-8", "replace")
                               for t in b.column("text").to_pylist()], 1 << 30)
                size, place = shard.longest(block)
                at = np.flatnonzero(size >= least)
                own = shard.owner[place[at]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.item_ids[n] for n in block.owner[at]], item_type),
                     pa.array(block.place[at], pa.int64()), pa.array(size[at], pa.int64()),
                     b.column("key").take(pa.array(own, pa.int64())),
                     pa.array(place[at] - shard.first[own], pa.int64())],
                    ["item", "item_word", "words", "key", "doc_word"])
        from pyspark.sql.pandas.types import to_arrow_type
        item_type = to_arrow_type(item_kind)
        return run

    for items in _blocks(benchmark, item_text, item, block_bytes):
        one = asked.mapInArrow(
            search(_shared(sc, items, 1)),
            f"item {item_kind.simpleString()}, item_word long, words long, "
            f"key {key_kind.simpleString()}, doc_word long")
        out = one if out is None else out.unionByName(one)
    best = F.max(F.struct("words", (-F.col("doc_word")).alias("w"), "key")).alias("b")
    return (out.groupBy("item", "item_word").agg(best)
            .select(F.col("item").alias(item), "item_word", F.col("b.words").alias("words"),
                    F.col("b.key").alias(key), (-F.col("b.w")).alias("doc_word")))


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, text: str = "text",
          key: str = "doc_id") -> DataFrame:
    """The documents without those that hold a window, with all their columns."""
    named, at = masked(docs)
    found = find(named, benchmark, width, at[text], at[key],
                 keep=tuple(k for c, k in at.items() if c != key))
    return unmasked(found.filter("n_hit = 0"), at)
