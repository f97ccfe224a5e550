"""Benchmark decontamination: Wu-Manber multi-pattern search for word windows of benchmark items in documents.

Patterns are windows of ``window`` consecutive item words; an item of fewer words is one window. Patterns of one length
make a matcher: its shift table tells, for the block of the last words before a position, how far the search may move on
since no pattern ends sooner; where the shift is 0, the block's hash picks the patterns that end with it, and comparing
all words confirms. A task searches many texts at once: their words lie in one flat array, cut into lanes that move on
independently, so each step is a few numpy operations. Words of no pattern are 0, which no pattern has; a 0 also stands
between texts.

The items are sent to the tasks, in blocks of at most BLOCK_CHARS characters: a larger benchmark takes as many passes, each
adding to the spans and items found so far. A worker makes the tables of a block once, as arrays that take about 15 times the
characters, and keeps them from task to task.

Nulls: a null text has no words; a null item id counts as an empty id. Repeated items count once by their id. Empty tables
give no hits. Documents are rows: repeated ones are searched alike. No task holds more than a batch of documents.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import chunks, letter_words, texts

#: Characters of benchmark items whose patterns are sent to the tasks at once.
BLOCK_CHARS = 16_000_000
FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.StringType()))])
FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.string()))])
#: Words that one lane of the search covers.
LANE = 2048


class Matcher:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, patterns: np.ndarray):
        self.patterns, (n, self.m) = patterns, patterns.shape
        self.block = min(2, self.m)
        self.mask = (1 << max(12, int(n * self.m).bit_length() + 1)) - 1
        far = self.m - self.block + 1
        self.shift = np.full(self.mask + 1, far, np.int16)
        for end in range(self.block - 1, self.m):  # the last ends shift least and come last
            self.shift[self.hash(patterns, end)] = self.m - 1 - end
        suffix = self.hash(patterns, self.m - 1)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.order, self.suffix = patterns[order], order.astype(np.int32), suffix[order]

    def hash(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self._hash(rows[:, end], rows[:, end - 1] if self.block == 2 else None)

    def _hash(self, last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        h = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if before is not None:
            h += before.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        return ((h >> np.uint64(29)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, pattern numbers) of all occurrences in a flat array of word ids."""
        at = np.arange(self.m - 1, len(ids), LANE)
        stop = np.minimum(at + LANE, len(ids))
        ends, hashes = [], []
        while len(at):
            h = self._hash(ids[at], ids[at - 1] if self.block == 2 else None)
            step = self.shift[h]
            zero = step == 0
            if zero.any():
                ends.append(at[zero])
                hashes.append(h[zero])
            at = at + np.maximum(step, 1)
            go = at < stop
            if not go.all():
                at, stop = at[go], stop[go]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end, h = np.concatenate(ends), np.concatenate(hashes)
        low, high = np.searchsorted(self.suffix, h, "left"), np.searchsorted(self.suffix, h, "right")
        got_end, got = [], []
        for k in range(int((high - low).max(initial=0))):  # the k-th pattern of each bucket, confirmed word by word
            more = low + k < high
            e, p = end[more], low[more] + k
            for back in range(self.m):
                same = ids[e - back] == self.patterns[p, self.m - 1 - back]
                e, p = e[same], p[same]
            got_end.append(e)
            got.append(self.order[p])
        return np.concatenate(got_end), np.concatenate(got)


class Searcher:
    """The matchers of a set of items, by length of pattern, and the items of each pattern."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        size = np.fromiter((len(words) for _, words in items), np.int64, len(items))
        put = self.vocabulary.setdefault
        ids = np.fromiter((put(w, len(self.vocabulary) + 1) for _, words in items for w in words), np.int32, int(size.sum()))
        first = np.cumsum(size) - size
        self.matchers = []
        for m in np.unique(np.minimum(size, window)).tolist():
            own = np.flatnonzero(np.minimum(size, window) == m)
            if not m:
                continue
            n = size[own] - m + 1
            item = np.repeat(own, n)
            at = np.arange(len(item)) + np.repeat(first[own] - (np.cumsum(n) - n), n)
            rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(ids, m)[at])
            _, one, number = np.unique(rows.view(np.dtype((np.void, 4 * m))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(number.astype(np.int64) * len(items) + item)  # (pattern, item)
            starts = np.searchsorted(pairs // len(items), np.arange(len(one) + 1))
            self.matchers.append((Matcher(rows[one]), starts, (pairs % len(items)).astype(np.int32)))

    def search(self, docs: list[list[bytes]]) -> list[tuple[int, list[list[int]], set[str]]]:
        """(words, merged spans of hit words, items) of each document."""
        sizes = np.fromiter(map(len, docs), np.int64, len(docs))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        ids = np.fromiter(map(self.vocabulary.get, chain.from_iterable(chain(d, (b"",)) for d in docs), repeat(0)), np.int64, int(starts[-1]))
        edge = np.zeros(len(ids) + 1, np.int32)
        items: dict[int, set[str]] = defaultdict(set)
        for matcher, begin, owners in self.matchers:
            end, pattern = matcher.find(ids)
            np.add.at(edge, end - matcher.m + 1, 1)
            np.add.at(edge, end + 1, -1)
            doc = np.searchsorted(starts, end, "right") - 1
            for d, p in set(zip(doc.tolist(), pattern.tolist(), strict=True)):
                items[d].update(self.names[i] for i in owners[begin[p] : begin[p + 1]].tolist())
        hit = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
        first, last = np.flatnonzero(hit == 1), np.flatnonzero(hit == -1)
        spans: dict[int, list[list[int]]] = defaultdict(list)
        for a, b, d in zip(first.tolist(), last.tolist(), (np.searchsorted(starts, first, "right") - 1).tolist(), strict=True):
            spans[d].append([a - int(starts[d]), b - int(starts[d])])
        return [(n, spans.get(d, []), items.get(d, set())) for d, n in enumerate(sizes.tolist())]


_SEARCHERS: dict[str, Searcher] = {}


def worker_searcher(key: str, items: list[tuple[str, bytes]], window: int) -> Searcher:
    """The searcher of a block, which a Python worker makes once; the one before goes."""
    if key not in _SEARCHERS:
        _SEARCHERS.clear()
        _SEARCHERS[key] = Searcher([(i, letter_words(t)) for i, t in items], window)
    return _SEARCHERS[key]


def merged(a: Iterable[list[int]], b: Iterable[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted([*a, *b]):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows (default: all) with found (a column of that name is replaced): n_words, spans of hit words [from, to), items (sorted as strings)."""
    spark = docs.sparkSession
    kept = [c for c in (columns or docs.columns) if c != "found"]
    item = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.col(item_text).alias("text")).where(F.length("text") > 0)
    blocks = 1 + int(item.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    before = docs.select(*kept, F.col(text).alias("__text"))
    for block in range(blocks):
        rows = item.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # bounded by BLOCK_CHARS
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r["id"], r["text"].encode()) for r in rows]))
        earlier = [*before.columns]

        def search(batches: Iterator[pa.RecordBatch], sent=sent, earlier=earlier) -> Iterator[pa.RecordBatch]:
            searcher = worker_searcher(*sent.value, window)
            for batch in batches:
                raw, found = texts(batch.column("__text")), []
                for a, b in chunks(raw):
                    found += searcher.search([letter_words(t) for t in raw[a:b]])
                old = batch.column("found").to_pylist() if "found" in earlier else repeat({"spans": [], "items": []})
                rows = [{"n_words": n, "spans": merged(o["spans"], s), "items": sorted({*o["items"], *i})} for (n, s, i), o in zip(found, old)]
                own = [c for c in earlier if c != "found"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(rows, FOUND_ARROW)], names=[*own, "found"])

        schema = T.StructType([*(f for f in before.schema if f.name != "found"), T.StructField("found", FOUND)])
        before = before.mapInArrow(search, schema)
        if block < blocks - 1:
            before = written(before)
    return before.drop("__text")


def n_hit() -> Column:
    return F.aggregate("found.spans", F.lit(0).cast("bigint"), lambda n, s: n + F.get(s, F.lit(1)) - F.get(s, F.lit(0)))
