"""LM scoring: a causal self-attention model over subword ids, trained in numpy inside Spark tasks, scores whole texts.

Training texts are those whose crc32 of the id (as text) modulo ``folds`` is not ``held_out``. A text is its words between
ASCII white space, A-Z lower-cased, and one end token; a word's subwords are those of a byte-level BPE vocabulary for the
word with a space before it. The vocabulary file is read where the driver runs and sent to the tasks.

1. One pass over all training texts counts words and subwords and cuts each text into windows, all of which are gathered.
   Each subword of them is a unit of its own at the model's input. Subwords get classes: the SINGLE most frequent have their
   own, the others are clustered by what they follow, apart for word starts and continuations. A second pass over all windows
   counts which subword follows each of the BUCKETS most frequent ones, and the others, as two buckets. Each different word
   teaches spelling: Spark counts the beginnings of all words and how they go on, or end. The model, of bounded size, keeps the
   shares after the AFTER_ROWS most frequent subwords and the BEGIN_ROWS most frequent longer beginnings, and the SPELLED most
   frequent beginnings; what is left out of these stays in the counts of the beginnings it goes on from. How much more general
   shares count is chosen among AFTER_WEIGHTS by the words of one more fold of training texts, which the counts leave out for it.
2. Training: all windows are dealt by hash to ROUNDS rounds and to replicas of about REPLICA subwords, as many as the corpus
   needs; each window trains once. In a round each replica's task trains a copy of the model on its windows; the copies'
   parameters are averaged, weighted by subwords, in Spark. So the model depends on the rows, not on their partitions. Windows
   at the end of a text are shorter and train as all others do.
3. Scoring: each text is scored whole in overlapping windows, each subword once: the model's class probability, which sees
   the window, times the subword's share of its class after the beginning of its word, or, at a word's start, after the bucket
   of the subword before, with absolute discounts. At most KNOWN_WORDS words, the most frequent, have their counts in the tasks;
   all others are held against the whole counts by a join, so that the unigram base is exact.

Nulls: a null text is empty and has the end token only; a null id counts as an empty text in crc32 and stays null. Repeated
rows are rows. Without training texts all counts are 0 and the base is not defined (null where N + V + 1 would be 0).
Columns other than the id and the text are left out. A very long text is cut into windows as any other, to its end.
"""

from __future__ import annotations

import base64
import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import Tables, written
from .tokens import chunks, mixed, texts

#: Learning rates of the rounds; subwords that a replica trains on, about.
LEARNING_RATES, REPLICA = (0.02, 0.005), 1 << 22
ROUNDS = len(LEARNING_RATES)
CLUSTERS, SINGLE, BUCKETS = 30, 64, 256
#: Subwords, and beginnings of words, that have their own shares of the classes after them (the most frequent); beginnings whose
#: counts the model keeps, at most.
AFTER_ROWS, BEGIN_ROWS, SPELLED = 4096, 16384, 1 << 19
#: What more general shares may count for among them; the first where the training texts can't tell.
AFTER_WEIGHTS = (16.0, 2.0, 4.0, 8.0, 32.0, 64.0)
#: What counts of followers are lessened by, and given to those that were not seen.
DISCOUNT = 0.75
#: Words whose counts are sent to the tasks, at most; words of which a task keeps the subwords.
KNOWN_WORDS, KEPT_WORDS = 1 << 17, 1 << 18
END = b"\n"  # no word has white space
#: Fixed value: the pattern that the vocabulary's words were cut by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER_SPACE = re.compile(r"[^\S ]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}


class Coder:
    """Words as numbers of a worker's table, which holds each word's subword ids; the end token is word 0."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end_id = max(ranks.values()) + 1
        self.initial = np.zeros(self.end_id, bool)
        self.initial[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {END: 0}
        self.names: list[bytes] = [END]
        self.flat, self.first, self.size = array("i", [self.end_id]), array("i", [0]), array("i", [1])

    def numbers(self, docs: list[list[bytes]]) -> np.ndarray:
        """The words' numbers, each text followed by the end token."""
        n = sum(map(len, docs)) + len(docs)
        words = list(chain.from_iterable(chain(d, (END,)) for d in docs))
        out = np.fromiter(map(self.number.get, words, repeat(-1)), np.int32, n)
        number, names, known = self.number, self.names, len(self.names)
        for i in np.flatnonzero(out < 0).tolist():
            w = words[i]
            k = out[i] = number.setdefault(w, len(names))
            if k == len(names):
                names.append(w)
        self._encode([" " + w.decode("utf-8", "replace") for w in names[known:]])
        return out

    def _encode(self, words: list[str]) -> None:
        """Adds words, which begin with their only space, to the table. They are encoded in a row: the pattern cuts before each, and
        the subword that begins with the space begins the word. A word with another white space is encoded by itself."""
        odd = [i for i, w in enumerate(words) if OTHER_SPACE.search(w)] if OTHER_SPACE.search("".join(words)) else []
        first = 0
        for end in (*odd, len(words)):
            ids = self.encoding.encode_ordinary("".join(words[first:end]))
            self._add(ids, np.flatnonzero(self.initial[np.array(ids, np.int64)]))
            if end < len(words):
                self._add(self.encoding.encode_ordinary(words[end]), np.zeros(1, np.int64))
            first = end + 1

    def _add(self, ids: list[int], starts: np.ndarray) -> None:
        self.first.extend((len(self.flat) + starts).tolist())
        self.size.extend(np.diff(starts, append=len(ids)).tolist())
        self.flat.extend(ids)

    def subwords(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(subword ids, how many of each word, where each is in the table) of words in a row."""
        flat, first, size = (np.array(x, np.int32) for x in (self.flat, self.first, self.size))
        n = size[numbers]
        before = np.cumsum(n) - n
        at = np.repeat(first[numbers] - before, n) + np.arange(int(n.sum()))
        return flat[at], n, at


_CODERS: dict[int, Coder] = {}


def worker_coder(ranks: dict[bytes, int]) -> Coder:
    """The coder that a Python worker keeps from task to task, emptied when it holds many words."""
    key = hash(frozenset(ranks.items()))
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(ranks)
    if len(_CODERS[key].names) > KEPT_WORDS:
        _CODERS[key].clear()
    return _CODERS[key]


def lower_words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def is_held_out(ids: list, folds: int, held_out: int) -> list[bool]:
    return [zlib.crc32(b"" if i is None else str(i).encode()) % folds == held_out for i in ids]


def _windows(flat: np.ndarray, ends: np.ndarray, end_id: int, seeds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(all windows of texts that lie one after the other in flat, up to ends; a random number for each, from its text's). A
    text begins after an end token; a window has FAR ids, fewer at a text's end, and the one before them."""
    far, starts = attention.FAR, np.concatenate([[0], ends[:-1]])
    begun = np.insert(flat, starts, end_id).astype(np.int32)
    n = -(-(ends - starts) // far)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    size = np.minimum(far, np.repeat(ends - starts, n) - k * far) + 1
    first = np.repeat(starts + np.arange(len(starts)), n) + k * far
    cuts = np.concatenate([[0], np.cumsum(size)])
    values = begun[np.repeat(first - cuts[:-1], size) + np.arange(cuts[-1])]
    draw = mixed(np.repeat(seeds, n) + k.astype(np.uint64)).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values)), draw


def _counted(docs: DataFrame, ranks, folds: int, held_out: int) -> DataFrame:
    """Rows (kind, word, id, n, m, window) of the training texts: counts of words, m of them in the fold after the held-out one,
    counts of subwords, and windows, whose n is a random number; what a kind has not is null."""
    kinds = {"kind": pa.string(), "word": pa.string(), "id": pa.int64(), "n": pa.int64(), "m": pa.int64(), "window": pa.list_(pa.int32())}

    def rows(kind: str, n: np.ndarray, **given: pa.Array) -> pa.RecordBatch:
        given |= {"kind": pa.array([kind] * len(n), pa.string()), "n": pa.array(n, pa.int64())}
        return pa.RecordBatch.from_arrays([given.get(c, pa.nulls(len(n), t)) for c, t in kinds.items()], names=list(kinds))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(ranks.value)
        words, ids = np.zeros((2, 0), np.int64), np.zeros(coder.end_id + 1, np.int64)

        def word_rows() -> pa.RecordBatch:
            found = np.flatnonzero(words[0])
            found = found[found > 0]
            names = pa.array([coder.names[i] for i in found.tolist()], pa.binary()).cast(pa.string())
            return rows("word", words[0, found], m=pa.array(words[1, found]), word=names)

        for batch in batches:
            own, raw = batch.column("doc_id").to_pylist(), texts(batch.column("text"))
            held, check = is_held_out(own, folds, held_out), is_held_out(own, folds, (held_out + 1) % folds)
            train = [(i, t, k) for i, t, h, k in zip(own, raw, held, check, strict=True) if not h]
            raw = [t for _, t, _ in train]
            for a, b in chunks(raw):
                docs = [lower_words(t) for t in raw[a:b]]
                numbers, sizes = coder.numbers(docs), [len(d) + 1 for d in docs]
                checks = numbers[np.repeat([k for _, _, k in train[a:b]], sizes)]
                seen = np.stack([np.bincount(x, minlength=len(coder.names)) for x in (numbers, checks)])
                seen[:, : words.shape[1]] += words
                words = seen
                flat, size, _ = coder.subwords(numbers)
                ids += np.bincount(flat, minlength=len(ids))
                ends = np.cumsum(size)[np.cumsum(sizes) - 1]
                seeds = np.array([xxhash.xxh3_64_intdigest(f"{i}:{len(t or b'')}") for i, t, _ in train[a:b]], np.uint64)
                windows, draw = _windows(flat, ends, coder.end_id, seeds)
                yield rows("window", draw, window=windows)
                if len(coder.names) > KEPT_WORDS:
                    yield word_rows()
                    words = np.zeros((2, 0), np.int64)
                    coder.clear()
        yield word_rows()
        found = np.flatnonzero(ids)
        yield rows("id", ids[found], id=pa.array(found))

    return docs.mapInArrow(count, "kind string, word string, id bigint, n bigint, m bigint, window array<int>")


class Lookup:
    """Where 64-bit hashes are in an array of different ones, in order: by their first bits, which leave a few places at most."""

    def __init__(self, table: np.ndarray):
        self.table = table
        bits = max(4, int(len(table)).bit_length() + 2)
        self.shift = np.uint64(64 - bits)
        n = np.bincount((table >> self.shift).astype(np.int64), minlength=1 << bits)
        self.most = int(n.max())
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(n, out=self.first[1:])

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are in the table, where they are)."""
        own, at = [], []
        slot = (keys >> self.shift).astype(np.int64)
        first, end = self.first[slot], self.first[slot + 1]
        open_ = np.flatnonzero(first < end)
        for k in range(self.most):
            where = first[open_] + k
            hit = self.table[where] == keys[open_]
            own.append(open_[hit])
            at.append(where[hit])
            open_ = open_[~hit & (where + 1 < end[open_])]
            if not len(open_):
                break
        return (np.concatenate(own), np.concatenate(at)) if own else (np.zeros(0, np.int64), np.zeros(0, np.int32))


@dataclass
class Classes:
    """What the counts say. unit: of each subword id; label and row: of each unit its class and its row of inner, which has the
    log share of each unit in its class, and whether it begins a word; after: log shares of the classes, whose rows from ``more`` on
    are those of the beginnings of words, hashes in order."""

    unit: np.ndarray
    label: np.ndarray
    row: np.ndarray
    after: attention.After
    inner: np.ndarray
    n_units: int
    n_classes: int
    starts: np.ndarray
    beginnings: np.ndarray
    more: int
    spelling: Spelling | None = None
    weight: float = AFTER_WEIGHTS[0]

    @cached_property
    def found(self) -> Lookup:
        return Lookup(self.beginnings)

    @cached_property
    def alone(self) -> np.ndarray:
        """Each unit's hash as the beginning of a word."""
        return mixed(np.arange(self.n_units, dtype=np.uint64) + np.uint64(1))

    def rows(self, whole: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Rows of after for beginnings of words, by their hashes, and their last units."""
        out = self.after.row[units]
        if len(self.beginnings):
            own, at = self.found(whole)
            out[own] = self.more + at
        return out

    def running(self, units: np.ndarray) -> np.ndarray:
        """Rows of after for each unit of windows; a word that began before its window goes by its last unit. A unit that begins a
        word has no longer beginning to be looked up."""
        by_place = np.ascontiguousarray(units.T)
        out, starts = self.after.row[by_place], self.starts[by_place]
        whole = np.zeros(len(units), np.uint64)
        for u, begins, rows in zip(by_place, starts, out, strict=True):
            later, first = np.flatnonzero(~begins), np.flatnonzero(begins)
            on = mixed(whole[later] * np.uint64(31) + self.alone[u[later]])
            whole[later], whole[first] = on, self.alone[u[first]]
            if len(self.beginnings):
                own, at = self.found(on)
                rows[later[own]] = self.more + at
        return np.ascontiguousarray(out.T)


def _followers(windows: DataFrame, unit, row, n_rows: int, n_units: int) -> np.ndarray:
    """How often each unit follows each row's units: rows * units sums at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_rows * n_units, np.int64)
        for batch in batches:
            at, ids = _filled(batch.column("window"))
            u = unit.value[ids]
            np.add.at(total, (row.value[u[:, :-1]] * n_units + u[:, 1:])[at[:, 1:]], 1)
        a = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(total[a])], names=["at", "n"])

    out = np.zeros(n_rows * n_units)
    found = windows.select("window").mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n_rows, n_units)


def _discounted(counts: np.ndarray, share: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shares within the labels of the columns, row by row, with absolute discounts that go by ``share``; sums by label)."""
    by = np.zeros((counts.shape[1], label.max() + 1))
    by[np.arange(len(label)), label] = 1
    n, kinds = counts @ by, (counts > 0).astype(float) @ by
    seen = n[:, label]
    return np.where(seen > 0, (np.maximum(counts - DISCOUNT, 0) + DISCOUNT * kinds[:, label] * share) / np.maximum(seen, 1), share), n


def _clusters(near: np.ndarray, weight: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means of the rows' square roots."""
    x = np.sqrt(near)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False, p=weight / weight.sum())]
    label = np.zeros(len(x), np.int64)
    for _ in range(25):
        label = (x @ centre.T).argmax(1)
        for c in range(len(centre)):
            if (own := label == c).any():
                m = (x[own] * np.sqrt(weight[own, None])).sum(0)
                centre[c] = m / max(np.linalg.norm(m), 1e-9)
    return label


@dataclass
class Spelling:
    """How the words of the training texts go on after their first subwords. begun: hashes of beginnings of two subwords or more, in
    order, and n: how many words, by counts, begin so; group and total: the same of a beginning and the next subword's class, and
    left: how much of it the discounts, and beginnings that are not kept, leave to more general shares."""

    begun: np.ndarray
    n: np.ndarray
    group: np.ndarray
    total: np.ndarray
    left: np.ndarray

    @cached_property
    def of_begun(self) -> Lookup:
        return Lookup(self.begun)

    @cached_property
    def of_group(self) -> Lookup:
        return Lookup(self.group)


def _beginnings(units: np.ndarray, first: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word's beginning up to each subword; hash of the beginning before it and its class; hash of that beginning),
    for words in a row whose first subwords are at ``first``."""
    place = np.arange(len(units)) - np.repeat(first, np.diff(first, append=len(units)))
    whole, before = mixed(units.astype(np.uint64) + np.uint64(1)), np.zeros(len(units), np.uint64)
    at = np.flatnonzero(place == 0)
    for k in range(1, int(place.max(initial=0)) + 1):
        at = at[at + 1 < len(units)] + 1
        at = at[place[at] == k]  # of the words that go on
        before[at] = whole[at - 1]
        whole[at] = mixed(before[at] * np.uint64(31) + whole[at])
    return whole, _group(before, label[units]), before


def _group(before: np.ndarray, label: np.ndarray) -> np.ndarray:
    return mixed(before + label.astype(np.uint64) * np.uint64(2) + np.uint64(1))


def _encoded(words: DataFrame, ranks) -> DataFrame:
    """Rows (ids, n, m): the subword ids of each word (word, n, m)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(ranks.value)
        for batch in batches:
            coder.clear()  # no word comes again
            flat, size, _ = coder.subwords(coder.numbers([texts(batch.column("word"))])[:-1])
            cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)), batch.column("n"), batch.column("m")], names=["ids", "n", "m"])
        coder.clear()

    return words.select("word", "n", "m").mapInArrow(encode, "ids array<int>, n bigint, m bigint")


def _begun(words: DataFrame, unit, label) -> DataFrame:
    """How all words (ids, n, m) go on, as rows (whole, before, goal, tip, n, m): for each beginning of two subwords or more its hash,
    that of the beginning before, its last subword's class and unit, and how many words, by counts, begin so; and, where whole is
    null, how many subwords of the unit tip, of those from BUCKETS up to AFTER_ROWS, have the class goal next in their word, or end
    it if goal is -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = int(label.value.max()) + 1
        on = np.zeros((2, AFTER_ROWS * (classes + 1)), np.int64)
        for batch in batches:
            ids, size = batch.column("ids"), pc.list_value_length(batch.column("ids")).to_numpy().astype(np.int64)
            units, first = unit.value[ids.flatten().to_numpy()], np.cumsum(size) - size
            n = np.repeat([batch.column(c).to_numpy() for c in ("n", "m")], size, axis=1)
            goal = label.value[np.roll(units, -1)] + 1
            goal[first + size - 1] = 0
            own = np.flatnonzero((units >= BUCKETS) & (units < AFTER_ROWS))
            for total, given in zip(on, n, strict=True):
                np.add.at(total, units[own] * (classes + 1) + goal[own], given[own])
            later = np.ones(len(units), bool)
            later[first] = False
            whole, _, before = (x[later] for x in _beginnings(units, first, label.value))
            found, one, of = np.unique(whole, return_index=True, return_inverse=True)
            tip = units[later][one]
            sums = [np.bincount(of, given[later], len(found)).astype(np.int64) for given in n]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (found.view(np.int64), before[one].view(np.int64), label.value[tip], tip, *sums)], names=names)
        at = np.flatnonzero(on[0])
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x) for x in (at % (classes + 1) - 1, at // (classes + 1), *on[:, at]))], names=names)

    names = ["whole", "before", "goal", "tip", "n", "m"]
    return words.mapInArrow(count, ", ".join(f"{c} bigint" for c in names)).groupBy(names[:4]).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _most(rows: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest ``n`` (1 or more), ``most`` at most: all from a size on, found by counts of sizes, without a sort."""
    size = F.floor(F.log2(n) * 64)
    sizes = sorted(rows.groupBy(size.alias("size")).count().collect(), reverse=True)  # 64 * 63 at most
    reach = np.cumsum([r["count"] for r in sizes]) <= most
    return rows.where(size >= sizes[int(reach.sum()) - 1]["size"]) if reach.any() else rows.where(F.lit(False))


def _columns(rows: DataFrame) -> list[np.ndarray]:
    found = rows.toArrow()
    return [c.to_numpy() for c in found.columns]


def _spelling(begun: DataFrame) -> tuple[Spelling, tuple[np.ndarray, ...]]:
    """(the spelling; the BEGIN_ROWS most frequent beginnings, as hashes in order, their last units, and the counts of their words and
    of these words by class after them, 0 being the end, as two arrays, of all and of those of the fold that is left out)."""
    begun = begun.where("whole is not null")
    kept = _most(begun, "n", SPELLED)
    whole, before, goal, tip, n, m = _columns(kept)
    whole = whole.view(np.uint64)
    order = np.argsort(whole)
    whole, before, goal, tip, n, m = (x[order] for x in (whole, before, goal, tip, n, m))
    group, of = np.unique(_group(before.view(np.uint64), goal), return_inverse=True)
    given = np.bincount(of, np.maximum(n - DISCOUNT, 0), len(group))
    sums = begun.groupBy("before", "goal").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    pairs = sums.join(kept.select("before", "goal").distinct(), ["before", "goal"], "left_semi")  # SPELLED rows at most
    b, g, total, _ = _columns(pairs)
    own = np.argsort(_group(b.view(np.uint64), g))
    total = total[own].astype(float)
    spelling = Spelling(whole, n.astype(float), group, total, np.maximum(total - given, 0))
    top = np.sort(np.lexsort((whole, -n))[:BEGIN_ROWS])
    some = begun.sparkSession.createDataFrame(pa.table({"before": whole[top].view(np.int64)}))
    after = sums.join(F.broadcast(some), "before", "left_semi")  # BEGIN_ROWS * classes at most
    b, g, *counts = _columns(after)
    return spelling, (whole[top], tip[top], np.stack([n[top], m[top]]), (np.searchsorted(whole[top], b.view(np.uint64)), g, np.stack(counts)))


def _spelled(classes: Classes, units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log share of each subword in its class after the beginning of its word, with absolute discounts that go by the share after
    the subword before; 0 for the first ones, which go by the word before."""
    s = classes.spelling
    whole, group, _ = _beginnings(units, first, classes.label)
    before = np.roll(units, 1)
    less = np.exp(classes.inner[classes.row[before], units].astype(float))

    n, total, left = np.zeros((3, len(units)))
    if len(s.begun):
        own, at = s.of_begun(whole)
        n[own] = s.n[at]
        own, at = s.of_group(group)
        total[own], left[own] = s.total[at], s.left[at]
    share = np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + left * less) / np.maximum(total, 1), less)
    share[first] = 1
    return np.log(share).astype(np.float32)


def _after(by_class: np.ndarray, whole: np.ndarray, row: np.ndarray, starts: np.ndarray, known: int, begun: DataFrame, longer: tuple) -> tuple[attention.After, int, float]:
    """(log shares of the classes; the first row of longer beginnings; what more general shares count for).

    After the units of a bucket the shares are as counted. After each further unit of the AFTER_ROWS most frequent, and after each
    beginning of the BEGIN_ROWS most frequent that are longer, they are how words go on, or, where a word ends, what begins a word
    after the bucket."""
    k = len(whole)
    table, _ = _discounted(by_class, whole / whole.sum(), np.zeros(k, np.int64))
    n = max(0, min(known, AFTER_ROWS) - BUCKETS)
    own = np.arange(BUCKETS, BUCKETS + n)
    table_row = row.copy()
    table_row[own] = len(table) + np.arange(n)
    goal, tip, *counts = _columns(begun.where("whole is null").select("goal", "tip", "n", "m"))
    units = np.zeros((2, n, k + 1))
    units[:, tip - BUCKETS, goal + 1] = counts
    hashes, tips, all_n, (at, goal, counts) = longer
    later = np.zeros((2, len(hashes), k + 1))
    later[:, at, goal + 1] = counts
    later[:, :, 0] = all_n - later.sum(2)

    def shares(counts: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Counts of classes, where that of the end is dealt to what begins words."""
        begin = table[bucket] * starts
        return counts[:, 1:] + counts[:, :1] * begin / np.maximum(begin.sum(1, keepdims=True), 1e-30)

    def mixed_in(counts: np.ndarray, less: np.ndarray, weight: float) -> np.ndarray:
        return (counts + weight * less) / (counts.sum(1, keepdims=True) + weight)

    def tables(units: np.ndarray, later: np.ndarray, weight: float) -> np.ndarray:
        rows = np.concatenate([table, mixed_in(units, table[row[own]], weight)])
        return np.concatenate([rows, mixed_in(later, rows[table_row[tips]], weight)])[len(table) :]

    units, later = (np.stack([shares(c, b) for c in x]) for x, b in ((units, row[own]), (later, row[tips])))
    check, rest = np.concatenate([units[1], later[1]]), (units[0] - units[1], later[0] - later[1])
    fits = [(check * np.log(tables(*rest, w))).sum() for w in AFTER_WEIGHTS] if check.any() and rest[0].any() else [0.0]
    weight = AFTER_WEIGHTS[int(np.argmax(fits))]
    rows = np.concatenate([table, tables(units[0], later[0], weight)])
    return attention.After(np.log(rows).astype(np.float32), table_row), len(table) + n, weight


def _classes(ids: dict[int, int], windows: DataFrame, ranks: dict[bytes, int], words: DataFrame) -> Classes:
    """words: rows (ids, n, m), the subword ids of all different words and their counts, m of them in the fold that is left out."""
    sc = windows.sparkSession.sparkContext
    size = max(ranks.values()) + 2
    end = size - 1
    counts = np.zeros(size)
    for i, n in ids.items():
        counts[i] = n
    initial = np.zeros(size, np.int64)
    for token, i in ranks.items():
        initial[i] = token[:1] == b" "
    order = np.argsort(-counts, kind="stable")
    top = order[: int((counts > 0).sum())]
    known = len(top)
    n_units = known + 2  # the last two: continuations and word starts that the training texts don't have
    unit = known + initial
    unit[top] = np.arange(known)
    starts = np.append(initial[top], [0, 1])
    row = np.where(np.arange(n_units) < min(known, BUCKETS), np.arange(n_units), BUCKETS + starts)
    follow = _followers(windows, sc.broadcast(unit), sc.broadcast(row), BUCKETS + 2, n_units)
    label = 2 * CLUSTERS + starts
    if known:
        label[:known] = 2 * _clusters(follow.T[:known], counts[top], CLUSTERS) + starts[:known]
    n_classes = 2 * CLUSTERS + 3 + SINGLE
    label[: min(known, SINGLE)] = n_classes - SINGLE + np.arange(min(known, SINGLE))
    label[unit[end]] = 2 * CLUSTERS + 2
    smooth = np.append(counts[top], [0, 0]) + 0.5
    smooth[known:] /= np.maximum(1, np.bincount(initial[counts == 0], minlength=2))  # a share for each of those subwords
    members = np.bincount(label[unit], smooth[unit], n_classes)
    whole = members + 0.5
    inner, by_class = _discounted(follow, smooth / members[label], label)
    by_class = np.pad(by_class, ((0, 0), (0, n_classes - by_class.shape[1])))
    begins = np.zeros(n_classes)
    begins[label[starts > 0]] = 1
    begins[label[unit[end]]] = 1
    tables = Tables(windows.sparkSession)
    begun = tables.written(_begun(words, sc.broadcast(unit), sc.broadcast(label)))
    spelling, longer = _spelling(begun)
    after, more, weight = _after(by_class, whole, row, begins, known, begun, longer)
    tables.drop()
    inner = np.log(inner).astype(np.float32)
    return Classes(unit, label, row, after, inner, n_units, n_classes, begins[label] > 0, longer[0], more, spelling, weight)


def _filled(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Windows as rows of FAR + 1 ids, and where they have ids; a window has a next id at least, the rest is id 0."""
    at = np.arange(attention.FAR + 1) < pc.list_value_length(windows).to_numpy()[:, None]
    ids = np.zeros(at.shape, np.int64)
    ids[at] = windows.flatten().to_numpy()
    return at, ids


def _trained(windows: DataFrame, classes: Classes, subwords: int) -> attention.Params:
    """windows: n (random), window."""
    sc = windows.sparkSession.sparkContext
    sent = sc.broadcast(replace(classes, inner=np.zeros((0, 0)), spelling=None))
    params = attention.start(classes.n_units, classes.n_classes)
    replicas = max(1, -(-subwords // (REPLICA * ROUNDS)))
    # ids of two bytes, where the vocabulary's fit, are half of what else is shuffled
    low = 1 << 15 if len(classes.unit) <= 1 << 16 else 0
    sent_as = F.transform("window", lambda i: (i - low).cast("short")).alias("window") if low else F.col("window")
    for turn, rate in enumerate(LEARNING_RATES):
        begin = sc.broadcast(attention.pack(params))

        def fit(batches: Iterator[pa.RecordBatch], begin=begin, rate=rate, low=low) -> Iterator[pa.RecordBatch]:
            c = sent.value
            learner, seen = attention.Adam(attention.unpack(begin.value, c.n_units, c.n_classes)), 0
            for batch in batches:
                at, ids = _filled(batch.column("window"))
                if len(ids):
                    u = c.unit[np.where(at, ids + low, 0)]
                    learner.train(u[:, :-1], np.where(at[:, 1:], c.label[u[:, 1:]], -1), c.after, rate, c.running(u[:, :-1]))
                    seen += int(at[:, 1:].sum())
            if seen:
                moved = attention.pack(learner.p).astype(np.float64) - begin.value
                at = np.flatnonzero(moved)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(moved[at] * seen, seen))], names=["at", "v"])

        # one partition a replica, in the order of the random numbers; one row a parameter that moved, the weights' sum at -1
        own = windows.where(F.pmod("n", F.lit(ROUNDS)) == turn).select(F.expr(f"n div {ROUNDS}").alias("n"), sent_as)
        dealt = own.repartitionById(replicas, F.pmod("n", F.lit(replicas)).cast("int")).sortWithinPartitions("n", "window")
        sums = dealt.select("window").mapInArrow(fit, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
        at, v = sums.column("at").to_numpy(), sums.column("v").to_numpy()
        flat = attention.pack(params).astype(np.float64)
        if len(at):
            flat[at[at >= 0]] += v[at >= 0] / v[at < 0].sum()
        params = attention.unpack(flat, classes.n_units, classes.n_classes)
    return params


@dataclass
class Model:
    classes: Classes
    params: attention.Params

    def spelled(self, coder: Coder, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(log shares of the coder's table of subwords, rows after them): ``known``, as they were, and those of newer words."""
        n, c = len(known[0]), self.classes
        first = np.array(coder.first, np.int64)
        first = first[np.searchsorted(first, n) :] - n
        if not len(first):
            return known
        units = c.unit[np.array(coder.flat, np.int64)[n:]]
        new = _spelled(c, units, first), c.rows(_beginnings(units, first, c.label)[0], units).astype(np.int32)
        return tuple(np.concatenate(x) for x in zip(known, new, strict=True))

    def log10(self, ids: np.ndarray, doc: np.ndarray, n_docs: int, begins: np.ndarray, spelled: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each of n_docs texts, whose subword ids lie one after the other, each with its end. begins: where
        words do; spelled: log share of each subword that begins none; rows: the rows of the shares after each subword."""
        c = self.classes
        current = np.concatenate([[len(c.unit) - 1], ids[:-1]])
        before, units = c.unit[current], c.unit[ids]
        natural = attention.score(self.params, before, c.label[units], doc, c.after, np.concatenate([c.after.row[before[:1]], rows[:-1]])) + spelled
        natural[begins] += c.inner[c.row[before[begins]], units[begins]]
        return np.bincount(doc, natural, n_docs) / np.log(10)


@dataclass
class Fit:
    """A model and what it was fitted on: counts of all words (word, n, m), of end tokens, of tokens and of different ones."""

    tables: Tables
    ranks: dict[bytes, int]
    folds: int
    held_out: int
    words: DataFrame
    ends: int
    n_train: int
    v_train: int
    model: Model


def fit(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> Fit:
    """The model of the training texts; its tables stay until its ``tables`` are dropped."""
    sc = docs.sparkSession.sparkContext
    table = read_ranks(vocabulary)
    ranks = sc.broadcast(table)
    t, own = Tables(docs.sparkSession), Tables(docs.sparkSession)
    gathered = own.written(_counted(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), ranks, folds, held_out))
    words = t.written(gathered.where("kind = 'word'").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    subwords = {r["id"]: r["n"] for r in gathered.where("kind = 'id'").groupBy("id").agg(F.sum("n").alias("n")).collect()}  # the vocabulary's size at most
    ends = subwords.get(max(table.values()) + 1, 0)
    distinct, running = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    windows = gathered.where("kind = 'window'").select("n", "window")
    classes = _classes(subwords, windows, table, own.written(_encoded(words, ranks)))  # written, so that a task has one Python worker
    params = _trained(windows, classes, sum(subwords.values()))
    own.drop()  # the windows, which scoring doesn't read
    return Fit(t, table, folds, held_out, words, ends, running + ends, distinct + (1 if ends else 0), Model(classes, params))


def score_documents(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", folds: int = 7, held_out: int = 2) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all rows, by the model fitted on them."""
    fitted = fit(docs, vocabulary, doc_id, text, folds, held_out)
    scored = score_by(docs, fitted, doc_id, text)
    fitted.tables.drop()
    return scored


def score_by(docs: DataFrame, fitted: Fit, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of score_documents by a model that is fitted already; they are written."""
    sc, folds, held_out = docs.sparkSession.sparkContext, fitted.folds, fitted.held_out
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    t = Tables(docs.sparkSession)
    ranks, model = sc.broadcast(fitted.ranks), sc.broadcast(fitted.model)
    top = _most(fitted.words, "n", KNOWN_WORDS).select("word", "n").toArrow()
    counts = dict(zip(top.column("word").cast(pa.large_binary()).to_pylist(), top.column("n").to_pylist(), strict=True))
    known = sc.broadcast(counts | {END: fitted.ends})

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counts, row = worker_coder(ranks.value), known.value, TaskContext.get().partitionId() << 40
        value, spelled = np.zeros(0), (np.zeros(0, np.float32), np.zeros(0, np.int32))
        for batch in batches:
            raw, ids = texts(batch.column("text")), batch.column("doc_id")
            held = is_held_out(ids.to_pylist(), folds, held_out)
            for a, b in chunks(raw):
                if len(coder.names) > KEPT_WORDS:
                    coder.clear()
                    value, spelled = np.zeros(0), (np.zeros(0, np.float32), np.zeros(0, np.int32))
                own = [lower_words(t) for t in raw[a:b]]
                numbers = coder.numbers(own)
                value = np.concatenate([value, np.array([counts.get(w, -1) for w in coder.names[len(value) :]], np.float64)])
                size = np.array([len(d) + 1 for d in own])
                word_doc = np.repeat(np.arange(b - a), size)
                c = value[numbers]
                rare = np.flatnonzero(c < 0)
                base = np.bincount(word_doc, np.where(c < 0, 0, np.log10(np.maximum(c, 0) + 1)), b - a)
                n_known = np.bincount(word_doc[c > 0], minlength=b - a)
                flat, n, at = coder.subwords(numbers)
                spelled = model.value.spelled(coder, spelled)
                s = model.value.log10(flat, np.repeat(word_doc, n), b - a, np.cumsum(n) - n, *(x[at] for x in spelled))
                found = pa.array([coder.names[i] for i in numbers[rare].tolist()], pa.binary()).cast(pa.string())
                cuts = np.concatenate([[0], np.cumsum(np.bincount(word_doc[rare], minlength=b - a))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + b - a)), ids.slice(a, b - a), pa.array(held[a:b]), pa.array(size), pa.array(n_known), pa.array(base), pa.array(s), pa.ListArray.from_arrays(pa.array(cuts), found)],
                    names=["row", "doc_id", "held_out", "n_tokens", "n_top", "base_top", "score", "rare"],
                )
                row += b - a

    schema = f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, n_tokens bigint, n_top bigint, base_top double, score double, rare array<string>"
    scored = t.written(docs.mapInArrow(score, schema))
    rest = scored.select("row", F.explode("rare").alias("word")).join(fitted.words, "word", "left")
    rest = rest.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("base_rare"), F.count("n").alias("n_rare"))
    total = fitted.n_train + fitted.v_train + 1
    result = written(
        scored.drop("rare")
        .join(rest, "row", "left")
        .select(
            F.col("doc_id").alias(doc_id),
            "held_out",
            "n_tokens",
            (F.col("n_top") + F.coalesce("n_rare", F.lit(0))).alias("n_known"),
            F.lit(fitted.n_train).cast("bigint").alias("train_tokens"),
            (F.col("base_top") + F.coalesce("base_rare", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total)))).alias("base_score"),
            "score",
        )
    )
    t.drop()
    return result
