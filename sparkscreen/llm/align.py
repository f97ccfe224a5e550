"""Cross-tokenizer alignment: which tokens of one vocabulary cover the same bytes as which tokens of another.

Each text is encoded by a byte-level BPE (A, with a space put before the text) and by a sentencepiece model (B, which puts
that space itself). A token of A and one of B are linked where their byte ranges overlap. Union-find over this bipartite graph
unites the ends of every link: of the two tokens the one that starts later is hung under the other, which happens to each
token once at most, so the links make a forest whose trees, found by pointer jumping, are the minimal groups of tokens that
cover the same bytes. The links of all groups are counted corpus-wide by pair of ids.

Encoded texts are written once, as packed ids, to the shared folder, and with them what each task has counted of each pair. These
counts are summed by pair; a second pass over the ids sums them over each text's links. Pairs that make up a share of 1 / FREQUENT of all links or more, of which there
are FREQUENT at most, are sent to the tasks (all pairs, if they are no more than that); the rest, none of them hot, are joined.

Texts that are null, empty, or not given back byte for byte by both tokenizers have no tokens: zeros and no groups. Texts
are cut into parts at the spaces between characters that are no white space: where no piece of B has a space after another
character, and A splits texts the byte-level way, no token lies across such a place, so a part gets the ids that it has in
its text. A worker keeps the ids of up to KEPT characters of parts. Other tokenizers encode texts whole. Repeated rows are rows of their own and count each. Input
columns named like the results are replaced, all others kept or those of ``columns``. An empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables
from .tokens import texts

#: Most id pairs that are sent to the tasks, 17 bytes each.
FREQUENT = 1 << 21
#: Tokens whose graph a task holds at once, more where one text has more: some 200 bytes each.
TOKENS = 500_000
#: Most characters of parts whose ids a worker keeps, and those that are encoded at once unless one part is longer.
KEPT, AT_ONCE = 2_000_000, 100_000
#: Most id pairs whose counts a task holds before it hands them on.
COUNTED = 500_000
#: Bytes of texts that are taken apart at once, more where one text has more.
BYTES = 1_000_000
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
PLACE = re.compile(r"(?<=\S) (?=\S)")
#: Where one of these is in a text, a space may stand beside other white space.
ODD_SPACE = ("  ", " \n", "\n ", *(c for i in range(0x3001) if (c := chr(i)).isspace() and c not in " \n"))


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, the others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*own}))}


def parts(text: str) -> list[str]:
    """The text's parts, between which a space is left out that stands between characters that are no white space."""
    return PLACE.split(text) if text[:1] == " " or text[-1:] == " " or any(c in text for c in ODD_SPACE) else text.split(" ")


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of a flat array one after another."""
    return flat[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]


class Kept:
    """Ids of parts by one tokenizer, in a flat array that grows."""

    def __init__(self):
        self.flat, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, rows: list[list[int]], sizes: np.ndarray) -> np.ndarray:
        """Keeps the rows; returns how many bytes the tokens of each have."""
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        new = np.array([*chain.from_iterable(rows)], np.int32)
        to = np.cumsum(size)
        self.start = np.concatenate([self.start, len(self.flat) + to - size])
        self.flat, self.size = np.concatenate([self.flat, new]), np.concatenate([self.size, size])
        return np.diff(np.concatenate([[0], np.cumsum(sizes[new])])[to], prepend=0)


class Pair:
    """The two tokenizers and the bytes of their tokens."""

    def __init__(self, a: bytes, b: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_str(a.decode()), sentencepiece.SentencePieceProcessor(model_proto=b)
        self.a.encode_special_tokens = True  # their strings are ordinary text
        alphabet, spec = byte_alphabet(), json.loads(a)
        names = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        as_bytes = lambda t: bytes(map(alphabet.get, t)) if alphabet.keys() >= {*t} else t.encode()
        self.bytes_a = [as_bytes(names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        split = spec.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(re.search("[^▁]▁", p) for p in pieces)
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.names = [f"{i}{end}" for end in (",", "|", ";", "") for i in range(n)]  # ids as they are written before each separator
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.kept_a, self.kept_b, self.same, self.chars = Kept(), Kept(), np.zeros(0, bool), 0

    def learn(self, new: list[str]) -> None:
        """Encodes parts that are not known yet."""
        for x, y in ranges(map(len, new), AT_ONCE):
            some = new[x:y]
            a = [e.ids for e in self.a.encode_batch_fast([f" {p}" for p in some], add_special_tokens=False)]
            b = self.b.encode(some, num_threads=1)
            want = [f" {p}".encode() for p in some]
            size = np.fromiter(map(len, want), np.int64, len(want))
            same = (self.kept_a.add(a, self.size_a) == size) & (self.kept_b.add(b, self.size_b) == size)
            whole, spelled = b"".join(want), lambda rows, data: b"".join(map(data.__getitem__, chain.from_iterable(rows)))
            if not (same.all() and spelled(a, self.bytes_a) == whole == spelled(b, self.bytes_b)):  # then which ones differ
                same = np.array([spelled([i], self.bytes_a) == w == spelled([j], self.bytes_b) for w, i, j in zip(want, a, b, strict=True)])
            self.number.update(zip(some, range(len(self.number), len(self.number) + len(some)), strict=True))
            self.same, self.chars = np.concatenate([self.same, same]), self.chars + sum(map(len, some))

    def encode(self, rows: list[bytes | None]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(flat ids, how many each text has) by A and by B; none where one does not give back the text's bytes."""
        if self.chars > KEPT:
            self.forget()
        given = [(row or b"").decode(errors="replace") for row in rows]
        split = [(parts(t) if self.cuts else [t]) if t else [] for t in given]
        flat = [*chain.from_iterable(split)]
        self.learn([*dict.fromkeys(p for p in flat if p not in self.number)])
        at = np.fromiter(map(self.number.__getitem__, flat), np.int64, len(flat))
        n = np.fromiter(map(len, split), np.int64, len(split))
        wrong = np.diff(np.concatenate([[0], np.cumsum(~self.same[at])])[np.cumsum(n)], prepend=0) > 0
        wrong |= ["\ufffd" in t and t.encode() != row for t, row in zip(given, rows, strict=True)]  # bytes that are no UTF-8
        at, to = at[np.repeat(~wrong, n)], np.cumsum(np.where(wrong, 0, n))
        of = lambda kept: (gathered(kept.flat, kept.start[at], kept.size[at]), np.diff(np.concatenate([[0], np.cumsum(kept.size[at])])[to], prepend=0))
        return of(self.kept_a), of(self.kept_b)


def ranges(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of what has these sizes, of about ``most`` each."""
    start = total = end = 0
    for end, size in enumerate(sizes, 1):
        total += size
        if total >= most:
            yield start, end
            start, total = end, 0
    if start < end:
        yield start, end


def find(parent: np.ndarray) -> np.ndarray:
    """The root of each node of a forest, by pointer jumping: each round halves the paths."""
    while not np.array_equal(further := parent[parent], parent):
        parent = further
    return parent


class Graph:
    """The overlap graph of many texts' tokens; a and b: flat ids, n_a and n_b: how many each text has."""

    def __init__(self, pair: Pair, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray):
        self.pair, self.a, self.b, self.n_a, self.n_b, self.n = pair, a, b, n_a, n_b, n_a + n_b
        end_a, end_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")  # two runs, which a stable sort merges
        ends = ends[np.diff(ends, prepend=0) > 0]  # at each end one link's shared bytes end
        self.link_a, self.link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        last = np.concatenate([[0], end_a])[np.cumsum(n_a)]  # where each text ends
        self.links_to = np.searchsorted(ends, last, "right")
        start_a, start_b = end_a - pair.size_a[a], end_b - pair.size_b[b]
        later = start_a[self.link_a] > start_b[self.link_b]
        node_a, node_b = self.link_a, self.link_b + len(a)
        parent = np.arange(len(a) + len(b))
        parent[np.where(later, node_a, node_b)] = np.where(later, node_b, node_a)
        root = find(parent)
        self.group = np.cumsum(np.bincount(root, minlength=len(root)) > 0)[root] - 1  # roots are tokens of A, in order
        self.groups_to = np.concatenate([[0], self.group[: len(a)] + 1])[np.cumsum(n_a)]

    def keys(self) -> np.ndarray:
        """The id pair of each link."""
        return self.a[self.link_a].astype(np.int64) << 32 | self.b[self.link_b]

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums over each text's links."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.links_to], prepend=0)

    def written(self) -> list[str]:
        """Each text's groups: a1,a2|b1;a3|b2,b3."""
        key = 2 * self.group
        key[len(self.a) :] += 1
        order = np.argsort(key, kind="stable")
        key, ids = key[order], np.concatenate([self.a, self.b])[order].astype(np.int64)
        end = np.full(len(key), 3, np.int64)
        end[:-1] = np.where(key[1:] == key[:-1], 0, np.where(key[1:] >> 1 == key[:-1] >> 1, 1, 2))
        to = np.cumsum(self.n)
        end[to[self.n > 0] - 1] = 3
        said = [*map(self.pair.names.__getitem__, (end * (len(self.pair.names) // 4) + ids).tolist())]
        return ["".join(said[x:y]) for x, y in zip((to - self.n).tolist(), to.tolist(), strict=True)]


_PAIRS: dict[str, Pair] = {}


def worker_pair(sent: Broadcast) -> Pair:
    """The tokenizers, which a Python worker loads once."""
    key, a, b = sent.value
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(a, b)
    return _PAIRS[key]


def packed(flat: np.ndarray, sizes: np.ndarray) -> pa.BinaryArray:
    """Stretches of a flat array as little-endian bytes."""
    to = np.concatenate([[0], np.cumsum(sizes)]) * flat.itemsize
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def unpacked(column: pa.BinaryArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat array, where each row begins in it, and the end) of what packed() has made."""
    _, offsets, data = column.buffers()
    to = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, kind, (to[-1] - to[0]) // np.dtype(kind).itemsize, to[0]) if data else np.zeros(0, kind), (to - to[0]) // np.dtype(kind).itemsize


def kinds(pair: Pair) -> tuple[str, str]:
    """How ids are packed: in two bytes where they fit."""
    return tuple("<u2" if len(x) <= 1 << 16 else "<u4" for x in (pair.bytes_a, pair.bytes_b))


def graphs(batch: pa.RecordBatch, sent: Broadcast) -> Iterator[tuple[pa.RecordBatch, Graph]]:
    """The batch in slices of about TOKENS tokens, with the graph of each."""
    pair = worker_pair(sent)
    (a, to_a), (b, to_b) = (unpacked(batch.column(c), kind) for c, kind in zip(("__a", "__b"), kinds(pair), strict=True))
    for x, y in ranges(np.diff(to_a + to_b).tolist(), TOKENS):
        yield batch.slice(x, y - x), Graph(pair, a[to_a[x] : to_a[y]], b[to_b[x] : to_b[y]], np.diff(to_a[x : y + 1]), np.diff(to_b[x : y + 1]))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, n, len(keys)).astype(np.int64)


def encoded(docs: DataFrame, sent: Broadcast, text: str, kept: list[str]) -> DataFrame:
    """The kept columns with __a and __b, the packed ids of the text by both tokenizers; and rows with nothing but __pairs and __counts, what a task has counted."""
    given = docs.select(*kept, F.col(text).alias("__text"))
    added = ("__a", "__b", "__pairs", "__counts")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, counts = worker_pair(sent), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        types: list[pa.DataType] = []

        def told() -> pa.RecordBatch:
            columns = [*(pa.nulls(1, t) for t in [*types, pa.binary(), pa.binary()]), *(pa.array([x.tobytes()]) for x in counts)]
            return pa.RecordBatch.from_arrays(columns, names=[*kept, *added])

        for batch in batches:
            raw, types = texts(batch.column("__text")), [batch.column(c).type for c in kept]
            for x, y in ranges((len(t or b"") for t in raw), BYTES):
                (a, n_a), (b, n_b) = pair.encode(raw[x:y])
                ids = (packed(flat.astype(kind), n) for flat, n, kind in zip((a, b), (n_a, n_b), kinds(pair), strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(x, y - x) for c in kept), *ids, *(pa.nulls(y - x, pa.binary()) for _ in range(2))], names=[*kept, *added])
                keys, n = np.unique(Graph(pair, a, b, n_a, n_b).keys(), return_counts=True)
                counts = summed(np.concatenate([counts[0], keys]), np.concatenate([counts[1], n]))
                if len(counts[0]) > COUNTED:
                    yield told()
                    counts = counts[0][:0], counts[1][:0]
        if len(counts[0]):
            yield told()

    fields = [*((f.name, f.dataType) for f in given.schema if f.name in kept), *((c, T.BinaryType()) for c in added)]
    return given.mapInArrow(encode, T.StructType([T.StructField(*f) for f in fields]))


def pair_counts(counted: DataFrame) -> DataFrame:
    """(pair, n): how many links there are of each pair of ids, over all texts."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(batch.column(c), "<i8")[0]) for c in ("__pairs", "__counts")], names=["pair", "n"])

    return counted.select("__pairs", "__counts").where(F.col("__pairs").isNotNull()).mapInArrow(unpack, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a: str, b: str, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows (default: all) with n_a, n_b, n_groups, n_links, n_best, count_sum and groups.

    a: a tokenizer file of a byte-level BPE; b: a sentencepiece model; both are read where the driver runs. n_best: the links
    whose pair is the commonest, ties included, of its id of b; count_sum: the counts of all links' pairs, summed.
    """
    spark = docs.sparkSession
    with open(a, "rb") as x, open(b, "rb") as y:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, x.read(), y.read()))
    kept, tables = [c for c in (columns or docs.columns) if c not in RESULTS], Tables(spark)
    both = tables.written(encoded(docs, sent, text, kept).withColumn("__row", F.monotonically_increasing_id()))
    tokens, first = both.where(F.col("__a").isNotNull()).select(*kept, "__a", "__b", "__row"), Tables(spark)
    counts = first.written(pair_counts(both))
    best = F.broadcast(counts.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("most")))  # as many rows as b has ids at most
    pairs = tables.written(counts.join(best, F.col("pair") % (1 << 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))
    first.drop()
    n, links = pairs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    least = links / FREQUENT if n > FREQUENT else 0
    top = pairs.where(F.col("n") >= least).orderBy("pair").toPandas()  # FREQUENT rows at most
    known = spark.sparkContext.broadcast(tuple(top[c].to_numpy() for c in top.columns))

    def look_up(graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair of each link, its count, whether it is a best one, whether it was found)"""
        pair, count, best = known.value
        keys = graph.keys()
        if not len(pair):
            return keys, np.zeros(len(keys), np.int64), np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(pair, keys), len(pair) - 1)
        found = pair[at] == keys
        return keys, np.where(found, count[at], 0), found & best[at], found

    own = [*kept, "__row"]

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, graph in chain.from_iterable(graphs(batch, sent) for batch in batches):
            _, count, best, _ = look_up(graph)
            numbers = [graph.n_a, graph.n_b, np.diff(graph.groups_to, prepend=0), np.diff(graph.links_to, prepend=0), graph.by_text(best), graph.by_text(count)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *(pa.array(x.astype(np.int64)) for x in numbers), pa.array(graph.written())], names=[*own, *RESULTS])

    longs = [T.StructField(c, T.LongType()) for c in RESULTS[:-1]]
    out = tokens.mapInArrow(describe, T.StructType([*(tokens.schema[c] for c in own), *longs, T.StructField("groups", T.StringType())]))
    if least:

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, graph in chain.from_iterable(graphs(batch, sent) for batch in batches):
                keys, _, _, found = look_up(graph)
                row = np.repeat(batch.column("__row").to_numpy(), np.diff(graph.links_to, prepend=0))
                yield pa.RecordBatch.from_arrays([pa.array(row[~found]), pa.array(keys[~found])], names=["__row", "pair"])

        rare = tokens.select("__a", "__b", "__row").mapInArrow(others, "__row bigint, pair bigint").groupBy("__row", "pair").agg(F.count("*").alias("k"))
        more = rare.join(pairs.where(F.col("n") < least).hint("merge"), "pair").groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("k"))).alias("__best"), F.sum(F.col("k") * F.col("n")).alias("__sum"))
        added = lambda c, extra: (F.col(c) + F.coalesce(F.col(extra), F.lit(0))).alias(c)
        out = out.join(more, "__row", "left").select(*kept, *RESULTS[:4], added("n_best", "__best"), added("count_sum", "__sum"), "groups")
    return out.drop("__row")
