"""Toxicity: maximum-scoring segments of token log-odds, weighed by extreme-value statistics.

Tokens are words of letters and digits, A-Z lower-cased. A token's log-odds come from labelled documents: how many toxic and
how many other documents have the word, with a Dirichlet prior whose mean is the same share for the word's first six bytes,
whose prior is that of its first four, whose prior is the share of all. A word that training has not seen, such as another
inflection, so has the odds of its stem, and a rare one stays near them. Counts are kept in 2^BITS buckets a level, by hash:
the size of the model, whatever the corpus holds. DRIFT is taken from each token's log-odds, so that clean text has a
negative mean.

A linear scan (a stack of candidates with links to the last that began lower) finds all maximal segments of a text: those
that no longer or shorter stretch beats. lambda solves E exp(lambda s) = 1 over the tokens of clean documents; a segment
of score S in n tokens has evidence lambda S - ln n - ln K, of which exp(-exp(-x)) is the chance that a clean text has none
better; K makes the mean over clean documents the Gumbel mean. Segments of positive evidence are added up (without any, the
best one counts), and a rising (isotonic) curve over that sum gives the chance of the label. lambda, K and the curve are fitted to
documents scored by the counts of the other half of the training documents, so that no document speaks for itself.

Fitting reads every labelled training document twice, in tasks; the driver gets bucket counts and two histograms. Scoring is
a pass without a shuffle. Null and empty texts have no tokens and get the curve's value for no evidence; a null id is hashed
as an empty one and has no label. Of several labels of an id the highest counts, null labels do not. If one class is missing,
every text gets the share of toxic training documents. Texts are taken whole; a long one is cut in pieces where words end,
which are put together again. Columns named like the results are replaced, others kept. Repeated rows get equal results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, small
from .tokens import _IS_SPACE, _OF_BYTE, FACTOR, TO_SPACE, _powers, chunks, mixed, pieces, texts

#: Bits of a bucket's number at each level; the levels, by the bytes of a word that they see.
BITS, LEVELS = 19, (4, 6, 1 << 30)
#: Documents that a level's prior counts for, and what is taken from each token's log-odds.
PRIOR, DRIFT = 10.0, 0.7
#: Steps and range of the histogram of tokens' scores, and of that of documents' evidence.
STEP, RANGE, EVIDENCE_STEP, EVIDENCE = 0.125, 10.0, 0.25, (-15.0, 60.0)
#: Weight of the evidence itself beside the curve, which is level in places, so that more evidence always scores higher.
SLOPE = 1e-3
#: Evidence from which a passage is reported: the chance that a clean text has one as good is 1/20.
SIGNIFICANT = 3.0
EULER = 0.5772156649015329
RESULTS = ("n_words", "score", "passages")
PASSAGE = T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("evidence", T.DoubleType())])


def tokens(rows: list[bytes | None]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each level the bucket keys of all tokens in a row, how many tokens each text has)."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in LEVELS]
    counts = np.zeros(len(rows), np.int64)
    parts = [(i, p) for i, row in enumerate(rows) for p in pieces(row or b"")]
    inverse = pow(FACTOR, -1, 1 << 64)
    for a, b in chunks([p for _, p in parts]):
        data = b" ".join(p for _, p in parts[a:b]).lower().translate(TO_SPACE) + b" "
        codes = np.frombuffer(data, np.uint8)
        edges = np.flatnonzero(np.diff(_IS_SPACE[codes], prepend=True))
        first, end = edges[0::2], edges[1::2]
        sums = np.cumsum(_OF_BYTE[codes] * _powers(FACTOR, len(codes)), dtype=np.uint64)
        before, back = np.where(first > 0, sums[first - 1], np.uint64(0)), _powers(inverse, len(codes))[first]
        for k, size in enumerate(LEVELS):
            h = mixed((sums[np.minimum(first + size, end) - 1] - before) * back)
            found[k].append((h >> np.uint64(64 - BITS)).astype(np.int64) + (k << BITS))
        ends = np.cumsum([len(p) + 1 for _, p in parts[a:b]])
        np.add.at(counts, [i for i, _ in parts[a:b]], np.diff(np.searchsorted(first, ends), prepend=0))
    return [np.concatenate(x) for x in found], counts


def log_odds(keys: list[np.ndarray], table: np.ndarray, share: float) -> np.ndarray:
    """Of each token, against the share of all; table: documents without and with the label, by key."""
    theta = np.full(len(keys[0]), share, np.float32)
    for key in keys:
        toxic = table[1][key]
        theta = (toxic + np.float32(PRIOR) * theta) / (table[0][key] + toxic + np.float32(PRIOR))
    return (np.log(theta / (1 - theta)) - np.log(share / (1 - share))).astype(np.float64)


def maximal(before: list[float], after: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of positive items, given the running sum before and after each."""
    first: list[int] = []
    last: list[int] = []
    low: list[float] = []
    high: list[float] = []
    link: list[int] = []  # the candidate below that began at a lower sum, which nothing between does
    for k, (lo, hi) in enumerate(zip(before, after, strict=True)):
        start, top = k, len(first) - 1
        while True:
            while top >= 0 and low[top] >= lo:
                top = link[top]
            if top < 0 or high[top] >= hi:
                break
            start, lo, keep = first[top], low[top], top
            top = link[top]
            for x in (first, last, low, high, link):
                del x[keep:]
        first.append(start)
        last.append(k)
        low.append(lo)
        high.append(hi)
        link.append(top)
    return [(a, b, y - x) for a, b, x, y in zip(first, last, low, high, strict=True)]


def segments(rows: list[bytes | None], table: np.ndarray, share: float) -> Iterator[tuple[int, np.ndarray, list[tuple[int, int, float]]]]:
    """Of each text: tokens, their scores, and its maximal segments [first, end) with scores."""
    keys, counts = tokens(rows)
    score = log_odds(keys, table, share) - DRIFT
    to = np.cumsum(counts)
    plus = np.flatnonzero(score > 0)
    at = np.searchsorted(plus, np.concatenate([[0], to]))
    for i, (end, n) in enumerate(zip(to.tolist(), counts.tolist(), strict=True)):
        own = score[end - n : end]
        where = plus[at[i] : at[i + 1]] - (end - n)
        total = np.cumsum(own)[where]
        found = maximal((total - own[where]).tolist(), total.tolist())
        yield n, own, [(int(where[a]), int(where[b]) + 1, s) for a, b, s in found]


@dataclass
class Model:
    """Fitted values; tables: documents by label and bucket key of all, and of the training half that a fold is scored with."""

    documents: tuple[int, int]
    share: float
    table: np.ndarray = field(repr=False)
    decay: float = 1.0
    log_k: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def evidence(self, n: int, scores: np.ndarray) -> tuple[np.ndarray, float]:
        """(of each segment, of the text)"""
        each = self.decay * scores - np.log(max(n, 1)) - self.log_k
        best = each.max(initial=-np.log(max(n, 1)) - self.log_k)
        return each, float(best if best <= 0 else each[each > 0].sum())

    def chance(self, evidence: np.ndarray) -> np.ndarray:
        evidence = np.clip(evidence, *EVIDENCE)
        return (1 - SLOPE) * np.interp(evidence, *self.curve) + SLOPE * (evidence - EVIDENCE[0]) / (EVIDENCE[1] - EVIDENCE[0])


def root(p: np.ndarray, s: np.ndarray) -> float:
    """The positive lambda with sum p exp(lambda s) = 1."""
    low, high = 1e-3, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return low


def isotonic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(evidence, chance): the rising curve nearest to the shares of label 1 at sorted points, one point a level of it."""
    blocks: list[list[float]] = []  # weight, label 1, sum of weighted x
    for point, clean, toxic in zip(x.tolist(), n0.tolist(), n1.tolist(), strict=True):
        blocks.append([clean + toxic, toxic, point * (clean + toxic)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last, strict=True)]
    n, toxic, total = np.array(blocks).T
    return total / n, np.maximum.accumulate((toxic + n1.sum() / (n0.sum() + n1.sum())) / (n + 1))


def bucket_counts(labelled: DataFrame) -> DataFrame:
    """(key, kind, n): documents that have a token of a bucket; kind: 2 * fold + label."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, kinds = texts(batch.column("text")), batch.column("kind").to_numpy()
            for a, b in chunks(raw):
                keys, n = tokens(raw[a:b])
                doc = np.repeat(np.arange(b - a), n)
                bits = BITS + 2
                once = np.unique(np.concatenate([doc << bits | k for k in keys]))
                both, n = np.unique((once & ((1 << bits) - 1)) << 2 | kinds[a:b][once >> bits], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both >> 2), pa.array((both & 3).astype(np.int32)), pa.array(n)], names=["key", "kind", "n"])

    return labelled.select("text", "kind").mapInArrow(count, "key bigint, kind int, n bigint").groupBy("key", "kind").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, text: str = "text", label: str = "label", fold: str = "fold") -> Model:
    """labelled: training documents with label 0 or 1 and fold 0 or 1."""
    spark = labelled.sparkSession
    rows = labelled.select(F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(fold) * 2 + F.col(label)).cast("int").alias("kind"))
    n = {r["kind"]: r["n"] for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    halves = np.zeros((4, len(LEVELS) << BITS), np.float32)
    documents = tuple(n.get(x, 0) + n.get(2 + x, 0) for x in (0, 1))
    if not all(documents):
        return Model(documents, 0.5, halves[:2], curve=(np.zeros(1), np.full(1, (documents[1] + 0.5) / (sum(documents) + 1))))
    found = bucket_counts(rows).toArrow()  # 4 rows a bucket at most
    halves[found["kind"].to_numpy(), found["key"].to_numpy()] = found["n"].to_numpy()
    share = documents[1] / sum(documents)
    model = Model(documents, share, halves[:2] + halves[2:])
    sent = spark.sparkContext.broadcast((share, halves))
    bins = int(2 * RANGE / STEP) + 1

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a document, with its segments' scores; and a histogram of the tokens' scores in clean ones."""
        share, halves = sent.value
        schema = pa.schema([("kind", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.float64())), ("histogram", pa.list_(pa.int64()))])
        total = np.zeros(bins, np.int64)
        for batch in batches:
            raw, kinds, out = texts(batch.column("text")), batch.column("kind").to_numpy(), []
            for fold in (0, 1):
                own = np.flatnonzero(kinds >> 1 == fold)
                other = halves[2 - 2 * fold : 4 - 2 * fold]
                rows = [raw[i] for i in own]
                for a, b in chunks(rows):
                    for i, (n, score, found) in zip(own[a:b].tolist(), segments(rows[a:b], other, share), strict=True):
                        if kinds[i] & 1 == 0:
                            total += np.bincount(np.rint((np.clip(score, -RANGE, RANGE) + RANGE) / STEP).astype(np.int64), minlength=bins)
                        out.append((int(kinds[i]), n, [s for _, _, s in found], None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema)
        yield pa.RecordBatch.from_pylist([{"histogram": total.tolist()}], schema)

    tables = Tables(spark)
    scanned = tables.written(rows.mapInArrow(scan, "kind int, n bigint, scores array<double>, histogram array<bigint>"))
    sums = scanned.where("histogram is not null").select(F.posexplode("histogram")).groupBy("pos").agg(F.sum("col").alias("n")).collect()  # a row a bin
    p, s = np.zeros(bins), np.arange(bins) * STEP - RANGE
    for r in sums:
        p[r["pos"]] = r["n"]
    model.decay = root(p / max(p.sum(), 1), s)
    docs = scanned.where("kind is not null").select((F.col("kind") % 2).alias("label"), F.log(F.greatest("n", F.lit(1)).cast("double")).alias("log_n"), "scores")
    best = F.coalesce(F.array_max("scores"), F.lit(0.0)) * model.decay - F.col("log_n")
    model.log_k = float(docs.where("label = 0").agg(F.avg(best)).first()[0]) - EULER
    beyond = lambda x: F.greatest(x * F.lit(model.decay) - F.col("log_n") - F.lit(model.log_k), F.lit(0.0))
    total = F.aggregate("scores", F.lit(0.0), lambda acc, x: acc + beyond(x))
    evidence = F.least(F.greatest(F.when(best > model.log_k, total).otherwise(best - F.lit(model.log_k)), F.lit(EVIDENCE[0])), F.lit(EVIDENCE[1]))
    seen = docs.groupBy((F.rint(evidence / EVIDENCE_STEP) * EVIDENCE_STEP).alias("x"), "label").agg(F.count("*").alias("n")).toPandas()  # a row a bin and label
    by = seen.pivot_table(index="x", columns="label", values="n", fill_value=0, aggfunc="sum").reindex(columns=[0, 1], fill_value=0)
    model.curve = isotonic(by.index.to_numpy(np.float64), by[0].to_numpy(np.float64), by[1].to_numpy(np.float64))
    tables.drop()
    return model


def score(docs: DataFrame, model: Model, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows (default: all) with n_words, score (0 to 1) and passages: words [first, end) of significant segments, with their evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (columns or docs.columns) if c not in RESULTS]
    given = docs.select(*kept, F.col(text).alias("__text"))
    passage = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("evidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            raw, sizes, sums, passages = texts(batch.column("__text")), [], [], []
            for a, b in chunks(raw):
                for n, _, found in segments(raw[a:b], model.table, model.share) if all(model.documents) else zip(tokens(raw[a:b])[1].tolist(), repeat(None), repeat([]), strict=False):
                    each, evidence = model.evidence(n, np.array([s for _, _, s in found]))
                    sizes.append(n)
                    sums.append(evidence if all(model.documents) else 0.0)
                    passages.append([{"first": f, "end": e, "evidence": x} for (f, e, _), x in zip(found, each.tolist(), strict=True) if x >= SIGNIFICANT])
            results = [pa.array(sizes, pa.int64()), pa.array(model.chance(np.array(sums, np.float64))), pa.array(passages, pa.list_(passage))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *results], names=[*kept, *RESULTS])

    added = [T.StructField("n_words", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("passages", T.ArrayType(PASSAGE))]
    return given.mapInArrow(run, T.StructType([*(given.schema[c] for c in kept), *added]))


def remainder(doc_id: Column, of: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(of))


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id with held_out (crc32(doc_id) mod 3 is 1: its label is not read), n_words, score and passages; learns from the other labels."""
    known = labels.where(remainder(F.col(doc_id), 3) != 1).where(F.col(label).isNotNull()).groupBy(doc_id).agg(F.max(F.col(label).cast("int")).alias("label"))
    training = docs.select(F.col(doc_id), F.col(text).alias("text")).where(remainder(F.col(doc_id), 3) != 1).join(small(known), doc_id)
    model = fit(training.withColumn("fold", (remainder(F.col(doc_id), 3) == 2).cast("int")))
    return score(docs.select(doc_id, F.col(text).alias("__t")), model, "__t", [doc_id]).withColumn("held_out", remainder(F.col(doc_id), 3) == 1)
