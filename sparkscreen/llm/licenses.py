"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Templates are grouped by length: a class has the power of two ``span`` that is at least its templates' words, and its
shingle length (five words; a shorter template is one shingle). Its windows cover 3 * span words and start every span
words, so that an occurrence of up to 2 * span words lies whole in a window. A window's signature has one MinHash value a
band; the number of bands is chosen so that a window with CONTAINMENT of a template's shingles meets it in a band with
probability PROBABILITY or more, from the least Jaccard similarity that such a window can have. Candidates are then
verified: the share of the template's distinct shingles in the window must reach CONTAINMENT. Windows with too few shingles
made of template words only cannot verify and need no signature; that bound is exact.

Templates are broadcast and held to MAX_TEMPLATE_CHARS; more are scanned in blocks, one pass each. Nulls: a null text
has no words; templates without words are skipped; a null template id is an empty id. Repeated rows are scanned alike.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .tokens import chunks, hashed, letter_words, mixed, shingles, texts

SHINGLE, CONTAINMENT, PROBABILITY = 5, 0.75, 0.9999
#: Characters of templates that are sent to the tasks at once.
MAX_TEMPLATE_CHARS = 16_000_000
MATCH = T.StructType([T.StructField("license_id", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("n_windows", T.LongType()), T.StructField("containment", T.DoubleType())])
MATCH_ARROW = pa.list_(pa.struct([("license_id", pa.string()), ("first_word", pa.int64()), ("n_windows", pa.int64()), ("containment", pa.float64())]))


def needed(n_shingles: int) -> int:
    return math.ceil(CONTAINMENT * n_shingles - 1e-9)


class TemplateClass:
    """Templates of one span and shingle length, with their bands."""

    def __init__(self, n: int, span: int, templates: list[tuple[str, list[bytes]]]):
        self.n, self.span, self.width = n, span, 3 * span
        self.words = np.unique(hashed([w for _, words in templates for w in words]))
        self.ids = [i for i, _ in templates]
        self.sets = [np.unique(shingles(hashed(words), n)) for _, words in templates]
        inside = self.width - n + 1
        self.least = min(needed(len(s)) for s in self.sets)
        jaccard = min(needed(len(s)) / (inside + len(s) - needed(len(s))) for s in self.sets)
        self.bands = max(1, math.ceil(math.log(1 - PROBABILITY) / math.log(1 - jaccard)))
        self.keys = mixed(np.arange(1, self.bands + 1, dtype=np.uint64))
        self.by_band: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(self.bands)]
        for t, s in enumerate(self.sets):
            for b, v in enumerate(self.signature(s)):
                self.by_band[b][int(v)].append(t)

    def signature(self, values: np.ndarray) -> np.ndarray:
        """The least value of each band's permutation of the shingles."""
        return mixed(values[None, :] ^ self.keys[:, None]).min(axis=1)

    def scan(self, words: np.ndarray) -> list[tuple[int, int, float]]:
        """(template, first word of the window, containment) of the verified windows of one text."""
        s = shingles(words, self.n)
        if not len(s):
            return []
        run = np.concatenate([[0], np.cumsum(np.isin(words, self.words))])
        full = (run[self.n :] - run[: -self.n]) == self.n  # shingles of template words only
        at = np.flatnonzero(full)
        if len(at) < self.least:
            return []
        starts = np.unique(np.concatenate([at // self.span - k for k in range(math.ceil(self.width / self.span))]))
        starts = starts[starts >= 0] * self.span
        ends = np.minimum(starts + self.width - self.n + 1, len(s))
        enough = np.searchsorted(at, ends) - np.searchsorted(at, starts) >= self.least
        out = []
        for a, b in zip(starts[enough].tolist(), ends[enough].tolist(), strict=True):
            window = np.unique(s[a:b])
            near = {t for band, v in zip(self.by_band, self.signature(window).tolist(), strict=True) for t in band.get(v, ())}
            for t in sorted(near):
                common = int(np.isin(self.sets[t], window, assume_unique=True).sum())
                if common >= needed(len(self.sets[t])):
                    out.append((t, a, common / len(self.sets[t])))
        return out


def classes(templates: list[tuple[str, str]]) -> list[TemplateClass]:
    groups: dict[tuple[int, int], list[tuple[str, list[bytes]]]] = defaultdict(list)
    for name, text in templates:
        if words := letter_words(text.encode()):
            groups[min(SHINGLE, len(words)), 1 << (len(words) - 1).bit_length()].append((name, words))
    return [TemplateClass(n, max(span, n), group) for (n, span), group in sorted(groups.items())]


def joined(old: list[dict], new: list[dict]) -> list[dict]:
    """Matches of two blocks of templates, one a license id, by id."""
    best = {m["license_id"]: m for m in old}
    for m in new:
        if b := best.get(m["license_id"]):
            m = m | {"first_word": min(b["first_word"], m["first_word"]), "n_windows": b["n_windows"] + m["n_windows"], "containment": max(b["containment"], m["containment"])}
        best[m["license_id"]] = m
    return [best[k] for k in sorted(best)]


def scan_licenses(docs: DataFrame, templates: DataFrame, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of the rows (default: all) with matches: for each template found license_id, first_word of its first
    window, n_windows and the largest containment, sorted by license_id. templates: license_id, text."""
    spark = docs.sparkSession
    kept = [c for c in (columns or docs.columns) if c != "matches"]
    rows = templates.select(F.coalesce(F.col("license_id").cast("string"), F.lit("")).alias("id"), "text").where(F.length("text") > 0)
    blocks = 1 + int(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // MAX_TEMPLATE_CHARS
    df = docs.select(*kept, F.col(text).alias("__text"), F.array().cast(T.ArrayType(MATCH)).alias("matches"))
    for block in range(blocks):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # bounded by MAX_TEMPLATE_CHARS
        sent = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in own])
        names = df.columns

        def scan(batches: Iterator[pa.RecordBatch], sent=sent, names=names) -> Iterator[pa.RecordBatch]:
            scanners = classes(sent.value)
            for batch in batches:
                raw, found = texts(batch.column("__text")), []
                for a, b in chunks(raw):
                    docs_words = [letter_words(t) for t in raw[a:b]]
                    flat = hashed([w for d in docs_words for w in d])
                    ends = np.cumsum([len(d) for d in docs_words])
                    for words in np.split(flat, ends[:-1]):
                        best: dict[str, list] = {}
                        for c in scanners:
                            for t, at, share in c.scan(words):
                                old = best.setdefault(c.ids[t], [at, 0, 0.0])
                                best[c.ids[t]] = [min(old[0], at), old[1] + 1, max(old[2], share)]
                        found.append([{"license_id": k, "first_word": v[0], "n_windows": v[1], "containment": v[2]} for k, v in best.items()])
                rows = [joined(old, new) for old, new in zip(batch.column("matches").to_pylist(), found, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names if c != "matches"), pa.array(rows, MATCH_ARROW)], names=[*(c for c in names if c != "matches"), "matches"])

        df = df.mapInArrow(scan, T.StructType([*(f for f in df.schema if f.name != "matches"), df.schema["matches"]]))
        if block < blocks - 1:
            df = written(df)
    return df.drop("__text")
