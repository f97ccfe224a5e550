"""Toxicity: segments and scores against definitions in plain Python, and accuracy on documents whose labels were not read."""

from __future__ import annotations

import math
import random
import re
import zlib

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from sparkscreen.llm import queries, tokens, toxicity

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_maximal(scores):
    """By the definition: take the best segment (shortest of the best), then the same left and right of it."""
    best = max(((sum(scores[a:b]), a - b, -a, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    *_, a, b = best
    return [*brute_maximal(scores[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in brute_maximal(scores[b:])]]


def test_segments_equal_the_definition():
    rng = random.Random(5)
    for _ in range(300):
        # sums of powers of two are exact, and no two segments tie
        scores = [rng.choice((-1, 1)) * (1 + rng.random()) for _ in range(rng.randrange(14))]
        sums = np.concatenate([[0], np.cumsum(scores)])
        where = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.maximal([float(sums[i]) for i in where], [float(sums[i + 1]) for i in where])
        want = brute_maximal(scores)
        assert [(where[a], where[b] + 1) for a, b, _ in found] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in found] == pytest.approx([s for *_, s in want])


def test_scan_is_linear():
    n = 200_000
    falling = [-float(i) for i in range(n)]
    assert len(toxicity.maximal(falling, [x + 0.5 for x in falling])) == n
    rising = [float(i) for i in range(n)]
    assert toxicity.maximal(rising, [x + 1.5 for x in rising]) == [(0, n - 1, n + 0.5)]


def test_tokens_of_long_and_short_texts(monkeypatch):
    rows = [None, b"", "Über-flüssig, CAFÉ 7x!".encode(), b"toxic toxical toxically " * 400, b"...", b"tox"]
    keys, n = toxicity.tokens(rows)
    assert n.tolist() == [len(WORD.findall((r or b"").decode().translate(AZ))) for r in rows]
    assert len({*keys[0][4:7]}) == 1 and len({*keys[1][4:7]}) == 2 and len({*keys[2][4:7]}) == 3
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 100)
    again, m = toxicity.tokens(rows)
    assert m.tolist() == n.tolist() and all((a == b).all() for a, b in zip(keys, again, strict=True))


def test_root_and_isotonic():
    p, s = np.array([0.7, 0.2, 0.1]), np.array([-1.0, 0.5, 1.0])
    assert (p * np.exp(toxicity.root(p, s) * s)).sum() == pytest.approx(1, abs=1e-6)
    x, y = toxicity.isotonic(np.arange(5.0), np.array([9, 8, 9, 2, 0]), np.array([1, 2, 1, 8, 9]))
    assert (np.diff(y) >= 0).all() and len(x) == 4 and 0 < y[0] and y[-1] < 1


def labelled(spark, n=400):
    rng = random.Random(2)
    calm, bad = [f"w{i}" for i in range(300)], ["vexing", "vexed", "grimly", "scorned"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=rng.randrange(5, 120))
        if toxic := rng.random() < 0.2:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(bad).title())
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("x")).repartition(4), spark.createDataFrame(labels, "doc_id bigint, toxic int").withColumn("text", F.lit("y"))


def test_scores_equal_plain_python(spark):
    docs, labels = labelled(spark)
    docs += [(None, "vexed vexed"), (9000, None), (9001, ""), (9002, " ".join(["w1"] * 30_000) + " vexing grimly"), (9003, "vexedly of w1"), (3, docs[3][1])]
    labels += [(0, None), (1, None), (2, 0), (2, 1), (None, 1), (9999, 1)]
    df, known = frames(spark, docs, labels)
    rest = toxicity.remainder(F.col("doc_id"), 3)
    top = known.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    model = toxicity.fit(df.join(top, "doc_id").where(rest != 1).withColumn("fold", (rest == 2).cast("int")))
    got = toxicity.score_documents(df, known).collect()
    assert len(got) == len(docs)
    said = {}
    for i, l in labels:
        if l is not None and i is not None and zlib.crc32(str(i).encode()) % 3 != 1:
            said[i] = max(l, said.get(i, 0))
    n, of = [0, 0], [{}, {}]
    for i, t in docs:
        if i in said:
            n[said[i]] += 1
            for level, size in enumerate(toxicity.LEVELS):
                for k in {w.encode()[:size] for w in WORD.findall((t or "").translate(AZ))}:
                    of[said[i]][level, k] = of[said[i]].get((level, k), 0) + 1
    assert model.documents == (n[0], n[1])
    share = n[1] / sum(n)
    by_id = {}
    for r in got:
        by_id.setdefault((r["doc_id"]), r)
    for i, t in docs:
        scores = []
        for w in WORD.findall((t or "").translate(AZ))[: 200 if i != 9002 else None]:
            theta = share
            for level, size in enumerate(toxicity.LEVELS):
                a, b = (x.get((level, w.encode()[:size]), 0) for x in of)
                theta = (b + toxicity.PRIOR * theta) / (a + b + toxicity.PRIOR)
            scores.append(math.log(theta / (1 - theta)) - math.log(share / (1 - share)) - toxicity.DRIFT)
        sums = np.concatenate([[0], np.cumsum(scores)])
        where = [k for k, s in enumerate(scores) if s > 0]
        found = toxicity.maximal([float(sums[k]) for k in where], [float(sums[k + 1]) for k in where])
        each, total = model.evidence(len(scores), np.array([s for *_, s in found]))
        r = by_id[i]
        assert r["n_words"] == len(scores) and r["held_out"] == (zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(float(model.chance(np.array([total]))[0]), abs=2e-3)
        assert len(r["passages"]) == int((each >= toxicity.SIGNIFICANT).sum())
    assert by_id[9002]["passages"][-1]["first"] >= 30_000 - 1
    assert by_id[9003]["score"] > by_id[9001]["score"]  # a word unknown to training speaks by its stem


def test_held_out_labels_are_not_read(spark):
    docs, labels = labelled(spark)
    turned = [(i, 1 - l if zlib.crc32(str(i).encode()) % 3 == 1 else l) for i, l in labels]
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score_documents(*frames(spark, docs, x)).collect()} for x in (labels, turned))
    assert one == two
    toxic = dict(labels)
    held = [i for i in one if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((one[i] >= 0.7) == toxic[i] for i in held) > 0.97 * len(held)


def test_missing_classes_and_empty_tables(spark):
    df, known = frames(spark, [(1, "a b"), (2, None), (2, None)], [(1, 0), (2, 0)])
    got = toxicity.score_documents(df, known).collect()
    assert len(got) == 3 and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] < 0.7
    assert toxicity.score_documents(df, known.limit(0)).count() == 3
    assert toxicity.score_documents(df.limit(0), known).count() == 0
    everyone = toxicity.score_documents(*frames(spark, *([(i, f"all {i}") for i in range(30)], [(i, 1) for i in range(30)]))).collect()
    assert all(r["score"] > 0.7 for r in everyone)


def test_held_out_accuracy(spark):
    folder = DATA.replace("sf0.001", "sf0.1")
    got = queries.op11_toxicity(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    toxic, clean = got[got.toxic == 1], got[got.toxic == 0]
    assert (toxic.predicted == 1).mean() > 0.9 and (clean.predicted == 1).mean() < 0.02
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
