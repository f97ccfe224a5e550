"""Operators with code in tasks: decontamination, licences, WARC, near duplicates, language model, against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from sparkscreen.llm import common, decontam, jaccard, licenses, lm, queries, warc

corpus_pipeline = pytest.importorskip("corpus_pipeline")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_pipeline_equals_its_sql(spark):
    assert_same(spark, corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)


def test_pipeline_takes_empty_tables_and_nulls(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() <= 6


def test_pipeline_null_ids_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    own = lambda i, n=60: " ".join(f"w{i:03d}x{k:05d}" for k in range(n))
    texts = [(i, own(i)) for i in range(40)] + [(40, own(40, 50_000)), (5, own(5)), (6, own(90)), (None, own(91)), (None, own(92)), (None, own(3))]
    kept = [None, None, None, *(i for i in range(41) if i != 3)]  # a null id is the smallest, so its row stays of the two with one text
    source = next(iter(corpus_pipeline.MIX_WEIGHTS))
    docs = spark.createDataFrame([(i, t, "en", source, len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clash = ("kept", "n_words", "n_dropped", "found", "component_id", "label", "n", "copies", "__host")
    docs = docs.withColumns({c: F.lit("clash") for c in clash}).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, own(99, 12))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, str(tmp_path)))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    rows = docs.collect()
    assert sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i)) == kept
    assert {r["text"] for r in rows} <= {t for _, t in texts} and [len(r["text"]) for r in rows if r["doc_id"] == 40] == [len(own(40, 50_000))]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert not set(clash) - {"copies"} & set(out.columns) and {r["doc_id"] for r in out.select("doc_id").collect()} <= set(kept)


def brute_hits(text, items, window=10):
    w = WORD.findall((text or "").translate(AZ))
    hit, found = set(), set()
    for item, words in items:
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == words[i : i + m]:
                    hit |= set(range(j, j + m))
                    found.add(item)
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("block", [1 << 30, 40])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_CHARS", block)
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "B", "c", "É", "d7"])
    items = [(i, None if i == 3 else " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 0, 9, 10, 14, 12, 12])] + [(8, "a B c")]
    docs = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 5, 200, 3000])] + [(9, None), (10, "~`!"), (11, f"x {items[6][1]}, y"), (11, f"x {items[6][1]}, y")]
    df, bench = spark.createDataFrame(docs, "doc_id int, text string").withColumn("found", F.lit(1)), spark.createDataFrame(items, "item_id int, text string")
    got = decontam.find_contamination(df, bench).withColumn("n_hit", decontam.n_hit()).collect()
    named = [(str(i), WORD.findall((t or "").translate(AZ))) for i, t in items]
    assert len(got) == len(docs)
    for r in got:
        assert (r["found"]["n_words"], r["n_hit"], r["found"]["items"]) == brute_hits(r["text"], named)
    assert all(r["found"]["items"] == [] for r in decontam.find_contamination(df, bench.limit(0)).collect())


def test_license_bands_and_edges(spark, monkeypatch):
    templates = [("t5", "alpha beta gamma delta epsilon"), ("t2", "All Rights"), ("t30", " ".join(f"word{i}" for i in range(30))), ("t0", "...")]
    edited = " ".join("oops" if i == 4 else f"Word{i}" for i in range(30))
    docs = [(1, f"{'x ' * 100}{templates[0][1]}{' y' * 100}"), (2, None), (3, ""), (4, f"{'z ' * 77}{edited}. all rights"), (5, "alpha beta gamma delta"), (6, "rights all")]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("matches", F.lit(1))
    got = {r["doc_id"]: [m["license_id"] for m in r["matches"]] for r in licenses.scan_licenses(df, spark.createDataFrame(templates, "license_id string, text string")).collect()}
    assert got == {1: ["t5"], 2: [], 3: [], 4: ["t2", "t30"], 5: [], 6: []}
    # a license of several texts, and blocks of templates: the same matches
    more = [*templates, ("t5", "zeta eta theta iota kappa"), ("t5", "alpha beta gamma delta epsilon")]
    rows = [*docs, (7, f"{more[4][1]} {'y ' * 50} {more[0][1]}"), (7, f"{more[4][1]} {'y ' * 50} {more[0][1]}"), (8, "x " * 20000 + more[4][1])]
    df, table = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(more, "license_id string, text string")
    one = sorted(map(str, licenses.scan_licenses(df, table).collect()))
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_CHARS", 40)
    assert sorted(map(str, licenses.scan_licenses(df, table).collect())) == one and len(one) == len(rows)
    for c in licenses.classes(templates):
        inside = c.width - c.n + 1
        least = min(licenses.needed(len(s)) / (inside + len(s) - licenses.needed(len(s))) for s in c.sets)
        assert 1 - (1 - least) ** c.bands >= licenses.PROBABILITY


@pytest.mark.parametrize("split", ["128m", "900b"])
def test_warc_round_trip(spark, tmp_path, split):
    rng = random.Random(1)
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 3\r\n\r\nyyy\r\n\r\nWARC/1.1\r\n"
    html = [None, "", "dup", fake, fake + "é", "x" + fake * 2, "WARC/1.1\r\n", "\r\n\r\n", "a" * 3000]
    rows = [(i, None if i % 9 == 0 else f"http://h/\r\n{i}", rng.choice(html) if i % 2 else f"own {i} {rng.choice(html)}") for i in range(300)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "10b")
    try:
        warc.write_warc(spark.createDataFrame(rows, "page_id int, url string, html string").repartition(2), str(tmp_path / "w"))
        got = {int(r["record_id"]): r for r in warc.read_warc(spark, str(tmp_path / "w"), keep_payload=True).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    first: dict[str, int] = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    assert len(got) == len(rows)
    for i, _, h in rows:
        data, r = (h or "").encode(), got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        if first[h or ""] == i:
            assert r["record_type"] == "response" and r["payload"] == (h or "") and r["digest_ok"] and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and int(r["refers_to"]) == first[h or ""]


def test_warc_empty(spark, tmp_path):
    warc.write_warc(spark.createDataFrame([], "page_id int, url string, html string"), str(tmp_path / "w"))
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_warc_null_ids_repeated_rows_and_other_columns(spark, tmp_path):
    rows = [(None, "u", "same", 1), (4, "u", "same", 1), (3, None, "same", 2), (3, None, "same", 2), (None, "v", "alone", 1)]
    warc.write_warc(spark.createDataFrame(rows, "page_id int, url string, html string, digest int"), str(tmp_path / "w"))
    got = [(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()]
    key = lambda x: tuple(v or "" for v in x)
    assert sorted(got, key=key) == sorted([("3", "response", None)] * 2 + [("4", "revisit", "3"), (None, "revisit", "3"), (None, "response", None)], key=key)


def test_decontamination_tables_are_small():
    import tracemalloc

    rng = random.Random(1)
    items = [(str(i), [f"w{rng.randrange(30000)}".encode() for _ in range(400)]) for i in range(800)]
    chars = sum(len(w) + 1 for _, words in items for w in words)
    tracemalloc.start()
    searcher = decontam.Searcher(items, 10)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 20 * chars
    found = searcher.search([[b"x", *items[5][1][7:30], b"y"]])[0]
    assert found == (25, [[1, 24]], {"5"})


def brute_components(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").translate(AZ).split()
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("seed", "block", "unit", "broadcast"), [(1, 256, 10**6, 10**6), (2, 4, 100, 0), (3, 2, 1, 10**6)])
def test_jaccard_components(spark, monkeypatch, seed, block, unit, broadcast):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "UNIT_TOKENS", unit)
    monkeypatch.setattr(common, "BROADCAST_BYTES", broadcast)
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    docs, n = [], 0
    for _ in range(12):  # chains of edited copies, some with a passage that many share
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 8, 30, 60, 120]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 9)):
            docs.append((n, " ".join(base)))
            n += 1
            if rng.random() < 0.8:
                base = [*base]
                base[rng.randrange(len(base))] = f"e{rng.randrange(9)}"
                if rng.random() < 0.3:
                    base = base[: len(base) * 9 // 10 + 1]
    docs += [(900, None), (901, ""), (902, " \t"), (903, "One two"), (904, "one TWO"), (905, docs[0][1]), (905, docs[0][1])]
    docs += [(906, docs[1][1]), (906, docs[-9][1]), (906, None), (907, None), (907, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("component_id", F.lit("clash")).repartition(4)
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(docs)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(docs)
    kept = jaccard.one_of_each(df.drop("component_id")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(brute_components(docs).values()))
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_language_model(spark):
    got = queries.op3_lm(spark, DATA).toPandas().set_index("doc_id")
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    words = {i: [*(t or "").translate(AZ).split(), None] for i, t in docs}
    counts = Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in words.items():
        r = got.loc[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(counts[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws))
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.score < 0
    held = got[got.held_out]
    assert held.score.sum() / held.n_tokens.sum() > -5  # subwords by their counts alone: -6; test_lm_training has the larger table


def test_language_model_edges(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (2, "a b"), (2, "a b"), (3, "x" * 3000)], "doc_id bigint, text string").withColumn("score", F.lit(1))
    got = lm.score_documents(docs, queries.VOCABULARY).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 2, 3, 3]
    assert lm.score_documents(docs.limit(0), queries.VOCABULARY).count() == 0
