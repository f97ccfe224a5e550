from __future__ import annotations

import random

from test_tasks import brute_components

from sparkscreen.llm import common, jaccard


def test_least_shared_is_least_over_all_sizes(spark):
    need = lambda n, m: -(-3 * (n + m) // 7) - -(-3 * max(n, m) // 4) + 1
    cases = [(n, a, b) for n in range(1, 41) for a in range(1, 4 * n // 3 + 1) for b in range(max(a, -(-3 * n // 4)), 4 * n // 3 + 4, 1 + n // 12)]
    got = spark.createDataFrame(cases, "n bigint, n_min bigint, n_max bigint").selectExpr("n", "n_min", "n_max", f"{jaccard.least_shared('n', 'n_min', 'n_max')} as need").collect()
    assert len(got) == len(cases)
    for r in got:
        sizes = range(max(r["n_min"], -(-3 * r["n"] // 4)), min(r["n_max"], 4 * r["n"] // 3) + 1)
        assert r["need"] == min(need(r["n"], m) for m in sizes), r


def test_pair_of_13_and_15_shingles_in_two_groups(spark):
    """12 of 16 shingles in common, and one prefix token; the larger one's group has 13, 15 and 16 shingles."""
    w, f, g = ([f"{c}{i}" for i in range(1, 18)] for c in "wfg")
    q = ["q1", "q2", "q3", "q4", "q5"]
    docs = {
        1: w[:5],
        2: w,
        10: [*q, *f[:10], *w[13:], "a"],
        11: [*q, *g[:12]],
        12: [*w[1:], "a", "b", "c"],
    }
    for i in (100, 101, 102):  # these make the passages frequent
        own = [f"z{i}x{k}" for k in range(200)]
        docs[i] = [*own[:50], *w[1:], *own[50:100], *q[1:], *f[:10], *w[13:], *own[100:150], *q[1:], *g[:12], *own[150:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs.items()], "doc_id bigint, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df).collect()}
    assert got[2] == (13, 2) and got[12] == (15, 2)
    assert {i: c for i, (_, c) in got.items() if i != 12} == {i: i for i in docs if i != 12}


def test_a_large_cluster_of_near_copies_and_null_ids(spark, monkeypatch):
    """300 copies, each with one or two words of its own, in blocks of 16, by shuffled joins; a null id is the smallest."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng, base, other = random.Random(5), [f"w{i}" for i in range(80)], [f"v{i}" for i in range(60)]
    docs = []
    for i in range(300):
        words = [*base]
        for _ in range(1 + (i % 7 == 0)):
            words[rng.randrange(80)] = f"own{i}x{rng.randrange(10)}"
        docs.append((i, " ".join(words)))
    docs += [(None, " ".join(other)), (None, "alone here"), (500, " ".join([*other, "end"])), (501, " ".join(base[:30] + other)), (None, None)]
    null = -(1 << 63)
    want = brute_components([(null if i is None else i, t) for i, t in docs])
    got = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)).collect()
    assert len(got) == len(docs)
    for r in got:
        component = want[null if r["doc_id"] is None else r["doc_id"]]
        assert r["component_id"] == (None if component == null else component), r
    assert len({c for i, c in want.items() if 0 <= i < 300}) < 150


def test_very_long_near_copies_fill_blocks_by_tokens(spark, monkeypatch):
    """24 texts of some 3000 words, 20 of them near copies, among short ones: no block holds many of them, no link is lost."""
    monkeypatch.setattr(jaccard, "BLOCK_TOKENS", 10_000)
    rng = random.Random(7)
    base, docs = [f"w{i}" for i in range(3000)], []
    for i in range(24):
        words = [*base] if i < 20 else [f"x{i}y{k}" for k in range(3000)]
        for _ in range(rng.randrange(1, 60)):
            words[rng.randrange(3000)] = f"own{i}x{rng.randrange(20)}"
        docs.append((i, " ".join(words)))
    docs += [(100 + i, " ".join(base[7 * i : 7 * i + 40])) for i in range(30)]
    docs += [(200 + i, " ".join([*base[7 * i : 7 * i + 40], "end"])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(df).collect()} == brute_components(docs)
    t = common.Tables(spark)
    blocks = jaccard.Join(t, df.withColumnRenamed("doc_id", "doc")).home.groupBy("g", "block").agg({"n": "sum", "*": "count"}).collect()
    t.drop()
    assert max(r["sum(n)"] for r in blocks) <= 5 * 10_000 and sum(r["sum(n)"] > 2500 for r in blocks) >= 4


def test_a_token_of_all_texts_brings_a_row_a_task(spark):
    """What is held against all texts is aggregated in the tasks before it is dealt by token, and by no window."""
    docs = spark.createDataFrame([(i, f"a b c d e own{i} f g h i j") for i in range(50)], "doc bigint, text string").repartition(3)
    plan = jaccard._sized(jaccard._lows(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("partial_") > 0
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "HashAggregate" in lines[i + 1]
