"""Fill-in-the-middle: against its SQL, and against units found by a regular expression."""

from __future__ import annotations

import hashlib
import re

import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from sparkscreen.llm import fim, oracles, queries

UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\x0b\x0c\r]*[ \t\n\x0b\x0c\r]+|[^ \t\n\x0b\x0c\r]+", "char": r"(?s:.)"}


def brute(doc_id, text, unit, seed, rate, spm):
    text = text or ""
    h = [int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(UNITS[unit], text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


TEXTS = [None, "", "\n", "\n\n", "a", "a\n", "a\nb", "é\n\nüß 😀\n", " \t lead", "x <P>y", "<S>", "<", "a<\n<P\nS>\nM", "<<<>>>\n" * 3, "tail \n ", "wörd\x0bwörd\r\n" * 4, "a b c d e f g\n" * 50_000, "n" * 300_000]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_cuts_equal_brute_force_and_restore(spark, unit):
    rows = [(i, t) for i in (*range(7), None) for t in TEXTS] + [(3, "a\nb\nc"), (3, "a\nb\nc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("output", F.lit(1)).withColumn("n", F.lit("other")).repartition(5)
    cut = fim.fill_in_middle(df, seed=5, rate=80, spm=30, unit=unit)
    got = cut.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows) and {"psm", "spm", "plain"} == {r["form"] for r in got}
    for r in got:
        assert (r["n_units"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], r["text"], unit, 5, 80, 30)
        assert r["back"] == (r["text"] or "") and r["n"] == "other"
    assert fim.fill_in_middle(df.limit(0), seed=5).count() == 0


def test_sentinels_that_can_overlap_are_refused():
    for bad in (("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "x"), ("", "<S>", "<M>")):
        with pytest.raises(ValueError, match="overlap"):
            fim.check(bad)
    fim.check(fim.SENTINELS)


def test_query_equals_its_sql(spark):
    assert_same(spark, queries.op12_fim, oracles.op12())


def test_texts_go_to_python_once(spark):
    plan = queries.op12_fim(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan
