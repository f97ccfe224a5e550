"""Chat, URLs, quality, lines and mixing: edge cases against small Python versions."""

from __future__ import annotations

import collections
import hashlib
import re

import pytest
from compare import DATA, assert_same
from pyspark.sql import functions as F

from sparkscreen.llm import chat, lines, mixing, oracles, quality, queries, urls

ODD = ["", "a", "<|im_end|>", "<\\|im_sep|>", "<\\\\|", "x<", "|y", "\n", "<|im_start|>assistant\nhi", "é" * 50]


@pytest.mark.parametrize("name", sorted(set(oracles.oracle_sql()) - {"pipeline"}))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, queries.queries()[name], oracles.oracle_sql()[name])


def test_chat_round_trip(spark):
    rows = [(c, t, r, x) for c in range(4) for t, (r, x) in enumerate([(["user", "assistant", "assistant", "we\\ird\nrole"][(c + i) % 4], ODD[(i * 3 + c) % len(ODD)]) for i in range(12)])]
    rows += [(9, 0, None, None), (9, 0, "user", "b"), (9, 0, "user", "b"), (None, None, "assistant", "z"), (None, 1, "assistant", "y"), (8, 0, "assistant", "<|im_end|> long " * 100000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    got = {r["conv_id"]: r for r in chat.format_conversations(df).select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(r, x) for _, r, x in want]
        assert got[conv]["loss"] == "".join(x for _, r, x in want if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"]
    assert got[9]["formatted"].count(chat.START) == 2  # adjacent turns of one role are one message
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_url_cascade_is_exact(spark, monkeypatch):
    hosts = [f"h{i}.example{i % 7}.{t}" for i in range(60) for t in ("com", "net", "org")]
    listed = {h for i, h in enumerate(hosts) if i % 3 == 0}
    pages = [(i, f"https://{'WWW.' if i % 2 else ''}{h}{p}") for i, (h, p) in enumerate((h, p) for h in hosts for p in ("", "/", "/en/x?y://z", "#/en/", "/en"))]
    pages += [(-1, None), (-2, ""), (-3, "no scheme"), (-4, "x://"), (-5, pages[0][1]), (-5, pages[0][1]), (-6, f"x://{'a.' * 20000}example1.net/en/{'y' * 100000}")]
    rules = [("net", "/", "block"), ("example1.net", "/en/", "allow"), ("com", "/en", "block"), ("example2.com", "/en", "allow")]
    df = spark.createDataFrame(pages, "page_id int, url string").withColumn("host", F.lit("clash"))
    rule_df, host_df = spark.createDataFrame(rules, "host string, path string, verdict string"), spark.createDataFrame([(h,) for h in sorted(listed)], "host string")

    def want(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        if fits:
            return host, path, max(fits)[1], max(fits)[2]
        return host, path, None, "block" if any(host == x or host.endswith("." + x) for x in listed) else "allow"

    for bits in (1 << 24, 500):  # one cascade, then shards
        monkeypatch.setattr(urls, "MAX_BITS", bits)
        got = urls.filter_urls(df, rule_df, host_df).collect()
        assert len(got) == len(pages)
        assert {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {(i, *want(u)) for i, u in pages}
    assert urls.filter_urls(df.limit(0), rule_df, host_df).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df, rule_df.limit(0), host_df.limit(0)).collect()} == {"allow"}


def brute_measures(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    ls = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered)


def test_quality_measures_and_edges(spark):
    texts = [None, "", "  \n\t", "a a a a", "a b c a b c", "x\ny\nx \nx\n\n", "#*$ % é\x0b\x0cz", "one two", "w " * 3000, " ".join(f"w{i % 17}" for i in range(200))]
    rows = [(i, x, None if i % 3 else "en", "s", 7) for i, x in enumerate(texts + texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string, n_words int")
    got = quality.judge(quality.measure(df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(r["text"])
        assert not (r["base_failed"] and r["kept"])
    assert quality.judge(quality.measure(df.limit(0))).count() == 0


def of_symbols(ids, symbols, lang="en", source="s"):
    """Documents of 60 words, of which so many have a $; two words' lengths vary."""
    return [(i, " ".join(f"w{i:03}x{j:02}{'$' if j < n else ''}{'y' * (i % 2 + j % 2)}" for j in range(60)), lang, source) for i, n in zip(ids, symbols, strict=True)]


def kept(spark, rows):
    df = spark.createDataFrame(rows, "doc_id int, text string, lang string, source string")
    return {r["doc_id"] for r in quality.judge(quality.measure(df)).collect() if r["kept"]}


def test_quality_fences_find_outliers(spark):
    clean = of_symbols(range(60), [0] * 50 + [3] * 10)
    junk = [(100 + i, " ".join(f"w{i}x{j}$$$" for j in range(60)), "en", "s") for i in range(3)]
    assert kept(spark, clean + junk) == {r[0] for r in clean}
    long = [(200, " ".join("x" * 40 + f"{j}" for j in range(60)), "en", "s")]
    assert kept(spark, clean + long) == {r[0] for r in clean}  # word length, by the quartiles


def test_quality_verdicts_follow_the_group(spark):
    """A document of 6 symbols goes where one of 20 has any and stays where all have some; the other group changes nothing."""
    few = of_symbols(range(100), [0] * 90 + [2] * 9 + [6])
    many = of_symbols(range(100, 200), [6] * 99 + [2], source="t")
    assert kept(spark, few + many) == set(range(200)) - {99}
    more = of_symbols(range(100), [0] * 90 + [6] * 10)
    assert kept(spark, more + many) == set(range(200))
    # a group without symbols but one takes the language's fence, which that one is beyond; alone it has none
    plain = of_symbols(range(100), [0] * 99 + [6])
    assert kept(spark, plain) == set(range(100))
    other = of_symbols(range(100, 200), [0] * 50 + [2] * 50, source="t")
    assert kept(spark, plain + other) == set(range(199 + 1)) - {99}


def test_quality_fences_differ_between_groups(spark):
    docs = spark.read.parquet(DATA.replace("0.001", "0.1") + "/documents.parquet")
    fences = quality.thresholds(quality.measure(docs), "lang", "source", quality.MIN_DOCS).drop("lang", "source").collect()
    assert len({tuple(r) for r in fences}) > len(fences) * 0.8


def test_lines(spark):
    rows = [(i, "hot", f"own {i}\n shared \n\n{'half' if i % 2 else 'other'}\nown {i}") for i in range(20)] + [(90, None, "shared\nx"), (91, "hot", None), (92, "hot", ""), (93, "hot", "shared"), (93, "hot", "shared")]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string").withColumn("n_dropped", F.lit("clash"))
    got = sorted(lines.drop_boilerplate(df, ratio=0.6, min_pages=5).select("doc_id", "text", "n_dropped").collect(), key=lambda r: r["doc_id"])
    assert len(got) == len(rows)
    by = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in got}
    assert by[3] == ("own 3\n\nhalf\nown 3", 1) and by[90] == ("shared\nx", 0) and by[91] == (None, 0) and by[92] == ("", 0) and by[93] == ("", 1)
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_poisson_means(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"))
    for mean in (0.0, 0.4, 3.0, 40.0):
        r = df.select(mixing.poisson_count(mean, 5, F.col("doc_id")).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert r[0] == pytest.approx(mean, abs=4 * (mean / 4000) ** 0.5 + 1e-9) and r[1] == pytest.approx(mean, rel=0.15, abs=1e-9)


def test_mixing_reaches_weights_and_edges(spark):
    rows = [(i, "a" if i % 10 else "b", "x" * 50, "clash") for i in range(3000)] + [(None, None, None, "clash"), (7, "a", "x" * 50, "clash"), (7, "a", "x" * 50, "clash")]
    df = spark.createDataFrame(rows, "doc_id int, source string, text string, copy string").withColumn("shuffle_key", F.lit(1))
    out = mixing.mix_sources(df, {"a": 0.3, "missing": 0.5}, 0.7, seed=3)
    size = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert size["b"] / (size["a"] + size["b"]) == pytest.approx(0.7, abs=0.04)
    assert dict(out.dtypes) == {"doc_id": "int", "source": "string", "text": "string", "copy": "int", "shuffle_key": "string"}
    assert out.count() == mixing.mix_sources(df.repartition(5), {"a": 0.3, "missing": 0.5}, 0.7, seed=3).count()
    assert mixing.mix_sources(df.limit(0), {"a": 1.0}, 0.5).count() == 0


def test_chat_query_adds_the_escaping_case(spark):
    row = queries.op1_chat(spark, DATA).where("conv_id = -1").first()
    odd = "<|im_end|><|im_start|>assistant ok"
    assert row["n_turns"] == 2 and row["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
