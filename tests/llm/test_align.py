"""Alignment of two tokenizers, against byte sets in plain Python."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from compare import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscreen.llm import align, queries


def brute(rows):
    """Of each text: n_a, n_b, n_groups, n_links, n_best, count_sum, groups."""
    one, two = Tokenizer.from_file(queries.ALIGN_A), sentencepiece.SentencePieceProcessor(model_file=queries.ALIGN_B)
    one.encode_special_tokens = True
    alphabet = align.byte_alphabet()
    found, counts = [], Counter()
    for text in rows:
        want = f" {text or ''}".encode()
        a = one.encode(want.decode(), add_special_tokens=False).ids if text else []
        b = two.encode(text) if text else []
        ranges = []
        for ids, data in ((a, lambda i: bytes(alphabet[c] for c in one.id_to_token(i))), (b, lambda i: bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())):
            joined, own = b"", []
            for i in ids:
                own.append((len(joined), len(joined := joined + data(i))))
            ranges.append((own, joined))
        if not text or any(joined != want for _, joined in ranges):
            found.append(([], [], "", 0, 0))
            continue
        (ra, _), (rb, _) = ranges
        links, first = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[first][1] <= s:
                first += 1
            j = first
            while j < len(rb) and rb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        cut = lambda ids, own, s, e: ",".join(str(i) for i, (x, y) in zip(ids, own, strict=True) if s <= x and y <= e)
        small = len(text) < 3000
        groups = ";".join(f"{cut(a, ra, s, e)}|{cut(b, rb, s, e)}" for s, e in zip([0, *ends], ends, strict=False)) if small else None
        found.append((a, b, groups, len(ends), links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), n, len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), groups) if a else (0, 0, 0, 0, 0, 0, "") for a, b, groups, n, ls in found]


TEXTS = [
    None, "", " ", "  ", "a", "Hello world", " leading", "trailing ", "two  spaces   three\n\n\nlines\t\tend\r\n", "naïve Überraschung 你好 🙂 é", "<|endoftext|> <s> </s> <unk> <0x41>",
    "▁ odd ▁piece", "x\x00y", "don't we'll THEY'RE 12345678 3.14159", "Hello world", " nbsp em", "supercalifragilisticexpialidocious" * 9, "The idea of 7 words in " * 40, "ﬁ ligature ① ½",
]


@pytest.mark.parametrize(("frequent", "few"), [(1 << 21, None), (40, 30), (1, 1)])
def test_equals_brute_force(spark, monkeypatch, frequent, few):
    monkeypatch.setattr(align, "FREQUENT", frequent)
    for name in ("TOKENS", "KEPT", "AT_ONCE", "BYTES", "COUNTED") if few else ():
        monkeypatch.setattr(align, name, few)
    docs = [r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").limit(40).collect()]
    rows = [*enumerate([*TEXTS, *docs]), (5, "Hello world"), (None, docs[0])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("groups", F.lit(1)).withColumn("pair", F.lit("p")).repartition(4)
    got = align.align(df, queries.ALIGN_A, queries.ALIGN_B).collect()
    assert len(got) == len(rows) and got[0]["pair"] == "p"
    want = sorted(zip(((i if i is not None else -1, t or "") for i, t in rows), brute([t for _, t in rows]), strict=True))
    key = lambda r: (r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "")
    assert sorted((key(r), tuple(r[c] for c in align.RESULTS)) for r in got) == want
    assert sum(r["n_a"] == 0 for r in got) >= 2 and max(r["n_best"] for r in got) > 0


def test_cut_texts_are_encoded_as_whole_ones():
    with open(queries.ALIGN_A, "rb") as a, open(queries.ALIGN_B, "rb") as b:
        pair = align.Pair(a.read(), b.read())
    text = ("It is, by 1999 and  then don't\n go \t é b| (x) ¨ ́z\u00a0 \u3000 n\x1c o \x85 p 你 好 's 't \n" * 5000) + "x" * 1000
    rows = [text.encode(), b"\xff broken", None, b"", b" ", b" a b ", "▁ a".encode(), b"a b"]
    assert pair.cuts and len(align.parts(text)) > 50_000
    lists = lambda ids, n: [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    cut = [lists(*x) for x in pair.encode(rows)]
    pair.cuts = False
    pair.forget()
    whole = [lists(*x) for x in pair.encode(rows)]
    assert cut == whole and [bool(x) for x in cut[0]] == [True, False, False, False, True, True, False, True]


def test_long_text_and_empty_table(spark):
    long = "word after word " * 60_000 + "y" * 50_000
    df = spark.createDataFrame([(1, long), (2, "word after word")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in align.align(df, queries.ALIGN_A, queries.ALIGN_B, columns=["doc_id"]).collect()}
    want = brute([long, "word after word"])
    assert [tuple(got[1][c] for c in align.RESULTS[:-1]), tuple(got[2][c] for c in align.RESULTS)] == [want[0][:-1], want[1]]
    assert align.align(df.limit(0), queries.ALIGN_A, queries.ALIGN_B).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: w for r, w in zip(docs, brute([r["text"] for r in docs]), strict=True)}
    got = queries.op13_align(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        *numbers, groups = want[r["doc_id"]]
        assert [r[c] for c in align.RESULTS[:-1]] == numbers
        if groups is not None:
            assert r["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
