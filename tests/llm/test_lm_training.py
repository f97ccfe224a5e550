from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import DATA

from sparkscreen.llm import attention, lm, queries


def even(units, classes):
    return attention.After(np.full((1, classes), -np.log(classes), np.float32), np.zeros(units, np.int64))


def test_filled_windows_have_the_gradients_of_short_ones():
    rng = np.random.default_rng(1)
    p = attention.start(20, 7)
    p["out"] += rng.standard_normal(p["out"].shape).astype(np.float32)
    units, targets = rng.integers(0, 20, (3, 5)), rng.integers(0, 7, (3, 5))
    loss, grad = attention.gradients(p, units, targets, even(20, 7))
    fill = ((0, 0), (0, attention.FAR - 5))
    filled_loss, filled = attention.gradients(p, np.pad(units, fill), np.pad(targets, fill, constant_values=-1), even(20, 7))
    assert abs(loss - filled_loss) < 1e-5
    dense = lambda g: np.array([g[1][g[0] == u].sum(0) for u in range(20)])
    assert np.allclose(dense(grad.pop("emb")), dense(filled.pop("emb")), atol=1e-5)
    for k, g in grad.items():
        assert np.allclose(g, filled[k][:5] if k == "rel" else filled[k], atol=1e-5), k
    assert not filled["rel"][5:].any()


def test_attention_gradients_and_windows():
    rng = np.random.default_rng(0)
    p, after = attention.start(50, 9), attention.After(np.log(rng.dirichlet(np.ones(9), 5)).astype(np.float32), np.arange(50) % 5)
    p["out"] += rng.standard_normal(p["out"].shape).astype(np.float32)
    u, t = rng.integers(0, 50, (4, attention.FAR)), rng.integers(0, 9, (4, attention.FAR))
    _, grad = attention.gradients(p, u, t, after)
    emb = np.zeros_like(p["emb"])
    emb[grad["emb"][0]] = grad["emb"][1]
    grad["emb"] = emb
    for name in attention.NAMES:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
        up[name][at] += 1e-2
        down[name][at] -= 1e-2
        assert grad[name][at] == pytest.approx((attention.gradients(up, u, t, after)[0] - attention.gradients(down, u, t, after)[0]) / 2e-2, rel=0.05)
    # the first window of a text sees what training sees; a text's score doesn't depend on its neighbours
    flat, doc = np.concatenate([u[0], u[1]]), np.repeat([0, 1], attention.FAR)
    both = attention.score(p, flat, np.concatenate([t[0], t[1]]), doc, after)
    alone = attention.score(p, u[1], t[1], np.zeros(attention.FAR, int), after)
    assert both[attention.FAR :] == pytest.approx(alone, abs=1e-5)
    assert -alone[: attention.STRIDE].mean() == pytest.approx(attention.gradients(p, u[1:2, : attention.STRIDE], t[1:2, : attention.STRIDE], after)[0], abs=1e-4)


def test_short_texts_train_the_model(spark):
    size = 12
    own = np.arange(size)
    classes = lm.Classes(own, own, 0 * own, even(size, size), np.zeros((1, size)), size, size, own >= 0, np.zeros(0, np.uint64), 1)
    windows = spark.createDataFrame([(i, [11, 1, 2, 11]) for i in range(2000)], "n bigint, window array<int>")
    p = lm._trained(windows, classes, 6000)
    run, doc = np.array([11, 1, 2]), np.zeros(3, np.int64)
    got = attention.score(p, run, np.array([1, 2, 11]), doc, classes.after)
    assert (got > np.log(0.5)).all(), got


def test_windows_hold_every_subword_of_the_training_texts(spark):
    table = lm.read_ranks(queries.VOCABULARY)
    docs = spark.createDataFrame([(i, f"word{i} stands in a text " * (i % 40)) for i in range(200)] + [(None, None)], "doc_id bigint, text string")
    found = lm._counted(docs, spark.sparkContext.broadcast(table), 7, 2).collect()
    total: dict[int, int] = {}
    for r in found:
        if r["id"] is not None:
            total[r["id"]] = total.get(r["id"], 0) + r["n"]
    seen: dict[int, int] = {}
    for w in (r["window"] for r in found if r["window"] is not None):
        assert 2 <= len(w) <= attention.FAR + 1
        for i in w[1:]:
            seen[i] = seen.get(i, 0) + 1
    assert total and seen == total


def test_shares_of_all_subwords_sum_to_one_after_each_and_each_counted_one_is_a_unit(spark):
    ranks = {(b" " if i % 3 else b"") + bytes([97 + i // 676, 97 + i // 26 % 26, 97 + i % 26]): i for i in range(3000)}
    ids = [i * i % 2000 for i in range(6000)]
    windows = spark.createDataFrame([(0, ids[i : i + 10]) for i in range(0, 6000, 10)], "n bigint, window array<int>")
    rng = np.random.default_rng(0)
    words = rng.choice(sorted(set(ids)), 4000), np.arange(0, 4000, 4), rng.integers(1, 50, 1000)
    spelled = [(words[0][a : a + 4].tolist(), int(n), int(n) // 6) for a, n in zip(*words[1:], strict=True)]
    got = lm._classes({i: ids.count(i) for i in set(ids)}, windows, ranks, spark.createDataFrame(spelled, "ids array<int>, n bigint, m bigint"))
    assert len(np.unique(got.unit[sorted(set(ids))])) == len(set(ids))
    own, table = got.row[got.unit], got.after.table
    for before in (0, ids[1], 1999, 2500):
        p = np.exp(table[got.after.row[got.unit[before]]][got.label[got.unit]].astype(float) + got.inner[own[before], got.unit])
        assert p.sum() == pytest.approx(1, abs=2e-3)
    # after the beginning of a known word, too, and after one that no known word has
    for word in (words[0][8:11], words[0][40:42], np.array([2500, 2501])):
        units = got.unit[word]
        row = got.rows(lm._beginnings(units, np.array([0]), got.label)[0], units)[-1]
        assert (row >= got.more) == (word[0] < 2500)
        assert (got.running(units[None])[0, -1] == row) or not got.starts[units[0]] or got.starts[units[1:]].any()
        every = np.concatenate([np.append(units, u) for u in got.unit])
        inner = lm._spelled(got, every, np.arange(0, len(every), len(word) + 1))[len(word) :: len(word) + 1]
        assert np.exp(table[row][got.label[got.unit]].astype(float) + inner).sum() == pytest.approx(1, abs=2e-3)
    assert (attention.STRIDE, attention.FAR) == (16, 32)


def test_score_does_not_depend_on_partitions(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(100)
    a, b = ({r["doc_id"]: r["score"] for r in lm.score_documents(d, queries.VOCABULARY).collect()} for d in (docs.coalesce(1), docs.repartition(5)))
    assert a == pytest.approx(b, rel=1e-6)


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_held_out_score_beats_the_unigram_base(spark, sf):
    got = lm.score_documents(spark.read.parquet(DATA.replace("0.001", sf) + "/documents.parquet"), queries.VOCABULARY).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * (1 if sf == "0.01" else 0.97)
    assert (held.score > held.base_score).mean() > (0.5 if sf == "0.01" else 0.6)


def test_no_training_texts_leave_a_model_of_unseen_subwords(spark):
    docs = spark.createDataFrame([(i, t) for i in range(60) if lm.is_held_out([i], 7, 2)[0] for t in ("some words", None, "")], "doc_id bigint, text string")
    got = lm.score_documents(docs, queries.VOCABULARY).toPandas()
    assert len(got) == docs.count() and (got.train_tokens == 0).all() and np.isfinite(got.score).all() and (got.score < 0).all()


def mix(h: int) -> int:
    for _ in range(2):
        h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def begun_as(units: tuple) -> int:
    """The hash of a word's beginning."""
    h = mix(units[0] + 1)
    for u in units[1:]:
        h = mix((h * 31 + mix(u + 1)) % 2**64)
    return h


@pytest.fixture(scope="module")
def fitted(spark):
    got = lm.fit(spark.read.parquet(f"{DATA}/documents.parquet"), queries.VOCABULARY)
    yield got
    got.tables.drop()


def word_units(fitted, text):
    coder, unit = lm.Coder(fitted.ranks), fitted.model.classes.unit
    words = [w.decode() for w in (text or "").encode().lower().split()]
    return [tuple(unit[coder.encoding.encode_ordinary(" " + w)].tolist()) for w in words] + [(int(unit[coder.end_id]),)]


def test_spelling_is_counted_from_every_training_word(spark, fitted):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    c, counts, goes, ends = fitted.model.classes, {}, {}, {}
    coder = lm.Coder(fitted.ranks)
    spelled = {w: tuple(c.unit[coder.encoding.encode_ordinary(" " + w)].tolist()) for r in rows for w in (w.decode() for w in (r["text"] or "").encode().lower().split())}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            for w in (r["text"] or "").encode().lower().split():
                u = spelled[w.decode()]
                for k in range(2, len(u) + 1):
                    counts[u[:k]] = counts.get(u[:k], 0) + 1
                    goes.setdefault((u[: k - 1], int(c.label[u[k - 1]])), {}).setdefault(u[:k], 0)
                    goes[u[: k - 1], int(c.label[u[k - 1]])][u[:k]] += 1
                ends[u] = ends.get(u, 0) + 1
    s = c.spelling
    assert dict(zip(s.begun.tolist(), s.n.tolist(), strict=True)) == {begun_as(u): n for u, n in counts.items()}
    want = {mix((begun_as(b) + label * 2 + 1) % 2**64): (sum(n.values()), lm.DISCOUNT * len(n)) for (b, label), n in goes.items()}
    assert dict(zip(s.group.tolist(), zip(s.total.tolist(), s.left.tolist(), strict=True), strict=True)) == want
    assert len(c.beginnings) == min(lm.BEGIN_ROWS, len(counts)) and c.weight in lm.AFTER_WEIGHTS
    # the classes after a beginning: how words go on, and, where they end, what begins words after its last subword's bucket
    k, begins = c.n_classes, np.zeros(c.n_classes)
    begins[c.label[c.starts]] = 1
    for u in sorted(counts, key=lambda u: (-counts[u], u))[:50]:
        at = np.searchsorted(c.beginnings, np.uint64(begun_as(u)))
        assert c.beginnings[at] == begun_as(u)
        bucket = np.exp(c.after.table[c.row[u[-1]]].astype(float)) * begins
        n = ends.get(u, 0) * bucket / bucket.sum()
        for label in range(k):
            n[label] += sum(goes.get((u, label), {}).values())
        less = np.exp(c.after.table[c.after.row[u[-1]]].astype(float))
        assert np.exp(c.after.table[c.more + at]) == pytest.approx((n + c.weight * less) / (n.sum() + c.weight), rel=1e-4)


def test_beginnings_that_are_not_kept_stay_in_the_sums(spark, monkeypatch):
    ranks = {bytes([97 + i]) if i else b" a": i for i in range(20)}
    words = [([0, *t], n, 0) for t, n in (((1, 2), 90), ((1, 3), 40), ((1, 4), 1), ((2,), 60), ((5, 6, 7), 1))]
    windows = spark.createDataFrame([(0, [i for w, _, _ in words for i in w] + [20])], "n bigint, window array<int>")
    monkeypatch.setattr(lm, "SPELLED", 5)
    got = lm._classes({i: 9 for i in range(21)}, windows, ranks, spark.createDataFrame(words, "ids array<int>, n bigint, m bigint"))
    assert sorted(got.spelling.n.tolist()) == [40, 60, 90, 131]
    own = np.flatnonzero(got.unit < got.n_units)
    for word in ([0, 1], [0, 5], [0]):
        units = got.unit[word]
        every = np.concatenate([np.append(units, u) for u in got.unit[own]])
        inner = lm._spelled(got, every, np.arange(0, len(every), len(word) + 1))[len(word) :: len(word) + 1]
        for label in np.unique(got.label[got.unit[own]]):
            of = got.label[got.unit[own]] == label
            assert np.exp(inner[of].astype(float)).sum() == pytest.approx(1, abs=2e-3)


def test_most_frequent_rows_are_within_the_bound(spark):
    rows = spark.createDataFrame([(i, 1 if i > 30 else 1 + i % 7) for i in range(200)], "k bigint, n bigint")
    for most in (0, 3, 29, 60, 500):
        got = [r["n"] for r in lm._most(rows, "n", most).collect()]
        every = sorted((r["n"] for r in rows.collect()), reverse=True)
        assert len(got) <= most and sorted(got, reverse=True) == every[: len(got)]
        assert len(got) == len(every) or every[len(got)] < min(got, default=99)


def test_scores_are_those_of_the_fitted_model_position_by_position(spark, fitted):
    """Every text of sf0.001 scored again one subword at a time, with dictionaries and loops."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in lm.score_by(docs, fitted).collect()}
    c, p = fitted.model.classes, {k: v.astype(float) for k, v in fitted.model.params.items()}
    s, st = c.spelling, attention.STRIDE
    begun, group = dict(zip(s.begun.tolist(), s.n.tolist(), strict=True)), {g: (t, f) for g, t, f in zip(s.group.tolist(), s.total.tolist(), s.left.tolist(), strict=True)}
    rows = {h: c.more + i for i, h in enumerate(c.beginnings.tolist())}
    query, key, value = p["emb"] @ p["wq"] / attention.WIDTH**0.5, p["emb"] @ p["wk"], p["emb"] @ p["wv"]
    memo: dict[tuple, tuple[int, float]] = {}

    def word(u: tuple) -> tuple[int, float]:
        """(row of the class shares after a beginning; log share of its last subword in its class)."""
        if u not in memo:
            share = 0.0
            if len(u) > 1:
                less = np.exp(float(c.inner[c.row[u[-2]], u[-1]]))
                total, left = group.get(mix((begun_as(u[:-1]) + int(c.label[u[-1]]) * 2 + 1) % 2**64), (0, 0))
                share = np.log((max(begun.get(begun_as(u), 0) - lm.DISCOUNT, 0) + left * less) / total) if total else np.log(less)
            memo[u] = rows.get(begun_as(u), int(c.after.row[u[-1]])) if len(u) > 1 else int(c.after.row[u[0]]), share
        return memo[u]

    end = int(c.unit[lm.Coder(fitted.ranks).end_id])
    for r in docs.select("doc_id", "text").collect():
        seen, last, score = [end], int(c.after.row[end]), 0.0
        for u in word_units(fitted, r["text"]):
            for k in range(len(u)):
                at = len(seen) - 1
                near = np.array(seen[max(0, at // st * st - st) :])
                a = key[near] @ query[seen[-1]] + p["rel"][np.arange(len(near))[::-1]]
                a = np.exp(a - a.max())
                h = p["emb"][seen[-1]] + (a / a.sum()) @ value[near] @ p["wo"]
                h = h + np.maximum(h @ p["w1"] + p["b1"], 0) @ p["w2"]
                z = c.after.table[last] + h @ p["out"]
                score += z[c.label[u[k]]] - z.max() - np.log(np.exp(z - z.max()).sum())
                score += word(u[: k + 1])[1] if k else float(c.inner[c.row[seen[-1]], u[0]])
                seen.append(u[k])
                last = word(u[: k + 1])[0]
        assert got[r["doc_id"]] == pytest.approx(score / np.log(10), rel=1e-4, abs=1e-3), r["doc_id"]


class Counted:
    """An encoding that counts its calls."""

    def __init__(self, encoding):
        self.encoding, self.calls = encoding, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.encoding.encode_ordinary(text)


@pytest.mark.parametrize("other", ["", " ", "　x", "a ", "\x85"])
def test_new_words_are_encoded_in_a_row_as_one_by_one(other):
    coder = lm.Coder(lm.read_ranks(queries.VOCABULARY))
    words = [w.encode() for k in range(300) for w in (f"word{k}", f"'s{k}'", f"überЖ{k}", f"--{k * k}..", f"中{k}文", "�" * k)] + [b"\xff\xfe", *([other.encode()] * bool(other)), other.encode() + b"a", b"end"]
    words = [w for w in words if w]
    coder.encoding = Counted(coder.encoding)
    ids, n, _ = coder.subwords(coder.numbers([words[:900], words[900:] + words[:5]]))
    assert coder.encoding.calls == 1 or other
    want = [coder.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
    want = [*want[:900], [coder.end_id], *want[900:], *want[:5], [coder.end_id]]
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]


def test_training_sends_ids_of_two_bytes_and_its_windows_go(spark, fitted):
    import glob

    assert len(glob.glob(fitted.tables.folder.removeprefix("file://") + "/*")) == 1  # the words
    size = 12
    own, sent = np.arange(size), []
    classes = lm.Classes(own, own, 0 * own, even(size, size), np.zeros((1, size)), size, size, own >= 0, np.zeros(0, np.uint64), 1)
    windows = spark.createDataFrame([(i, [11, 1, 2, 11]) for i in range(200)], "n bigint, window array<int>")
    kind = type(windows)
    repartition = kind.repartitionById
    with pytest.MonkeyPatch.context() as m:
        m.setattr(kind, "repartitionById", lambda self, *a: sent.append(dict(self.dtypes)["window"]) or repartition(self, *a))
        lm._trained(windows, classes, 600)
    assert sent == ["array<smallint>"] * lm.ROUNDS


def test_hashes_are_found_where_they_are_without_a_search_of_the_whole_table(fitted, monkeypatch):
    rng = np.random.default_rng(0)
    edges = np.array([0, 1, 2, 3, 2**63, 2**64 - 2, 2**64 - 1], np.uint64)  # some share their first bits
    for table in (edges[:0], edges[-1:], edges, np.unique(np.concatenate([edges, rng.integers(0, 2**64, 3000, np.uint64)]))):
        keys = np.concatenate([rng.permutation(table), rng.integers(0, 2**64, 500, np.uint64), edges, table[:9]])
        own, at = lm.Lookup(table)(keys)
        assert sorted(own.tolist()) == np.flatnonzero(np.isin(keys, table)).tolist() and (table[at] == keys[own]).all()
    c, monkeypatched = fitted.model.classes, []
    units = rng.integers(0, c.n_units, (50, attention.FAR))
    monkeypatch.setattr(np, "searchsorted", lambda *a, **_: monkeypatched.append(a))
    rows, place = c.running(units), dict(zip(c.beginnings.tolist(), range(len(c.beginnings)), strict=True))
    assert not monkeypatched
    for u, r in zip(units.tolist(), rows.tolist(), strict=True):
        h = 0
        for unit, row in zip(u, r, strict=True):
            alone = mix(unit + 1)
            h = alone if c.starts[unit] else mix((h * 31 + alone) % 2**64)
            assert row == (c.more + place[h] if h in place else c.after.row[unit])


def test_classes_in_parts_have_the_gradients_of_the_whole(monkeypatch):
    rng = np.random.default_rng(2)
    p, after = attention.start(30, 21), attention.After(np.log(rng.dirichlet(np.ones(21), 6)).astype(np.float32), np.arange(30) % 6)
    p["out"] += rng.standard_normal(p["out"].shape).astype(np.float32)
    u, t = rng.integers(0, 30, (7, attention.FAR)), rng.integers(-1, 21, (7, attention.FAR))
    loss, grad = attention.gradients(p, u, t, after)
    monkeypatch.setattr(attention, "PART", 50)
    got, parts = attention.gradients(p, u, t, attention.After(attention.wide(after.table), after.row))
    assert got == pytest.approx(loss, rel=1e-6) and grad["out"].shape == p["out"].shape
    assert (grad["emb"][0] == parts["emb"][0]).all()
    for k, g in grad.items():
        assert np.allclose(*(x[1] if k == "emb" else x for x in (g, parts[k])), atol=1e-6), k
