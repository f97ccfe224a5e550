"""N-gram Jaccard join with a token-group matrix: components of documents that share at least 75 % of their shingles.

A document's tokens are its distinct 5-word shingles (fewer words: the whole sequence), as 64-bit hashes. Documents with the
same words are one class, whose smallest id represents it; the join is over classes:

1. Candidates. A class that is linked with any lacks at most a quarter of its own tokens in the other. Tokens with small
   hashes (a share of all that is larger for short texts) are held against all texts: a class with more than a quarter of
   its tokens among those that no other class has is linked with nothing. A task sends a token that several of its texts
   have but twice, so a token of very many texts makes no large group.
2. Groups. The full sets of the others are made, and their tokens counted. In an order common to all, rarer tokens first,
   two linked sets share a token of their first n - ceil(0.75 n) + 1. A class's group is its smallest token that another
   class has, so groups hold similar documents, in blocks of about BLOCK members of like size. Links inside a block are
   found there: found members are expanded until none is left, and members that a chain of links connects aren't compared.
3. Matrix. It has a row (token, group) for the first tokens of a group's members, and each group's union of all tokens is
   stored. First each class asks the one group that the matrix says most of its tokens began in; then, labels being merged,
   the smaller component's members ask all groups of other components that have their tokens, where the number of shared
   first tokens and the sizes allow a link. A group whose union has too few of the asking class's tokens is not opened;
   members of the others are compared with it.

Every pair that shares one of its first tokens is in one component already, or cannot reach 75 % by an exact bound, or is
compared; so no link is lost but to equal 64-bit hashes. A block, and those who ask it in one task, have about BLOCK members
and BLOCK_TOKENS tokens of 8 bytes at most, or one set if that is larger; a task holds both, each up to four times over while
sets are taken apart, sorted and laid in a row: with sets of up to BLOCK_TOKENS about 256 MB.

Nulls and empty texts have no shingles and link with nothing; a null id is the smallest id. Rows that share an id are one
node of the graph, so their links are those of all their texts. Repeated rows are returned as rows. An empty table gives no
rows. Columns other than the id and the text are left out. A full set is held in one row, so its text must fit in a row; a
very long text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, small, written
from .components import components
from .tokens import chunks, shingles, space_words, texts, word_hashes

SHINGLE = 5
#: Linked: NUM * union <= DEN * intersection.
NUM, DEN = 75, 100
#: Members of a block, and classes that ask a block in one task's group; their tokens.
BLOCK, BLOCK_TOKENS = 256, 1 << 21
#: Sizes within this ratio count as alike where a group has more members than a block.
SIZE_STEP = 1.1
#: Share of the tokens that is held against all texts: LOW_SHARE + LOW_MORE / sqrt(n), for a set of n.
LOW_SHARE, LOW_MORE = 0.3, 1.0
#: Tokens that a task holds against each other before it sends them; classes that it remembers.
UNIT_TOKENS, SEEN_CLASSES = 2_000_000, 1_000_000
NULL_ID = -(1 << 63)


def sets_of(rows: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    flat, counts = word_hashes(rows)
    grams = shingles(flat, SHINGLE)
    out, at = [], 0
    for n in counts.tolist():
        own = grams[at : at + n - SHINGLE + 1] if n >= SHINGLE else shingles(flat[at : at + n], n) if n else grams[:0]
        out.append(np.unique(own))
        at += n
    return out


def class_keys(rows: list[bytes | None]) -> np.ndarray:
    """(texts, 2): 128 bits for the words of each text; the first 64 name the class where that is enough."""
    keys = b"".join(xxhash.xxh3_128_digest(b" ".join(space_words(r))) for r in rows)
    return np.frombuffer(keys, ">i8").astype(np.int64).reshape(-1, 2)


def linked(a: int, b: int, common: np.ndarray | int) -> np.ndarray | bool:
    return DEN * common >= NUM * (a + b - common)


def least_shared(n: str, n_min: str, n_max: str) -> str:
    """SQL of the fewest prefix tokens that a set of n tokens shares with a linked one of n_min to n_max tokens.

    Sets of n and m tokens that share c prefix tokens overlap in at most c and what lies beyond the longer prefix. What m
    needs grows up to n; beyond n it falls, but for the two roundings, which may lift an end by less than 2 over a size
    before it. So the least is at the lower end or at one of the last sizes, which are all looked at."""
    low = f"greatest({n_min}, ({NUM} * {n} + {DEN - 1}) div {DEN})"
    high = f"least({n_max}, {DEN} * {n} div {NUM})"
    last = -(-2 * DEN * (NUM + DEN) // (NUM * NUM))
    need = lambda m: f"({NUM} * ({n} + {m}) + {NUM + DEN - 1}) div {NUM + DEN} - ({NUM} * greatest({n}, {m}) + {DEN - 1}) div {DEN} + 1"
    return f"least({', '.join(need(m) for m in [low, *(f'greatest({low}, {high} - {k})' for k in range(last))])})"


def _id(c: str) -> Column:
    return F.coalesce(F.col(c).cast("bigint"), F.lit(NULL_ID))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc, k1, k2): the class of each document; null if it has no words."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column("text"))
            none = np.fromiter((not r or r.isspace() for r in raw), bool, len(raw))
            keys = class_keys(raw)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *(pa.array(keys[:, k], mask=none) for k in (0, 1))], names=["doc", "k1", "k2"])

    return docs.mapInArrow(emit, "doc bigint, k1 bigint, k2 bigint")


def low_share(n: np.ndarray) -> np.ndarray:
    """Falls as n grows, so that a set has sent what any linked one up to its size holds against it."""
    return LOW_SHARE + LOW_MORE / np.sqrt(np.maximum(n, 1))


def _low_rows(sets: list[np.ndarray], sids: np.ndarray) -> pa.RecordBatch:
    """The low tokens of classes as rows (token, sid, own, n); own says whether one that no other class has counts against the
    class. A token that several have is sent for the first and the last of them only. Each class has a row with its n."""
    n = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    part = flat.astype(np.float64) / float(1 << 64)
    low = part < low_share(n)[owner]
    flat, owner, part = flat[low], owner[low], part[low]
    order = np.argsort(flat, kind="stable")
    flat, owner, part = flat[order], owner[order], part[order]
    new = np.ones(len(flat) + 1, bool)
    new[1:-1] = flat[1:] != flat[:-1]
    sent = new[:-1] | new[1:]
    at, own = owner[sent], part[sent] < low_share(n * DEN // NUM)[owner[sent]]
    rows, more = len(at), len(sets)
    column = lambda a, b, kind: np.concatenate([a, b]).astype(kind)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(column(flat[sent].view(np.int64), sids, np.int64)),
            pa.array(column(sids[at], sids, np.int64)),
            pa.array(column(own, np.zeros(more), bool)),
            pa.array(column(np.zeros(rows), n, np.int64), mask=np.arange(rows + more) < rows),
        ],
        names=["token", "sid", "own", "n"],
    )


def _lows(docs: DataFrame) -> DataFrame:
    """The rows of _low_rows(); of the texts of a class, a task sends one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            raw = texts(batch.column("text"))
            sets, sids, held = [], [], 0
            for a, b in chunks(raw):
                keys = class_keys(raw[a:b])
                new = []
                for i in range(b - a):
                    if (k := keys[i].tobytes()) not in seen and raw[a + i] and not raw[a + i].isspace():
                        seen.add(k)
                        new.append(i)
                sets += sets_of([raw[a + i] for i in new])
                sids.append(keys[new, 0])
                held += sum(map(len, sets[len(sets) - len(new) :]))
                if sets and (held > UNIT_TOKENS or b == len(raw)):
                    yield _low_rows(sets, np.concatenate(sids))
                    sets, sids, held = [], [], 0
                if len(seen) > SEEN_CLASSES:
                    seen.clear()

    return docs.mapInArrow(emit, "token bigint, sid bigint, own boolean, n bigint")


def _sized(lows: DataFrame) -> DataFrame:
    """Rows (sid, n, alive) of all classes: whether others have enough of the class's low tokens. Both aggregations begin in the
    tasks, so a token of very many texts brings a row a task."""
    ends = lows.groupBy("token", F.col("n").isNotNull().alias("whole")).agg(F.min("sid").alias("sid"), F.max("sid").alias("last"), F.max("own").alias("own"), F.max("n").alias("n"))
    ends = ends.where("whole or (own and sid = last)").groupBy("sid").agg(F.max("n").alias("n"), F.count_if(~F.col("whole")).alias("lacks"))
    return ends.selectExpr("sid", "n", f"lacks <= n - ({NUM} * n + {DEN - 1}) div {DEN} as alive")


def _sets(docs: DataFrame) -> DataFrame:
    """Rows (sid, doc, n, tokens): the full sets."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = texts(batch.column("text"))
            for a, b in chunks(raw):
                sets = sets_of(raw[a:b])
                n = np.array([len(s) for s in sets], np.int64)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(class_keys(raw[a:b])[:, 0]), batch.column("doc").slice(a, b - a), pa.array(n), tokens], names=["sid", "doc", "n", "tokens"])

    return docs.mapInArrow(emit, "sid bigint, doc bigint, n bigint, tokens array<bigint>")


def groups_in(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of one key after the other, from batches that are sorted by key."""
    rest: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not len(t):
            continue
        values = [t.column(k).to_numpy() for k in keys]
        new = np.zeros(len(t), bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest


def _lists(group: pa.Table, name: str = "tokens") -> list[np.ndarray]:
    """The list of each row, in signed order."""
    column = group.column(name).combine_chunks()
    values, ends = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])
    return [np.sort(values[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def common_tokens(a: np.ndarray, b: np.ndarray) -> int:
    return int((a[np.searchsorted(a, b).clip(max=len(a) - 1)] == b).sum()) if len(a) else 0


class Block:
    """Members by size, with their sets, and the lower part of their tokens in one flat array."""

    LOW = -(1 << 63) + (1 << 64) * 3 // 10

    def __init__(self, docs: list[int], sets: list[np.ndarray]):
        self.order = sorted(range(len(docs)), key=lambda i: len(sets[i]))
        self.docs, self.sets = np.array([docs[i] for i in self.order]), [sets[i] for i in self.order]
        self.sizes = np.array([len(x) for x in self.sets])
        lows = [self.lower(x) for x in self.sets]
        self.low = np.array([len(x) for x in lows])
        self.flat, self.starts = np.concatenate(lows), np.concatenate([[0], np.cumsum(self.low)])

    def lower(self, x: np.ndarray) -> np.ndarray:
        return x[: np.searchsorted(x, self.LOW)]

    def near(self, x: np.ndarray, alive: np.ndarray) -> list[int]:
        """The members, of those alive, that x is linked with: where the lower parts differ by no more than they may."""
        n, own = len(x), self.lower(x)
        a, b = np.searchsorted(self.sizes, -(-NUM * n // DEN)), np.searchsorted(self.sizes, n * DEN // NUM, "right")
        if a >= b or not alive[a:b].any():
            return []
        flat = self.flat[self.starts[a] : self.starts[b]]
        found = own[np.searchsorted(own, flat).clip(max=len(own) - 1)] == flat if len(own) else np.zeros(len(flat), bool)
        sums = np.concatenate([[0], np.cumsum(found)])
        apart = len(own) + self.low[a:b] - 2 * np.diff(sums[self.starts[a : b + 1] - self.starts[a]])  # a part of what may differ
        may = np.flatnonzero(alive[a:b] & (apart * (DEN + NUM) <= (n + self.sizes[a:b]) * (DEN - NUM))) + a
        return [i for i in may.tolist() if linked(n, int(self.sizes[i]), common_tokens(x, self.sets[i]))]


def connect(docs: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """(member, root) for all members of a block that are not roots; no member is linked with one of another root. The search
    begins at the smallest document."""
    block = Block(docs, sets)
    links, alive = [], np.ones(len(docs), bool)
    for root in sorted(range(len(docs)), key=lambda i: block.docs[i] != min(docs)):
        if not alive[root]:
            continue
        alive[root] = False
        frontier = [root]
        while frontier and alive.any():
            found = block.near(block.sets[frontier.pop(0)], alive)
            links += [(int(block.docs[i]), int(block.docs[root])) for i in found]
            alive[found] = False
            frontier += found
    return links


def _grouped(rows: DataFrame) -> DataFrame:
    """rows: g, block, sid, doc, tokens. Rows (g, block, a, b, tokens): links inside each block, and its union of tokens."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in(batches, ["g", "block"]):
            docs, sids, sets = group.column("doc").to_pylist(), group.column("sid").to_pylist(), _lists(group)
            one = list({s: i for i, s in enumerate(sids)}.values())
            links = connect([docs[i] for i in one], [sets[i] for i in one]) if len(one) > 1 else []
            union = np.unique(np.concatenate(sets))
            n = len(links) + 1
            key = [pa.array([group.column(c)[0].as_py()] * n, pa.int64()) for c in ("g", "block")]
            ends = [pa.array([*(x[k] for x in links), None], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*key, *ends, pa.array([*[None] * len(links), union], pa.list_(pa.int64()))], names=["g", "block", "a", "b", "tokens"])

    dealt = rows.repartition("g", "block").sortWithinPartitions("g", "block")
    return dealt.mapInArrow(find, "g bigint, block bigint, a bigint, b bigint, tokens array<bigint>")


MEETING = ["g", "block", "part"]


def _bounded(rows: DataFrame) -> DataFrame:
    """rows: g, block, part, sid (null: the group's union), tokens. The rows (sid, n, g, block) whose group may have a link."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in(batches, MEETING):
            sids, sets = group.column("sid").to_pylist(), _lists(group)
            union = next((x for s, x in zip(sids, sets, strict=True) if s is None), np.zeros(0, np.int64))
            found = [(s, len(x)) for s, x in zip(sids, sets, strict=True) if s is not None and DEN * common_tokens(union, x) >= NUM * len(x)]
            if found:
                key = [pa.array([group.column(c)[0].as_py()] * len(found), pa.int64()) for c in ("g", "block")]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*found, strict=True)), *key], names=["sid", "n", "g", "block"])

    return rows.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(find, "sid bigint, n bigint, g bigint, block bigint")


def _opened(rows: DataFrame) -> DataFrame:
    """rows: g, block, part, member (whether of the group or asking), doc, label, tokens. Links (a, b), one a label met."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_in(batches, MEETING):
            docs, label, sets = group.column("doc").to_pylist(), group.column("label").to_pylist(), _lists(group)
            member = group.column("member").to_pylist()
            own, asking = [i for i, m in enumerate(member) if m], [i for i, m in enumerate(member) if not m]
            if not own or not asking:
                continue
            block = Block([docs[i] for i in own], [sets[i] for i in own])
            labels = np.array([label[own[k]] for k in block.order])
            found = []
            for q in asking:
                once = {int(labels[i]): int(block.docs[i]) for i in block.near(sets[q], labels != label[q])}
                found += [(docs[q], other) for other in once.values()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return rows.repartition(*MEETING).sortWithinPartitions(*MEETING).mapInArrow(find, "a bigint, b bigint")


def _pieces() -> Column:
    """Blocks, or parts of those who ask, that rows with sets of n tokens make."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_TOKENS))


def _meetings(asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """asked: sid, n, g, block. (rows g, block, part, sid: those who ask, in parts of a block's size; rows g, block, part: all
    parts)."""
    parts = asked.groupBy("g", "block").agg(_pieces().alias("parts"))
    who = asked.join(parts, ["g", "block"]).select("g", "block", F.pmod(F.xxhash64("sid"), F.col("parts")).alias("part"), "sid")
    return who, parts.select("g", "block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))


class Join:
    """Sets, groups and unions of the classes that may have a link, as tables."""

    def __init__(self, tables: Tables, docs: DataFrame):
        self.t, w = tables, tables.written
        self.sets = w(_sets(docs))
        flat = self.sets.select("sid", "n", F.explode("tokens").alias("token"))
        counts = flat.groupBy("token").agg(F.count(F.lit(1)).alias("count")).where("count > 1")
        shared = flat.join(counts, "token").groupBy("sid").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("count", "token"))).alias("s"))
        need = f"({NUM} * n + {DEN - 1}) div {DEN}"
        first = f"slice(s, 1, cast(size(s) - {need} + 1 as int)).token"
        self.first = w(shared.where(f"size(s) >= {need}").selectExpr("sid", "n", "array_min(s.token) as g", f"{first} as first"))
        large = self.first.groupBy("g").agg((_pieces() > 1).alias("large"))
        step = F.when(F.col("large"), F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(SIZE_STEP)))).otherwise(F.lit(0).cast("bigint"))
        wanted = self.first.select("sid", "n", "g").join(large, "g").withColumn("step", step)
        blocks = wanted.groupBy("g", "step").agg(_pieces().alias("blocks"))
        place = (F.shiftleft(F.col("step"), 40) + F.pmod(F.xxhash64("sid"), F.col("blocks"))).alias("block")
        doc = self.sets.groupBy("sid").agg(F.min("doc").alias("doc"))
        self.home = w(wanted.join(blocks, ["g", "step"]).join(doc, "sid").select("sid", "doc", "n", "g", place))
        rows = self.sets.select("sid", "tokens").join(self.home, "sid")
        self.found = w(_grouped(rows.select("g", "block", "sid", "doc", "tokens")))
        self.inside = self.found.where("a is not null").select("a", "b")

    def placed(self, links: DataFrame) -> DataFrame:
        """home with the label of each class's component."""
        named = components(links, self.t).withColumnsRenamed({"node": "doc"})
        return self.t.written(self.home.join(named, "doc", "left").withColumn("label", F.coalesce("label", "doc")))

    def tokens(self, placed: DataFrame) -> DataFrame:
        """Rows (token, sid, n, g, block, label) of the first tokens that two components and two groups have."""
        rows = self.first.select("sid", F.explode("first").alias("token")).join(placed.drop("doc"), "sid")
        cell = F.struct("g", "block")
        apart = rows.groupBy("token").agg(F.min(cell).alias("x"), F.max(cell).alias("y"), F.min("label").alias("u"), F.max("label").alias("v"))
        return self.t.written(rows.join(apart.where("x <> y and u <> v").selectExpr("token", "x.g as begun_g", "x.block as begun_block"), "token"))

    def sized(self, asked: DataFrame, placed: DataFrame) -> DataFrame:
        """asked (sid, n, label, g, block, ...) with n_min, n_max, where the group's sizes and labels allow a new link."""
        stats = placed.groupBy("g", "block").agg(F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min("label").alias("least"), F.max("label").alias("most"))
        return asked.join(stats, ["g", "block"]).where(f"n_max * {DEN} >= n * {NUM} and n * {DEN} >= n_min * {NUM} and (least <> label or most <> label)")

    def begun(self, placed: DataFrame) -> DataFrame:
        """Of the groups, other than its own, in which its tokens began, the one with most of a class's: rows (sid, n, g, block)."""
        rows = self.tokens(placed).where("g <> begun_g or block <> begun_block")
        asked = rows.groupBy("sid", "n", "label", F.col("begun_g").alias("g"), F.col("begun_block").alias("block")).agg(F.count(F.lit(1)).alias("c"))
        return self.sized(asked, placed).groupBy("sid", "n").agg(F.max_by(F.struct("g", "block"), F.struct("c", "g", "block")).alias("m")).selectExpr("sid", "n", "m.g as g", "m.block as block")

    def others(self, placed: DataFrame) -> DataFrame:
        """All groups of larger components with so many of a class's first tokens that a link is possible: rows (sid, n, g, block)."""
        weight = placed.groupBy("label").agg(F.count(F.lit(1)).alias("weight"))
        rows = self.t.written(self.tokens(placed).join(weight, "label").withColumn("rank", F.struct("weight", "label")))
        matrix = rows.groupBy("token", F.col("g").alias("p"), F.col("block").alias("q")).agg(F.max("rank").alias("top"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        new = "rank < top and (g <> p or block <> q) and (label <> lo or label <> hi)"
        asked = rows.select("token", "sid", "n", "label", "rank", "g", "block").join(matrix, "token").where(new)
        asked = asked.groupBy("sid", "n", "label", F.col("p").alias("g"), F.col("q").alias("block")).agg(F.count(F.lit(1)).alias("c"))
        return self.sized(asked, placed).where(f"c >= {least_shared('n', 'n_min', 'n_max')}").select("sid", "n", "g", "block")

    def links(self, asked: DataFrame, placed: DataFrame) -> DataFrame:
        """The links of the classes that ask with members of the groups, if their unions allow any."""
        w, sets = self.t.written, self.sets.select("sid", "tokens")
        who, parts = _meetings(w(asked))
        unions = self.found.where("a is null").select("g", "block", "tokens").join(parts, ["g", "block"])
        bound = who.join(sets, "sid").unionByName(unions.withColumn("sid", F.lit(None).cast("bigint")))
        who, parts = _meetings(w(_bounded(bound.select(*MEETING, "sid", "tokens"))))
        members = self.home.select("g", "block", "sid").join(parts, ["g", "block"])
        met = who.withColumn("member", F.lit(False)).unionByName(members.withColumn("member", F.lit(True)))
        met = met.join(placed.select("sid", "doc", "label"), "sid").join(sets, "sid")
        return w(_opened(met.select(*MEETING, "member", "doc", "label", "tokens")))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row (doc_id, n_shingles, component_id) for each row of docs."""
    docs = docs.select(_id(doc_id).alias("doc"), F.col(text).alias("text"))
    t = Tables(docs.sparkSession)
    keyed = t.written(_keyed(docs))
    classes = t.written(keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("doc").alias("rep")))
    sized = t.written(_sized(_lows(docs)))
    alive = classes.join(sized.where("alive").select(F.col("sid").alias("k1")), "k1", "left_semi").select(F.col("rep").alias("doc")).distinct()
    join = Join(t, docs.join(small(t.written(alive)), "doc", "left_semi"))
    links = join.inside
    for ask in (join.begun, join.others):
        placed = join.placed(links)
        links = links.unionByName(join.links(ask(placed), placed))

    # an id whose rows have several texts connects their classes
    key = F.struct(F.coalesce("k1", F.lit(0)), F.coalesce("k2", F.lit(0)))
    several = t.written(keyed.groupBy("doc").agg((F.min(key) != F.max(key)).alias("several")).where("several").select("doc"))
    same = keyed.join(small(several), "doc", "left_semi").join(classes, ["k1", "k2"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    final = t.written(components(links.unionByName(same), t))
    named = classes.join(sized.select(F.col("sid").alias("k1"), "n"), "k1").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.groupBy("k1", "k2").agg(F.max("n").alias("n"), F.min(F.coalesce("label", "rep")).alias("label"))
    out = keyed.join(t.written(named), ["k1", "k2"], "left").select("doc", "n", "label")
    other = final.join(small(several), F.col("node") == F.col("doc"), "left_semi").select(F.col("node").alias("doc"), F.col("label").alias("by_id"))
    out = out.join(small(t.written(other)), "doc", "left").withColumn("label", F.coalesce("label", "by_id", "doc"))
    shown = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    result = written(out.select(shown("doc").alias(doc_id), F.coalesce("n", F.lit(0)).alias("n_shingles"), shown("label").alias("component_id")))
    t.drop()
    return result


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of documents that are the smallest of their component; of rows that share an id, one.

    The ids that go are broadcast if few, else the anti join shuffles. Rows with a null id all stay unless they repeat a
    smaller document, which no id is.
    """
    found = jaccard_components(docs, doc_id, text)
    gone = found.where(F.col(doc_id) != F.coalesce("component_id", F.lit(NULL_ID))).select(doc_id).distinct()
    kept = docs.join(small(gone), doc_id, "left_anti")
    repeated = written(found.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id))
    if repeated.isEmpty():
        return kept
    rows = F.struct(*docs.columns)
    once = kept.join(small(repeated), doc_id, "left_semi").groupBy(doc_id).agg(F.min(rows).alias("r")).select("r.*")
    return kept.join(small(repeated), doc_id, "left_anti").unionByName(once)
