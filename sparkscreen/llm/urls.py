"""URL filters: Bloom filter cascades give exact membership of url keys in rule and host lists, without joins.

A rule is a host and a path prefix with a verdict; it fits its host and all subdomains where the url's path starts with
the rule's, and the longest wins. A url has one candidate key (host suffix + path prefix) for each shape, the pair
(labels of the host, characters of the path), that some rule has; so the keys of a url are few. A cascade's first level
encodes the listed keys, the second the keys of the corpus that pass the first though not listed, the third the listed
ones that pass the second, and so on until none is left over. Every key of the corpus was held against every level, so
the answer for each of them is exact. Levels are literals of the plan: their bits are counted before they are gathered,
and lists beyond MAX_BITS are cut into shards by a key's hash, each tested in a pass of its own.

Nulls: a null url or one without ``://`` has an empty host and path and fits nothing. Repeated rows are judged alike. An
empty table stays empty; without rules and hosts every url is allowed. Columns host, path, rule and verdict of the input are
replaced. A long url has no more candidate keys than a short one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az, written

#: Bits of one level that a plan carries (2 MB); more are cut into shards.
MAX_BITS = 1 << 24


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, as written."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + F.lit(3))).otherwise(F.lit(""))
    return lower_az(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: tuple[int, ...]

    def holds(self, key: Column) -> Column:
        """Whether all of the key's bits are set; words is one folded array literal."""
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        test = F.lit(True)
        for at in _positions(key, self.bits, self.hashes, self.seed):
            test = test & (F.getbit(F.get(table, (F.floor(at / 64)).cast("int")), at % 64) == 1)
        return test


def _positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(bits).cast("bigint")) for i in range(hashes)]


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    bits = 64 * max(1, math.ceil(-max(n, 1) * math.log(rate) / math.log(2) ** 2 / 64))
    hashes = max(1, round(-math.log2(rate)))
    at = F.explode(F.array(*_positions(F.col("key"), bits, hashes, seed))).alias("at")
    got = keys.select(at).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("v")).collect()
    table = [0] * (bits // 64)
    for r in got:
        table[r["word"]] = r["v"]
    return Level(bits, hashes, seed, tuple(table))


class Cascade:
    """Exact membership for the keys of one universe."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame, universe_rows: int) -> Cascade:
        """listed, universe: column key. Filters are sized by the counts; the first rate balances its errors against the list."""
        listed = listed.where(F.col("key").isNotNull()).distinct()
        n = listed.count()
        if not n:
            return cls([])
        first = _level(listed, n, min(0.5, max(1e-9, n * math.sqrt(0.5) / max(universe_rows, 1))), 0)
        levels = [first]
        wrong = written(universe.where(first.holds(F.col("key"))).distinct().join(listed, "key", "left_anti"))
        inside, outside = listed, wrong  # what the next level has to tell from what it encodes
        while m := outside.count():
            levels.append(level := _level(outside, m, 0.5, len(levels)))
            inside, outside = outside, written(inside.where(level.holds(F.col("key"))))
        return cls(levels)

    def holds(self, key: Column) -> Column:
        test = F.lit(False)
        for depth in range(len(self.levels) - 1, -1, -1):
            odd = self.levels[depth].holds(key)
            test = odd & ~test
        return test


def _shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """Distinct (labels of the host, characters of the path) of the rules: bounded by the lengths of hosts and paths."""
    return sorted(map(tuple, rules.select(F.size(F.split("host", r"\.")), F.length("path")).distinct().collect()))


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The keys under which a rule of some shape could list this url."""
    keys = [
        F.when((host != "") & (F.size(F.split(host, r"\.")) >= labels) & (F.length(path) >= chars), F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, chars)))
        for labels, chars in shapes
    ]
    return F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")


def _members(df: DataFrame, keys: str, lists: dict[str, DataFrame], universe_rows: int) -> DataFrame:
    """Adds for each list a column with those of the keys that it holds, in as many passes as the lists need shards."""
    universe = df.select(F.explode(keys).alias("key"))
    bits_each = 1.5 * (math.log2(max(universe_rows, 2)) + 4)
    sizes = {name: rows.count() for name, rows in lists.items()}
    shards = max(1, math.ceil(max(sizes.values(), default=0) * bits_each / MAX_BITS))
    shard = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))
    for name in lists:
        df = df.withColumn(name, F.array().cast("array<string>"))
    for s in range(shards):
        for name, rows in lists.items():
            own = (rows, universe) if shards == 1 else (rows.where(shard(F.col("key")) == s), universe.where(shard(F.col("key")) == s))
            cascade = Cascade.build(*own, universe_rows // shards)
            own_keys = F.filter(keys, lambda k: shard(k) == s) if shards > 1 else F.col(keys)  # noqa: B023
            if cascade.levels:
                df = df.withColumn(name, F.concat(name, F.filter(own_keys, cascade.holds)))
        if shards > 1:
            df = written(df)
    return df


def filter_urls(pages: DataFrame, rules: DataFrame, blocked_hosts: DataFrame, url: str = "url") -> DataFrame:
    """The rows with host, path, rule and verdict (columns of these names are replaced).

    rules: host, path, verdict (allow or block). blocked_hosts: host; a url that no rule fits is blocked if its host or a
    parent domain is listed here, else allowed. Where the same key has both verdicts, block holds.
    """
    host, path = split_url(F.col(url))
    df = pages.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    n = pages.count()
    key = F.concat("host", "path").alias("key")
    listed = {v: rules.where(F.col("verdict") == v).select(key) for v in ("block", "allow")}
    shapes, labels = _shapes(rules), _shapes(blocked_hosts.select("host", F.lit("").alias("path")))
    df = df.withColumns({"__keys": candidates(F.col("host"), F.col("path"), shapes), "__hosts": candidates(F.col("host"), F.lit(""), labels)})
    df = _members(df, "__keys", {f"__{v}": rows for v, rows in listed.items()}, n * max(1, len(shapes)))
    df = _members(df, "__hosts", {"__listed": blocked_hosts.select(F.col("host").alias("key"))}, n * max(1, len(labels)))
    longest = lambda keys: F.element_at(F.array_sort(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))), -1)
    df = df.withColumns({"__b": F.when(F.size("__block") > 0, longest("__block")), "__a": F.when(F.size("__allow") > 0, longest("__allow"))})
    block = F.coalesce(F.col("__b.n"), F.lit(-1)) >= F.coalesce(F.col("__a.n"), F.lit(-1))
    rule = F.when(block, F.col("__b.key")).otherwise(F.col("__a.key"))
    verdict = F.when(rule.isNotNull(), F.when(block, "block").otherwise("allow")).when(F.size("__listed") > 0, "block").otherwise("allow")
    df = df.withColumns({"rule": rule, "verdict": verdict})
    return df.drop("__keys", "__hosts", "__block", "__allow", "__listed", "__b", "__a")
