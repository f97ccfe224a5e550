"""WARC archives: written with Spark's text sink, read back with boundary-chain verification.

Writing: a record is one string, and CR LF CR LF, which ends every record, is the sink's line separator. Of records with
equal payloads of at least ``min_revisit_bytes`` bytes, that with the smallest page id is a response with its payload; the
others are revisits that refer to it.

Reading: the text source splits files at the magic ``WARC/1.1`` CR LF, so each row is a candidate record that tasks read in
parallel splits of a file. A candidate's offset is the sum of the lengths before it, in its split and then over the
splits of the file; its header gives the successor's offset. Chains are contracted inside each split by pointer jumping;
then jumps from split to split, doubled each round, start at offset 0 of each file. What is reached is a record; magic inside
a payload is not reached. The few payloads that the magic cuts are put together again from a second scan, by content hash.

Nulls: a null payload is empty, a null url is left out, a null page id is written empty and read back null; it is never the
smallest unless all are null. Rows that share the smallest id of a payload are all responses. Repeated rows are records.
Line breaks in urls are percent-encoded. A record that a file's end cuts off is not returned. Empty tables give no records.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, small, written

MAGIC, EOL, BLANK = "WARC/1.1\r\n", "\r\n", "\r\n\r\n"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: each 5 hex digits give 4 characters."""

    def four(hex5: Column) -> Column:
        v = F.conv(hex5, 16, 10).cast("int")
        return F.concat(*(F.substr(F.lit(BASE32), F.pmod(F.floor(v / (1 << s)), F.lit(32)).cast("int") + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return let(F.sha1(data), lambda h: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: let(F.substr(h, k * 5 + 1, F.lit(5)), four)), ""))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 0) -> None:
    """Writes a record for each row as uncompressed WARC files under path; records_per_file 0: a file a task."""
    payload = F.coalesce(F.col(html), F.lit(""))
    p = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"), payload.alias("payload"))
    p = p.withColumns({"n": F.octet_length("payload"), "digest": base32_sha1(F.col("payload").cast("binary"))})
    shared = p.groupBy("digest", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("n") >= min_revisit_bytes))
    p = p.join(small(written(shared.select(F.col("digest").alias("d"), "first"))), F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(F.coalesce(F.col("id").cast("string"), F.lit("")) != F.col("first").cast("string"), F.lit(False))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(BLANK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    line = lambda key, v: F.concat(F.lit(f"{key}: "), v, F.lit(EOL))
    safe = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", safe), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", name(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
    )
    made = p.select(F.concat(head, let(block, lambda b: F.concat(line("Content-Length", F.octet_length(b).cast("string")), F.lit(EOL), b))).alias("value"))
    writer = made.write.option("lineSep", BLANK)
    (writer.option("maxRecordsPerFile", records_per_file) if records_per_file else writer).text(path)


def _parsed(value: Column, keep_payload: bool) -> Column:
    """A struct of what the text after the magic says; complete: it is exactly one record."""
    field = lambda head, key: F.nullif(F.regexp_extract(head, rf"(?im)^{key}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    page = lambda v: F.regexp_extract(v, "^<urn:page:(.*)>$", 1)

    def of(head: Column) -> Column:
        n = field(head, "Content-Length").try_cast("bigint")
        start = F.octet_length(head) + 4
        block = F.substr(value.cast("binary"), start + 1, n.cast("int"))
        is_http = F.coalesce(field(head, "Content-Type").startswith("application/http"), F.lit(False))
        http = F.when(is_http, F.substring_index(block.cast("string"), BLANK, 1)).otherwise("")
        return let(
            F.struct(http.alias("http"), block.alias("block"), is_http.alias("is_http")),
            lambda b: let(
                F.when(b["is_http"], F.substr(b["block"], F.octet_length(b["http"]) + 5)).otherwise(b["block"]),
                lambda body: F.struct(
                    field(head, "WARC-Type").alias("record_type"),
                    page(field(head, "WARC-Record-ID")).alias("record_id"),
                    field(head, "WARC-Target-URI").alias("target_uri"),
                    page(field(head, "WARC-Refers-To")).alias("refers_to"),
                    F.regexp_replace(field(head, "WARC-Payload-Digest"), "^sha1:", "").alias("stated_digest"),
                    field(b["http"], "Content-Length").try_cast("bigint").alias("stated_bytes"),
                    F.octet_length(body).cast("bigint").alias("read_bytes"),
                    base32_sha1(body).alias("read_digest"),
                    *([body.cast("string").alias("payload")] if keep_payload else []),
                    F.when(F.contains(value, F.lit(BLANK)), start + n + 4).alias("needed"),
                ),
            ),
        )

    return let(F.substring_index(value, BLANK, 1), of)


def contract(group: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a split, where its chain leaves the split: pointer jumping until no pointer moves."""
    group = group.sort_values("at", ignore_index=True)
    at, to = group["at"].to_numpy(), group["to"].to_numpy()
    hop = _hops(at, to)
    while not np.array_equal(further := hop[hop], hop):
        hop = further
    return group.assign(leaves=to[hop])[["file", "split", "at", "leaves"]]


def _hops(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The index of each candidate's successor in the split; its own if that is elsewhere or no candidate."""
    own = np.arange(len(at))
    found = np.searchsorted(at, to).clip(max=len(at) - 1)
    return np.where(at[found] == to, found, own)


def mark(group: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that its entries reach."""
    group = group.sort_values("at", ignore_index=True)
    at = group["at"].to_numpy()
    hop, reached = _hops(at, group["to"].to_numpy()), np.isin(at, entries["at"].to_numpy())
    while True:
        more = reached.copy()
        more[hop[reached]] = True
        hop = hop[hop]
        if np.array_equal(more, reached) and np.array_equal(hop, hop[hop]):
            return group.loc[reached, ["file", "split", "at"]]
        reached = more


def _reached(c: DataFrame) -> DataFrame:
    """The (file, split, at) that chains from offset 0 reach. c: file, split, at, to."""
    jumps = written(c.groupBy("file", "split").applyInPandas(contract, "file string, split bigint, at bigint, leaves bigint"))
    splits = c.select("file", "split").distinct().groupBy("file").count().agg(F.max("count")).first()[0] or 0
    starts = jumps.where(F.col("at") == 0).select("file", "at")
    targets = jumps.select("file", F.col("leaves").alias("at")).distinct()
    entries = starts
    if splits > 1:
        table = written(jumps.join(starts.unionByName(targets).distinct(), ["file", "at"], "left_semi").select("file", "at", "leaves"))
        hops = 1
        while hops < splits:  # after each round the entries lie up to twice as many splits away
            entries = written(entries.unionByName(entries.join(table, ["file", "at"]).select("file", F.col("leaves").alias("at"))).distinct())
            ahead = table.select("file", F.col("at").alias("leaves"), F.col("leaves").alias("further"))
            table = written(table.join(ahead, ["file", "leaves"]).select("file", "at", F.col("further").alias("leaves")))
            hops *= 2
        entries = entries.join(jumps.select("file", "at", "split"), ["file", "at"])
    else:
        entries = jumps.where(F.col("at") == 0).select("file", "at", "split")
    return c.groupBy("file", "split").cogroup(entries.groupBy("file", "split")).applyInPandas(mark, "file string, split bigint, at bigint")


def read_warc(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row a record: record_type, record_id, target_uri, refers_to, payload_bytes and payload_digest (of a revisit as
    stated, else as read), digest_ok (as stated; null for revisits), payload if wanted, file, at."""
    raw = spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    content = F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), F.col("value")).alias("b"))
    scan = raw.withColumns({"__i": F.monotonically_increasing_id(), "n": F.octet_length("value").cast("bigint"), "hash": content, "p": F.explode(F.array(_parsed(F.col("value"), keep_payload)))}).drop("value")
    scan = written(scan)
    # offsets: within a split in its order, then over the splits of a file
    inner = "sum(n + {0}) over (partition by file, split order by __i) - n".format(len(MAGIC))
    splits = scan.groupBy("file", "split").agg(F.sum(F.col("n") + len(MAGIC)).alias("size"))
    base = splits.select(F.col("file").alias("__file"), F.col("split").alias("__split"), F.expr("sum(size) over (partition by file order by split) - size").alias("base"))
    placed = scan.withColumn("inner", F.expr(inner)).join(small(written(base)), (F.col("file") == F.col("__file")) & (F.col("split") == F.col("__split")))
    # a row's text starts after the magic of its candidate: base and inner count one magic more than lie before the text
    placed = placed.withColumn("at", F.col("base") + F.col("inner") - 2 * len(MAGIC)).where(F.col("at") >= 0).drop("__file", "__split", "base", "inner", "__i")
    placed = written(placed.withColumn("to", F.col("at") + len(MAGIC) + F.col("p.needed")))
    chain = placed.where(F.col("to").isNotNull()).select("file", "split", "at", "to")
    reached = written(_reached(chain)).select(F.col("file").alias("__file"), F.col("at").alias("__at"))
    known = placed.join(reached, (F.col("file") == F.col("__file")) & (F.col("at") == F.col("__at")), "left").withColumn("ok", F.col("__at").isNotNull()).drop("__file", "__at")
    whole = F.col("ok") & (F.col("p.needed") == F.col("n"))
    records = known.where(whole).select("file", "at", "p")
    cut = written(known.where(~F.coalesce(whole, F.lit(False))).select("file", "at", "ok", "hash"))
    if cut.where("ok").isEmpty():
        return _columns(records)
    # payloads that the magic cuts: each unreached candidate belongs to the last reached one before it
    parts = cut.withColumn("head", F.expr("last(case when ok then at end, true) over (partition by file order by at)")).where(F.col("head").isNotNull())
    found = raw.withColumn("hash", content).join(small(written(cut.select("hash").distinct())), "hash", "left_semi").groupBy("hash").agg(F.first("value").alias("value"))
    joined = parts.join(found, "hash").groupBy("file", "head").agg(F.array_join(F.sort_array(F.collect_list(F.struct("at", "value")))["value"], MAGIC).alias("value"))
    again = joined.select("file", F.col("head").alias("at"), F.octet_length("value").alias("n"), F.explode(F.array(_parsed(F.col("value"), keep_payload))).alias("p"))
    return _columns(records.unionByName(again.where(F.col("p.needed") == F.col("n")).select("file", "at", "p")))


def _columns(records: DataFrame) -> DataFrame:
    revisit = F.col("p.record_type") == "revisit"
    kept = [F.col("p.payload")] if "payload" in records.schema["p"].dataType.names else []
    return records.select(
        F.col("p.record_type").alias("record_type"),
        F.nullif(F.col("p.record_id"), F.lit("")).alias("record_id"),
        "p.target_uri",
        F.nullif(F.col("p.refers_to"), F.lit("")).alias("refers_to"),
        F.when(revisit, F.col("p.stated_bytes")).otherwise(F.col("p.read_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("p.stated_digest")).otherwise(F.col("p.read_digest")).alias("payload_digest"),
        F.when(~revisit, F.col("p.stated_digest") == F.col("p.read_digest")).alias("digest_ok"),
        *kept,
        "file",
        "at",
    )
