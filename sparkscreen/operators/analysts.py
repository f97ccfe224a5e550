"""One row a symbol from raw analyst payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.parse import EPS_KEYS, RATING_KEYS, TARGET_KEYS

#: Calls whose errors are listed, in this order.
CALLS = ("targets", "recommendations", "eps_revisions", "earnings_dates")


def assemble(raw: DataFrame, run_ts: str) -> DataFrame:
    """The analyst relation from rows as sources.analysts.PAYLOADS has them.

    One aggregation by symbol: each field group comes from the row that is first by (does not fit, ordinal), which tasks find
    among their own rows before the shuffle, so a symbol sends a row a task however many it has. A symbol whose fetch broke
    off has only that error.
    """
    of = lambda call: F.col("call") == call

    def first(call: str, fits: Column | None = None) -> Column:
        order = F.struct(F.lit(False) if fits is None else ~fits, F.col("ordinal"))
        return F.min_by(F.struct("label", "kv"), F.when(of(call) & F.col("error").isNull(), order)).alias(call)

    at = F.when(of("earnings_dates"), parse.instant(F.col("text")))
    errors = {call: F.max(F.when(of(call), F.col("error"))) for call in (*CALLS, "unhandled")}
    found = raw.groupBy("symbol").agg(
        first("quote"),
        first("targets"),
        first("recommendations", parse.is_label(F.col("label"), "0m", trim=False)),
        first("eps_revisions", parse.is_label(F.col("label"), "0q")),
        F.min(F.when(at >= parse.cutoff(run_ts), at)).alias("next_earnings_date"),
        F.max("fetched_at").alias("data_fetched_at_utc"),
        *(e.alias(f"__{call}") for call, e in errors.items()),
    )
    broken = F.col("__unhandled").isNotNull()
    kv = {name: parse.normalize_map(F.when(~broken, F.col(f"{name}.kv"))) for name in ("targets", "recommendations", "eps_revisions")}
    named = found.select("*", *(v.alias(f"kv_{k}") for k, v in kv.items()))
    group = lambda name, keys: [parse.pick(F.col(f"kv_{name}"), k).alias(c) for c, k in keys.items()]
    said = F.array_compact(F.array(*(F.concat(F.lit(f"{call}="), F.col(f"__{call}")) for call in CALLS)))
    label = lambda name: F.when(broken, "").otherwise(F.coalesce(F.col(f"{name}.label"), F.lit("")))
    return named.select(
        "symbol",
        F.when(~broken, parse.quote_price(F.col("quote.kv"))).alias("latest_quote"),
        *group("targets", TARGET_KEYS),
        *group("recommendations", RATING_KEYS),
        label("recommendations").alias("recommendation_period"),
        *group("eps_revisions", EPS_KEYS),
        label("eps_revisions").alias("eps_revision_period"),
        F.when(~broken, F.col("next_earnings_date")).alias("next_earnings_date"),
        "data_fetched_at_utc",
        F.when(broken, F.concat(F.lit("UNHANDLED="), F.col("__unhandled"))).otherwise(F.array_join(said, " | ")).alias("data_errors"),
    )
