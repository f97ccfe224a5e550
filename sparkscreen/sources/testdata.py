"""The relations of a screen made from the test tables: suppliers as companies, their line items as price bars.

The text is SQL that Spark and DuckDB both take; {name} stands for a table, and two fragments differ by dialect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RUN_TS = "2001-12-01 00:00:00"
SPARK = {"later": "timestampadd(SECOND, {seconds}, TIMESTAMP_NTZ '" + RUN_TS + "')", "text": "string"}
DUCKDB = {"later": "(TIMESTAMP '" + RUN_TS + "' + to_seconds({seconds}))", "text": "varchar"}

CONSTITUENTS = """
select cast(s_suppkey as bigint) as ordinal, concat('S.', s_suppkey) as source_symbol, concat('S-', s_suppkey) as symbol, s_name as company_name,
  case when s_suppkey % 37 = 36 then null else r_name end as sector, n_name as sub_industry
from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey"""

PRICE = "100 * (1 + (case when l_suppkey % 10 = 9 then 6e0 else 3e-1 * (1 + l_suppkey % 10) end) * (l_discount - l_tax)) + l_extendedprice / 1e5"
SEQUENCE = f"""
select l_suppkey as s, l_shipdate as price_date, l_orderkey, l_linenumber, l_quantity, l_returnflag,
  {PRICE} as cu,
  row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as ra,
  row_number() over (partition by l_suppkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc, l_extendedprice desc) as rd
from {{lineitem}}"""

BARS = f"""
select concat('S-', s) as symbol, price_date, cast(ra as bigint) as seq,
  case when l_linenumber = 7 and s % 7 = 3 then null else cu end as close,
  case when l_returnflag = 'N' and s % 5 = 2 then null else l_quantity * 1000 * (1 + (s * 3) % 10) end as volume
from ({SEQUENCE}) q"""
#: The same bars with the order key itself for its number, which Spark need not sort all bars to give out.
KEYED_BARS = f"""
select concat('S-', l_suppkey) as symbol, l_shipdate as price_date, struct(l_shipdate, l_orderkey, l_linenumber, l_extendedprice) as seq,
  case when l_linenumber = 7 and l_suppkey % 7 = 3 then null else {PRICE} end as close,
  case when l_returnflag = 'N' and l_suppkey % 5 = 2 then null else l_quantity * 1000 * (1 + (l_suppkey * 3) % 10) end as volume
from {{lineitem}}"""

ANALYSTS = f"""
select concat('S-', s_suppkey) as symbol,
  case when s_suppkey % 6 = 1 or s_suppkey % 40 = 0 then null else last_cu * 1001e-3 end as latest_quote,
  cast(null as double) as target_current,
  median * (1 - 8e-2 * (s_suppkey % 6)) as target_low, mean as target_mean, median as target_median, median * (1 + 8e-2 * (s_suppkey % 6)) as target_high,
  cast(case when s_suppkey % 4 = 0 then p1 + p3 else p1 end as double) as strong_buy, cast(case when s_suppkey % 4 = 0 then p2 + p4 else p2 end as double) as buy,
  cast(case when s_suppkey % 4 = 0 then 0 else p3 end as double) as hold, cast(case when s_suppkey % 4 = 0 then 0 else p4 end as double) as sell, cast(p5 as double) as strong_sell,
  '0m' as recommendation_period,
  cast(null as double) as eps_up_7d, case when s_suppkey % 9 = 0 then null else cast(ups as double) end as eps_up_30d,
  cast(null as double) as eps_down_7d, case when s_suppkey % 9 = 0 then null when s_suppkey % 4 = 0 then 0e0 else cast(downs as double) end as eps_down_30d,
  '0q' as eps_revision_period,
  case when s_suppkey % 8 = 7 then null else @later end as next_earnings_date,
  case when s_suppkey % 15 = 4 then 'targets=Timeout: x' else '' end as data_errors
from (
  select s_suppkey, last_cu, coalesce(p1, 0) as p1, coalesce(p2, 0) as p2, coalesce(p3, 0) as p3, coalesce(p4, 0) as p4, coalesce(p5, 0) as p5, coalesce(ups, 0) as ups, coalesce(downs, 0) as downs,
    case when s_suppkey % 11 = 5 or s_suppkey % 17 = 8 then null else mid * (75e-2 + 1e-1 * (s_suppkey % 13)) end as median,
    case when s_suppkey % 17 = 8 then null else avg_cu * (75e-2 + 1e-1 * (s_suppkey % 13)) end as mean
  from {{supplier}} left join (
    select s, max(case when rd = 1 then cu end) as last_cu, median(case when rd <= 60 then cu end) as mid, avg(case when rd <= 60 then cu end) as avg_cu,
      count(case when rd <= (s * 7) % 40 and o_orderpriority = '1-URGENT' then 1 end) as p1, count(case when rd <= (s * 7) % 40 and o_orderpriority = '2-HIGH' then 1 end) as p2,
      count(case when rd <= (s * 7) % 40 and o_orderpriority = '3-MEDIUM' then 1 end) as p3, count(case when rd <= (s * 7) % 40 and o_orderpriority = '4-NOT SPECIFIED' then 1 end) as p4,
      count(case when rd <= (s * 7) % 40 and o_orderpriority = '5-LOW' then 1 end) as p5,
      count(case when rd <= s % 9 and l_returnflag = 'A' then 1 end) as ups, count(case when rd <= s % 9 and l_returnflag = 'R' then 1 end) as downs
    from ({SEQUENCE}) q join {{orders}} on l_orderkey = o_orderkey group by s) a on s_suppkey = s) b"""
#: The same rows from the latest bars alone: nothing of an older one is read, and Spark cuts them in each task before it shuffles.
LATEST_ANALYSTS = ANALYSTS.replace(f"from ({SEQUENCE}) q", f"from (select * from ({SEQUENCE}) w where rd <= 60) q")

SECONDS = "cast(round(((s_suppkey * 3) % 70 - 4e-1) * 86400) as bigint)"


def text(relation: str, dialect: dict[str, str]) -> str:
    return relation.replace("@later", dialect["later"].replace("{seconds}", SECONDS))


def load(spark: SparkSession, sf_dir: str, relation: str) -> DataFrame:
    names = [t for t in ("supplier", "nation", "region", "lineitem", "orders") if "{" + t + "}" in relation]
    return spark.sql(text(relation, SPARK), **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names})


def constituents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, CONSTITUENTS)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, KEYED_BARS)


def analysts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, LATEST_ANALYSTS)
