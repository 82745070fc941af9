"""Test views over the driver's tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from answerproof.session import spread

QA = """
select concat('m', cast(o_custkey % 4 as varchar(20))) as model, o_orderpriority as template,
 o_orderkey as id, o_custkey as cluster_id,
 case when k <= 1 then concat('How many dollars, rounded down, did order ', cast(o_orderkey as varchar(20)), ' cost?')
      when k <= 3 then concat('Which customer placed order ', cast(o_orderkey as varchar(20)), '?')
      else concat('In which nation does the buyer of order ', cast(o_orderkey as varchar(20)), ' live?') end as prompt,
 gold as correct_answer,
 case o_orderkey % 12
  when 0 then gold when 1 then concat('  ', upper(gold), '  ')
  when 2 then concat('The answer is ', gold) when 3 then concat(alt, ' or ', gold)
  when 4 then alt when 5 then concat('It is not ', gold)
  when 6 then 'There is no such record' when 7 then ''
  when 8 then concat(gold, ', to be exact') when 9 then 'I would have to look that up for you'
  when 10 then concat('Perhaps ', alt, ' as far as anyone can tell from the books')
  else concat(gold, ' is not the right one') end as model_response
from (select o_orderkey, o_custkey, o_orderpriority, o_orderkey % 5 as k,
   case when o_orderkey % 5 <= 1 then cast(cast(floor(o_totalprice) as bigint) as varchar(20)) when o_orderkey % 5 <= 3 then c_name else n_name end as gold,
   case when o_orderkey % 5 <= 1 then cast(cast(floor(o_totalprice) as bigint) + 7 as varchar(20)) when o_orderkey % 5 <= 3 then concat('Client', cast(o_orderkey as varchar(20))) else 'Atlantis' end as alt
   from {orders} join {customer} on o_custkey = c_custkey join {nation} on c_nationkey = n_nationkey) g
"""

NLI = """
select id, dir, con as contradiction, (1.0e0 - con) * ent as entailment, (1.0e0 - con) * (1.0e0 - ent) as neutral from (
 select o_orderkey as id, dir, cast((o_orderkey * 37 + case when dir = 'fwd' then 0 else 11 end) % 101 as double) / 100.0e0 as con,
  cast((o_orderkey * 53 + case when dir = 'fwd' then 0 else 7 end) % 101 as double) / 100.0e0 as ent
 from {orders} cross join (select 'fwd' as dir union all select 'rev' as dir) d) x
"""

REVIEW = """
select o_orderkey as id, o_custkey as cluster_id, o_orderpriority as category, (o_orderkey % 7 = 0) as detector_hallucinated,
 case when o_orderkey % 7 = 0 and o_orderkey % 3 = 0 then 'contradiction' when o_orderkey % 41 = 0 then 'contradiction' when o_orderkey % 11 = 0 then 'incomplete_or_vacuous' when o_orderkey % 29 = 0 then 'abstention' else 'supported' end as rater_a,
 case when o_orderkey % 7 = 0 and o_orderkey % 3 = 0 then 'contradiction' when o_orderkey % 41 = 0 then 'contradiction' when o_orderkey % 11 = 0 and o_orderkey % 5 > 0 then 'incomplete_or_vacuous' when o_orderkey % 29 = 0 then 'abstention' else 'supported' end as rater_b
from {orders}
"""

TABLES = ("orders", "customer", "nation")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: read(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    used["orders"] = spread(used["orders"])
    return spark.sql(sql, **used)


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts, reference answers and responses, one row per order."""
    return _view(spark, sf_dir, QA)


def nli(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entailment scores, two directions per order."""
    return _view(spark, sf_dir, NLI)


def review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters and a detector flag, one row per order."""
    return _view(spark, sf_dir, REVIEW)


def plain_sql(view: str) -> str:
    """The view for an engine that has the tables under their own names."""
    return view.format(**{t: t for t in TABLES})
