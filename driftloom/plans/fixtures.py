"""Monitoring inputs derived from the given tables, over all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
REFERENCE_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _batched(df: DataFrame, when: str) -> DataFrame:
    return df.withColumn("batch_id", F.year(when)).withColumn("is_reference", F.col("batch_id") == REFERENCE_YEAR)


def shipments(spark, sf_dir) -> DataFrame:
    """Line items; batch = ship year, reference = 1995."""
    return _batched(table(spark, sf_dir, "lineitem"), "l_shipdate")


def shifted(spark, sf_dir) -> DataFrame:
    """Shipments whose price grows 10 % a year and discount 1 % a year."""
    age = F.col("batch_id") - REFERENCE_YEAR
    return shipments(spark, sf_dir).withColumns(
        {
            "l_extendedprice": F.col("l_extendedprice") * (1 + 0.1 * age),
            "l_discount": F.col("l_discount") * (1 + 0.01 * age),
        }
    )


def gappy(spark, sf_dir) -> DataFrame:
    """Shipments with NULL for quantity 10 and NaN for the tax of linenumber 1."""
    return shipments(spark, sf_dir).withColumns(
        {
            "l_quantity": F.nullif("l_quantity", F.lit(10.0)),
            "l_tax": F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.col("l_tax")),
        }
    )


def flags(spark, sf_dir) -> DataFrame:
    """Shipments with a new return flag value after 1998."""
    renamed = F.when((F.col("batch_id") > 1998) & (F.col("l_returnflag") == "R"), "X").otherwise(F.col("l_returnflag"))
    return shipments(spark, sf_dir).withColumn("l_returnflag", renamed)


def priorities(spark, sf_dir) -> DataFrame:
    """Orders; batch = order year, reference = 1995; status is replaced by one value after 1996."""
    return _batched(table(spark, sf_dir, "orders"), "o_orderdate")


def scored(spark, sf_dir) -> DataFrame:
    """Labelled scores: y = returned; score_a has heavy ties, score_b has few."""
    return shipments(spark, sf_dir).withColumns(
        {
            "y": (F.col("l_returnflag") == "R").cast("int"),
            "score_a": F.col("l_discount") * 10,
            "score_b": F.col("l_extendedprice") / 105000,
        }
    )


# DuckDB twins of the fixtures, used as CTEs
SQL = {
    "f1": """f1 as (select *, year(l_shipdate)::int as batch_id, year(l_shipdate) = 1995 as is_reference from lineitem)""",
    "f1s": """f1s as (select * replace (l_extendedprice * (1 + 0.1::double * (batch_id - 1995)) as l_extendedprice,
      l_discount * (1 + 0.01::double * (batch_id - 1995)) as l_discount) from f1)""",
    "f1n": """f1n as (select * replace (nullif(l_quantity, 10) as l_quantity,
      case when l_linenumber = 1 then 'nan'::double else l_tax end as l_tax) from f1)""",
    "sc": """sc as (select * replace (l_extendedprice * (1 + case when is_reference then 0.0 when l_returnflag = 'R' then 0.5
      when l_returnflag = 'A' then 0.1::double * (batch_id - 1995) else 0.0 end::double) as l_extendedprice,
      case when is_reference then 'reference' when l_returnflag = 'R' then 'sudden' when l_returnflag = 'A' then 'gradual' else 'none' end as batch_id) from f1)""",
    "f2": """f2 as (select * replace (case when batch_id > 1998 and l_returnflag = 'R' then 'X' else l_returnflag end
      as l_returnflag) from f1)""",
    "f2o": """f2o as (select *, year(o_orderdate)::int as batch_id, year(o_orderdate) = 1995 as is_reference from orders)""",
    "f3": """f3 as (select *, (l_returnflag = 'R')::int as y, l_discount * 10 as score_a,
      l_extendedprice / 105000 as score_b from f1)""",
}


def ctes(*names: str) -> str:
    return ",\n".join(SQL[n] for n in names)


def rounded(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places, for comparison only."""
    return df.select(
        *[F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    )
