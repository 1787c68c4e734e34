"""The survey-like tables the registered queries run on, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyveil.operators.binning import bin_code, fit_edges
from tallyveil.operators.domain import Domain, encode
from tallyveil.operators.marginals import count_rows

CATS = ["status", "priority", "segment"]


# The labels the survey may hold, for private runs.
LABELS = {
    "status": ["F", "O", "P"],
    "priority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"],
    "segment": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "price": ["0", "1", "2", "3", "4"],
    "balance": ["0", "1", "2", "3", "4"],
}


def declared(columns: list[str], **other: list[str]) -> Domain:
    """Declared domain of survey columns; `other` replaces the labels of some."""
    return Domain.declare({c: other.get(c, LABELS[c]) for c in columns})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: three label columns, three numeric ones, a unique row_id."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("o_totalprice").alias("price"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))


SURVEY = """survey AS (
  SELECT o_orderkey AS row_id, o_orderstatus AS status, o_orderpriority AS priority, c_mktsegment AS segment,
         o_totalprice AS price, c_nationkey AS nation, c_acctbal AS balance
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The survey with price and balance cut into 5 bins, all columns labels."""
    df = survey(spark, sf_dir)
    edges = fit_edges(df, ["price", "balance"], 5)
    return df.select("row_id", *CATS, bin_code("price", edges["price"]).cast("string").alias("price"),
                     bin_code("balance", edges["balance"]).cast("string").alias("balance"))


def _bin_sql(column: str, bins: int = 5) -> str:
    steps = " + ".join(f"CAST({column} > {column}_lo + {i} * (({column}_hi - {column}_lo) / {bins}) AS INT)" for i in range(1, bins))
    return f"({steps})"


BINNED = SURVEY + f""", survey_edges AS (
  SELECT min(price) AS price_lo, max(price) AS price_hi, min(balance) AS balance_lo, max(balance) AS balance_hi FROM survey),
binned AS (
  SELECT row_id, status, priority, segment, CAST({_bin_sql('price')} AS VARCHAR) AS price,
         CAST({_bin_sql('balance')} AS VARCHAR) AS balance
  FROM survey CROSS JOIN survey_edges)"""

COLUMNS = [*CATS, "price", "balance"]


def coded(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, Domain]:
    """The binned survey as integer codes, with its domain."""
    names = columns or COLUMNS
    df = binned(spark, sf_dir).select("row_id", *names)
    domain = Domain.infer(df, names)
    return encode(df, domain), domain


def counted(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> tuple[DataFrame, Domain]:
    """Distinct coded rows with their number (`rows`) and the domain: the survey is read once."""
    names = columns or COLUMNS
    labels = count_rows(binned(spark, sf_dir), names)
    domain = Domain.infer(labels, names)
    return encode(labels, domain), domain


def _code_sql(column: str) -> str:
    return f"CAST(dense_rank() OVER (ORDER BY {column}) - 1 AS INT) AS {column}"


CODED = BINNED + ", coded AS (SELECT row_id, " + ", ".join(_code_sql(c) for c in COLUMNS) + " FROM binned)"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sold item, all label columns."""
    li = table(spark, sf_dir, "lineitem")
    percent = lambda c: F.round(F.col(c) * 100).cast("int").cast("string")
    return li.select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"),
                     percent("l_discount").alias("discount"), percent("l_tax").alias("tax"),
                     F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))


ITEMS = """items AS (
  SELECT l_returnflag AS flag, l_linestatus AS line, CAST(CAST(round(l_discount * 100) AS INT) AS VARCHAR) AS discount,
         CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) AS tax, l_quantity AS quantity, l_extendedprice AS price
  FROM lineitem)"""

# Fixed choice for the registered queries: the pairs that are measured, in order.
PAIRS = [("status", "priority"), ("status", "segment"), ("priority", "price"), ("segment", "balance")]


def values_sql(rows: list[tuple], names: list[str]) -> str:
    """A literal relation for SQL texts."""
    def show(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)

    body = ", ".join("(" + ", ".join(show(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({', '.join(names)}))"
