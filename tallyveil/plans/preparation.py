"""Registered queries: reading, cleaning, discretising."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyveil.functions.keyed import sql_uniform
from tallyveil.functions.text import (epsilon_from_label, epsilon_label, pairs_key, parse_number_list,
                                      parse_pair_list, run_key)
from tallyveil.operators import binning as B
from tallyveil.operators import cleaning as P
from tallyveil.plans.base import ITEMS, SURVEY, items, survey, table
from tallyveil.plans.registry import query
from tallyveil.session import scratch_path
from tallyveil.sources import tables as S

# ---------------------------------------------------------------- sources and sinks


@query("s01_read_table", "SELECT o_orderkey, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders")
def s01(spark, sf):
    path = scratch_path(spark, "orders-csv")
    S.write_table(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, fmt="csv")
    df = S.read_table(spark, path, "o_orderkey long, o_orderstatus string, o_totalprice double", "csv")
    return df.withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("s02_read_headerless", "SELECT p_partkey, p_brand, p_type, p_size FROM part")
def s02(spark, sf):
    path = scratch_path(spark, "part-raw")
    cols = ["p_partkey", "p_brand", "p_type", "p_size"]
    table(spark, sf, "part").select(F.concat_ws(", ", *cols).alias("value")).write.text(path)
    return S.read_headerless(spark, path, "p_partkey long, p_brand string, p_type string, p_size int")


@query("s03_read_categories", """
SELECT CAST(p_size AS VARCHAR) AS p_size, p_brand, count(*) AS n FROM part GROUP BY ALL""")
def s03(spark, sf):
    path = scratch_path(spark, "part-labels")
    S.write_table(table(spark, sf, "part").select("p_size", "p_brand"), path, fmt="csv")
    return S.read_categories(spark, path, ["p_size", "p_brand"]).groupBy("p_size", "p_brand").agg(F.count("*").alias("n"))


@query("s04_write_table", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1")
def s04(spark, sf):
    path = scratch_path(spark, "lineitem")
    S.write_table(table(spark, sf, "lineitem").select("l_returnflag", "l_quantity"), path)
    return S.read_table(spark, path).groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("s05_combine_result_files", """
SELECT o_orderkey AS id, o_orderstatus AS label, CAST(NULL AS DOUBLE) AS amount FROM orders
UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM customer""")
def s05(spark, sf):
    left, right = scratch_path(spark, "res-a"), scratch_path(spark, "res-b")
    S.write_table(table(spark, sf, "orders").selectExpr("o_orderkey AS id", "o_orderstatus AS label"), left)
    S.write_table(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS label", "c_acctbal AS amount"), right)
    return S.combine([S.read_table(spark, left), S.read_table(spark, right)])


@query("s06_metadata_from_path", """
SELECT o_orderpriority AS dataset, o_orderstatus AS query_name, count(*) AS n, round(sum(o_totalprice), 2) AS total
FROM orders GROUP BY 1, 2""")
def s06(spark, sf):
    path = scratch_path(spark, "runs")
    named = table(spark, sf, "orders").select(
        F.regexp_replace("o_orderpriority", "[ ]", "_").alias("d"), F.col("o_orderstatus").alias("q"), "o_totalprice")
    S.write_table(named, path, partition_by=["d", "q"])
    runs = spark.read.schema("o_totalprice double").option("recursiveFileLookup", "true").parquet(path)
    parts = S.with_path_parts(runs, r"/d=([^/]*)/q=([^/]*)/", ["dataset", "query_name"])
    return parts.groupBy(F.replace(F.col("dataset"), F.lit("_"), F.lit(" ")).alias("dataset"), "query_name").agg(
        F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s07_sink_replace_and_append", """
SELECT c_nationkey, CAST(2 * count(*) AS BIGINT) AS n FROM customer GROUP BY 1""")
def s07(spark, sf):
    path = scratch_path(spark, "sink")
    c = table(spark, sf, "customer").select("c_nationkey")
    S.write_table(table(spark, sf, "customer").selectExpr("c_nationkey + 1000 AS c_nationkey"), path)
    S.write_table(c, path, "replace")
    S.write_table(c, path, "append")
    return S.read_table(spark, path).groupBy("c_nationkey").agg(F.count("*").alias("n"))


@query("s08_drop_repeated_headers", """
SELECT event_id AS id, event_type AS task, round(value, 4) AS seconds FROM events""")
def s08(spark, sf):
    ev = table(spark, sf, "events")
    rows = ev.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("task"), F.col("value").cast("string").alias("seconds"))
    heads = ev.groupBy("user_id").count().select(F.lit("id").alias("id"), F.lit("task").alias("task"), F.lit("seconds").alias("seconds"))
    path = scratch_path(spark, "appended")
    rows.unionByName(heads).write.option("header", False).csv(path)
    raw = spark.read.schema("id string, task string, seconds string").csv(path)
    return S.drop_repeated_headers(raw, {"id": "long", "seconds": "double"}).withColumn("seconds", F.round("seconds", 4))


# ---------------------------------------------------------------- projections, filters, predicates

_DIRTY = """dirty AS (SELECT *, CASE WHEN segment = 'MACHINERY' THEN '?' ELSE segment END AS raw FROM survey)"""


def _dirty(spark, sf):
    return survey(spark, sf).withColumn("raw", F.when(F.col("segment") == "MACHINERY", "?").otherwise(F.col("segment")))


@query("p01_sentinel_to_null", f"WITH {SURVEY}, {_DIRTY} SELECT row_id, nullif(raw, '?') AS raw FROM dirty")
def p01(spark, sf):
    return P.sentinel_to_null(_dirty(spark, sf).select("row_id", "raw"), "?", ["raw"])


@query("p02_drop_incomplete", f"WITH {SURVEY}, {_DIRTY} SELECT row_id, raw FROM dirty WHERE raw <> '?'")
def p02(spark, sf):
    return P.drop_incomplete(P.sentinel_to_null(_dirty(spark, sf).select("row_id", "raw"), "?", ["raw"]))


@query("p03_recode_chained", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '0' WHEN 'O' THEN '1' ELSE o_orderstatus END AS status FROM orders""")
def p03(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.concat("o_orderstatus", F.lit(".")).alias("status"))
    return P.recode(df, "status", {"F.": "F", "O.": "O", "P.": "P"}, {"F": "0", "O": "1"})


@query("p04_drop_columns", "SELECT c_custkey, c_mktsegment FROM customer")
def p04(spark, sf):
    return table(spark, sf, "customer").drop("c_name", "c_nationkey", "c_acctbal")


@query("p05_keep_columns", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def p05(spark, sf):
    return P.keep_columns(table(spark, sf, "orders"), ["o_orderpriority", "o_orderkey", "o_orderstatus", "absent"])


@query("p06_cast_by_type_table", """
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_quantity AS INTEGER) AS l_quantity, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem""")
def p06(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_linenumber")
    return P.cast_columns(df, {"l_orderkey": "string", "l_quantity": "int", "l_linenumber": "long"})


@query("p07_all_numeric", "SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS DOUBLE) AS done, o_custkey FROM orders")
def p07(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "1").otherwise("0").alias("done"), "o_custkey")
    return P.all_numeric(df)


@query("p08_all_categorical", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic FROM labels")
def p08(spark, sf):
    return P.all_categorical(table(spark, sf, "labels"))


@query("p09_positive_flag", "SELECT c_custkey, CAST(c_acctbal > 0 AS INTEGER) AS had_balance FROM customer")
def p09(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", P.positive_flag("c_acctbal").alias("had_balance"))


@query("p10_target_last", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def p10(spark, sf):
    return P.target_last(table(spark, sf, "orders").drop("o_orderdate"), "o_orderstatus")


@query("p11_collapse_labels", """
SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'RUSH' ELSE o_orderpriority END AS o_orderpriority FROM orders""")
def p11(spark, sf):
    return P.collapse_labels(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH"], "RUSH")


@query("p12_overwrite_column", "SELECT l_orderkey, l_linenumber, l_tax, l_tax AS l_discount FROM lineitem")
def p12(spark, sf):
    return P.overwrite_column(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount"), "l_discount", "l_tax")


@query("p13_filters", """
SELECT event_id, event_type, value FROM events WHERE event_type = 'purchase' AND value >= 1 AND value < 50 AND user_id <> 7""")
def p13(spark, sf):
    flags = [F.col("event_type") == "purchase", F.col("value") >= 1, F.col("value") < 50, F.col("user_id") != 7]
    return table(spark, sf, "events").filter(P.all_true(flags)).select("event_id", "event_type", "value")


@query("p14_round_columns", """
SELECT l_orderkey, CAST(round_even(l_quantity / 8 * 100, 0) AS DOUBLE) / 100 AS eighths, CAST(round_even(l_extendedprice / 7 * 10, 0) AS DOUBLE) / 10 AS price FROM lineitem""")
def p14(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity / 8 AS eighths", "l_extendedprice / 7 AS price")
    return P.round_columns(df, {"eighths": 2, "price": 1})


@query("p15_log_column", "SELECT o_orderkey, round(ln(o_totalprice), 6) AS log_price FROM orders")
def p15(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", F.round(F.ln("o_totalprice"), 6).alias("log_price"))


@query("p16_split_by_position", """
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= 1000 THEN 'train' ELSE 'test' END AS part FROM orders""")
def p16(spark, sf):
    return P.split_by_position(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 1000)


@query("p17_split_by_fraction", f"""
SELECT event_id, CASE WHEN {sql_uniform('split', 'event_id')} < 0.7 THEN 'train' ELSE 'test' END AS part FROM events""")
def p17(spark, sf):
    return P.split_by_fraction(table(spark, sf, "events").select("event_id"), "event_id", 0.7)


@query("p18_sanitise_names", "SELECT o_orderkey AS orderkey, o_totalprice AS totalpriceUSD FROM orders")
def p18(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order-key"), F.col("o_totalprice").alias("total price (USD)"))
    return P.sanitise_names(df)


@query("p19_pair_list_key", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'empty'
  ELSE c_mktsegment || '+' || CAST(c_nationkey AS VARCHAR) || '-' || c_name || '+' || c_mktsegment END AS pairs FROM customer""")
def p19(spark, sf):
    nation = F.col("c_nationkey").cast("string")
    pairs = F.array(F.array("c_mktsegment", nation), F.array("c_name", "c_mktsegment"))
    none = F.filter(pairs, lambda p: F.lit(False))
    return table(spark, sf, "customer").select("c_custkey", pairs_key(F.when(F.col("c_acctbal") < 0, none).otherwise(pairs)).alias("pairs"))


@query("p20_epsilon_labels", """
SELECT o_orderkey, replace(CAST(eps AS VARCHAR), '.', '') AS label, eps AS back,
       o_orderpriority || '_' || replace(CAST(eps AS VARCHAR), '.', '') || 'e_' || o_orderstatus AS run
FROM (SELECT *, CASE o_orderstatus WHEN 'F' THEN 0.1::DOUBLE WHEN 'O' THEN 1.0::DOUBLE ELSE 8.0::DOUBLE END AS eps FROM orders)""")
def p20(spark, sf):
    df = table(spark, sf, "orders").withColumn("eps", F.when(F.col("o_orderstatus") == "F", 0.1).when(F.col("o_orderstatus") == "O", 1.0).otherwise(8.0))
    return df.select("o_orderkey", epsilon_label("eps").alias("label"), epsilon_from_label(epsilon_label("eps")).alias("back"),
                     run_key("o_orderpriority", "eps", "o_orderstatus").alias("run"))


@query("p21_parse_array_text", """
SELECT l_orderkey, l_linenumber, round(l_quantity + l_discount, 6) AS total, l_returnflag || '/' || l_linestatus AS pair FROM lineitem""")
def p21(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.format_string("[%s   %s]", F.col("l_quantity"), F.col("l_discount")).alias("cell"),
        F.format_string("[('%s', '%s')]", F.col("l_returnflag"), F.col("l_linestatus")).alias("pairs"))
    numbers, pairs = parse_number_list("cell"), parse_pair_list("pairs")
    return df.select("l_orderkey", "l_linenumber", F.round(numbers[0] + numbers[1], 6).alias("total"), F.array_join(pairs[0], "/").alias("pair"))


@query("p22_null_alternatives", f"""
WITH {SURVEY}, {_DIRTY}, n AS (SELECT row_id, status, nullif(raw, '?') AS raw FROM dirty)
SELECT row_id, status, raw, raw IS NULL AS pooled FROM n WHERE raw IS NULL OR (raw IS NOT NULL AND status = 'P')""")
def p22(spark, sf):
    df = P.sentinel_to_null(_dirty(spark, sf), "?", ["raw"])
    keep = P.any_true([F.col("raw").isNull(), P.all_true([F.col("raw").isNotNull(), F.col("status") == "P"])])
    return df.filter(keep).select("row_id", "status", "raw", F.col("raw").isNull().alias("pooled"))


# ---------------------------------------------------------------- discretisation


@query("b01_equal_width_bins", f"""
WITH {SURVEY}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM survey)
SELECT row_id, CAST(price > lo + 1 * ((hi - lo) / 5) AS INT) + CAST(price > lo + 2 * ((hi - lo) / 5) AS INT)
  + CAST(price > lo + 3 * ((hi - lo) / 5) AS INT) + CAST(price > lo + 4 * ((hi - lo) / 5) AS INT) AS bin FROM survey, e""")
def b01(spark, sf):
    df = survey(spark, sf).select("row_id", "price")
    return df.select("row_id", B.bin_code("price", B.fit_edges(df, ["price"], 5)["price"]).alias("bin"))


@query("b02_fixed_width_buckets", """
SELECT o_orderkey, CASE WHEN v < 100 THEN CAST(CAST(floor(v / 10) * 10 AS INT) AS VARCHAR) || ' - ' || CAST(CAST(floor(v / 10) * 10 AS INT) + 10 AS VARCHAR) END AS bucket
FROM (SELECT o_orderkey, floor(o_totalprice / 4500) AS v FROM orders)""")
def b02(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.floor(F.col("o_totalprice") / 4500).alias("v"))
    return df.select("o_orderkey", B.width_bucket_label("v", 10).alias("bucket"))


@query("b03_edges_from_train", f"""
WITH {SURVEY}, p AS (SELECT *, CASE WHEN {sql_uniform('split', 'row_id')} < 0.7 THEN 'train' ELSE 'test' END AS part FROM survey),
e AS (SELECT min(price) AS lo, max(price) AS hi FROM p WHERE part = 'train')
SELECT row_id, CASE WHEN price > lo - 0.001 * (hi - lo) AND price <= hi THEN CAST(price > lo + ((hi - lo) / 2) AS INT) END AS bin
FROM p, e WHERE part = 'test'""")
def b03(spark, sf):
    df = P.split_by_fraction(survey(spark, sf).select("row_id", "price"), "row_id", 0.7)
    edges = B.fit_edges(df.filter("part = 'train'"), ["price"], 2)
    return df.filter("part = 'test'").select("row_id", B.bin_code("price", edges["price"]).alias("bin"))


@query("b03_edges_per_table", f"""
WITH {SURVEY}, e AS (SELECT nation, min(price) AS lo, max(price) AS hi FROM survey GROUP BY 1)
SELECT nation, CAST(price > lo + 1 * ((hi - lo) / 4) AS INT) + CAST(price > lo + 2 * ((hi - lo) / 4) AS INT)
  + CAST(price > lo + 3 * ((hi - lo) / 4) AS INT) AS bin, count(*) AS n FROM survey JOIN e USING (nation) GROUP BY 1, 2""")
def b03_per_table(spark, sf):
    df = B.apply_per_table(survey(spark, sf).select("nation", "price"), "nation", "price", 4, "bin")
    return df.groupBy("nation", "bin").agg(F.count("*").alias("n"))


@query("b04_named_preset", f"""
WITH {SURVEY}, e AS (SELECT min(price) AS lo, max(price) AS hi FROM survey), c AS (
SELECT CASE WHEN priority IN ('1-URGENT', '2-HIGH') THEN 'RUSH' ELSE priority END AS priority, segment,
  CAST(price > lo + ((hi - lo) / 2) AS INT) AS price_bin, status FROM survey, e)
SELECT priority, segment, price_bin, status, count(*) AS n FROM c GROUP BY ALL""")
def b04(spark, sf):
    preset = B.Preset(("priority", "segment", "price", "status"), "status", ("price",), n_buckets=2,
                      collapse={"priority": (("1-URGENT", "2-HIGH"), "RUSH")})
    raw = survey(spark, sf)
    edges = B.fit_edges(raw, ["price"], 2)
    out = B.prepare(raw, preset, edges)
    high = (F.col("price") == edges["price"].labels[1]).cast("int").alias("price_bin")
    return out.select("priority", "segment", high, "status").groupBy("priority", "segment", "price_bin", "status").agg(F.count("*").alias("n"))


@query("b04_default_width_preset", f"""
WITH {ITEMS} SELECT flag, line, CAST(CAST(floor(quantity / 10) * 10 AS INT) AS VARCHAR) || ' - ' || CAST(CAST(floor(quantity / 10) * 10 AS INT) + 10 AS VARCHAR) AS quantity,
 count(*) AS n FROM items GROUP BY ALL""")
def b04_width(spark, sf):
    preset = B.Preset(("quantity", "line", "flag"), "flag", ("quantity",), bucket_size=10)
    return B.prepare(items(spark, sf), preset).groupBy("flag", "line", "quantity").agg(F.count("*").alias("n"))


@query("b06_toy_preset", """
SELECT CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, count(*) AS n FROM labels GROUP BY ALL""")
def b06(spark, sf):
    preset = B.Preset(("quality", "toxic"), "toxic")
    return B.prepare(table(spark, sf, "labels"), preset).groupBy("quality", "toxic").agg(F.count("*").alias("n"))
