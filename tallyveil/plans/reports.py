"""Registered queries: quality and independence reports, diagnostics, tables about runs, stored results."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyveil.operators import experiments as X
from tallyveil.operators import quality as Q
from tallyveil.operators.marginals import all_pairs, count_rows
from tallyveil.operators.privacy import statistic_sigma
from tallyveil.plans import synthesiser as S
from tallyveil.plans.base import CATS, CODED, COLUMNS, PAIRS, SURVEY, binned, coded, counted, declared, survey, table
from tallyveil.plans.counting import counts_sql, grid_sql
from tallyveil.plans.registry import query
from tallyveil.session import scratch_path
from tallyveil.sources import store

# ---------------------------------------------------------------- marginals side by side

_SIDES = f"{SURVEY}, syn AS (SELECT CAST(nation % 4 AS INT) AS dataset_id, status, priority, segment FROM survey)"


def _sides(spark, sf):
    df = survey(spark, sf)
    return df, df.withColumn("dataset_id", (F.col("nation") % 4).cast("int"))


@query("q01_value_counts_by_kind", f"WITH {_SIDES} " + " UNION ALL ".join(
    f"SELECT 'original' AS kind, CAST(NULL AS INT) AS dataset_id, '{c}' AS col, {c} AS value, count(*) AS n FROM survey GROUP BY {c} "
    f"UNION ALL SELECT 'synthetic', dataset_id, '{c}', {c}, count(*) FROM syn GROUP BY dataset_id, {c}" for c in CATS))
def q01(spark, sf):
    return Q.value_count_table(*_sides(spark, sf), CATS)


@query("q02_mean_synthetic_counts", f"WITH {_SIDES} " + " UNION ALL ".join(
    f"SELECT 'original' AS kind, '{c}' AS col, {c} AS value, round(count(*)::DOUBLE, 6) AS mean_n FROM survey GROUP BY {c} "
    f"UNION ALL SELECT 'synthetic', '{c}', {c}, round(count(*) / 4, 6) FROM syn GROUP BY {c}" for c in CATS))
def q02(spark, sf):
    return Q.mean_counts(Q.value_count_table(*_sides(spark, sf), CATS), 4).withColumn("mean_n", F.round("mean_n", 6))


# ---------------------------------------------------------------- chi-square

_ALL = all_pairs(COLUMNS)
_CELLS = f"{CODED}, {grid_sql(_ALL)}, {counts_sql(_ALL)}"
_CHI = f"""{_CELLS}, rs AS (SELECT clique_id, v0, sum(n) AS r FROM cells GROUP BY 1, 2), cs AS (SELECT clique_id, v1, sum(n) AS c FROM cells GROUP BY 1, 2),
ns AS (SELECT clique_id, sum(n) AS t, (count(DISTINCT v0) - 1) * (count(DISTINCT v1) - 1) AS df FROM cells GROUP BY 1),
chi AS (SELECT cells.clique_id, df, sum(pow(n - r * c / t, 2) / (r * c / t)) AS statistic, sum(CASE WHEN v0 = 0 AND v1 = 0 THEN r * c / t END) AS first_expected
 FROM cells JOIN rs USING (clique_id, v0) JOIN cs USING (clique_id, v1) JOIN ns USING (clique_id) GROUP BY 1, 2),
named AS (SELECT *, CASE clique_id {' '.join(f"WHEN {i} THEN '{a}'" for i, (a, _) in enumerate(_ALL))} END AS left_col,
 CASE clique_id {' '.join(f"WHEN {i} THEN '{b}'" for i, (_, b) in enumerate(_ALL))} END AS right_col,
 1 - (SELECT sum(exp((df / 2 + k) * ln(statistic / 2) - statistic / 2 - lgamma(df / 2 + k + 1))) FROM range(400) g(k)) AS p FROM chi)"""


@query("q03_chi_square", f"WITH {_CHI} SELECT left_col, right_col, CAST(df AS BIGINT) AS df, round(statistic, 5) AS statistic, round(p, 6) + 0.0 AS p FROM named")
def q03(spark, sf):
    r = Q.pair_chi_square(*counted(spark, sf), rows="rows")
    return r.select("left_col", "right_col", "df", F.round("statistic", 5).alias("statistic"), (F.round("p", 6) + 0.0).alias("p"))


@query("q03_chi_square_two_by_two", """
WITH b AS (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)),
c AS (SELECT source, y.v AS quality, x.v AS toxic, count(b.source) AS n FROM (SELECT DISTINCT source FROM b) s CROSS JOIN (VALUES (0), (1)) y(v) CROSS JOIN (VALUES (0), (1)) x(v)
 LEFT JOIN b USING (source) WHERE b.quality = y.v AND b.toxic = x.v GROUP BY ALL),
f AS (SELECT k.source, q.v AS quality, x.v AS toxic, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT source FROM b) k CROSS JOIN (VALUES (0), (1)) q(v) CROSS JOIN (VALUES (0), (1)) x(v)
 LEFT JOIN c ON c.source = k.source AND c.quality = q.v AND c.toxic = x.v),
e AS (SELECT *, sum(n) OVER (PARTITION BY source, quality) * sum(n) OVER (PARTITION BY source, toxic) / sum(n) OVER (PARTITION BY source) AS ex FROM f)
SELECT source, round(sum(pow(greatest(abs(n - ex) - 0.5, 0), 2) / ex), 6) AS statistic FROM e GROUP BY 1
HAVING min(ex) > 0""")
def q03_yates(spark, sf):
    df = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    cells = df.groupBy("source", "quality", "toxic").agg(F.count("*").alias("n"))
    return Q.chi_square(cells, ["source"], "quality", "toxic").filter("df = 1").select("source", F.round("statistic", 6).alias("statistic"))


@query("q04_first_expected_count", f"WITH {_CHI} SELECT left_col, right_col, round(first_expected, 6) AS first_expected FROM named")
def q04(spark, sf):
    return Q.pair_chi_square(*counted(spark, sf), rows="rows").select("left_col", "right_col", F.round("first_expected", 6).alias("first_expected"))


@query("q05_rank_pairs", f"WITH {_CHI} SELECT left_col, right_col, CAST(row_number() OVER (ORDER BY statistic, left_col, right_col) AS INT) AS place FROM named")
def q05(spark, sf):
    return Q.rank_pairs(Q.pair_chi_square(*counted(spark, sf), rows="rows"), "statistic").select("left_col", "right_col", "place")


@query("q06_compare_rankings", f"""
WITH {_CHI}, a AS (SELECT *, row_number() OVER (ORDER BY statistic, left_col, right_col) AS place FROM named),
b AS (SELECT left_col, right_col, statistic / df AS s, row_number() OVER (ORDER BY statistic / df, left_col, right_col) AS place FROM named)
SELECT least(left_col, right_col) AS c1, greatest(left_col, right_col) AS c2, CAST(abs(a.place - b.place) AS INT) AS distance, round(abs(a.statistic - b.s) / a.statistic, 6) AS relative_difference
FROM a JOIN b USING (left_col, right_col)""")
def q06(spark, sf):
    chi = Q.pair_chi_square(*counted(spark, sf), rows="rows").persist()
    other = chi.withColumn("statistic", F.col("statistic") / F.col("df")).select(F.col("right_col").alias("left_col"), F.col("left_col").alias("right_col"), "statistic")
    # the second ranking names each pair the other way round; ties do not occur
    out = Q.compare_rankings(Q.rank_pairs(chi, "statistic"), Q.rank_pairs(other, "statistic"), "statistic")
    return out.withColumn("relative_difference", F.round("relative_difference", 6))


@query("q07_sorted_pair_keys", f"""
WITH {_CHI} SELECT CASE WHEN left_col < right_col THEN left_col || '+' || right_col ELSE right_col || '+' || left_col END AS pair,
 CAST(row_number() OVER (ORDER BY statistic DESC, left_col, right_col) AS INT) AS place FROM named""")
def q07(spark, sf):
    ranked = Q.rank_pairs(Q.pair_chi_square(*counted(spark, sf), rows="rows"), "statistic", ascending=False)
    return ranked.select(Q.pair_key("left_col", "right_col").alias("pair"), "place")


@query("q08_min_max_scores", f"WITH {_CHI} SELECT left_col, right_col, round((statistic - (SELECT min(statistic) FROM named)) / (SELECT max(statistic) - min(statistic) FROM named), 2) AS scaled FROM named")
def q08(spark, sf):
    return Q.min_max(Q.pair_chi_square(*counted(spark, sf), rows="rows"), "statistic", "scaled").select("left_col", "right_col", "scaled")


@query("q09_attach_score", """
SELECT e.event_id, e.event_type AS missing_query, round(s.score, 6) AS score FROM events e LEFT JOIN
 (SELECT event_type, avg(value) AS score FROM events GROUP BY 1 HAVING event_type <> 'click') s ON s.event_type = e.event_type""")
def q09(spark, sf):
    ev = table(spark, sf, "events")
    scores = ev.filter("event_type <> 'click'").groupBy(F.col("event_type").alias("pair")).agg(F.round(F.avg("value"), 6).alias("score"))
    return Q.attach_score(ev.select("event_id", F.col("event_type").alias("missing_query")), scores, "missing_query", "pair", "score").select("event_id", "missing_query", "score")


# ---------------------------------------------------------------- closeness


@query("q10_moments_close", """
WITH o AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders),
d AS (SELECT CAST(o_custkey % 50 AS INT) AS dataset_id, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1)
SELECT dataset_id, 'o_totalprice' AS col, round(abs(d.m - o.m) / abs(o.m), 6) AS mean_gap, round(abs(d.s - o.s) / abs(o.s), 6) AS std_gap,
 abs(d.m - o.m) / abs(o.m) <= 0.03 AND abs(d.s - o.s) / abs(o.s) <= 0.03 AS close FROM d, o""")
def q10(spark, sf):
    o = table(spark, sf, "orders")
    out = Q.moments_close(o, o.withColumn("dataset_id", (F.col("o_custkey") % 50).cast("int")), ["o_totalprice"], 0.03)
    return out.withColumn("mean_gap", F.round("mean_gap", 6)).withColumn("std_gap", F.round("std_gap", 6))


_DRAWS = """draws AS (SELECT o_orderkey % 4 AS chain, o_orderkey // 4 AS draw, 'price' AS param, o_totalprice AS value FROM orders
 UNION ALL SELECT o_orderkey % 4, o_orderkey // 4, 'customer', o_custkey::DOUBLE FROM orders)"""


def _draws(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("chain"), F.call_function("div", F.col("o_orderkey"), F.lit(4)).alias("draw"),
                                          F.col("o_totalprice").alias("price"), F.col("o_custkey").cast("double").alias("customer"))
    return o.unpivot(["chain", "draw"], ["price", "customer"], "param", "value")


@query("q11_draw_summary", f"""
WITH {_DRAWS}, e AS (SELECT param, chain, count(*) AS len, min(draw) AS d0 FROM draws GROUP BY 1, 2),
h AS (SELECT draws.*, CASE WHEN draw - d0 < len // 2 THEN 0 WHEN draw - d0 >= len - len // 2 THEN 1 END AS half FROM draws JOIN e USING (param, chain)),
per AS (SELECT param, chain, half, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM h WHERE half IS NOT NULL GROUP BY 1, 2, 3),
mix AS (SELECT param, avg(v) AS w, var_samp(m) AS bn, min(n) AS n FROM per GROUP BY 1),
s AS (SELECT param, avg(value) AS mean, stddev_samp(value) AS sd, quantile_disc(value, 0.05) AS p05, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM draws GROUP BY 1)
SELECT param, round(mean, 4) AS mean, round(sd, 4) AS sd, p05, median, p95, round(sqrt(((n - 1) / n * w + bn) / w), 6) AS r_hat FROM s JOIN mix USING (param)""")
def q11(spark, sf):
    s = Q.draw_summary(_draws(spark, sf))
    return s.select("param", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "p05", "median", "p95", F.round("r_hat", 6).alias("r_hat"))


@query("q12_trace_stats_per_chain", f"WITH {_DRAWS} SELECT chain, param, min(value) AS value_min, max(value) AS value_max, round(avg(value), 4) AS value_mean, round(stddev_pop(value), 4) AS value_std FROM draws GROUP BY 1, 2")
def q12(spark, sf):
    t = Q.trace_stats(_draws(spark, sf), ["chain", "param"], ["value"])
    return t.withColumn("value_mean", F.round("value_mean", 4)).withColumn("value_std", F.round("value_std", 4))


@query("q13_run_chain_stats", """
SELECT event_type AS dataset, user_id % 3 AS epsilon, user_id % 4 AS chain, round(avg(value), 6) AS value_mean, round(stddev_pop(value), 6) AS value_std, count(*) AS n
FROM events GROUP BY 1, 2, 3""")
def q13(spark, sf):
    from tallyveil.sources.tables import with_path_parts, write_table

    path = scratch_path(spark, "traces")
    ev = table(spark, sf, "events").select(F.col("event_type").alias("d"), (F.col("user_id") % 3).alias("e"), (F.col("user_id") % 4).alias("chain"), "value")
    write_table(ev, path, partition_by=["d", "e"])
    raw = spark.read.schema("chain long, value double").option("recursiveFileLookup", "true").parquet(path)
    runs = with_path_parts(raw, r"/d=([^/]*)/e=([^/]*)/", ["dataset", "epsilon"]).withColumn("epsilon", F.col("epsilon").cast("long"))
    stats = Q.trace_stats(runs.withColumn("one", F.lit(1)), ["dataset", "epsilon", "chain"], ["value"])
    sizes = runs.groupBy("dataset", "epsilon", "chain").agg(F.count("*").alias("n"))
    return stats.join(sizes, ["dataset", "epsilon", "chain"]).select("dataset", "epsilon", "chain", F.round("value_mean", 6).alias("value_mean"), F.round("value_std", 6).alias("value_std"), "n")


_NUM = ["l_quantity", "l_discount", "l_tax"]


@query("q14_covariance_matrix", " UNION ALL ".join(f"SELECT '{a}' AS left_col, '{b}' AS right_col, round(covar_samp({a}, {b}), 6) + 0.0 AS cov FROM lineitem" for a in _NUM for b in _NUM))
def q14(spark, sf):
    return Q.covariance_matrix(table(spark, sf, "lineitem"), _NUM).withColumn("cov", F.round("cov", 6) + 0.0)


@query("q15_histogram", """
WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)
SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 50)), 49) AS INT) AS bin, count(*) AS n FROM orders, e GROUP BY 1""")
def q15(spark, sf):
    return Q.histogram(table(spark, sf, "orders"), "o_totalprice", 50)


@query("q16_normal_density_grid", """
WITH s AS (SELECT event_type, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY 1)
SELECT event_type, round(x, 6) AS x, round(exp(-pow(x - m, 2) / (2 * v)) / sqrt(2 * pi() * v), 8) AS density
FROM s, (SELECT -50 + i * (200.0::DOUBLE / 40) AS x FROM range(41) t(i))""")
def q16(spark, sf):
    s = table(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    g = Q.normal_density_grid(s, ["event_type"], "m", "v", -50.0, 150.0, 41)
    return g.select("event_type", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"))


def _central_sql(t: str) -> str:
    f = f"exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow(i * ({t}) / 400, 2) / df, -(df + 1) / 2)"
    return f"(SELECT 2 * sum((CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}) * (({t}) / 400) / 3 FROM range(401) steps(i))"


@query("q17_correlation_per_group", f"""
WITH s AS (SELECT c_mktsegment, corr(c_acctbal, c_nationkey) AS r, count(*) AS n, count(*) - 2.0::DOUBLE AS df FROM customer GROUP BY 1)
SELECT c_mktsegment, round(r, 6) AS r, n, round(1 - {_central_sql('abs(r) * sqrt(df / (1 - r * r))')}, 5) AS p FROM s""")
def q17(spark, sf):
    c = Q.correlation(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey")
    return c.select("c_mktsegment", F.round("r", 6).alias("r"), "n", F.round("p", 5).alias("p"))


@query("q18_kernel_density", f"""
WITH b AS (SELECT event_type, (floor((value - 0.0) / (200.0::DOUBLE / 2048)) + 0.5) * (200.0::DOUBLE / 2048) AS c, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, round(x, 6) AS x, round(sum(n * exp(-pow((x - c) / 5.0, 2) / 2) / (5.0 * {math.sqrt(2 * math.pi)!r}::DOUBLE)) / sum(n), 8) AS density,
 round(exp(-x * x / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE, 8) AS standard_normal
FROM b, (SELECT i * (200.0::DOUBLE / 50) AS x FROM range(51) t(i)) GROUP BY 1, x""")
def q18(spark, sf):
    k = Q.kernel_density(table(spark, sf, "events"), ["event_type"], "value", 0.0, 200.0, 51, 5.0)
    return k.select("event_type", F.round("x", 6).alias("x"), F.round("density", 8).alias("density"), F.round("standard_normal", 8).alias("standard_normal"))


@query("q19_tables_equal", """
SELECT count(*) AS only_a, CAST(0 AS BIGINT) AS only_b, count(*) = 0 AS equal FROM orders WHERE o_orderstatus = 'P'""")
def q19(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = scratch_path(spark, "stored")
    o.filter("o_orderstatus <> 'P'").write.parquet(path)
    return Q.tables_equal(o, spark.read.parquet(path))


# ---------------------------------------------------------------- tables about runs

_LOG = "log AS (SELECT user_id, event_type AS task, min(ts) AS start, max(ts) AS stop FROM events GROUP BY 1, 2)"


@query("x01_durations", f"WITH {_LOG} SELECT user_id, task, round(epoch(stop) - epoch(start), 3) AS seconds FROM log WHERE task IN ('click', 'purchase')")
def x01(spark, sf):
    log = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("task")).agg(F.min("ts").alias("start"), F.max("ts").alias("stop"))
    return X.durations(log, tasks=["click", "purchase"]).select("user_id", "task", F.round("seconds", 3).alias("seconds"))


@query("x02_upsert_fields", """
WITH n AS (SELECT c_custkey + 100 AS c_custkey, CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS c_mktsegment, c_acctbal AS score FROM customer)
SELECT coalesce(o.c_custkey, n.c_custkey) AS c_custkey, coalesce(n.c_mktsegment, o.c_mktsegment) AS c_mktsegment, o.c_nationkey, n.score
FROM (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer) o FULL JOIN n ON n.c_custkey = o.c_custkey""")
def x02(spark, sf):
    c = table(spark, sf, "customer")
    new = c.select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).alias("c_mktsegment"), F.col("c_acctbal").alias("score"))
    return X.upsert_fields(c.select("c_custkey", "c_mktsegment", "c_nationkey"), new, "c_custkey")


@query("x02_latest_fields", "SELECT user_id, event_type AS field, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def x02_long(spark, sf):
    return X.latest_fields(table(spark, sf, "events").withColumnRenamed("event_type", "field"), "user_id", "field", "value", "event_id")


# The budgets of the experiments.
EPSILONS = [0.1, 0.3, 1.0, 3.0, 8.0]
_SETS = f"{SURVEY}, sets AS (SELECT segment AS dataset_name, count(*) AS n FROM survey GROUP BY 1)"
_EPS_SQL = "(SELECT unnest([" + ", ".join(map(str, EPSILONS)) + "])::DOUBLE AS epsilon)"


def _sets(spark, sf):
    return survey(spark, sf).groupBy(F.col("segment").alias("dataset_name")).agg(F.count("*").alias("n"))


@query("x03_parameter_grid", f"""
WITH {_SETS}, g AS (SELECT *, dataset_name || '_' || replace(CAST(epsilon AS VARCHAR), '.', '') || 'e_' || query AS run_key
 FROM sets, (SELECT unnest(['empty', 'status+priority', 'status+priority-status+segment']) AS query), {_EPS_SQL}, (SELECT CAST(unnest(range(20)) AS INT) AS repeat))
SELECT dataset_name, n, query, epsilon, repeat, run_key, round(1.0::DOUBLE / (n * n), 14) AS delta, md5(run_key || '_' || repeat) AS run_id FROM g""")
def x03(spark, sf):
    return X.parameter_grid(_sets(spark, sf), [[], PAIRS[:1], PAIRS[:2]], EPSILONS, 20).withColumn("delta", F.round("delta", 14))


@query("x04_pruning_grid", f"""
WITH {_SETS} SELECT dataset_name, n, missing_query, epsilon, {len(PAIRS) - 1} AS pairs_left, dataset_name || '_' || replace(CAST(epsilon AS VARCHAR), '.', '') || 'e_' || missing_query AS run_key
FROM sets, (SELECT unnest([{', '.join(f"'{a}+{b}'" for a, b in PAIRS)}]) AS missing_query), {_EPS_SQL}""")
def x04(spark, sf):
    return X.pruning_grid(_sets(spark, sf), PAIRS, EPSILONS)


_RES = "res AS (SELECT l_returnflag AS dataset, CAST(l_linenumber AS DOUBLE) AS epsilon, l_suppkey AS run, avg(l_discount) AS metric FROM lineitem GROUP BY 1, 2, 3)"


def _results(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").cast("double").alias("epsilon"), F.col("l_suppkey").alias("run")).agg(F.avg("l_discount").alias("metric"))


@query("x05_append_originals", f"""
WITH {_RES} SELECT dataset, CAST(epsilon AS VARCHAR) AS epsilon, run, round(metric, 8) AS metric FROM res
UNION ALL SELECT l_returnflag, 'Inf', NULL, round(avg(l_discount), 8) FROM lineitem GROUP BY 1""")
def x05(spark, sf):
    orig = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("dataset")).agg(F.avg("l_discount").alias("metric"))
    return X.with_originals(_results(spark, sf), orig).withColumn("metric", F.round("metric", 8))


@query("x06_labelled_union", """
SELECT event_id AS id, value, NULL::BIGINT AS user_id, 'first' AS experiment FROM events WHERE user_id < 50
UNION ALL SELECT event_id, value, user_id, 'second' FROM events WHERE user_id >= 50""")
def x06(spark, sf):
    ev = table(spark, sf, "events").withColumnRenamed("event_id", "id")
    return X.labelled_union({"first": ev.filter("user_id < 50").select("id", "value"), "second": ev.filter("user_id >= 50").select("id", "value", "user_id")})


@query("x07_results_with_extremes", f"""
WITH {_RES} SELECT dataset, epsilon, run, round(metric, 8) AS metric, round(max(metric) OVER (PARTITION BY dataset), 8) AS best, round(min(metric) OVER (PARTITION BY dataset), 8) AS worst FROM res""")
def x07(spark, sf):
    out = X.with_extremes(_results(spark, sf), "dataset", "metric")
    return out.select("dataset", "epsilon", "run", *[F.round(c, 8).alias(c) for c in ("metric", "best", "worst")])


@query("x08_metric_facets", f"""
WITH {_RES} SELECT dataset, epsilon, round(avg(metric), 8) AS mean, round(stddev_samp(metric), 8) AS sd, count(metric) AS n, grouping(dataset, epsilon) AS level
FROM res GROUP BY CUBE (dataset, epsilon)""")
def x08(spark, sf):
    out = X.metric_facets(_results(spark, sf), ["dataset", "epsilon"], "metric")
    return out.withColumn("mean", F.round("mean", 8)).withColumn("sd", F.round("sd", 8))


# ---------------------------------------------------------------- fitting, storing, generating


def _fitted(spark, sf, **kw):
    labels = count_rows(survey(spark, sf), CATS)
    return S.fit(labels, declared(CATS), S.Options(pairs=PAIRS[:2], draws=3, salt="fit", **kw), "rows")


@query("m19_fit_plan_sweep", f"""
WITH {CODED}, k AS (SELECT {', '.join(f'(SELECT max({c}) + 1 FROM coded) AS k{i}' for i, c in enumerate(COLUMNS))})
""" + " UNION ALL ".join(
    f"SELECT {k} AS columns, {k * (k - 1) // 2} AS pairs, CAST(" + " + ".join([f"(k{i} - 1)" for i in range(k)] + [f"(k{i} - 1) * (k{j} - 1)" for i in range(k) for j in range(i + 1, k)])
    + f" AS BIGINT) AS canonical_cells, {k} AS width, round({statistic_sigma(k * (k - 1) // 2, 1.0, 1e-6)!r}::DOUBLE, 6) AS sigma, (SELECT count(*) FROM coded) AS n_rows FROM k" for k in range(2, 6)))
def m19(spark, sf):
    df, domain = coded(spark, sf)
    rows = []
    for k in range(2, len(COLUMNS) + 1):
        plan = S.plan_fit(df, domain.only(COLUMNS[:k]), S.Options(pairs=all_pairs(COLUMNS[:k])))
        rows.append((k, len(plan.pairs), plan.canonical_cells, plan.width, round(plan.sigma, 6)))
    out = spark.createDataFrame(rows, "columns int, pairs int, canonical_cells long, width int, sigma double")
    return out.join(F.broadcast(df.agg(F.count("*").alias("n_rows"))))


@query("m20_fit_and_generate_tree")
def m20(spark, sf):
    labels = count_rows(binned(spark, sf), COLUMNS)
    fitted = S.fit(labels, declared(COLUMNS), S.Options(epsilon=3.0, draws=4), "rows")
    return S.generate(spark, fitted, 4).groupBy("dataset_id", "status", "priority").agg(F.count("*").alias("n"))


@query("m20_fit_and_generate_explicit")
def m20_explicit(spark, sf):
    fitted = _fitted(spark, sf, method="explicit")
    return S.generate(spark, fitted, 3).groupBy("dataset_id", "status", "segment").agg(F.count("*").alias("n"))


@query("d18_select_measure_generate")
def d18(spark, sf):
    labels = binned(spark, sf)
    out = S.select_measure_generate(labels, declared(COLUMNS), 1.0, 1e-6)
    return out.groupBy("priority", "price").agg(F.count("*").alias("n"))


@query("s09_store_synthetic_tables", f"WITH {SURVEY} SELECT CAST(nation % 3 AS INT) AS dataset_id, status, count(*) AS n, '1.0' AS epsilon FROM survey GROUP BY 1, 2")
def s09(spark, sf):
    path = scratch_path(spark, "synthetic")
    syn = survey(spark, sf).select((F.col("nation") % 3).cast("int").alias("dataset_id"), "status", "priority")
    store.store_synthetic(syn, path, "run-a", {"epsilon": 1.0, "query": "status+priority"})
    store.store_synthetic(syn.filter("dataset_id = 0"), path, "run-b", {"epsilon": 8.0})
    rows, meta = store.load_synthetic(spark, path, "run-a")
    return rows.groupBy("dataset_id", "status").agg(F.count("*").alias("n")).withColumn("epsilon", F.lit(meta["epsilon"]))


@query("s10_store_fitted_model", f"WITH {SURVEY} SELECT 'tree' AS method, count(*) AS n_rows, true AS equal, true AS recognised, false AS other FROM survey")
def s10(spark, sf):
    fitted, path = _fitted(spark, sf), scratch_path(spark, "model")
    S.save(spark, fitted, path)
    back = S.load(spark, path)
    a, b = [f.cpts.select("draw_id", "col", "parent_code", "code", F.round("cum", 9).alias("cum")) for f in (fitted, back)]
    same = Q.tables_equal(a, b).first()["equal"]
    n = survey(spark, sf).agg(F.count("*").alias("n_rows"))
    return n.select(F.lit(back.meta["method"]).alias("method"), "n_rows", F.lit(same).alias("equal"),
                    F.lit(store.is_stored_model(spark, path)).alias("recognised"), F.lit(store.is_stored_model(spark, f"{path}/cpts")).alias("other"))
