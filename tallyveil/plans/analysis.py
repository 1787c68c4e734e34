"""Registered queries: regression, classification, combining rules, coverage."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from tallyveil.operators import classify as C
from tallyveil.operators import regression as R
from tallyveil.operators import rubin as V
from tallyveil.operators.cleaning import split_by_fraction
from tallyveil.operators.domain import Domain, encode
from tallyveil.operators.marginals import count_rows
from tallyveil.plans.base import CATS, SURVEY, coded, declared, survey, table
from tallyveil.plans.coverage import LEVELS, repeated_records
from tallyveil.plans.registry import query
from tallyveil.plans.synthesiser import Options, fit, generate_counts

REPEATS, TABLES = 50, 100  # fixed values: releases and synthetic tables of the experiments

# One binary feature: the estimates have a closed form, so SQL can check the iterations.
_XY = f"""{SURVEY}, xy AS (SELECT row_id, nation, CAST(priority IN ('1-URGENT', '2-HIGH') AS INT) AS rush, CAST(status = 'F' AS INT) AS done, price FROM survey)"""


def _xy(spark, sf):
    df = survey(spark, sf)
    return df.select("row_id", "nation", F.col("priority").isin("1-URGENT", "2-HIGH").cast("int").alias("rush"),
                     (F.col("status") == "F").cast("int").alias("done"), "price")


def _logit_sql(source: str, key: str, weight: float = 1.0, y: str = "done") -> str:
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}, rush" if key else "GROUP BY rush"
    on = f"USING ({key})" if key else "ON true"
    kk = f"{key}, " if key else ""
    return f"""(WITH c AS (SELECT {k}rush, avg({y}) AS p, count(*) * {weight}::DOUBLE AS n FROM {source} {g}),
 a AS (SELECT * FROM c WHERE rush = 0), b AS (SELECT * FROM c WHERE rush = 1)
 SELECT {kk}0 AS param_index, 'const' AS param, ln(a.p / (1 - a.p)) AS q, 1 / (a.n * a.p * (1 - a.p)) AS u FROM a JOIN b {on}
 UNION ALL SELECT {kk}1, 'rush', ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)), 1 / (a.n * a.p * (1 - a.p)) + 1 / (b.n * b.p * (1 - b.p)) FROM a JOIN b {on})"""


def _round_qu(df):
    return df.withColumn("q", F.round("q", 6) + 0.0).withColumn("u", F.round("u", 6))


_QU = "param_index, param, round(q, 6) + 0.0 AS q, round(u, 6) AS u"


@query("r01_logistic_many_tables", f"WITH {_XY} SELECT nation, {_QU} FROM {_logit_sql('xy', 'nation')}")
def r01(spark, sf):
    return _round_qu(R.fit_many(_xy(spark, sf), ["nation"], ["rush"], "done"))


@query("r01_logistic_many_tables_by_sums", f"WITH {_XY} SELECT nation, {_QU} FROM {_logit_sql('xy', 'nation')}")
def r01_sums(spark, sf):
    return _round_qu(R.fit_many(_xy(spark, sf), ["nation"], ["rush"], "done", task_rows=0))


@query("r02_logistic_one_table", f"WITH {_XY} SELECT {_QU} FROM {_logit_sql('xy', '')}")
def r02(spark, sf):
    return _round_qu(R.fit_one(_xy(spark, sf), ["rush"], "done"))


_Z = {v: NormalDist().inv_cdf(0.5 + v / 2) for v in (0.5, 0.9, 0.95)}


@query("r03_normal_intervals", f"WITH {_XY} " + " UNION ALL ".join(
    f"SELECT nation, param, {v}::DOUBLE AS level, round(q - {z!r}::DOUBLE * sqrt(u), 5) AS low, round(q + {z!r}::DOUBLE * sqrt(u), 5) AS high FROM {_logit_sql('xy', 'nation')}" for v, z in _Z.items()))
def r03(spark, sf):
    est = R.fit_many(_xy(spark, sf), ["nation"], ["rush"], "done")
    return R.normal_intervals(est, list(_Z)).select("nation", "param", "level", F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("r04_constant_weight", f"WITH {_XY} SELECT nation, {_QU} FROM {_logit_sql('xy', 'nation', 2.5)}")
def r04(spark, sf):
    return _round_qu(R.fit_many(_xy(spark, sf), ["nation"], ["rush"], "done", weight=2.5))


_SEP = f"{_XY}, sep AS (SELECT nation, rush, CASE WHEN nation % 5 = 0 THEN rush ELSE done END AS done FROM xy)"


@query("r05_perfect_separation", f"""
WITH {_SEP} SELECT nation, {_QU} FROM {_logit_sql("(SELECT * FROM sep WHERE nation % 5 <> 0)", 'nation')}
UNION ALL SELECT nation, unnest([0, 1]), unnest(['const', 'rush']), NULL, NULL FROM (SELECT DISTINCT nation FROM sep WHERE nation % 5 = 0)""")
def r05(spark, sf):
    df = _xy(spark, sf).withColumn("done", F.when(F.col("nation") % 5 == 0, F.col("rush")).otherwise(F.col("done")))
    return _round_qu(R.fit_many(df, ["nation"], ["rush"], "done"))


# Bootstrap means stay near the closed form and bootstrap variances near the squared standard errors.
@query("r06_regularised_bootstrap", f"WITH {_XY} SELECT nation, param, true AS near FROM {_logit_sql('xy', 'nation')}")
def r06(spark, sf):
    return _near_plain(_xy(spark, sf))


def _near_plain(df, **kw):
    boot = R.fit_bootstrap(df, ["nation"], ["rush"], "done", samples=50, **kw)
    plain = R.fit_many(df, ["nation"], ["rush"], "done").select("nation", "param", F.col("q").alias("q0"), F.col("u").alias("u0"))
    near = (F.abs(F.col("q") - F.col("q0")) < 5 * F.sqrt(F.col("u0") / 10)) & (F.col("u") / F.col("u0")).between(0.3, 3.0) & (F.col("low") < F.col("q0")) & (F.col("high") > F.col("q0"))
    return boot.join(plain, ["nation", "param"]).select("nation", "param", near.alias("near"))


@query("r06_bootstrap_by_sums", f"WITH {_XY} SELECT nation, param, true AS near FROM {_logit_sql('xy', 'nation')}")
def r06_sums(spark, sf):
    return _near_plain(_xy(spark, sf), task_rows=0)


@query("r06_resample_totals", f"WITH {_XY} SELECT nation, boot_id, count(*) AS n FROM xy, (SELECT CAST(unnest(range(50)) AS INT) AS boot_id) GROUP BY ALL")
def r06_totals(spark, sf):
    rows = R.compress(_xy(spark, sf), ["nation"], ["rush", "price"], "done")
    drawn = R.resample_counts(rows, ["nation"], ["rush", "price"], 50, 0, part_rows=100)
    return drawn.select("nation", F.posexplode("counts").alias("boot_id", "n")).groupBy("nation", "boot_id").agg(F.sum("n").alias("n"))


@query("r07_score_rows", """
SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(-1.5 + 0.04 * l_quantity + 3.0 * l_discount))), 8) AS p,
 CAST(1 / (1 + exp(-(-1.5 + 0.04 * l_quantity + 3.0 * l_discount))) >= 0.5 AS INT) AS label FROM lineitem""")
def r07(spark, sf):
    p, label = R.score({"const": -1.5, "l_quantity": 0.04, "l_discount": 3.0})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(p, 8).alias("p"), label.alias("label"))


@query("r08_per_table_and_pooled", f"WITH {_XY} SELECT nation, {_QU} FROM {_logit_sql('xy', 'nation')} UNION ALL SELECT NULL, {_QU} FROM {_logit_sql('xy', '')}")
def r08(spark, sf):
    return _round_qu(R.fit_per_table_and_pooled(_xy(spark, sf), "nation", ["rush"], "done"))


@query("r08_per_table_and_pooled_by_sums", f"WITH {_XY} SELECT nation, {_QU} FROM {_logit_sql('xy', 'nation')} UNION ALL SELECT NULL, {_QU} FROM {_logit_sql('xy', '')}")
def r08_sums(spark, sf):
    return _round_qu(R.fit_per_table_and_pooled(_xy(spark, sf), "nation", ["rush"], "done", task_rows=0))


@query("r09_original_fit_with_interval", f"""
WITH {_XY} SELECT param, round(q, 6) + 0.0 AS q, round(q - {_Z[0.95]!r}::DOUBLE * sqrt(u), 5) AS low, round(q + {_Z[0.95]!r}::DOUBLE * sqrt(u), 5) AS high FROM {_logit_sql('xy', '')}""")
def r09(spark, sf):
    est = R.normal_intervals(R.fit_one(_xy(spark, sf), ["rush"], "done"), [0.95])
    return est.select("param", (F.round("q", 6) + 0.0).alias("q"), F.round("low", 5).alias("low"), F.round("high", 5).alias("high"))


@query("r10_least_squares", """
WITH s AS (SELECT sum(l_quantity * l_quantity) AS aa, sum(l_quantity * l_tax) AS ab, sum(l_tax * l_tax) AS bb,
 sum(l_quantity * l_extendedprice) AS ay, sum(l_tax * l_extendedprice) AS b_y FROM lineitem)
SELECT 'l_quantity' AS param, round((ay * bb - b_y * ab) / (aa * bb - ab * ab), 4) AS q FROM s
UNION ALL SELECT 'l_tax', round((b_y * aa - ay * ab) / (aa * bb - ab * ab), 4) FROM s""")
def r10(spark, sf):
    return R.ols(table(spark, sf, "lineitem"), ["l_quantity", "l_tax"], "l_extendedprice").select("param", F.round("q", 4).alias("q"))


_POIS = f"""{_XY}, pois AS (SELECT *, CAST(floor(price / 100000) AS INT) AS hits FROM xy),
mu AS (SELECT rush, avg(hits) AS m FROM pois GROUP BY 1)"""


@query("r11_poisson", f"""
WITH {_POIS} SELECT round((SELECT ln(m) FROM mu WHERE rush = 0), 6) AS const, round((SELECT ln(m) FROM mu WHERE rush = 1) - (SELECT ln(m) FROM mu WHERE rush = 0), 6) + 0.0 AS rush,
 round(avg(CAST(hits = round_even(m, 0) AS DOUBLE)), 6) AS accuracy FROM pois JOIN mu USING (rush)""")
def r11(spark, sf):
    df = _xy(spark, sf).withColumn("hits", F.floor(F.col("price") / 100000).cast("int"))
    coef = R.coefficients(R.fit_many(df, [], ["rush"], "hits", family="poisson"))
    _, label = R.score(coef, "poisson")
    return df.agg(F.round(F.avg((F.col("hits") == label).cast("double")), 6).alias("accuracy")).select(
        F.round(F.lit(coef["const"]), 6).alias("const"), (F.round(F.lit(coef["rush"]), 6) + 0.0).alias("rush"), "accuracy")


# z is a cubic of two columns without noise, so the fit must return its coefficients.
_CUBIC = {"const": 3.0, "x0_y1": -1.0, "x0_y2": 0.5, "x0_y3": 0.25, "x1_y0": 2.0, "x1_y1": 0.75, "x1_y2": -0.5, "x2_y0": 0.125, "x2_y1": -0.25, "x3_y0": 1.5}


@query("r12_polynomial_surface", "SELECT unnest([" + ", ".join(f"'{k}'" for k in _CUBIC) + "]) AS param, unnest([" + ", ".join(f"{v}::DOUBLE" for v in _CUBIC.values()) + """]) AS q,
 (SELECT count(*) FROM lineitem) AS n_rows, (SELECT count(*) FROM lineitem) AS n_exact""")
def r12(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("x"), (F.col("l_tax") * 10).alias("y"))
    df = df.withColumn("z", R.predict_polynomial(_CUBIC, "x", "y"))
    surface = R.fit_polynomial(df, "x", "y", "z")
    close = F.abs(R.predict_polynomial(R.coefficients(surface), "x", "y") - F.col("z")) < 1e-6
    counts = df.agg(F.count("*").alias("n_rows"), F.sum(close.cast("long")).alias("n_exact"))
    return surface.select("param", (F.round("q", 4) + 0.0).alias("q")).join(F.broadcast(counts))


# ---------------------------------------------------------------- classification


@query("c01_majority_class", f"""
WITH {SURVEY}, n AS (SELECT nation, CAST(status = 'F' AS INT) AS y, count(*) AS n FROM survey GROUP BY 1, 2)
SELECT nation, arg_max(y, n * 10 - y) AS prediction FROM n GROUP BY 1""")
def c01(spark, sf):
    return C.majority_label(_xy(spark, sf), "done", ["nation"])


def _train_test(spark, sf):
    """Synthetic tables of the coded survey, and the real rows as the test table; target: order finished."""
    labels = count_rows(survey(spark, sf), CATS)
    domain = declared(CATS)
    fitted = fit(labels, domain, Options(pairs=[("status", "priority"), ("status", "segment")], salt="clf", draws=TABLES), "rows")
    target = lambda d: d.withColumn("label", (F.col("status") == 1).cast("int")).drop("status")
    return target(generate_counts(fitted)), target(encode(labels, domain))


def _one_model(name):
    def run(spark, sf):
        train, test = _train_test(spark, sf)
        return C.train_all(train, test, ["priority", "segment"], "label", models=[name], rows="rows", test_rows="rows")
    return run


query("c02_gradient_boosting")(_one_model("gradient_boosting"))
query("c03_random_forest")(_one_model("random_forest"))
query("c04_linear_support_vectors")(_one_model("linear_svc"))
query("c05_neural_net")(_one_model("neural_net"))

_PRED = "(SELECT l_returnflag, CAST(l_linestatus = 'F' AS INT) AS y, CAST(l_quantity > 25 AS INT) AS p FROM lineitem)"


@query("c06_metrics", f"""
WITH c AS (SELECT l_returnflag, sum(y * p) AS tp, sum((1 - y) * (1 - p)) AS tn, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn FROM {_PRED} GROUP BY 1)
SELECT l_returnflag, round((tp + tn) / (tp + tn + fp + fn), 8) AS accuracy, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 8) AS balanced_accuracy, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""")
def c06(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("label"), (F.col("l_quantity") > 25).cast("int").alias("prediction"))
    m = C.metrics(df, ["l_returnflag"])
    return m.select("l_returnflag", *[F.round(c, 8).alias(c) for c in ("accuracy", "balanced_accuracy", "f1")])


@query("c07_train_synthetic_test_real")
def c07(spark, sf):
    """All models on each of 100 synthetic tables and on all of them together."""
    train, test = _train_test(spark, sf)
    return C.train_all(train, test, ["priority", "segment"], "label", "dataset_id", rows="rows", test_rows="rows")


@query("c08_single_class_tables", """
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus = 'F') > 1""")
def c08(spark, sf):
    df = table(spark, sf, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    return C.two_class_tables(df, "o_custkey", "label").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("c09_train_and_test_on_original")
def c09(spark, sf):
    df = coded(spark, sf, CATS)[0].withColumn("label", (F.col("status") == 1).cast("int"))
    part = split_by_fraction(df, "row_id", 0.7)
    return C.train_all(part.filter("part = 'train'"), part.filter("part = 'test'"), ["priority", "segment"], "label")


# ---------------------------------------------------------------- combining estimates

_EST = "est AS (SELECT event_type, user_id, avg(value) * (1 + user_id % 7) AS q, var_samp(value) / count(*) AS u FROM events GROUP BY 1, 2)"
_AGG = f"{_EST}, agg AS (SELECT event_type, count(*) AS m, avg(q) AS q_m, var_samp(q) AS b_m, avg(u) AS u_m FROM est WHERE u < 1000 GROUP BY 1)"
_TOT = f"""{_AGG}, tot AS (SELECT *, (1 + 1.0::DOUBLE / m) * b_m - u_m AS t_m, (m - 1) * pow(1 - u_m / ((1 + 1.0::DOUBLE / m) * b_m), 2) AS df FROM agg)"""


def _estimates(spark, sf, spread=7):
    ev = table(spark, sf, "events")
    return ev.groupBy("event_type", "user_id").agg((F.avg("value") * (1 + F.first("user_id") % spread)).alias("q"), (F.var_samp("value") / F.count("*")).alias("u"))


@query("v01_rubin_aggregates", f"WITH {_AGG} SELECT event_type, m, round(q_m, 6) AS q_m, round(b_m, 4) AS b_m, round(u_m, 6) AS u_m FROM agg")
def v01(spark, sf):
    a = V.aggregates(V.usable(_estimates(spark, sf)), ["event_type"])
    return a.select("event_type", "m", F.round("q_m", 6).alias("q_m"), F.round("b_m", 4).alias("b_m"), F.round("u_m", 6).alias("u_m"))


@query("v02_total_variance", f"WITH {_TOT} SELECT event_type, round(t_m, 4) AS t_m, round(df, 6) AS df FROM tot")
def v02(spark, sf):
    t = V.total_variance(V.combined(_estimates(spark, sf), ["event_type"]))
    return t.select("event_type", F.round("t_m", 4).alias("t_m"), F.round("df", 6).alias("df"))


# t quantile by bisection on Simpson's rule over the density.
_DENS = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + pow({t}, 2) / df, -(df + 1) / 2)"


def _central_sql(t: str) -> str:
    f = _DENS.format(t=f"(i * ({t}) / 400)")
    return f"(SELECT 2 * sum((CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f}) * (({t}) / 400) / 3 FROM range(401) r(i))"


_TQ = f"""RECURSIVE {_TOT}, s AS (SELECT event_type, df, level, 0.0::DOUBLE AS lo, 40.0::DOUBLE AS hi, 0 AS i FROM tot, (SELECT unnest([{', '.join(map(str, LEVELS))}])::DOUBLE AS level)
 UNION ALL SELECT event_type, df, level, CASE WHEN c < level THEN (lo + hi) / 2 ELSE lo END, CASE WHEN c < level THEN hi ELSE (lo + hi) / 2 END, i + 1
 FROM (SELECT *, {_central_sql('(lo + hi) / 2')} AS c FROM s WHERE i < 45)),
ranges AS (SELECT tot.*, s.level, q_m - (lo + hi) / 2 * sqrt(t_m) AS low, q_m + (lo + hi) / 2 * sqrt(t_m) AS high FROM s JOIN tot USING (event_type) WHERE i = 45)"""


@query("v03_rubin_intervals", f"WITH {_TQ} SELECT event_type, level, round(low, 4) AS low, round(high, 4) AS high FROM ranges")
def v03(spark, sf):
    r = V.intervals(V.total_variance(V.combined(_estimates(spark, sf), ["event_type"])), LEVELS)
    return r.select("event_type", "level", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


_NEG = """est AS (SELECT event_type, user_id % 5 AS part, user_id, avg(value) AS q, 3 * var_samp(value) / count(*) AS u FROM events GROUP BY 1, 2, 3),
agg AS (SELECT event_type, part, count(*) AS m, avg(q) AS q_m, var_samp(q) AS b_m, avg(u) AS u_m FROM est WHERE u < 1000 GROUP BY 1, 2),
tot AS (SELECT *, (1 + 1.0::DOUBLE / m) * b_m - u_m AS t_m FROM agg)"""


@query("v04_non_negative_variance", f"WITH {_NEG} SELECT event_type, part, t_m < 0 AS negative, round(CASE WHEN t_m > 0 THEN t_m ELSE 0.5 * u_m END, 5) AS t_nn FROM tot")
def v04(spark, sf):
    ev = table(spark, sf, "events").withColumn("part", F.col("user_id") % 5)
    est = ev.groupBy("event_type", "part", "user_id").agg(F.avg("value").alias("q"), (3 * F.var_samp("value") / F.count("*")).alias("u"))
    t = V.total_variance(V.combined(est, ["event_type", "part"]), 1000.0, 2000.0)
    return t.select("event_type", "part", (F.col("t_m") < 0).alias("negative"), F.round("t_nn", 5).alias("t_nn"))


@query("v05_drop_huge_variances", """
WITH est AS (SELECT event_type, user_id, avg(value) AS q, var_samp(value) * (1 + user_id % 3) / 2 AS u FROM events GROUP BY 1, 2),
keys AS (SELECT DISTINCT user_id FROM est), agg AS (SELECT user_id, count(*) AS m, avg(q) AS q_m FROM est WHERE u < 1000 GROUP BY 1)
SELECT user_id, m, round(q_m, 6) AS q_m FROM keys LEFT JOIN agg USING (user_id)""")
def v05(spark, sf):
    ev = table(spark, sf, "events")
    est = ev.groupBy("event_type", "user_id").agg(F.avg("value").alias("q"), (F.var_samp("value") * (1 + F.first("user_id") % 3) / 2).alias("u"))
    return V.combined(est, ["user_id"], est.select("user_id").distinct()).select("user_id", "m", F.round("q_m", 6).alias("q_m"))


_TRUE = f"{_TQ}, truth AS (SELECT event_type, avg(q) * 1.05 AS true_value FROM est GROUP BY 1), rec AS (SELECT ranges.*, true_value, high - low AS width, true_value BETWEEN low AND high AS hit FROM ranges JOIN truth USING (event_type))"


def _records(spark, sf):
    est = _estimates(spark, sf)
    truth = est.groupBy("event_type").agg((F.avg("q") * 1.05).alias("true_value"))
    return V.against_truth(V.intervals(V.total_variance(V.combined(est, ["event_type"])), LEVELS).join(F.broadcast(truth), "event_type"))


@query("v06_width_and_hit", f"WITH {_TRUE} SELECT event_type, level, round(width, 4) AS width, hit AS contains FROM rec")
def v06(spark, sf):
    return _records(spark, sf).select("event_type", "level", F.round("width", 4).alias("width"), "contains")


@query("v07_coverage_by_level", f"WITH {_TRUE} SELECT level, round(avg(CAST(hit AS INT)), 6) AS coverage, round(avg(width), 4) AS mean_width, count(*) AS n FROM rec GROUP BY 1")
def v07(spark, sf):
    c = V.coverage(_records(spark, sf), ["level"])
    return c.select("level", F.round("coverage", 6).alias("coverage"), F.round("mean_width", 4).alias("mean_width"), "n")


def coverage_run(spark, sf, repeats: int = REPEATS, tables: int = TABLES):
    """Every repeat releases anew; tables are as large as the original."""
    labels = count_rows(survey(spark, sf).withColumn("status", F.when(F.col("status") == "F", "F").otherwise("O")), CATS)
    options = Options(pairs=[("status", "priority"), ("status", "segment")], salt="cov")
    records = repeated_records(labels, declared(CATS, status=["F", "O"]), options, "status", repeats, tables, "rows")
    return V.coverage(records, ["param", "level"], "nn_")


@query("v08_coverage_experiment")
def v08(spark, sf):
    return coverage_run(spark, sf)


@query("v09_true_values", f"WITH {_XY} SELECT param_index, param, round(q, 6) + 0.0 AS true_value FROM {_logit_sql('xy', '')}")
def v09(spark, sf):
    from tallyveil.plans.coverage import true_values

    t = true_values(_xy(spark, sf).select("rush", "done"), ["rush"], "done", add_constant=True)
    return t.withColumn("true_value", F.round("true_value", 6) + 0.0)


@query("v10_number_by_value", """
SELECT o_custkey, o_orderstatus, dense_rank() OVER (ORDER BY first_key) AS group_no FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2)""")
def v10(spark, sf):
    from tallyveil.operators.marginals import first_appearance_number

    return first_appearance_number(table(spark, sf, "orders"), ["o_custkey", "o_orderstatus"], "o_orderkey")
