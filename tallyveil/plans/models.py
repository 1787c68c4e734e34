"""Registered queries: weighted tables, maximum-entropy moments, tree model, synthetic rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.functions.keyed import md5_uniform, sql_normal, sql_uniform
from tallyveil.operators import factors as M
from tallyveil.operators import marginals as A
from tallyveil.operators import cliquetree as T
from tallyveil.operators import maxent as X
from tallyveil.operators import privacy as D
from tallyveil.operators import sampling as G
from tallyveil.operators import treemodel as TM
from tallyveil.operators.domain import Domain
from tallyveil.plans import synthesiser as S
from tallyveil.plans.base import COLUMNS, PAIRS, coded, counted, survey, table
from tallyveil.plans.counting import CELLS, canonical_sql
from tallyveil.plans.registry import query
from tallyveil.session import cut_lineage

# Parameters are taken from the counts: log of a canonical count over the average count.
LAMS = f"""{CELLS}, lams AS (SELECT clique_id, cell, v0, v1, CAST(row_number() OVER (ORDER BY clique_id, cell) - 1 AS INT) AS query_id,
  ln((n + 1.0::DOUBLE) / (1.0::DOUBLE + (SELECT avg(n) FROM cells))) AS lam FROM cells WHERE {canonical_sql()})"""
FACTORS = LAMS + ", " + ", ".join(
    f"f{i} AS (SELECT g.v0 AS {a}, g.v1 AS {b}, coalesce(l.lam, 0.0::DOUBLE) AS logw FROM grid g LEFT JOIN lams l ON l.clique_id = g.clique_id AND l.cell = g.cell WHERE g.clique_id = {i})"
    for i, (a, b) in enumerate(PAIRS))
ROWS = FACTORS + """, dom_rows AS (SELECT status, priority, segment, price, balance, f0.logw + f1.logw + f2.logw + f3.logw AS logw
  FROM f0 JOIN f1 USING (status) JOIN f2 USING (priority) JOIN f3 USING (segment)),
z AS (SELECT ln(sum(exp(logw))) AS z FROM dom_rows), probs AS (SELECT dom_rows.*, exp(logw - z) AS p FROM dom_rows, z)"""
_HITS = " UNION ALL ".join(
    f"SELECT r.status, r.priority, r.segment, r.price, r.balance, r.p, l.query_id FROM probs r JOIN lams l ON l.clique_id = {i} AND l.v0 = r.{a} AND l.v1 = r.{b}"
    for i, (a, b) in enumerate(PAIRS))


def parameters(spark, sf):
    """Canonical cells with parameters, the domain, and the coded table."""
    df, domain = counted(spark, sf)
    mean = A.count_all_cells(df, PAIRS, domain, "rows").agg(F.avg("n")).first()[0]
    stat = D.statistic_cells(df, PAIRS, domain, "rows")
    return stat.withColumn("lam", F.ln((F.col("n") + 1.0) / F.lit(1.0 + mean))), domain, df


def factor_tables(spark, sf):
    lams, domain, _ = parameters(spark, sf)
    lams = cut_lineage(lams)
    return [M.from_parameters(domain, q, lams.filter(F.col("clique_id") == i), spark) for i, q in enumerate(PAIRS)], lams, domain


def rounded(df, column="logw", digits=6):
    return df.withColumn(column, F.round(column, digits))


@query("m01_factor_from_parameters", f"WITH {FACTORS} SELECT status, priority, round(logw, 6) AS logw FROM f0")
def m01(spark, sf):
    return rounded(factor_tables(spark, sf)[0][0])


@query("m02_factor_product", f"WITH {FACTORS} SELECT status, priority, segment, round(f0.logw + f1.logw, 6) AS logw FROM f0 JOIN f1 USING (status)")
def m02(spark, sf):
    f = factor_tables(spark, sf)[0]
    return rounded(M.product(f[0], f[1]))


@query("m03_marginalise", f"WITH {FACTORS} SELECT priority, segment, round(ln(sum(exp(f0.logw + f1.logw))), 6) AS logw FROM f0 JOIN f1 USING (status) GROUP BY 1, 2")
def m03(spark, sf):
    f = factor_tables(spark, sf)[0]
    return rounded(M.marginalise(M.product(f[0], f[1]), "status"))


@query("m03_log_sum_exp_of_rows", """
SELECT l_returnflag, round(max(l_extendedprice) + ln(sum(exp(l_extendedprice - m))), 4) AS logw
FROM lineitem JOIN (SELECT l_returnflag, max(l_extendedprice) AS m FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""")
def m03_rows(spark, sf):
    df = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("logw"))
    return rounded(M.log_sum_exp(df, ["l_returnflag"]), digits=4)


@query("m04_total_weight", f"WITH {FACTORS} SELECT round(ln(sum(exp(logw))), 6) AS logw FROM f2")
def m04(spark, sf):
    return rounded(M.total(factor_tables(spark, sf)[0][2]))


@query("m05_project", f"WITH {FACTORS} SELECT segment, round(ln(sum(exp(f1.logw + f3.logw))), 6) AS logw FROM f1 JOIN f3 USING (segment) GROUP BY 1")
def m05(spark, sf):
    f = factor_tables(spark, sf)[0]
    return rounded(M.project(M.product(f[1], f[3]), ["segment"]))


@query("m06_condition", f"WITH {FACTORS} SELECT price, round(logw, 6) AS logw FROM f2 WHERE priority = 2")
def m06(spark, sf):
    return rounded(M.condition(factor_tables(spark, sf)[0][2], "priority", 2))


@query("m07_batch_condition", f"""
WITH {FACTORS} SELECT b.row_id AS batch, price, round(logw, 6) AS logw FROM f2 JOIN (SELECT DISTINCT nation AS row_id, nation % 5 AS priority FROM survey) b USING (priority)""")
def m07(spark, sf):
    f = factor_tables(spark, sf)[0][2]
    values = survey(spark, sf).select(F.col("nation").alias("batch"), (F.col("nation") % 5).alias("priority")).distinct()
    return rounded(M.batch_condition(M.add_batch(f, 25), "priority", values)).select("batch", "price", "logw")


@query("m08_cell_probabilities", f"WITH {FACTORS} SELECT row_id, round(exp(logw) / (SELECT sum(exp(logw)) FROM f0), 8) AS p FROM coded JOIN f0 USING (status, priority)")
def m08(spark, sf):
    f, _, _ = factor_tables(spark, sf)
    cells = coded(spark, sf)[0].select("row_id", "status", "priority")
    return M.probabilities(f[0], cells).select("row_id", F.round("p", 8).alias("p"))


@query("m09_eliminate_columns", f"WITH {ROWS} SELECT price, balance, round(ln(sum(exp(logw))), 6) AS logw FROM dom_rows GROUP BY 1, 2")
def m09(spark, sf):
    return rounded(M.eliminate(factor_tables(spark, sf)[0], ["price", "balance"]))


def explicit(spark, sf):
    lams, domain, df = parameters(spark, sf)
    lams = cut_lineage(lams)
    model = X.Model.of(domain, PAIRS, lams)
    values = [r[0] for r in lams.orderBy("query_id").select("lam").collect()]
    return model, values, lams, df


@query("m10_log_normaliser", f"WITH {ROWS} SELECT round(z, 6) AS lambda0, (SELECT count(*) FROM dom_rows) AS n_rows FROM z")
def m10(spark, sf):
    model, values, _, _ = explicit(spark, sf)
    cache = X.statistic_cache(X.domain_rows(spark, model))
    return cache.agg(F.sum("rows").alias("n_rows")).withColumn("lambda0", F.round(F.lit(X.lambda0(cache, values)), 6))


@query("m10_statistic_mean", f"WITH {ROWS} SELECT query_id, round(sum(p), 8) AS mean FROM ({_HITS}) GROUP BY 1")
def m10_mean(spark, sf):
    model, values, _, _ = explicit(spark, sf)
    return X.statistic_mean(X.statistic_cache(X.domain_rows(spark, model)), values).withColumn("mean", F.round("mean", 8))


@query("m10_statistic_covariance", f"""
WITH {ROWS}, hits AS ({_HITS}), means AS (SELECT query_id, sum(p) AS m FROM hits GROUP BY 1),
second AS (SELECT a.query_id AS i, b.query_id AS j, sum(a.p) AS s FROM hits a JOIN hits b USING (status, priority, segment, price, balance) GROUP BY 1, 2)
SELECT CAST(x.query_id AS BIGINT) AS i, CAST(y.query_id AS BIGINT) AS j, round(coalesce(s, 0) - x.m * y.m, 8) + 0.0 AS cov FROM means x CROSS JOIN means y
LEFT JOIN second ON second.i = x.query_id AND second.j = y.query_id""")
def m10_cov(spark, sf):
    model, values, _, _ = explicit(spark, sf)
    cov = X.statistic_covariance(X.statistic_cache(X.domain_rows(spark, model)), values, model.size)
    return cov.withColumn("cov", F.round("cov", 8) + 0.0)


def _statistics(model):
    return T.Statistics(T.CliqueTree.of(PAIRS, model.domain), PAIRS, model.ids)


@query("m10_moments_by_messages", f"""
WITH {ROWS}, hits AS ({_HITS}), means AS (SELECT query_id, sum(p) AS m FROM hits GROUP BY 1),
second AS (SELECT a.query_id AS i, b.query_id AS j, sum(a.p) AS s FROM hits a JOIN hits b USING (status, priority, segment, price, balance) GROUP BY 1, 2)
SELECT CAST(x.query_id AS BIGINT) AS i, CAST(y.query_id AS BIGINT) AS j, round(x.m, 8) AS mean_i, round(coalesce(s, 0) - x.m * y.m, 8) + 0.0 AS cov
FROM means x CROSS JOIN means y LEFT JOIN second ON second.i = x.query_id AND second.j = y.query_id""")
def m10_messages(spark, sf):
    """The moments again without the domain: messages between small tables."""
    model, values, _, _ = explicit(spark, sf)
    out = T.model_moments(spark, _statistics(model), values)
    return out.select("i", "j", F.round("mean_i", 8).alias("mean_i"), (F.round("cov", 8) + 0.0).alias("cov"))


@query("m11_step_conditionals", f"WITH {ROWS} " + " UNION ALL ".join(
    f"SELECT '{a}|{b}' AS pair, {a} AS v0, {b} AS v1, round(sum(p) / sum(sum(p)) OVER (PARTITION BY {a}), 8) AS p_v1_given_v0 FROM probs GROUP BY {a}, {b}" for a, b in PAIRS))
def m11_steps(spark, sf):
    """Conditional tables that rows are drawn from; the chance of the second column of a pair given the first by Bayes' rule."""
    model, values, lams, _ = explicit(spark, sf)
    statistics = _statistics(model)
    cpts = T.step_conditionals(statistics, lams.select(F.lit(0).cast("long").alias("draw_id"), "query_id", "lam"))
    domain, rows = model.domain, None
    for column, given, _ in statistics.tree.steps():  # joint chances of the columns drawn so far, two at a time
        part = cpts.where(F.col("col") == column).select(*([F.col("parent_code").cast("int").alias(given[0])] if given else []), F.col("code").alias(column), F.col("p").alias(f"p_{column}"))
        rows = part if rows is None else rows.join(part, list(given)) if given else rows.crossJoin(part)
    p = rows.withColumn("p", F.lit(1.0))
    for column in domain.columns:
        p = p.withColumn("p", F.col("p") * F.col(f"p_{column}"))
    out = None
    for a, b in PAIRS:
        joint = p.groupBy(F.col(a).alias("v0"), F.col(b).alias("v1")).agg(F.sum("p").alias("p"))
        total = F.sum("p").over(W.partitionBy("v0"))
        one = joint.select(F.lit(f"{a}|{b}").alias("pair"), "v0", "v1", F.round(F.col("p") / total, 8).alias("p_v1_given_v0"))
        out = one if out is None else out.unionByName(one)
    return out


@query("m11_pair_marginals_by_messages", f"WITH {ROWS} " + " UNION ALL ".join(
    f"SELECT {i} AS clique_id, {a} AS v0, {b} AS v1, round(sum(p), 8) AS p FROM probs GROUP BY {a}, {b}" for i, (a, b) in enumerate(PAIRS)))
def m11(spark, sf):
    f = factor_tables(spark, sf)[0]
    beliefs = M.tree_messages(dict(zip(PAIRS, f)), "status")
    parts = [beliefs[q].select(F.lit(i).alias("clique_id"), F.col(q[0]).alias("v0"), F.col(q[1]).alias("v1"), F.round("p", 8).alias("p")) for i, q in enumerate(PAIRS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


CPTS = f"""{CELLS}, cpt_x AS (
 SELECT 'status' AS col, 0 AS parent_code, v0 AS code, sum(n)::DOUBLE AS x FROM cells WHERE clique_id = 0 GROUP BY v0
 UNION ALL SELECT 'priority', v0, v1, n FROM cells WHERE clique_id = 0 UNION ALL SELECT 'segment', v0, v1, n FROM cells WHERE clique_id = 1
 UNION ALL SELECT 'price', v0, v1, n FROM cells WHERE clique_id = 2 UNION ALL SELECT 'balance', v0, v1, n FROM cells WHERE clique_id = 3),
cpts AS (SELECT col, parent_code, code, x / sum(x) OVER (PARTITION BY col, parent_code) AS p,
 sum(x) OVER (PARTITION BY col, parent_code ORDER BY code) / sum(x) OVER (PARTITION BY col, parent_code) AS cum FROM cpt_x),
thresholds AS (SELECT col, parent_code, list(cum ORDER BY code) AS t FROM cpts GROUP BY 1, 2)"""


def tree_tables(spark, sf):
    df, domain = counted(spark, sf)
    tree = TM.Tree.of(PAIRS, COLUMNS)
    n = df.agg(F.sum("rows")).first()[0]
    return TM.conditionals(A.count_all_cells(df, PAIRS, domain, "rows"), PAIRS, domain, tree), tree, domain, n


@query("m12_tree_conditionals", f"WITH {CPTS} SELECT col, parent_code, code, round(p, 8) AS p, round(cum, 8) AS cum FROM cpts")
def m12(spark, sf):
    cpts = tree_tables(spark, sf)[0]
    return cpts.select("col", "parent_code", "code", F.round("p", 8).alias("p"), F.round("cum", 8).alias("cum"))


@query("m12_projected_pair_counts", f"""
WITH {CELLS}, noisy AS (SELECT clique_id, cell, v0, v1, n + 20.0::DOUBLE * {sql_normal('project', 'clique_id', 'cell')} AS y FROM cells),
level AS (SELECT clique_id, cell, v0, v1, y + ((SELECT count(*) FROM survey) - sum(y) OVER w) / count(*) OVER w AS y FROM noisy WINDOW w AS (PARTITION BY clique_id)),
names(clique_id, a, b) AS (VALUES {', '.join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS))}),
margins AS (SELECT clique_id, a AS col, v0 AS code, sum(y) AS m, count(*) AS w FROM level JOIN names USING (clique_id) GROUP BY ALL
 UNION ALL SELECT clique_id, b, v1, sum(y), count(*) FROM level JOIN names USING (clique_id) GROUP BY ALL),
moves AS (SELECT clique_id, col, code, (sum(m / w) OVER s / sum(1.0::DOUBLE / w) OVER s - m) / w AS d FROM margins WINDOW s AS (PARTITION BY col, code)),
even AS (SELECT level.clique_id, cell, y + p.d + q.d AS y FROM level JOIN names USING (clique_id)
 JOIN moves p ON p.clique_id = level.clique_id AND p.col = a AND p.code = v0 JOIN moves q ON q.clique_id = level.clique_id AND q.col = b AND q.code = v1),
ranked AS (SELECT *, (sum(y) OVER o - (SELECT count(*) FROM survey)) / row_number() OVER o AS off FROM even
 WINDOW o AS (PARTITION BY clique_id ORDER BY y DESC, cell ROWS UNBOUNDED PRECEDING))
SELECT clique_id, cell, round(greatest(y - max(off) OVER (PARTITION BY clique_id), 0), 4) + 0.0 AS y FROM ranked""")
def m12_projected(spark, sf):
    df, domain = counted(spark, sf)
    noisy = D.noisy(A.count_all_cells(df, PAIRS, domain, "rows"), "n", 20.0, ["clique_id", "cell"], "y", "project")
    n = df.agg(F.sum("rows")).first()[0]
    return TM.project(noisy, PAIRS, domain, n).select("clique_id", "cell", (F.round("y", 4) + 0.0).alias("y"))


@query("m13_row_probabilities", f"WITH {ROWS} SELECT status, priority, segment, price, balance, round(p, 9) AS p FROM probs")
def m13(spark, sf):
    model, values, _, _ = explicit(spark, sf)
    return X.row_probabilities(spark, model, values).drop("cell_id").withColumn("p", F.round("p", 9))


@query("m14_query_means", f"WITH {ROWS} SELECT priority, balance, round(sum(p), 8) AS mean FROM probs GROUP BY 1, 2")
def m14(spark, sf):
    model, values, _, _ = explicit(spark, sf)
    return X.query_means(X.row_probabilities(spark, model, values), ["priority", "balance"]).withColumn("mean", F.round("mean", 8))


@query("m15_distinct_statistics", f"""
WITH {ROWS}, a AS (SELECT status, priority, segment, price, balance, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS active FROM ({_HITS}) GROUP BY ALL)
SELECT coalesce(active, '') AS active, count(*) AS n_rows FROM probs LEFT JOIN a USING (status, priority, segment, price, balance) GROUP BY 1""")
def m15(spark, sf):
    model, _, _, _ = explicit(spark, sf)
    cache = X.statistic_cache(X.domain_rows(spark, model))
    return cache.select(F.array_join(F.array_sort("active"), ",").alias("active"), F.col("rows").alias("n_rows"))


@query("m16_conjugate_log_density", f"""
WITH {ROWS}, draws AS (SELECT d AS draw_id, query_id, lam * (1 + d / 10.0::DOUBLE) AS lam FROM lams, (SELECT DISTINCT nation AS d FROM survey)),
w AS (SELECT h.status, h.priority, h.segment, h.price, h.balance, d.draw_id, sum(d.lam) AS w FROM ({_HITS}) h JOIN draws d USING (query_id) GROUP BY ALL),
full_w AS (SELECT r.d AS draw_id, coalesce(w.w, 0) AS w FROM (SELECT probs.*, d FROM probs, (SELECT DISTINCT nation AS d FROM survey)) r LEFT JOIN w
 ON w.draw_id = r.d AND w.status = r.status AND w.priority = r.priority AND w.segment = r.segment AND w.price = r.price AND w.balance = r.balance),
zz AS (SELECT draw_id, max(w) + ln(sum(exp(w - m))) AS z FROM full_w JOIN (SELECT draw_id, max(w) AS m FROM full_w GROUP BY 1) USING (draw_id) GROUP BY 1),
dots AS (SELECT draw_id, sum(draws.lam * n) AS dot FROM draws JOIN (SELECT query_id, n FROM lams JOIN cells USING (clique_id, cell)) USING (query_id) GROUP BY 1)
SELECT draw_id, round(dot - 100.0 * z, 2) AS logp FROM dots JOIN zz USING (draw_id)""")
def m16(spark, sf):
    model, values, lams, _ = explicit(spark, sf)
    nations = survey(spark, sf).select(F.col("nation").alias("draw_id")).distinct()
    draws = nations.select("draw_id", F.posexplode(F.lit(values)).alias("query_id", "lam")).withColumn("lam", F.col("lam") * (1 + F.col("draw_id") / 10.0))
    cache = X.statistic_cache(X.domain_rows(spark, model))
    out = X.conjugate_log_density(draws, lams.select("query_id", F.col("n").alias("chi")), 100.0, cache)
    return out.withColumn("logp", F.round("logp", 2))


@query("m16_many_draws", f"""
WITH {ROWS}, draws AS (SELECT d AS draw_id, query_id, lam * (1 + d / 2000.0::DOUBLE) AS lam FROM lams, (SELECT DISTINCT row_id % 2000 AS d FROM survey)),
w AS (SELECT h.status, h.priority, h.segment, h.price, h.balance, d.draw_id, sum(d.lam) AS w FROM ({_HITS}) h JOIN draws d USING (query_id) GROUP BY ALL),
full_w AS (SELECT r.d AS draw_id, coalesce(w.w, 0) AS w FROM (SELECT probs.*, d FROM probs, (SELECT DISTINCT row_id % 2000 AS d FROM survey)) r LEFT JOIN w
 ON w.draw_id = r.d AND w.status = r.status AND w.priority = r.priority AND w.segment = r.segment AND w.price = r.price AND w.balance = r.balance),
zz AS (SELECT draw_id, max(w) + ln(sum(exp(w - m))) AS z FROM full_w JOIN (SELECT draw_id, max(w) AS m FROM full_w GROUP BY 1) USING (draw_id) GROUP BY 1),
dots AS (SELECT draw_id, sum(draws.lam * n) AS dot FROM draws JOIN (SELECT query_id, n FROM lams JOIN cells USING (clique_id, cell)) USING (query_id) GROUP BY 1)
SELECT draw_id, round(dot - 100.0 * z, 2) AS logp FROM dots JOIN zz USING (draw_id)""")
def m16_many(spark, sf):
    model, values, lams, _ = explicit(spark, sf)
    ids = survey(spark, sf).select((F.col("row_id") % 2000).alias("draw_id")).distinct()
    draws = ids.select("draw_id", F.posexplode(F.lit(values)).alias("query_id", "lam")).withColumn("lam", F.col("lam") * (1 + F.col("draw_id") / 2000.0))
    cache = X.statistic_cache(X.domain_rows(spark, model))
    out = X.conjugate_log_density(draws, lams.select("query_id", F.col("n").alias("chi")), 100.0, cache)
    return out.withColumn("logp", F.round("logp", 2))


def _noise_aware(spark, sf):
    """A small noise-aware fit on two pairs of the survey."""
    df, domain = coded(spark, sf, ["status", "priority", "segment"])
    sigma = D.statistic_sigma(2, 1.0, 1e-6)
    stat = D.release_statistic(df, PAIRS[:2], domain, sigma, "stat")
    model = X.Model.of(domain, PAIRS[:2], stat)
    y = [r[0] for r in stat.orderBy("query_id").select("y").collect()]
    cache = X.statistic_cache(X.domain_rows(spark, model))
    n = df.count()
    return X.fit_noise_aware(cache, y, n, sigma), cache, stat, n


# The fitted model's expected counts must come back close to the released ones: within 4 sigma each.
@query("m17_noise_aware_fit", f"""
WITH {CELLS} SELECT CAST(row_number() OVER (ORDER BY clique_id, cell) - 1 AS INT) AS query_id, true AS close
FROM cells WHERE clique_id < 2 AND {canonical_sql()}""")
def m17(spark, sf):
    post, cache, stat, n = _noise_aware(spark, sf)
    sigma = D.statistic_sigma(2, 1.0, 1e-6)
    mean = X.statistic_mean(cache, list(post.mean))
    gap = F.abs(F.col("y") - n * F.coalesce("mean", F.lit(0.0)))
    return stat.join(mean, "query_id", "left").select("query_id", (gap <= 4 * F.sqrt(F.lit(sigma ** 2) + F.greatest("y", F.lit(0.0)))).alias("close"))


@query("m18_posterior_draws")
def m18(spark, sf):
    post, _, _, _ = _noise_aware(spark, sf)
    return X.posterior_draws(spark, post, 200)


@query("m18_reweighted_draws")
def m18_weighted(spark, sf):
    """Draws weighted by the full noise-aware density and drawn again: mean and spread of each parameter, and their worth."""
    df, domain = coded(spark, sf, ["status", "priority", "segment"])
    sigma, n = D.statistic_sigma(2, 1.0, 1e-6), df.count()
    stat = cut_lineage(D.release_statistic(df, PAIRS[:2], domain, sigma, "stat"))
    model = X.Model.of(domain, PAIRS[:2], stat)
    statistics = T.Statistics(T.CliqueTree.of(PAIRS[:2], domain), PAIRS[:2], model.ids)
    post = X.fit_noise_aware(X.message_moments(spark, model), [r[0] for r in stat.orderBy("query_id").select("y").collect()], n, sigma)
    lambdas = cut_lineage(X.posterior_draws(spark, post, 400))
    weights = cut_lineage(X.draw_weights(post, statistics, lambdas))
    again = X.resample_draws(lambdas, weights, 400, least=1.0)
    return again.groupBy("query_id").agg(F.avg("lam").alias("mean"), F.stddev("lam").alias("spread")).withColumn("effective_draws", F.lit(X.effective_draws(weights)))


@query("m18_draws_match_release", f"""
WITH {CELLS} SELECT t.cell AS query_id, true AS close FROM (SELECT CAST(unnest(range(p * p - 1)) AS INT) AS cell FROM (SELECT count(DISTINCT priority) AS p FROM survey)) t""")
def m18_release(spark, sf):
    """A pair of equal columns, most cells empty: expected counts averaged over draws are within 4 sigma of the release."""
    df, domain = counted(spark, sf, ["priority"])
    domain = Domain.declare({"a": domain.labels["priority"], "b": domain.labels["priority"]})
    df = df.select(F.col("priority").alias("a"), F.col("priority").alias("b"), "rows")
    n, sigma = df.agg(F.sum("rows")).first()[0], D.statistic_sigma(1, 1.0, 1e-6)
    stat = D.release_statistic(df, [("a", "b")], domain, sigma, "sparse", rows="rows")
    model = X.Model.of(domain, [("a", "b")], stat)
    cache = X.statistic_cache(X.domain_rows(spark, model))
    post = X.fit_noise_aware(cache, [r[0] for r in stat.orderBy("query_id").select("y").collect()], n, sigma)
    cells = S.chain_conditionals(spark, model, X.posterior_draws(spark, post, 50), 50)
    means = cells.join(X.domain_rows(spark, model).select("cell_id", F.explode("active").alias("query_id")), "cell_id").groupBy("query_id").agg(F.sum("p").alias("mean"))
    gap = F.abs(F.col("y") - n * F.col("mean") / 50)
    return stat.join(means, "query_id").select("query_id", (gap <= 4 * F.sqrt(F.lit(sigma ** 2) + F.greatest("y", F.lit(0.0)))).alias("close"))


@query("g01_sample_tree", f"""
WITH {CPTS}, ids AS (SELECT CAST(i // n AS INT) AS dataset_id, i % n AS row_id FROM (SELECT unnest(range(2 * count(*))) AS i, count(*) AS n FROM survey)),
s1 AS (SELECT ids.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/status', 'dataset_id', 'row_id')})) AS INT) AS status FROM ids, thresholds WHERE col = 'status'),
s2 AS (SELECT s1.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/priority', 'dataset_id', 'row_id')})) AS INT) AS priority FROM s1 JOIN thresholds ON col = 'priority' AND parent_code = status),
s3 AS (SELECT s2.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/segment', 'dataset_id', 'row_id')})) AS INT) AS segment FROM s2 JOIN thresholds ON col = 'segment' AND parent_code = status),
s4 AS (SELECT s3.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/price', 'dataset_id', 'row_id')})) AS INT) AS price FROM s3 JOIN thresholds ON col = 'price' AND parent_code = priority)
SELECT s4.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/balance', 'dataset_id', 'row_id')})) AS INT) AS balance FROM s4 JOIN thresholds ON col = 'balance' AND parent_code = segment""")
def g01(spark, sf):
    cpts, tree, domain, n = tree_tables(spark, sf)
    return G.sample_tree(spark, cpts, tree, domain, n, 2, uniform=md5_uniform)


# Three perturbed models, six tables; the noise of each model and the choice of one per table come from keys.
_BASE = f"""{CELLS}, pert AS (SELECT draw_id, clique_id, v0, v1, CASE WHEN n > 0 THEN n * exp(sqrt(l) * z - l / 2) ELSE 0 END AS x FROM
 (SELECT d AS draw_id, clique_id, v0, v1, n::DOUBLE AS n, {sql_normal('draws', 'd', 'clique_id', 'cell')} AS z,
  ln(1 + (400.0::DOUBLE + n * (1 - n / sum(n) OVER (PARTITION BY d, clique_id))) / nullif(n::DOUBLE * n, 0)) AS l
  FROM cells, (SELECT CAST(unnest(range(3)) AS INT) AS d))),
pcpt AS (SELECT draw_id, 'status' AS col, 0 AS parent_code, v0 AS code, sum(greatest(x, 0)) AS x FROM pert WHERE clique_id = 0 GROUP BY 1, 4
 UNION ALL SELECT draw_id, 'priority', v0, v1, greatest(x, 0) FROM pert WHERE clique_id = 0),
pthr AS (SELECT draw_id, col, parent_code, list(cum ORDER BY code) AS t FROM (SELECT draw_id, col, parent_code, code,
 sum(x) OVER (PARTITION BY draw_id, col, parent_code ORDER BY code) / sum(x) OVER (PARTITION BY draw_id, col, parent_code) AS cum FROM pcpt) GROUP BY ALL),
ids AS (SELECT *, CAST(floor({sql_uniform('sample/draw', 'dataset_id')} * 3) AS INT) AS draw_id FROM
 (SELECT CAST(i // n AS INT) AS dataset_id, i % n AS row_id FROM (SELECT unnest(range(6 * count(*))) AS i, count(*) AS n FROM survey))),
t1 AS (SELECT ids.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/status', 'dataset_id', 'row_id')})) AS INT) AS s FROM ids JOIN pthr USING (draw_id) WHERE col = 'status'),
t2 AS (SELECT t1.*, CAST(len(list_filter(t[:-2], lambda x: x <= {sql_uniform('sample/priority', 'dataset_id', 'row_id')})) AS INT) AS p FROM t1 JOIN pthr ON pthr.draw_id = t1.draw_id AND col = 'priority' AND parent_code = s)"""


@query("g02_synthetic_tables", f"""
WITH {_BASE}, names AS (SELECT (SELECT list(DISTINCT status ORDER BY status) FROM survey) AS ls, (SELECT list(DISTINCT priority ORDER BY priority) FROM survey) AS lp)
SELECT dataset_id, draw_id, ls[s + 1] AS status, lp[p + 1] AS priority, count(*) AS n FROM t2, names GROUP BY ALL""")
def g02(spark, sf):
    df, domain = counted(spark, sf)
    tree = TM.Tree.of(PAIRS, COLUMNS)
    cells = A.count_all_cells(df, PAIRS, domain, "rows").withColumnRenamed("n", "y")
    cpts = TM.conditionals(TM.perturb(cells, 3, 20.0), PAIRS, domain, tree, by=["draw_id"])
    n = df.agg(F.sum("rows")).first()[0]
    out = G.generate(spark, cpts, tree, domain, n, 6, draws=3, uniform=md5_uniform, columns=["status", "priority"])
    return out.groupBy("dataset_id", "draw_id", "status", "priority").agg(F.count("*").alias("n"))


@query("g03_sample_explicit", f"""
WITH {ROWS}, c AS (SELECT status, priority, segment, price, balance, sum(p) OVER (ORDER BY status, priority, segment, price, balance) AS cum, p FROM probs),
u AS (SELECT i AS row_id, {sql_uniform('explicit', 'i')} AS u FROM (SELECT unnest(range(count(*))) AS i FROM survey))
SELECT u.row_id, c.status, c.priority, c.segment, c.price, c.balance FROM u ASOF JOIN (SELECT *, cum - p AS low FROM c) c ON u.u >= c.low""")
def g03(spark, sf):
    model, values, _, df = explicit(spark, sf)
    return G.sample_explicit(spark, X.row_probabilities(spark, model, values), model.domain, df.agg(F.sum("rows")).first()[0])


@query("g04_jitter", f"SELECT event_id, round(value + 0.1 * {sql_normal('jitter', 'event_id')}, 6) AS value FROM events")
def g04(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(G.jitter("value", 0.1, "event_id"), 6).alias("value"))


@query("g05_sample_rows_with_replacement", f"""
WITH numbered AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS no FROM events),
drawn AS (SELECT CAST(floor({sql_uniform('rows', 'i')} * n) AS BIGINT) AS no FROM (SELECT unnest(range(2 * count(*))) AS i, count(*) AS n FROM events))
SELECT event_id, count(*) AS times FROM drawn JOIN numbered USING (no) GROUP BY 1""")
def g05(spark, sf):
    events = table(spark, sf, "events").select("event_id")
    return G.sample_rows(events, "event_id", 2 * events.count()).groupBy("event_id").agg(F.count("*").alias("times"))
