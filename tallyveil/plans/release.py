"""Registered queries: budgets, noise, selection, release (noise computed from keys, so values compare)."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tallyveil.functions.keyed import sql_gumbel, sql_normal, sql_uniform
from tallyveil.functions.special import gaussian_delta, gaussian_sigma
from tallyveil.operators import privacy as D
from tallyveil.operators.marginals import all_pairs, count_all_cells
from tallyveil.plans.base import CODED, COLUMNS, PAIRS, SURVEY, coded, counted, survey, table
from tallyveil.plans.counting import CELLS, canonical_sql, counts_sql, grid_sql
from tallyveil.plans.registry import query

EPS, DELTA = 1.0, 1e-6
RHO = D.rho_number(EPS, DELTA)
SINGLES = [(c,) for c in COLUMNS]

# A budget per nation: epsilon grows with its share of the orders, delta = 1 / n^2 as for a table of n rows.
_BUDGETS = f"""{SURVEY}, budgets AS (SELECT nation, count(*) AS n, 0.1 + count(*) / 400.0::DOUBLE AS eps, 1.0::DOUBLE / (count(*) * count(*)) AS delta FROM survey GROUP BY 1)"""


def _budgets(spark, sf):
    n = F.count("*")
    return survey(spark, sf).groupBy("nation").agg(n.alias("n"), (F.lit(0.1) + n / 400).alias("eps"), (F.lit(1.0) / (n * n)).alias("delta"))


# Normal upper tail by Simpson's rule on [x, x + 12], 1200 steps.
def _tail_sql(x: str) -> str:
    return (f"(SELECT sum((CASE WHEN i = 0 OR i = 1200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(({x}) + i * 0.01, 2))) "
            f"* 0.01 / 3 / sqrt(2 * pi()) FROM range(1201) t(i))")


def _delta_sql(eps: str, ratio: str) -> str:
    return f"({_tail_sql(f'{eps} / ({ratio}) - ({ratio}) / 2')} - exp({eps}) * {_tail_sql(f'{eps} / ({ratio}) + ({ratio}) / 2')})"


@query("d01_gaussian_delta", f"""
WITH {_BUDGETS}, g AS (SELECT nation, eps, unnest([0.25, 0.5, 1.0, 2.0])::DOUBLE AS ratio FROM budgets)
SELECT nation, ratio, round({_delta_sql('eps', 'ratio')}, 6) AS delta FROM g""")
def d01(spark, sf):
    grid = _budgets(spark, sf).select("nation", "eps", F.explode(F.lit([0.25, 0.5, 1.0, 2.0])).alias("ratio"))
    return grid.select("nation", "ratio", F.round(gaussian_delta("eps", "ratio"), 6).alias("delta"))


@query("d02_gaussian_sigma", f"""
WITH RECURSIVE {_BUDGETS}, s AS (SELECT nation, eps, delta, 0.0::DOUBLE AS lo, 20.0::DOUBLE AS hi, 0 AS i FROM budgets
 UNION ALL SELECT nation, eps, delta, CASE WHEN d > delta THEN lo ELSE (lo + hi) / 2 END, CASE WHEN d > delta THEN (lo + hi) / 2 ELSE hi END, i + 1
 FROM (SELECT *, {_delta_sql('eps', '((lo + hi) / 2)')} AS d FROM s WHERE i < 45))
SELECT nation, round(sqrt(8.0) / ((lo + hi) / 2), 4) AS sigma FROM s WHERE i = 45""")
def d02(spark, sf):
    return _budgets(spark, sf).select("nation", F.round(gaussian_sigma("eps", "delta", F.lit(math.sqrt(8.0))), 4).alias("sigma"))


@query("d03_zcdp_budget", f"WITH {_BUDGETS} SELECT nation, round(pow(sqrt(-ln(delta) + eps) - sqrt(-ln(delta)), 2), 8) AS rho FROM budgets")
def d03(spark, sf):
    return _budgets(spark, sf).select("nation", F.round(D.rho_of(F.col("eps"), F.col("delta")), 8).alias("rho"))


@query("d04_composed_sigma", f"""
WITH {SURVEY}, s AS (SELECT nation, segment, count(*) AS times, sqrt(count(DISTINCT priority)) AS sens FROM survey GROUP BY 1, 2)
SELECT nation, round(sqrt(sum(times * sens * sens) / (2 * {RHO!r})), 6) AS sigma, round(max(sens) / sqrt(2 * {RHO!r}), 6) AS largest_single FROM s GROUP BY 1""")
def d04(spark, sf):
    sens = survey(spark, sf).groupBy("nation", "segment").agg(F.count("*").alias("times"), F.sqrt(F.countDistinct("priority")).alias("sensitivity")).withColumn("rho", F.lit(RHO))
    single = sens.groupBy("nation").agg(F.round(F.max(D.zcdp_sigma(F.col("rho"), F.col("sensitivity"))), 6).alias("largest_single"))
    return D.composed_sigma(sens, ["nation"]).withColumn("sigma", F.round("sigma", 6)).join(single, "nation")


@query("d05_gaussian_mechanism", f"WITH {CELLS} SELECT clique_id, cell, round(n + 2.5 * {sql_normal('gauss', 'clique_id', 'cell')}, 6) AS n_noisy FROM cells")
def d05(spark, sf):
    df, domain = coded(spark, sf)
    return D.noisy(count_all_cells(df, PAIRS, domain), "n", 2.5, ["clique_id", "cell"], "n_noisy", "gauss").select("clique_id", "cell", F.round("n_noisy", 6).alias("n_noisy"))


@query("d05_gaussian_mechanism_entropy")
def d05_entropy(spark, sf):
    df, domain = coded(spark, sf)
    return D.release_gaussian(count_all_cells(df, PAIRS, domain), "n", 2.5, ["clique_id", "cell"])


_SIGMA = math.sqrt(3 / (2 * RHO))
_GRID1 = CODED + ", " + grid_sql(SINGLES) + ", " + counts_sql(SINGLES)


def _measured_sql(sigma: float) -> str:
    return f"{_GRID1}, measured AS (SELECT clique_id, cell, {sigma!r}::DOUBLE AS sigma, n + {sigma!r}::DOUBLE * {sql_normal('measure', 'clique_id', 'cell')} AS y FROM cells)"


@query("d06_measure_columns", f"WITH {_measured_sql(_SIGMA * math.sqrt(len(COLUMNS)))} SELECT clique_id, cell, round(y, 5) AS y, round(sigma, 6) AS sigma FROM measured")
def d06(spark, sf):
    df, domain = coded(spark, sf)
    m = D.measure(df, SINGLES, domain, _SIGMA, salt="measure")
    return m.select("clique_id", "cell", F.round("y", 5).alias("y"), F.round("sigma", 6).alias("sigma"))


# Documents give small cells, so some values really get merged: language and source, noise 60 and 6.
_DOCS = """dcodes AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS lang, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INT) AS source FROM documents)"""
_DOC_MEASURED = f"""{_DOCS}, dcells AS (SELECT 0 AS clique_id, CAST(lang AS BIGINT) AS cell, count(*) AS n FROM dcodes GROUP BY 2
 UNION ALL SELECT 1, CAST(source AS BIGINT), count(*) FROM dcodes GROUP BY 2),
dmeasured AS (SELECT clique_id, cell, n, n + s * {sql_normal('docs', 'clique_id', 'cell')} AS y, s AS sigma FROM (SELECT *, 0.06::DOUBLE * (SELECT count(*) FROM documents) AS s FROM dcells))"""
_DOC_SUPPORT = f"""{_DOC_MEASURED}, marked AS (SELECT *, y < 3 * sigma AS merged FROM dmeasured),
supports AS (SELECT clique_id, cell, y, sigma, merged, CAST(CASE WHEN merged THEN sum(CAST(NOT merged AS INT)) OVER (PARTITION BY clique_id)
  ELSE sum(CAST(NOT merged AS INT)) OVER (PARTITION BY clique_id ORDER BY cell) - 1 END AS INT) AS code FROM marked)"""


def _docs(spark, sf):
    from tallyveil.operators.domain import Domain, encode

    df = table(spark, sf, "documents").select("doc_id", "lang", "source")
    domain = Domain.infer(df, ["lang", "source"])
    return encode(df, domain), domain


def _doc_supports(spark, sf):
    df, domain = _docs(spark, sf)
    n = df.count()
    counts = count_all_cells(df, [("lang",), ("source",)], domain).withColumn("sigma", F.lit(0.06 * n))
    return D.compress(D.noisy(counts, "n", F.col("sigma"), ["clique_id", "cell"], "y", "docs"))


@query("d07_compress_domain", f"""
WITH {_DOC_SUPPORT} SELECT clique_id, code, round(sum(y) / sqrt(count(*)), 5) AS y, count(*) AS members FROM supports GROUP BY 1, 2""")
def d07(spark, sf):
    return _doc_supports(spark, sf)[1].select("clique_id", "code", F.round("y", 5).alias("y"), "members")


_REMAP = f"""{_DOC_SUPPORT}, remapped AS (SELECT doc_id, l.code AS lang, s.code AS source FROM dcodes d
 JOIN supports l ON l.clique_id = 0 AND l.cell = d.lang JOIN supports s ON s.clique_id = 1 AND s.cell = d.source)"""


@query("d08_remap_to_compressed", f"WITH {_REMAP} SELECT doc_id, lang, source FROM remapped")
def d08(spark, sf):
    df, _ = _docs(spark, sf)
    return D.remap(df, D.support_lists(_doc_supports(spark, sf)[0], ["lang", "source"]))


def _unmap_sql(col: str, i: int) -> str:
    return (f"CASE WHEN {col} = (SELECT count(*) FROM supports WHERE clique_id = {i} AND NOT merged) THEN "
            f"(SELECT list(cell ORDER BY cell) FROM supports WHERE clique_id = {i} AND merged)[1 + CAST(floor({sql_uniform(f'unmap/{col}', 'doc_id')} * "
            f"(SELECT count(*) FROM supports WHERE clique_id = {i} AND merged)) AS INT)] "
            f"ELSE (SELECT list(cell ORDER BY cell) FROM supports WHERE clique_id = {i} AND NOT merged)[1 + {col}] END")


@query("d09_undo_remap", f"WITH {_REMAP} SELECT doc_id, CAST({_unmap_sql('lang', 0)} AS INT) AS lang, CAST({_unmap_sql('source', 1)} AS INT) AS source FROM remapped")
def d09(spark, sf):
    df, _ = _docs(spark, sf)
    lists = D.support_lists(_doc_supports(spark, sf)[0], ["lang", "source"])
    return D.unmap(D.remap(df, lists), lists, "doc_id")


_ALL = all_pairs(COLUMNS)
_NAME = "CASE clique_id " + " ".join(f"WHEN {i} THEN '{a}+{b}'" for i, (a, b) in enumerate(_ALL)) + " END"


def _scores_sql(noise: bool) -> str:
    """Scores of all pairs against independence; the noise is small, so nothing is merged."""
    y = f"n + {sql_normal('measure', 'clique_id', 'cell')} * {math.sqrt(len(COLUMNS))!r}::DOUBLE" if noise else "n::DOUBLE"
    ones = f"""ones AS (SELECT clique_id, CAST(cell AS INT) AS code, {y} AS x FROM ones_n),
shares AS (SELECT clique_id, code, greatest(x, 0) / sum(greatest(x, 0)) OVER (PARTITION BY clique_id) AS p FROM ones),
total AS (SELECT avg(s) AS n_hat FROM (SELECT sum(x) AS s FROM ones GROUP BY clique_id))"""
    one_n = " UNION ALL ".join(f"SELECT {i} AS clique_id, {c} AS cell, count(*) AS n FROM coded GROUP BY {c}" for i, c in enumerate(COLUMNS))
    place = {c: i for i, c in enumerate(COLUMNS)}
    gaps = " UNION ALL ".join(
        f"SELECT {i} AS clique_id, abs(g.n - n_hat * a.p * b.p) AS gap FROM cells g, total, shares a, shares b "
        f"WHERE g.clique_id = {i} AND a.clique_id = {place[x]} AND a.code = g.v0 AND b.clique_id = {place[z]} AND b.code = g.v1"
        for i, (x, z) in enumerate(_ALL))
    return (f"{CODED}, {grid_sql(_ALL)}, {counts_sql(_ALL)}, ones_n AS ({one_n}), {ones}, "
            f"scores AS (SELECT {_NAME} AS pair, sum(gap) AS score FROM ({gaps}) GROUP BY clique_id)")


@query("d10_pair_scores", f"WITH {_scores_sql(True)} SELECT pair, round(score, 5) AS score FROM scores")
def d10(spark, sf):
    df, domain = counted(spark, sf)
    _, ones = D.compress(D.measure(df, SINGLES, domain, 1.0, salt="measure", rows="rows"))
    return D.pair_scores(df, COLUMNS, domain, ones.collect(), "rows").select(F.concat_ws("+", "left_col", "right_col").alias("pair"), F.round("score", 5).alias("score"))


_CAND = f"{SURVEY}, cand AS (SELECT nation, segment, count(*) AS q FROM survey GROUP BY 1, 2)"


@query("d11_exponential_mechanism", f"WITH {_CAND} SELECT nation, arg_max(segment, 0.5 * 0.2 / 1.0 * q + {sql_gumbel('exp', 'nation', 'segment')}) AS chosen FROM cand GROUP BY 1")
def d11(spark, sf):
    cand = survey(spark, sf).groupBy("nation", "segment").agg(F.count("*").alias("q"))
    return D.exponential_choice(cand, ["nation"], "segment", "q", 0.2)


@query("d12_report_noisy_max", f"WITH {_CAND} SELECT nation, arg_max(segment, q + {1 / math.sqrt(2 * RHO)!r}::DOUBLE * {sql_gumbel('max', 'nation', 'segment')}) AS chosen FROM cand GROUP BY 1")
def d12(spark, sf):
    cand = survey(spark, sf).groupBy("nation", "segment").agg(F.count("*").alias("q"))
    return D.noisy_max(cand, ["nation"], "segment", "q", RHO, 1.0)


# A pair is in the best spanning set unless its columns are already joined by better pairs.
_SPAN = f"""RECURSIVE {_scores_sql(False)}, edges AS (SELECT pair, split_part(pair, '+', 1) AS a, split_part(pair, '+', 2) AS b, score FROM scores),
sym AS (SELECT pair, a, b, score FROM edges UNION ALL SELECT pair, b, a, score FROM edges),
reach AS (SELECT e.pair, e.score, e.a AS at FROM edges e UNION SELECT r.pair, r.score, s.b FROM reach r JOIN sym s ON s.a = r.at AND (s.score, s.pair) > (r.score, r.pair))"""


@query("d13_select_pairs", f"WITH {_SPAN} SELECT e.pair FROM edges e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.pair = e.pair AND r.at = e.b)")
def d13(spark, sf):
    df, domain = counted(spark, sf)
    pairs, _ = D.select_pairs(df, domain, None, None, rows="rows")
    return spark.createDataFrame([("+".join(p),) for p in pairs], "pair string")


@query("d13_select_pairs_private")
def d13_private(spark, sf):
    df, domain = counted(spark, sf)
    pairs, _ = D.select_pairs(df, domain, RHO / 3, RHO / 3, required=[PAIRS[0]], rows="rows")
    return spark.createDataFrame([(i, "+".join(p)) for i, p in enumerate(pairs)], "place int, pair string")


@query("d14_selection_scores", f"WITH {_scores_sql(False)} SELECT pair, round(score, 5) AS score FROM scores")
def d14(spark, sf):
    df, domain = counted(spark, sf)
    _, scores = D.select_pairs(df, domain, None, None, return_scores=True, rows="rows")
    return scores.select(F.concat_ws("+", "left_col", "right_col").alias("pair"), F.round("score", 5).alias("score"))


_STAT_SIGMA = D.statistic_sigma(len(PAIRS), EPS, DELTA)


@query("d15_release_statistic", f"""
WITH {CELLS} SELECT clique_id, cell, CAST(row_number() OVER (ORDER BY clique_id, cell) - 1 AS INT) AS query_id,
 round(n + {_STAT_SIGMA!r}::DOUBLE * {sql_normal('stat', 'clique_id', 'cell')}, 5) AS y FROM cells WHERE {canonical_sql()}""")
def d15(spark, sf):
    df, domain = coded(spark, sf)
    return D.release_statistic(df, PAIRS, domain, _STAT_SIGMA, "stat").select("clique_id", "cell", "query_id", F.round("y", 5).alias("y"))


@query("d16_release_without_noise", f"""
WITH {CELLS} SELECT clique_id, cell, CAST(row_number() OVER (ORDER BY clique_id, cell) - 1 AS INT) AS query_id, n::DOUBLE AS y FROM cells WHERE {canonical_sql()}""")
def d16(spark, sf):
    df, domain = coded(spark, sf)
    return D.release_statistic(df, PAIRS, domain, 0.0)


@query("d17_given_pairs_only", f"WITH {CELLS} SELECT clique_id, cell, n FROM cells WHERE clique_id < 2 AND {canonical_sql()}")
def d17(spark, sf):
    df, domain = coded(spark, sf)
    return D.statistic_cells(df, PAIRS[:2], domain).select("clique_id", "cell", "n")
