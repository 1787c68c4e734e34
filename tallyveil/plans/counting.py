"""Registered queries: domains, codes and marginal counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyveil.operators import domain as E
from tallyveil.operators import marginals as A
from tallyveil.plans.base import (BINNED, CATS, CODED, COLUMNS, ITEMS, PAIRS, SURVEY, coded, counted, items, survey, table)
from tallyveil.plans.registry import query

_DOMAIN = """dom AS (SELECT col, CAST(row_number() OVER (PARTITION BY col ORDER BY label) - 1 AS INT) AS code, label FROM (
  SELECT DISTINCT 'status' AS col, status AS label FROM survey UNION SELECT DISTINCT 'priority', priority FROM survey
  UNION SELECT DISTINCT 'segment', segment FROM survey))"""

_K = "(SELECT " + ", ".join(f"max({c}) + 1 AS k_{c}" for c in COLUMNS) + " FROM coded)"


def grid_sql(cliques=PAIRS, name: str = "grid") -> str:
    """All cells of pair (or single, triple) cliques as (clique_id, cell, codes...)."""
    parts = []
    for i, q in enumerate(cliques):
        ranges = ", ".join(f"(SELECT unnest(range(max({c}) + 1)) AS v{j} FROM coded)" for j, c in enumerate(q))
        cell = "0"
        for j, c in enumerate(q):
            cell = f"({cell}) * (SELECT max({c}) + 1 FROM coded) + v{j}"
        vals = ", ".join(f"CAST(v{j} AS INT) AS v{j}" for j in range(len(q)))
        parts.append(f"SELECT {i} AS clique_id, CAST({cell} AS BIGINT) AS cell, {vals} FROM {ranges}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def counts_sql(cliques=PAIRS, name: str = "cells") -> str:
    """Zero-filled counts of the grid."""
    parts = []
    for i, q in enumerate(cliques):
        on = " AND ".join(f"c.{c} = g.v{j}" for j, c in enumerate(q))
        parts.append(f"SELECT g.clique_id, g.cell, {', '.join(f'g.v{j}' for j in range(len(q)))}, count(c.row_id) AS n "
                     f"FROM grid g LEFT JOIN coded c ON {on} WHERE g.clique_id = {i} GROUP BY ALL")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


GRID = CODED + ", " + grid_sql()
CELLS = GRID + ", " + counts_sql()


def canonical_sql(cliques=PAIRS) -> str:
    """Filter text for the canonical cells of pair cliques (v0, v1)."""
    seen, keep = set(), []
    for i, q in enumerate(cliques):
        for mask in range(1, 2 ** len(q)):
            s = frozenset(c for b, c in enumerate(q) if mask >> b & 1)
            if s not in seen:
                seen.add(s)
                keep.append("(clique_id = %d AND %s)" % (i, " AND ".join(f"v{b} {'<>' if mask >> b & 1 else '='} 0" for b in range(len(q)))))
    return "(" + " OR ".join(keep) + ")"


# ---------------------------------------------------------------- domain and codes


@query("e01_encode", f"WITH {CODED} SELECT row_id, status, priority, segment, price, balance FROM coded")
def e01(spark, sf):
    return coded(spark, sf)[0]


_KEYS = ["part", "supplier", "day"]
_KEYED = """keyed AS (SELECT l_orderkey AS row_id, l_linenumber AS line, CAST(l_partkey AS VARCHAR) AS part,
 CAST(l_suppkey AS VARCHAR) AS supplier, CASE WHEN l_linenumber > 1 THEN CAST(date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS VARCHAR) END AS day FROM lineitem),
keys AS (SELECT col, CAST(dense_rank() OVER (PARTITION BY col ORDER BY label) - 1 AS INT) AS code, label FROM (
 SELECT DISTINCT 'part' AS col, part AS label FROM keyed UNION SELECT 'supplier', supplier FROM keyed UNION SELECT 'day', day FROM keyed) WHERE label IS NOT NULL)"""


def _keyed(spark, sf):
    """Sold items with label columns of thousands of labels; first lines have no day."""
    text = lambda c: F.col(c).cast("string")
    day = F.when(F.col("l_linenumber") > 1, F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("line"), text("l_partkey").alias("part"),
                                               text("l_suppkey").alias("supplier"), day.alias("day"))


@query("e01_encode_many_labels", f"""WITH {_KEYED} SELECT row_id, line, p.code AS part, s.code AS supplier, d.code AS day FROM keyed k
 JOIN keys p ON p.col = 'part' AND p.label = k.part JOIN keys s ON s.col = 'supplier' AND s.label = k.supplier
 LEFT JOIN keys d ON d.col = 'day' AND d.label = k.day""")
def e01_many(spark, sf):
    df = _keyed(spark, sf)
    return E.encode_by_table(df, E.domain_table(df, _KEYS), _KEYS)


@query("e02_domain_table_many_labels", f"WITH {_KEYED} SELECT * FROM keys")
def e02_many(spark, sf):
    return E.domain_table(_keyed(spark, sf), _KEYS)


@query("e02_domain_table", f"WITH {SURVEY}, {_DOMAIN} SELECT * FROM dom")
def e02(spark, sf):
    return E.domain_table(survey(spark, sf), CATS).select("col", F.col("code").cast("int").alias("code"), "label")


@query("e03_domain_size", f"""
WITH {CODED} SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max((SELECT k_status * k_priority * k_segment * k_price * k_balance FROM {_K})) AS BIGINT) AS domain_size FROM coded""")
def e03(spark, sf):
    df, domain = coded(spark, sf)
    return df.agg(F.count("*").alias("n_rows")).withColumn("domain_size", F.lit(domain.cells()).cast("long"))


@query("e04_all_possible_rows", f"""
WITH {CODED} SELECT CAST(s.v AS INT) AS status, CAST(p.v AS INT) AS priority, CAST(g.v AS INT) AS segment FROM
 (SELECT DISTINCT status AS v FROM coded) s, (SELECT DISTINCT priority AS v FROM coded) p, (SELECT DISTINCT segment AS v FROM coded) g""")
def e04(spark, sf):
    return E.all_rows(spark, coded(spark, sf, CATS)[1]).drop("cell_id")


@query("e05_category_mapping", f"WITH {BINNED} SELECT CAST(dense_rank() OVER (ORDER BY price) - 1 AS INT) AS code, price AS label FROM (SELECT DISTINCT price FROM binned)")
def e05(spark, sf):
    return coded(spark, sf, ["price"])[1].table(spark).select("code", "label")


@query("e06_decode", f"WITH {BINNED} SELECT row_id, status, priority, segment, price, balance FROM binned")
def e06(spark, sf):
    df, domain = coded(spark, sf)
    return E.decode(df, domain)


def _order_queries(spark, sf, value):
    """Per order a two-column query on priority and segment."""
    df, _ = coded(spark, sf, CATS) if value == "code" else (survey(spark, sf), None)
    pair = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("col"), F.col(c).alias(value)) for i, c in enumerate(["priority", "segment"])]))
    return df.select(F.col("row_id").alias("query_id"), pair.alias("p")).select("query_id", "p.*")


@query("e07_label_queries", f"""
WITH {SURVEY} SELECT row_id AS query_id, 0 AS pos, 'priority' AS col, priority AS label FROM survey
UNION ALL SELECT row_id, 1, 'segment', segment FROM survey""")
def e07(spark, sf):
    domain = E.domain_table(survey(spark, sf), CATS)
    return E.label_queries(_order_queries(spark, sf, "code"), domain).select("query_id", "pos", "col", "label")


@query("e08_code_queries", f"""
WITH {CODED} SELECT row_id AS query_id, 0 AS pos, 'priority' AS col, priority AS code FROM coded
UNION ALL SELECT row_id, 1, 'segment', segment FROM coded""")
def e08(spark, sf):
    domain = E.domain_table(survey(spark, sf), CATS)
    return E.code_queries(_order_queries(spark, sf, "label"), domain).select("query_id", "pos", "col", F.col("code").cast("int").alias("code"))


@query("e10_mixed_to_codes", f"""
WITH {SURVEY} SELECT row_id, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INT) AS status, nation FROM survey""")
def e10(spark, sf):
    return E.to_codes(survey(spark, sf).select("row_id", "status", "nation"))


@query("e12_one_hot", """
SELECT l_orderkey, CAST(l_returnflag = 'A' AS INT) AS flag_A, CAST(l_returnflag = 'N' AS INT) AS flag_N, CAST(l_returnflag = 'R' AS INT) AS flag_R,
  CAST(l_linestatus = 'O' AS INT) AS line FROM lineitem""")
def e12(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"))
    return E.one_hot(df, E.Domain.infer(df, ["flag", "line"]), "line")


@query("e13_for_modelling", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(toxic AS VARCHAR) AS toxic, CAST(quality AS VARCHAR) AS quality FROM labels")
def e13(spark, sf):
    return E.for_modelling(table(spark, sf, "labels"), "quality")


@query("e14_for_coverage", f"""
WITH {SURVEY} SELECT row_id, nation, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INT) AS segment, CAST(dense_rank() OVER (ORDER BY status) - 1 AS INT) AS status FROM survey""")
def e14(spark, sf):
    return E.for_coverage(survey(spark, sf).select("row_id", "status", "nation", "segment"), "status")


@query("e15_align_columns", """
SELECT l_orderkey, CAST(l_returnflag = 'A' AS INT) AS flag_A, CAST(l_returnflag = 'N' AS INT) AS flag_N, 0 AS flag_R, CAST(l_linestatus = 'O' AS INT) AS line
FROM lineitem WHERE l_returnflag <> 'R'""")
def e15(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line"))
    train = df.filter("flag <> 'R'")
    full = E.one_hot(df, E.Domain.infer(df, ["flag", "line"]), "line")
    return E.align_columns(E.one_hot(train, E.Domain.infer(train, ["flag", "line"]), "line"), full.columns)


@query("e16_stack_tables", """
SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS dataset_id, l_orderkey, l_quantity FROM lineitem""")
def e16(spark, sf):
    li = table(spark, sf, "lineitem")
    return E.stack_tables([li.filter(F.col("l_returnflag") == f).select("l_orderkey", "l_quantity") for f in ("A", "N", "R")])


@query("e16_one_of_stacked", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_returnflag = 'R'")
def e16_one(spark, sf):
    return E.one_table(e16(spark, sf), 2)


@query("e17_ordinal_categories", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS code, lang AS label FROM documents""")
def e17(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "lang")
    domain = E.Domain.infer(df, ["lang"])
    codes = E.encode(df, domain).withColumnRenamed("lang", "code")
    return codes.join(F.broadcast(domain.table(spark).select("code", "label")), "code").select("doc_id", "code", "label")


# ---------------------------------------------------------------- marginal queries and counts


@query("a01_predicate", "SELECT o_orderkey AS row_id, CAST(o_orderstatus = 'F' AND o_orderpriority = '2-HIGH' AS INT) AS hit FROM orders")
def a01(spark, sf):
    hit = A.predicate({"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), hit.alias("hit"))


_FEW = [{"status": 1, "segment": 1}, {"status": 1, "segment": 0}, {"priority": 1, "segment": 1}, {"status": 1, "priority": 1}, {"status": 1, "priority": 0}]


_WIDE = 40  # columns of a wide survey; column i has 2 + i % 4 levels
_WIDE_KEYS = ["l_partkey", "l_suppkey", "l_linenumber", "l_orderkey"]


def _wide_survey(batches):
    """The columns of the wide survey. As Spark expressions they make one method that is too long for the JVM to compile."""
    for b in batches:
        if not b.num_rows:
            continue
        known = np.all([b.column(k).is_valid().to_numpy(zero_copy_only=False) for k in _WIDE_KEYS], axis=0)
        part, supp, line, order = (b.column(k).fill_null(0).to_numpy() for k in _WIDE_KEYS)
        if max(int(k.max()) for k in (part, supp, line, order)) >= 1 << 55 or min(int(k.min()) for k in (part, supp, line, order)) <= -(1 << 55):
            raise OverflowError("a key is too large for the sums of the wide survey")
        values = [np.fmod(np.fmod(part * (i + 3) + supp * i + line * (i + 1) + order, 7 + i), 2 + i % 4).astype(np.int32) for i in range(_WIDE)]  # signs as in SQL
        yield pa.RecordBatch.from_arrays([pa.array(v, mask=~known) for v in values], names=[f"c{i}" for i in range(_WIDE)])


@query("a08_all_pairs_of_forty_columns", f"""
WITH x AS (SELECT [{', '.join(f"(l_partkey * {i + 3} + l_suppkey * {i} + l_linenumber * {i + 1} + l_orderkey) % {7 + i} % {2 + i % 4}" for i in range(_WIDE))}] AS c FROM lineitem),
p AS (SELECT CAST(row_number() OVER (ORDER BY i, j) - 1 AS INT) AS clique_id, i, j FROM (SELECT unnest(range({_WIDE})) AS i), (SELECT unnest(range({_WIDE})) AS j) WHERE i < j)
SELECT clique_id, CAST(c[i + 1] * (2 + j % 4) + c[j + 1] AS BIGINT) AS cell, count(*) AS n FROM x, p GROUP BY 1, 2""")
def a08_wide(spark, sf):
    names = [f"c{i}" for i in range(_WIDE)]
    keys = table(spark, sf, "lineitem").selectExpr(*[f"CAST({k} AS BIGINT) AS {k}" for k in _WIDE_KEYS])
    df = keys.mapInArrow(_wide_survey, ", ".join(f"{c} int" for c in names))
    domain = E.Domain.declare({c: range(2 + i % 4) for i, c in enumerate(names)})
    return A.count_cells(df, A.all_pairs(names), domain)


@query("a02_query_list_wide", f"WITH {CODED} SELECT row_id, " + ", ".join(
    "CAST(" + " AND ".join(f"{c} = {v}" for c, v in q.items()) + f" AS INT) AS q{i}" for i, q in enumerate(_FEW)) + " FROM coded")
def a02(spark, sf):
    return A.wide_hits(coded(spark, sf, CATS)[0], "row_id", _FEW)


_HITS = CODED + ", hits AS (" + " UNION ALL ".join(
    f"SELECT row_id, {i} AS clique_id, CAST({a} * (SELECT max({b}) + 1 FROM coded) + {b} AS BIGINT) AS cell FROM coded" for i, (a, b) in enumerate(PAIRS)) + ")"


@query("a02_query_list_long", f"WITH {_HITS} SELECT * FROM hits")
def a02_long(spark, sf):
    df, domain = coded(spark, sf)
    return A.row_hits(df, "row_id", PAIRS, domain)


@query("a03_query_subset", f"WITH {_HITS} SELECT row_id, clique_id, cell FROM hits WHERE cell IN (1, 3)")
def a03(spark, sf):
    df, domain = coded(spark, sf)
    chosen = A.cell_grid(spark, PAIRS, domain).filter(F.col("cell").isin(1, 3))
    return A.row_hits(df, "row_id", PAIRS, domain, F.broadcast(chosen))


@query("a04_cells_of_one_set", f"WITH {GRID} SELECT cell, v0, v1 FROM grid WHERE clique_id = 2")
def a04(spark, sf):
    _, domain = coded(spark, sf)
    cells = A.with_codes(A.cell_grid(spark, PAIRS[2:3], domain), A.clique_table(spark, PAIRS[2:3], domain))
    return cells.select("cell", F.col("codes")[0].alias("v0"), F.col("codes")[1].alias("v1"))


@query("a05_cells_of_all_sets", f"WITH {GRID} SELECT clique_id, cell, v0, v1 FROM grid")
def a05(spark, sf):
    _, domain = coded(spark, sf)
    cells = A.with_codes(A.cell_grid(spark, PAIRS, domain), A.clique_table(spark, PAIRS, domain))
    return cells.select("clique_id", "cell", F.col("codes")[0].alias("v0"), F.col("codes")[1].alias("v1"))


@query("a06_rows_of_one_set", f"WITH {_HITS} SELECT row_id, cell FROM hits WHERE clique_id = 1")
def a06(spark, sf):
    df, domain = coded(spark, sf)
    return A.row_hits(df, "row_id", PAIRS, domain).filter("clique_id = 1").select("row_id", "cell")


@query("a07_one_marginal_with_zeros", f"WITH {CELLS} SELECT cell, n FROM cells WHERE clique_id = 3")
def a07(spark, sf):
    df, domain = counted(spark, sf)
    return A.count_all_cells(df, PAIRS[3:], domain, "rows").select("cell", "n")


@query("a08_all_marginals_one_scan", f"WITH {CELLS} SELECT clique_id, cell, n FROM cells")
def a08(spark, sf):
    df, domain = counted(spark, sf)
    return A.count_all_cells(df, PAIRS, domain, "rows")


_ITEM_COLS = ["flag", "line", "discount", "tax", "q"]
_ITEM_PAIRS = A.all_pairs(_ITEM_COLS)


@query("a08_all_item_pairs", f"""WITH {ITEMS}, b AS (SELECT *, CAST(floor(quantity / 10) AS VARCHAR) AS q FROM items), """ + ", ".join(
    f"u{i} AS (SELECT '{a}+{b}' AS pair, {a} AS left_label, {b} AS right_label, count(*) AS n FROM b GROUP BY {a}, {b})" for i, (a, b) in enumerate(_ITEM_PAIRS)
) + " " + " UNION ALL ".join(f"SELECT * FROM u{i}" for i in range(len(_ITEM_PAIRS))))
def a08_items(spark, sf):
    df = items(spark, sf).withColumn("q", F.floor(F.col("quantity") / 10).cast("double").cast("string"))
    rows = A.count_rows(df, _ITEM_COLS)
    domain = E.Domain.infer(rows, _ITEM_COLS)
    cells = A.count_cells(E.encode(rows, domain), _ITEM_PAIRS, domain, "rows")
    coded_cells = A.with_codes(cells, A.clique_table(spark, _ITEM_PAIRS, domain))
    side = lambda i: F.struct(F.col("cols")[i].alias("col"), F.col("codes")[i].alias("code"))
    names = domain.table(spark)
    left, right = names.select("col", "code", F.col("label").alias("left_label")), names.select("col", "code", F.col("label").alias("right_label"))
    out = coded_cells.select(F.array_join("cols", "+").alias("pair"), "n", side(0).alias("l"), side(1).alias("r"))
    out = out.join(F.broadcast(left), (F.col("l.col") == left["col"]) & (F.col("l.code") == left["code"])).drop("col", "code")
    out = out.join(F.broadcast(right), (F.col("r.col") == right["col"]) & (F.col("r.code") == right["code"])).drop("col", "code")
    return out.select("pair", "left_label", "right_label", "n")


_JOINED = [("status", "priority"), ("priority", "price"), ("status", "segment")]


@query("a09_join_query_sets", f"WITH {CODED}, {grid_sql(_JOINED)} SELECT clique_id, cell FROM grid")
def a09(spark, sf):
    _, domain = coded(spark, sf)
    return A.cell_grid(spark, A.join_workloads(_JOINED[:2], [_JOINED[0], _JOINED[2]]), domain)


_CANON = f"{GRID}, canon AS (SELECT *, row_number() OVER (ORDER BY clique_id, cell) - 1 AS query_id FROM grid WHERE {canonical_sql()})"
_CLIQUE_NAME = "CASE clique_id " + " ".join(f"WHEN {i} THEN '{a}+{b}'" for i, (a, b) in enumerate(PAIRS)) + " END"


def _canonical(spark, sf):
    _, domain = coded(spark, sf)
    cliques = A.clique_table(spark, PAIRS, domain)
    return A.with_codes(A.query_ids(A.canonical(A.cell_grid(spark, PAIRS, domain), cliques)), cliques)


@query("a10_query_ids_by_set", f"""
WITH {_CANON} SELECT {_CLIQUE_NAME} AS cols, string_agg(CAST(query_id AS VARCHAR), ',' ORDER BY query_id) AS query_ids FROM canon GROUP BY clique_id""")
def a10(spark, sf):
    return A.associations(_canonical(spark, sf)).select(F.array_join("cols", "+").alias("cols"), F.array_join("query_ids", ",").alias("query_ids"))


@query("a11_query_text", f"""
WITH {_CANON} SELECT CAST(query_id AS INT) AS query_id, replace(replace({_CLIQUE_NAME}, '+', '=' || v0 || ', '), '=', '=') || '=' || v1 AS text FROM canon""")
def a11(spark, sf):
    return _canonical(spark, sf).select("query_id", A.query_text().alias("text"))


@query("a12_canonical_cells", f"WITH {_CANON} SELECT clique_id, cell, v0, v1, CAST(query_id AS INT) AS query_id FROM canon")
def a12(spark, sf):
    return _canonical(spark, sf).select("clique_id", "cell", F.col("codes")[0].alias("v0"), F.col("codes")[1].alias("v1"), "query_id")


_TRIPLES = [("status", "priority", "segment"), ("priority", "segment", "price")]


@query("a12_canonical_cells_three_way", f"""
WITH {CODED}, {grid_sql(_TRIPLES)} SELECT clique_id, cell FROM grid WHERE
 (clique_id = 0 AND (v0 <> 0 OR v1 <> 0 OR v2 <> 0)) OR (clique_id = 1 AND v2 <> 0)""")
def a12_three(spark, sf):
    _, domain = coded(spark, sf)
    return A.canonical(A.cell_grid(spark, _TRIPLES, domain), A.clique_table(spark, _TRIPLES, domain))


@query("a13_canonical_count", f"WITH {_CANON} SELECT count(*) AS n FROM canon")
def a13(spark, sf):
    _, domain = counted(spark, sf)
    return A.canonical(A.cell_grid(spark, PAIRS, domain), A.clique_table(spark, PAIRS, domain)).agg(F.count("*").alias("n"))


@query("a13_canonical_count_grid", f"""
WITH {SURVEY} SELECT nation, n_cols, n_cats, CAST(n_cols * (n_cats - 1) + n_cols * (n_cols - 1) / 2 * (n_cats - 1) * (n_cats - 1) AS BIGINT) AS n
FROM (SELECT nation, CAST(count(DISTINCT segment) AS INT) AS n_cols, CAST(unnest(range(2, 8)) AS INT) AS n_cats FROM survey GROUP BY nation)""")
def a13_grid(spark, sf):
    sizes = survey(spark, sf).groupBy("nation").agg(F.countDistinct("segment").cast("int").alias("n_cols"))
    d, k = F.col("n_cols"), F.col("n_cats")
    return sizes.select("nation", "n_cols", F.explode(F.sequence(F.lit(2), F.lit(7))).alias("n_cats")).select(
        "nation", "n_cols", "n_cats", (d * (k - 1) + d * (d - 1) / 2 * (k - 1) * (k - 1)).cast("long").alias("n"))


@query("a14_subsets", """
SELECT o_orderkey, m, concat_ws(',', CASE WHEN m & 1 > 0 THEN o_orderstatus END, CASE WHEN m & 2 > 0 THEN o_orderpriority END,
  CASE WHEN m & 4 > 0 THEN CAST(o_custkey AS VARCHAR) END) AS subset
FROM orders, (SELECT CAST(unnest(range(8)) AS INT) AS m)""")
def a14(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority", F.col("o_custkey").cast("string")).alias("s"))
    return df.select("o_orderkey", F.posexplode(A.subsets("s")).alias("m", "x")).select("o_orderkey", "m", F.array_join("x", ",").alias("subset"))


@query("a15_workloads", f"""
WITH {CODED}, pairs AS (SELECT a.c AS l, b.c AS r FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS))}) a(i, c),
  (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(COLUMNS))}) b(i, c) WHERE a.i < b.i),
w AS (SELECT 'all' AS workload, l || '+' || r AS pair FROM pairs UNION ALL
 SELECT x.l || '+' || x.r, y.l || '+' || y.r FROM pairs x, pairs y WHERE (x.l, x.r) <> (y.l, y.r)),
n AS (SELECT l || '+' || r AS pair, CASE l || '+' || r {' '.join(f"WHEN '{a}+{b}' THEN (SELECT count(*) FROM (SELECT DISTINCT {a}, {b} FROM coded))" for a, b in A.all_pairs(COLUMNS))} END AS n FROM pairs)
SELECT workload, CAST(count(*) AS BIGINT) AS pairs, CAST(sum(n) AS BIGINT) AS cells FROM w JOIN n USING (pair) GROUP BY 1""")
def a15(spark, sf):
    df, domain = counted(spark, sf)
    pairs = A.all_pairs(COLUMNS)
    seen = A.count_cells(df, pairs, domain, "rows").groupBy("clique_id").agg(F.count("*").alias("cells"))
    rows = [(name, pairs.index(p)) for name, kept in A.without_each(pairs).items() for p in kept]
    work = spark.createDataFrame(rows, "workload string, clique_id int")
    return work.join(F.broadcast(seen), "clique_id").groupBy("workload").agg(F.count("*").alias("pairs"), F.sum("cells").alias("cells"))


@query("a16_contingency_table", """
SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P
FROM orders GROUP BY 1""")
def a16(spark, sf):
    return A.crosstab(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@query("a17_value_counts", """
SELECT 'lang' AS col, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def a17(spark, sf):
    return A.value_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("a18_statistic_moments", f"WITH {CELLS} SELECT round(avg(n), 6) AS mean, round(var_pop(n), 4) AS var, count(*) AS cells FROM cells")
def a18(spark, sf):
    return a08(spark, sf).agg(F.round(F.avg("n"), 6).alias("mean"), F.round(F.var_pop("n"), 4).alias("var"), F.count("*").alias("cells"))


@query("a19_number_by_first_appearance", """
SELECT user_id, event_type, row_number() OVER (ORDER BY first_id) AS group_no FROM
 (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY 1, 2)""")
def a19(spark, sf):
    return A.first_appearance_number(table(spark, sf, "events"), ["user_id", "event_type"], "event_id")


@query("a20_column_moments", f"""
SELECT 'l_quantity' AS col, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std FROM lineitem
UNION ALL SELECT 'l_discount', round(avg(l_discount), 6), round(stddev_samp(l_discount), 6) FROM lineitem
UNION ALL SELECT 'share_R', round(avg(CAST(l_returnflag = 'R' AS DOUBLE)), 6), round(stddev_samp(CAST(l_returnflag = 'R' AS DOUBLE)), 6) FROM lineitem""")
def a20(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("share_R", (F.col("l_returnflag") == "R").cast("double"))
    return A.moments(li, ["l_quantity", "l_discount", "share_R"]).select("col", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a21_distinct_names", """
SELECT lang, count(DISTINCT source) AS sources, string_agg(DISTINCT source, ',' ORDER BY source) AS names FROM documents GROUP BY 1""")
def a21(spark, sf):
    pairs = table(spark, sf, "documents").select("lang", "source").distinct()
    return pairs.groupBy("lang").agg(F.count("source").alias("sources"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"))


@query("a22_maximum_per_group", "SELECT c_mktsegment, max(c_acctbal) AS best, max(c_nationkey) AS nation FROM customer GROUP BY 1")
def a22(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.max("c_acctbal").alias("best"), F.max("c_nationkey").alias("nation"))
