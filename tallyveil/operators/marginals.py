"""Marginal queries: predicates on column sets, their counts over a table, and the canonical cells.

A workload is a list of column sets ("cliques"). Its cells are rows (clique_id, cell, n) where
`cell` numbers the value combination inside the clique (last column fastest). Long form, so size
follows the number of cells and not the number of columns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyveil.functions.sqltext import array, search
from tallyveil.operators import slabs
from tallyveil.operators.domain import Domain, encode, rank_text
from tallyveil.session import broadcast_checked, cut_lineage

Clique = tuple[str, ...]

JOINT_CELLS = 5_000_000  # joint domains up to this size are counted once, then marginalised
GROUPING_SETS = 30  # above this many sets rows are not expanded by grouping sets
VECTOR_CELLS = 8_000_000  # cells of a workload whose counts one task may hold (8 bytes each)
BLOCK_CELLS = 362  # joint levels of a block of columns; two blocks have a table of at most 131 044 cells
ROWS_AT_ONCE = 1 << 18  # rows tallied together, more than such a table has cells
GRID_CELLS = 200_000_000


def predicate(values: Mapping[str, int | str]) -> Column:
    """0/1 column: the row has these values."""
    test = None
    for c, v in values.items():
        test = (F.col(c) == F.lit(v)) if test is None else test & (F.col(c) == F.lit(v))
    return F.coalesce(test, F.lit(False)).cast("int") if test is not None else F.lit(1)


def all_pairs(columns: Sequence[str]) -> list[Clique]:
    return list(combinations(columns, 2))


def without_each(cliques: Sequence[Clique]) -> dict[str, list[Clique]]:
    """Workloads: `all`, `none`, and one per removed pair (named by it)."""
    out = {"all": list(cliques), "none": []}
    for c in cliques:
        out["+".join(c)] = [d for d in cliques if d != c]
    return out


def check_cliques(cliques: Sequence[Clique], domain: Domain) -> None:
    for c in cliques:
        missing = [v for v in c if v not in domain.labels]
        if missing:
            raise ValueError(f"unknown columns {missing}")
        if len(set(c)) < len(c):
            raise ValueError(f"column set {c} repeats a column")


def clique_table(spark: SparkSession, cliques: Sequence[Clique], domain: Domain) -> DataFrame:
    """One small row per clique: id, columns, sizes, number of cells, and the non-zero patterns it owns.

    A pattern is the bit mask of columns whose code is not 0. The first clique (in order) that holds
    all columns of a pattern owns it.
    """
    check_cliques(cliques, domain)
    owner: dict[frozenset, int] = {}
    rows = []
    for i, clique in enumerate(cliques):
        own = []
        for mask in range(1, 2 ** len(clique)):
            held = frozenset(c for b, c in enumerate(clique) if mask >> b & 1)
            if owner.setdefault(held, i) == i:
                own.append(mask)
        rows.append((i, list(clique), domain.sizes(clique), domain.cells(clique), own))
    schema = "clique_id int, cols array<string>, sizes array<int>, cells long, own array<int>"
    return spark.createDataFrame(rows, schema)


def cell_grid(spark: SparkSession, cliques: Sequence[Clique], domain: Domain,
              max_cells: int = GRID_CELLS) -> DataFrame:
    """Every cell of every clique: (clique_id, cell), zero counts or not.

    One range over all cells of the workload; each number is mapped to its clique by the
    cliques' running totals.
    """
    check_cliques(cliques, domain)
    total = sum(domain.cells(c) for c in cliques)
    if total > max_cells:
        raise ValueError(f"{total} cells are more than {max_cells}")
    which, starts = _clique_of(cliques, domain, "id")
    grid = spark.range(total).selectExpr(f"{which} AS clique_id", "id")
    return grid.selectExpr("clique_id", f"id - get({starts}, clique_id) AS cell")


def with_codes(cells: DataFrame, cliques: DataFrame) -> DataFrame:
    """Add the columns and codes of each cell (`cols`, `codes`); the clique table is tiny."""
    joined = cells.join(F.broadcast(cliques), "clique_id")
    return joined.withColumn("codes", codes_of("cell", "sizes")).drop("sizes", "cells", "own")


def codes_of(cell: str, sizes: str) -> Column:
    """array<int> of codes of a cell number, last column fastest."""
    strides = F.transform(sizes, lambda s, i: F.aggregate(F.slice(F.col(sizes), i + 2, F.size(sizes)), F.lit(1).cast("long"), lambda a, b: a * b))
    numbers = F.array_repeat(F.col(cell), F.size(sizes))  # outside the lambda: there Spark may overlook the column
    return F.transform(F.arrays_zip(strides.alias("st"), F.col(sizes).alias("sz"), numbers.alias("no")),
                       lambda z: (F.call_function("div", z["no"], z["st"]) % z["sz"]).cast("int"))


def count_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct combinations of some columns with their number (`rows`), in one pass over the table.

    Partial counts shrink the rows before the shuffle. The result is written to the shared folder, so
    whatever is counted, encoded or fitted next starts from it and never reads the table again.
    """
    return cut_lineage(df.groupBy(*columns).agg(F.count("*").alias("rows")))


def count_once(coded: DataFrame, domain: Domain, columns: Sequence[str] | None = None) -> tuple[DataFrame, str | None]:
    """`count_rows` when the joint domain is small enough to be sure it pays; otherwise the rows as they are."""
    names = list(columns or domain.columns)
    if domain.cells(names) > JOINT_CELLS:
        return coded, None
    return count_rows(coded, names), "rows"


def encode_counted(labels: DataFrame, domain: Domain) -> tuple[DataFrame, str | None]:
    """Label rows -> coded rows, counted first when that pays, so labels are looked up once per combination."""
    rows, weight = count_once(labels.select(*domain.columns), domain)
    return encode(rows, domain), weight


def count_cells(coded: DataFrame, cliques: Sequence[Clique], domain: Domain, weight: str | None = None,
                by: Sequence[str] = ()) -> DataFrame:
    """Counts of all occurring cells of all cliques, in one pass over the rows.

    When the joint domain of the used columns is small, rows not counted before (`weight`) are counted once
    per joint cell and the cliques are summed from that; otherwise each row contributes to every clique.
    Either way partial sums are built before the shuffle, so a hot cell costs nothing extra.
    Rows with a code missing in a clique are not counted there.
    """
    check_cliques(cliques, domain)
    used = [c for c in domain.columns if any(c in q for q in cliques)]
    rows = coded.select(*by, *used, (F.col(weight) if weight else F.lit(1).cast("long")).alias("n"))
    if weight is None and domain.cells(used) <= JOINT_CELLS:
        rows = rows.groupBy(*by, *used).agg(F.sum("n").alias("n"))
    if len(cliques) <= GROUPING_SETS:
        return _by_grouping_sets(rows, cliques, domain, used, by)
    if not by and isinstance(rows.schema["n"].dataType, T.LongType) and sum(domain.cells(c) for c in cliques) <= VECTOR_CELLS:
        return _by_vectors(rows, cliques, domain, used)
    return _by_explode(rows, cliques, domain, by)


def _clique_of(cliques: Sequence[Clique], domain: Domain, place: str) -> tuple[str, str]:
    """Texts of clique id and first place of a number that runs over all cells of all cliques."""
    ends, total = [], 0
    for c in cliques:
        total += domain.cells(c)
        ends.append(total)
    return search([str(e) for e in ends[:-1]], str, f"{place} <"), array([0, *ends[:-1]])


def _blocks(used: Sequence[str], domain: Domain) -> dict[str, Clique]:
    """Neighbouring columns put together while their joint levels, a missing one each, stay few: the block of each column."""
    blocks: list[list[str]] = []
    for c in used:
        if not blocks or math.prod(domain.size(x) + 1 for x in (*blocks[-1], c)) > BLOCK_CELLS:
            blocks.append([])
        blocks[-1].append(c)
    return {c: tuple(block) for block in blocks for c in block}


def _joint_tables(cliques: Sequence[Clique], domain: Domain, used: Sequence[str]) -> dict[tuple[Clique, ...], list[int]]:
    """Tables of one or two blocks, with the numbers of the column sets that can be summed from them.

    Sets of other blocks, or all if the tables were too large, are in none and are counted by themselves.
    """
    block = _blocks(used, domain)
    tables: dict[tuple[Clique, ...], list[int]] = {}
    for i, q in enumerate(cliques):
        held = tuple(dict.fromkeys(block[c] for c in used if c in q))
        if len(held) <= 2 and all(math.prod(domain.size(c) + 1 for c in h) <= BLOCK_CELLS for h in held):
            tables.setdefault(held, []).append(i)
    tables = {held: which for held, which in tables.items() if len(which) > 1}
    total = sum(math.prod(domain.size(c) + 1 for h in held for c in h) for held in tables)
    return tables if total <= VECTOR_CELLS else {}


def _by_vectors(rows: DataFrame, cliques: Sequence[Clique], domain: Domain, used: Sequence[str]) -> DataFrame:
    """Many column sets: every task fills one vector of counts, the vectors are added slab by slab.

    Rows are not multiplied by the sets, and what is shuffled depends on the cells and tasks alone. Sets that lie in the same
    two blocks of columns are counted once, as the joint table of these blocks, and are summed from it when the task ends.
    """
    starts = np.concatenate([[0], np.cumsum([domain.cells(c) for c in cliques])])
    sizes = {c: domain.size(c) for c in used}
    joint = _joint_tables(cliques, domain, used)
    summed = {i for which in joint.values() for i in which}
    blocks = list(dict.fromkeys(b for held in joint for b in held))
    width = {b: math.prod(sizes[c] + 1 for c in b) for b in blocks}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(starts[-1], np.int64)
        tables = {held: np.zeros(math.prod(width[b] for b in held), np.int64) for held in joint}

        def add(held_back: list[pa.RecordBatch]):
            b = pa.Table.from_batches(held_back)
            codes = {c: b.column(c).fill_null(-1).to_numpy().astype(np.int64) for c in used}
            n = b.column("n").to_numpy()
            ones = bool((n == 1).all())
            at = {}
            for block in blocks:
                at[block] = np.zeros(len(n), np.int64)
                for c in block:
                    if int(codes[c].max()) >= sizes[c]:
                        raise ValueError(f"a code of column {c!r} is outside its domain")
                    at[block] = at[block] * (sizes[c] + 1) + np.where(codes[c] < 0, sizes[c], codes[c])
            for held, table in tables.items():
                cell = at[held[0]] if len(held) == 1 else at[held[0]] * width[held[1]] + at[held[1]]
                table += _tally(cell, None if ones else n, len(table))
            for i, (q, start, end) in enumerate(zip(cliques, starts[:-1], starts[1:])):
                if i in summed:
                    continue
                cell, known = np.zeros(len(n), np.int64), np.ones(len(n), bool)
                for c in q:
                    cell, known = cell * sizes[c] + codes[c], known & (codes[c] >= 0)
                if known.all():
                    counts[start:end] += _tally(cell, None if ones else n, end - start)
                else:
                    counts[start:end] += _tally(cell[known], None if ones else n[known], end - start)

        waiting, size = [], 0
        for b in batches:
            waiting.append(b)
            size += b.num_rows
            if size >= ROWS_AT_ONCE:
                add(waiting)
                waiting, size = [], 0
        if size:
            add(waiting)
        for held, table in tables.items():
            if not table.any():
                continue
            columns = [c for block in held for c in block]
            table = table.reshape([sizes[c] + 1 for c in columns])
            for i in joint[held]:
                q = cliques[i]
                part = table.sum(axis=tuple(k for k, c in enumerate(columns) if c not in q))
                left = [c for c in columns if c in q]
                part = part[tuple(slice(sizes[c]) for c in left)].transpose([left.index(c) for c in q])  # without the missing level
                counts[starts[i]:starts[i + 1]] += part.ravel()
        yield pa.RecordBatch.from_pydict(slabs.pack(counts))

    found = rows.select(*used, "n").mapInArrow(fill, slabs.schema("long"))
    cells = slabs.spread(slabs.add_up(found), [], "place", "n")
    which, first = _clique_of(cliques, domain, "place")
    return cells.selectExpr(f"{which} AS clique_id", "place", "n").selectExpr("clique_id", f"place - get({first}, clique_id) AS cell", "n")


def _tally(cell: np.ndarray, n: np.ndarray | None, cells: int) -> np.ndarray:
    """Exact whole-number counts per cell of one batch."""
    if n is None or int(n.max(initial=0)) * len(n) < 1 << 53:  # doubles hold these sums exactly
        return np.bincount(cell, n, cells).astype(np.int64)
    out = np.zeros(cells, np.int64)
    np.add.at(out, cell, n)
    return out


def _cell_structs(cliques: Sequence[Clique], domain: Domain) -> Column:
    """One (clique_id, cell) per column set of a row."""
    parts = [f"named_struct('clique_id', {i}, 'cell', {rank_text(q, domain.sizes(q))})" for i, q in enumerate(cliques)]
    return F.expr(f"explode(array({', '.join(parts)}))")


def _by_explode(rows: DataFrame, cliques: Sequence[Clique], domain: Domain, by: Sequence[str]) -> DataFrame:
    long = rows.select(*by, "n", _cell_structs(cliques, domain).alias("p")).select(*by, "p.clique_id", "p.cell", "n")
    return long.filter("cell IS NOT NULL").groupBy(*by, "clique_id", "cell").agg(F.sum("n").alias("n"))


def _by_grouping_sets(rows: DataFrame, cliques: Sequence[Clique], domain: Domain, used: Sequence[str],
                      by: Sequence[str]) -> DataFrame:
    first = {}
    for i, q in enumerate(cliques):
        first.setdefault(frozenset(q), i)
    columns = {c: F.col(c) for c in (*by, *used)}
    sets = [[columns[c] for c in (*by, *cliques[i])] for i in first.values()]
    keys = [*by, *used]
    grouped = rows.groupingSets(sets, *columns.values()).agg(F.sum("n").alias("n"), F.grouping_id(*keys).alias("gid"))
    out = []
    for i, q in enumerate(cliques):
        mask = sum(1 << (len(used) - 1 - p) for p, c in enumerate(used) if c not in q)
        out.append((f"gid = {mask}", f"named_struct('clique_id', {i}, 'cell', {rank_text(q, domain.sizes(q))})"))
    if len(first) == len(cliques):
        cell = "CASE " + " ".join(f"WHEN {w} THEN {s}" for w, s in out) + " END"
    else:  # the same set listed twice (maybe in another column order) gives a row for each
        cell = "explode(array_compact(array(" + ", ".join(f"CASE WHEN {w} THEN {s} END" for w, s in out) + ")))"
    picked = grouped.select(*by, "n", F.expr(cell).alias("p"))
    return picked.select(*by, "p.clique_id", "p.cell", "n").filter("cell IS NOT NULL")


def count_all_cells(coded: DataFrame, cliques: Sequence[Clique], domain: Domain, weight: str | None = None) -> DataFrame:
    """Counts with zero cells included: (clique_id, cell, n)."""
    grid = cell_grid(coded.sparkSession, cliques, domain)
    seen = broadcast_checked(count_cells(coded, cliques, domain, weight), sum(domain.cells(c) for c in cliques), 48)
    return grid.join(seen, ["clique_id", "cell"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def pair_sides(pairs: Sequence[Clique], domain: Domain) -> dict[str, str]:
    """Texts for cells of pair cliques: names and codes of both sides, by arithmetic on the cell number."""
    if any(len(p) != 2 for p in pairs):
        raise ValueError("only pairs have two sides")
    width = f"get({array([domain.size(b) for _, b in pairs])}, clique_id)"
    return {"left_col": f"get({array([a for a, _ in pairs])}, clique_id)", "right_col": f"get({array([b for _, b in pairs])}, clique_id)",
            "left_code": f"int(cell div {width})", "right_code": f"int(cell % {width})"}


def canonical(cells: DataFrame, cliques: DataFrame) -> DataFrame:
    """Keep a linearly independent set of cells that spans all of them.

    A cell is kept when its pattern of non-zero codes is not empty and its clique owns the pattern.
    """
    coded = cells.join(F.broadcast(cliques.select("clique_id", "sizes", "own")), "clique_id").withColumn("codes", codes_of("cell", "sizes"))
    mask = F.aggregate(
        F.transform("codes", lambda v, i: F.when(v != 0, F.pow(F.lit(2.0), i).cast("int")).otherwise(0)),
        F.lit(0), lambda a, b: a + b)
    return coded.filter(F.array_contains("own", mask)).drop("sizes", "own", "codes")


def canonical_count(cliques: Sequence[Clique], domain: Domain) -> int:
    """How many canonical cells there are, in closed form."""
    held = {frozenset(s) for q in cliques for k in range(1, len(q) + 1) for s in combinations(q, k)}
    return sum(math.prod(domain.size(c) - 1 for c in s) for s in held)


def query_ids(cells: DataFrame) -> DataFrame:
    """Number queries in clique order, then cell order: cells are few, one row per query.

    The count per clique is summed first, so each clique is numbered by its own task.
    """
    from pyspark.sql import Window as W

    per = cells.groupBy("clique_id").agg(F.count("*").alias("__c"))
    base = F.sum("__c").over(W.orderBy("clique_id")) - F.col("__c")
    starts = per.select("clique_id", base.alias("__base"))
    rank = F.row_number().over(W.partitionBy("clique_id").orderBy("cell"))
    return cells.join(F.broadcast(starts), "clique_id").withColumn("query_id", (rank - 1 + F.col("__base")).cast("int")).drop("__base")


def row_hits(coded: DataFrame, key: str, cliques: Sequence[Clique], domain: Domain, queries: DataFrame | None = None) -> DataFrame:
    """Per row the cells it falls in: (key, clique_id, cell), one per clique.

    This is the row x query 0/1 table in sparse form. `queries` (clique_id, cell, ...) restricts it.
    """
    long = coded.select(key, _cell_structs(cliques, domain).alias("p")).select(key, "p.clique_id", "p.cell").filter("cell IS NOT NULL")
    return long if queries is None else long.join(queries, ["clique_id", "cell"])


def wide_hits(coded: DataFrame, key: str, queries: Sequence[Mapping[str, int]]) -> DataFrame:
    """Row x query 0/1 table with one column per query, for few queries."""
    return coded.select(key, *[predicate(q).alias(f"q{i}") for i, q in enumerate(queries)])


def join_workloads(*parts: Sequence[Clique]) -> list[Clique]:
    """Column sets of several workloads, order kept, repeated sets once."""
    out: dict[Clique, None] = {}
    for p in parts:
        for q in p:
            out.setdefault(tuple(q))
    return list(out)


def associations(queries: DataFrame) -> DataFrame:
    """Query ids of each column set."""
    return queries.groupBy("cols").agg(F.array_sort(F.collect_list("query_id")).alias("query_ids"))


def query_text(cols: str = "cols", codes: str = "codes") -> Column:
    """`a=1, b=0` text of a query."""
    pairs = F.arrays_zip(F.col(cols).alias("c"), F.col(codes).alias("v"))
    return F.array_join(F.transform(pairs, lambda p: F.concat_ws("=", p["c"], p["v"].cast("string"))), ", ")


def subsets(column: str) -> Column:
    """All sub-arrays of an array column, by bit mask (array<array<...>>)."""
    masks = F.sequence(F.lit(0), F.pow(F.lit(2.0), F.size(column)).cast("int") - 1)
    bit = lambda m, i: F.call_function("div", m.cast("long"), F.pow(F.lit(2.0), i).cast("long")) % 2 == 1
    return F.transform(masks, lambda m: F.filter(F.col(column), lambda v, i: bit(m, i)))


def crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Wide contingency table; the column's levels are given, so there is no extra pass to find them."""
    return df.groupBy(row).pivot(column, list(levels)).count().na.fill(0)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, value, n) of several label columns in one pass."""
    return df.select(*columns).unpivot([], list(columns), "col", "value").groupBy("col", "value").agg(F.count("*").alias("n"))


def first_appearance_number(df: DataFrame, group: Sequence[str], order_key: str) -> DataFrame:
    """Groups numbered from 1 by where they first appear: (group..., group_no).

    Rows shrink to one per group before the numbers are given.
    """
    from tallyveil.operators.numbering import number_rows

    first = df.groupBy(*group).agg(F.min(order_key).alias("__first"))
    return number_rows(first, "__first", "group_no").drop("__first")


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(col, mean, std) of numeric columns in one pass."""
    row = df.agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    parts = [F.struct(F.lit(c).alias("col"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std")) for c in columns]
    return row.select(F.explode(F.array(*parts)).alias("p")).select("p.*")
