"""Label domains and integer codes.

A code is the place of a label in its column's domain. Domains are declared, or inferred from
the rows when no privacy is asked for. The inferred order is binary text order.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tallyveil.functions.sqltext import array, ident, literal, search
from tallyveil.functions.text import clean_name
from tallyveil.operators.cleaning import target_last
from tallyveil.session import broadcast_checked, cut_lineage

MAX_LEVELS = 200_000  # labels of all columns a driver-side domain may hold; more raises
TREE_LEVELS = 256  # up to here codes come from nested comparisons, above from a join
MAX_CELLS = 2_000_000_000


def require_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> None:
    """Refuse columns that are not labels, from the schema alone."""
    wrong = [f.name for f in df.schema if (columns is None or f.name in columns) and not isinstance(f.dataType, T.StringType)]
    if wrong:
        raise ValueError(f"columns must be categorical (string): {wrong}")


def column_positions(df: DataFrame, names: Sequence[str]) -> tuple[int, ...]:
    """Schema positions of columns; an unknown name raises."""
    place = {c: i for i, c in enumerate(df.columns)}
    missing = [n for n in names if n not in place]
    if missing:
        raise ValueError(f"unknown columns {missing}")
    return tuple(place[n] for n in names)


def label_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct (col, label); duplicates vanish on the map side, so the shuffle is small."""
    return df.select(*columns).unpivot([], list(columns), "col", "label").distinct()


def domain_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """domain(col, code, label) over all rows, codes from 0 in label order; nulls have no code.

    Any number of labels: they are sorted by ranges and numbered inside each range, and the ranges are lined up by their counts,
    so no label leaves the executors. The sorted labels are written first, which fixes the ranges.
    """
    require_categorical(df, columns)
    labels = label_rows(df, columns).filter("label IS NOT NULL").repartitionByRange("col", "label")
    ranged = cut_lineage(labels.withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("col", "__range").agg(F.count("*").alias("n"))  # a row per column and range
    before = W.partitionBy("col").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("col", "__range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    within = F.row_number().over(W.partitionBy("col", "__range").orderBy("label")) - 1
    numbered = ranged.withColumn("__no", within).join(first, ["col", "__range"])
    return numbered.select("col", (F.col("__first") + F.col("__no")).cast("int").alias("code"), "label")


def encode_by_table(df: DataFrame, domain: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Labels -> codes through a domain table of any size; other columns pass, nulls and unknown labels give null.

    Labels are counted first. Those that hold more rows than an even share of a shuffle partition, fewer than there are
    partitions, are looked up in a broadcast table; all others by an equality join, in which rows that have nothing to find any more
    are spread over all partitions.
    """
    require_categorical(df, columns)
    clash = {"__label", "__code", "__top", "__part", "__key", "__spread"} & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are used while encoding")
    parts, order = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.columns
    counts = df.select(*columns).unpivot([], list(columns), "col", "label").groupBy("col", "label").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("label").isNotNull() & (F.col("n") > F.lit(df.count() / parts)))
    top = cut_lineage(frequent.join(domain, ["col", "label"]).select("col", F.col("label").alias("__label"), F.col("code").alias("__top")))
    for c in columns:
        mine = top.filter(F.col("col") == c).drop("col")
        keyed = df.join(F.broadcast(mine), F.col(c) == F.col("__label"), "left").drop("__label")
        keyed = keyed.withColumn("__key", F.when(F.col("__top").isNull(), F.col(c)))
        keyed = keyed.withColumn("__spread", F.when(F.col("__key").isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(parts))).otherwise(-1))
        table = domain.filter(F.col("col") == c).select(F.col("label").alias("__label"), F.col("code").alias("__code"), F.lit(-1).cast("long").alias("__part"))
        found = keyed.join(table, (F.col("__key") == F.col("__label")) & (F.col("__spread") == F.col("__part")), "left")
        df = found.withColumn(c, F.coalesce("__top", "__code")).select(order)
    return df


@dataclass(frozen=True)
class Domain:
    """Ordered labels per column; small by construction (`MAX_LEVELS`)."""

    labels: Mapping[str, tuple[str, ...]]
    inferred: bool = field(default=False, compare=False)  # read off rows: not for private runs

    @staticmethod
    def declare(labels: Mapping[str, Sequence]) -> "Domain":
        out = {c: tuple(str(v) for v in vs) for c, vs in labels.items()}
        for c, vs in out.items():
            if len(set(vs)) < len(vs):
                raise ValueError(f"labels of {c!r} repeat")
        return Domain(out)

    @staticmethod
    def infer(df: DataFrame, columns: Sequence[str], null_label: str | None = None, max_levels: int = MAX_LEVELS) -> "Domain":
        """Labels seen in the rows, all of them or an error. Reveals them, so private runs declare theirs."""
        require_categorical(df, columns)
        rows = label_rows(df, columns).limit(max_levels + 1).collect()
        if len(rows) > max_levels:
            raise ValueError(f"more than {max_levels} labels; these columns are not categorical")
        found: dict[str, set] = {c: set() for c in columns}
        for r in rows:
            if r["label"] is None and null_label is None:
                raise ValueError(f"column {r['col']!r} has nulls; clean them or give null_label")
            found[r["col"]].add(null_label if r["label"] is None else r["label"])
        return Domain({c: tuple(sorted(found[c], key=lambda v: v.encode())) for c in columns}, inferred=True)

    @property
    def columns(self) -> list[str]:
        return list(self.labels)

    def size(self, column: str) -> int:
        return len(self.labels[column])

    def sizes(self, columns: Sequence[str] | None = None) -> list[int]:
        return [self.size(c) for c in (columns or self.columns)]

    def cells(self, columns: Sequence[str] | None = None) -> int:
        """Number of possible rows, exact."""
        return math.prod(self.sizes(columns))

    def only(self, columns: Sequence[str]) -> "Domain":
        return Domain({c: self.labels[c] for c in columns}, self.inferred)

    def require_declared(self) -> None:
        """Refuse labels that were read off the rows: which labels occur is not protected by any noise."""
        if self.inferred:
            raise ValueError("a private run needs a declared domain; if the labels are public, declare them: Domain.declare(domain.labels)")

    def table(self, spark: SparkSession) -> DataFrame:
        """The domain as domain(col, code, label)."""
        rows = [(c, i, v) for c, vs in self.labels.items() for i, v in enumerate(vs)]
        return spark.createDataFrame(rows, "col string, code int, label string")

    def mapping(self) -> dict[str, dict[int, str]]:
        return {c: dict(enumerate(vs)) for c, vs in self.labels.items()}


def code_of(column: str, labels: Sequence[str]) -> Column:
    """Code expression of a short domain: binary search in nested comparisons; null for labels outside it."""
    if not labels:
        return F.lit(None).cast("int")
    name = ident(column)
    ordered = sorted(((v, i) for i, v in enumerate(labels)), key=lambda p: p[0].encode())
    leaf = lambda i: f"CASE WHEN {name} = {literal(ordered[i][0])} THEN {ordered[i][1]} END"
    return F.expr(search([literal(v) for v, _ in ordered[:-1]], leaf, f"{name} <="))


def label_of(column: str, labels: Sequence[str]) -> Column:
    """Label expression of a short domain; null for codes outside it."""
    if not labels:
        return F.lit(None).cast("string")
    return F.expr(f"get({array(labels)}, {ident(column)})")


def _joined(df: DataFrame, domain: Domain, columns: Sequence[str], source: str, target: str) -> DataFrame:
    """Replace columns through their (long) domain tables; a broadcast join when small."""
    for c in columns:
        pairs = [(v, i) for i, v in enumerate(domain.labels[c])]
        table = df.sparkSession.createDataFrame(pairs, f"label string, code int").select(
            F.col(source).alias(c), F.col(target).alias("__to"))
        df = df.join(broadcast_checked(table, len(pairs), 64), c, "left").withColumn(c, F.col("__to")).drop("__to")
    return df


def encode(df: DataFrame, domain: Domain) -> DataFrame:
    """Labels -> codes for the domain's columns; other columns pass. Unknown labels give null."""
    require_categorical(df, domain.columns)
    short = {c for c in domain.columns if domain.size(c) <= TREE_LEVELS}
    order = df.columns
    out = df.select([code_of(c, domain.labels[c]).alias(c) if c in short else F.col(c) for c in order])
    return _joined(out, domain, [c for c in domain.columns if c not in short], "label", "code").select(order)


def decode(df: DataFrame, domain: Domain) -> DataFrame:
    """Codes -> labels; columns without a domain pass through."""
    order = df.columns
    known = [c for c in order if c in domain.labels]
    short = {c for c in known if domain.size(c) <= TREE_LEVELS}
    out = df.select([label_of(c, domain.labels[c]).alias(c) if c in short else F.col(c) for c in order])
    return _joined(out, domain, [c for c in known if c not in short], "code", "label").select(order)


def to_codes(df: DataFrame, domain: Domain | None = None) -> DataFrame:
    """Label columns -> codes, whole-number columns stay, any other type raises."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    labels = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    wrong = [f.name for f in df.schema if f.name not in labels and not isinstance(f.dataType, whole)]
    if wrong:
        raise ValueError(f"unsupported column types: {wrong}")
    if not labels:
        return df
    return encode(df, domain.only(labels) if domain else Domain.infer(df, labels))


def unrank(index: str, sizes: Sequence[int]) -> list[Column]:
    """Codes of the cell whose number is in column `index`; the last column runs fastest."""
    out, stride = [], math.prod(sizes)
    for k in sizes:
        stride //= k
        out.append(F.expr(f"int(({ident(index)} div {stride}L) % {k})"))
    return out


def rank_text(columns: Sequence[str], sizes: Sequence[int]) -> str:
    """Text of the number of a cell from its codes; inverse of `unrank`."""
    out = "0L"
    for c, k in zip(columns, sizes):
        out = f"({out} * {k}L + {ident(c)})"
    return out


def rank_cell(columns: Sequence[str], sizes: Sequence[int]) -> Column:
    return F.expr(rank_text(columns, sizes))


def all_rows(spark: SparkSession, domain: Domain, columns: Sequence[str] | None = None,
             max_cells: int = MAX_CELLS) -> DataFrame:
    """Every possible row of the domain as codes: one range, split by mixed-radix division."""
    names = list(columns or domain.columns)
    sizes, total = domain.sizes(names), domain.cells(names)
    if total > max_cells:
        raise ValueError(f"{total} cells are more than {max_cells}")
    digits = unrank("id", sizes)
    return spark.range(total).select(F.col("id").alias("cell_id"), *[d.alias(n) for d, n in zip(digits, names)])


def one_hot(df: DataFrame, domain: Domain, target: str) -> DataFrame:
    """0/1 column per label (all levels kept), cleaned names, target last and as code."""
    out = []
    for c in df.columns:
        if c == target:
            continue
        if c in domain.labels:
            out += [(F.col(c) == F.lit(v)).cast("int").alias(clean_name(f"{c}_{v}")) for v in domain.labels[c]]
        else:
            out.append(F.col(c).alias(clean_name(c)))
    goal = code_of(target, domain.labels[target]) if target in domain.labels else F.col(target)
    out.append(goal.alias(clean_name(target)))
    names = [clean_name(f"{c}_{v}") for c in df.columns if c != target and c in domain.labels for v in domain.labels[c]]
    if len(set(names)) < len(names):
        raise ValueError("one-hot names collide after cleaning")
    return df.select(out)


def for_modelling(df: DataFrame, target: str) -> DataFrame:
    """All columns as labels, target last."""
    return target_last(df.select([F.col(c).cast("string").alias(c) for c in df.columns]), target)


def for_coverage(df: DataFrame, target: str, domain: Domain | None = None) -> DataFrame:
    """Labels as codes, whole numbers kept, target last."""
    return target_last(to_codes(df, domain), target)


def align_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Columns in the wanted order; ones the table lacks become 0, ones it has in excess raise."""
    extra = set(df.columns) - set(wanted)
    if extra:
        raise ValueError(f"columns not in the other table: {sorted(extra)}")
    return df.select([F.col(c) if c in df.columns else F.lit(0).alias(c) for c in wanted])


def stack_tables(frames: Sequence[DataFrame]) -> DataFrame:
    """m tables -> one with `dataset_id`."""
    out = None
    for i, frame in enumerate(frames):
        tagged = frame.withColumn("dataset_id", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no tables")
    return out


def one_table(df: DataFrame, dataset_id: int) -> DataFrame:
    """One of the stacked tables; a partition filter when stored by dataset."""
    return df.filter(F.col("dataset_id") == dataset_id).drop("dataset_id")


def label_queries(queries: DataFrame, domain: DataFrame) -> DataFrame:
    """queries(query_id, pos, col, code) -> with the label of each value."""
    return queries.join(domain, ["col", "code"], "left").select("query_id", "pos", "col", "code", "label")


def code_queries(queries: DataFrame, domain: DataFrame) -> DataFrame:
    """queries(query_id, pos, col, label) -> with codes; an unknown column or label raises."""
    unknown = queries.join(domain, ["col", "label"], "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no such column or label: {unknown[0]['col']} = {unknown[0]['label']}")
    return queries.join(domain, ["col", "label"]).select("query_id", "pos", "col", "code", "label")
