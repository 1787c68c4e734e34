"""MinHash near-duplicates with an LSH forest: every document is a leaf of TREES sorted signature orders.

A tree orders documents by its own sequence of MinHash values. Documents that share the first DEPTH values form a region; its
candidates are the WINDOW neighbours before each in the order, which have the longest common prefixes, and each member with
the region's smallest id. Where a region is dense, neighbours must share twice the depth, so that a region of copies with small
edits is not compared all over. All orders are one range-partitioned sort, read as a stream: a region of any size is spread
over tasks, and what meets at the border of two tasks is compared in a small pass over the border rows. Candidates are
confirmed on full shingle sets. Regions with more than WINDOW + 1 members that still hold more than one component after that
are open: there all pairs of different components are compared, found by the rarest quarter of their shingles, which any two
sets of that similarity share. So no number of partners is capped; what can be missed are links whose documents meet in no
tree, at the threshold 5 in a million.

Copies of a shingle set are one leaf. A null text or one without words is linked with nothing. A row with a null doc_id is
linked with nothing and is its own. Rows that share a doc_id get the component of their own text. Ties have no effect: groups
are named by their smallest id. An empty table gives an empty result; texts of any length are hashed whole, one block for a
long text. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.llm.blocks import LOWER, SEED, byte_hashes, mix, text_blocks, utf8, words
from tallyveil.llm.common import carrying, discard, saved, sifted
from tallyveil.llm.components import components

WORDS = 5
PERCENT = 75
TREES = 32
DEPTH = 4  # MinHash values that leaves of a region share; DEPTH / 2 longs
DENSE = 64  # members of a region after which neighbours must share twice the depth
WINDOW = 3  # neighbours before a leaf that are candidates
TASK_LEAVES = 2_000_000
_RNG = np.random.default_rng(20240229)
_FACTORS = (_RNG.integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_STEP = np.uint64(0xD1342543DE82EF95)


def shingle_sets(column: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed word shingles of each row: (row numbers, hashes), sorted by both."""
    data, offsets = utf8(column)
    found = words(LOWER[data], offsets)
    hashed, counts = byte_hashes(found.distinct)[found.ids], np.diff(found.bounds)
    rows = found.rows()
    whole = np.zeros(max(0, len(hashed) - size + 1), np.uint64)
    for k in range(size):
        whole = whole * _STEP + hashed[k:k + len(whole)]
    inside = rows[size - 1:] == rows[:len(whole)]
    row, value = rows[:len(whole)][inside], mix(whole[inside])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        total = counts[short].astype(np.uint64) * SEED
        for k in range(size - 1):
            some = counts[short] > k
            total[some] = total[some] * _STEP + hashed[found.bounds[short[some]] + k]
        row, value = np.concatenate([row, short]), np.concatenate([value, mix(total)])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def _sketch_task(batches):
    for block in text_blocks(batches):
        row, value = shingle_sets(block.column("text"))
        n = np.bincount(row, minlength=block.num_rows)
        some = np.flatnonzero(n)
        starts = np.concatenate([[0], np.cumsum(n[some])])[:-1]
        k1, k2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
        sketch = np.zeros((len(n), TREES * DEPTH), np.uint64)
        if len(some):
            k1[some] = np.add.reduceat(mix(value + SEED), starts)
            k2[some] = np.add.reduceat(mix(value * _STEP), starts)
            for j, factor in enumerate(_FACTORS):
                sketch[some, j] = np.minimum.reduceat(value * factor, starts) >> np.uint64(32)
        pairs = ((sketch[:, 0::2] << np.uint64(32)) | sketch[:, 1::2]).view(np.int64)
        offsets = pa.array(np.arange(len(n) + 1, dtype=np.int32) * pairs.shape[1])
        yield pa.RecordBatch.from_arrays(
            [block.column("doc_id"), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(pairs.ravel()))],
            names=["doc_id", "n_shingles", "k1", "k2", "sketch"])


def _leaves(reps: DataFrame) -> DataFrame:
    """rep, region (hash of the tree and the first DEPTH values), deeper (the next values of the tree) for each tree."""
    half = DEPTH // 2
    width = TREES * half

    def at(t, k):
        return F.element_at("sketch", (((t * half) + k) % width + 1).cast("int"))

    leaf = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        F.xxhash64(t, *[at(t, k) for k in range(half)]).alias("region"), at(t, half).alias("deeper")))
    return reps.select("rep", F.explode(leaf).alias("leaf")).select("leaf.region", "leaf.deeper", "rep")


def _neighbour_task(batches):
    """Regions of several leaves in a sorted run: a row (region, rep, null) for each member, and one for each neighbour before it.

    Rows at the start and end of the task come again with `edge` set.
    """
    held, behind, edge, kind = None, 0, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema
        if len(edge) < WINDOW:
            edge.append(batch.slice(0, WINDOW))
        rows = pa.concat_batches([held, batch]) if held is not None else batch
        old = held.num_rows if held is not None else 0
        region, deeper = rows.column("region").to_numpy(), rows.column("deeper").to_numpy()
        rep = rows.column("rep")
        code = pc.fill_null(rep.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        n = len(region)
        starts = np.ones(n, bool)
        starts[1:] = region[1:] != region[:-1]
        place = np.arange(n) - np.maximum.accumulate(np.where(starts, np.arange(n), 0))
        first_run = np.cumsum(starts) == 1
        place[first_run] += behind  # members of the first run that came before what is held
        whose, who, beside = [], [], []
        new = np.arange(n) >= old
        second = np.flatnonzero(new & (place == 1))
        second = second[second > 0]
        members = np.concatenate([second - 1, np.flatnonzero(new & (place > 0))])
        whose.append(region[members])
        who.append(members)
        beside.append(np.full(len(members), -1))
        for k in range(1, WINDOW + 1):
            i = np.arange(max(old, k), n)
            near = (region[i] == region[i - k]) & (code[i] != code[i - k]) & ((place[i] < DENSE) | (deeper[i] == deeper[i - k]))
            i = i[near]
            whose.append(region[i])
            who.append(i)
            beside.append(i - k)
        who, beside = np.concatenate(who), np.concatenate(beside)
        if len(who):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(whose)), rep.take(pa.array(who)), rep.take(pa.array(np.where(beside < 0, 0, beside), mask=beside < 0)),
                 pa.nulls(len(who), pa.int64()), pa.array(np.zeros(len(who), bool))], names=["region", "rep", "beside", "deeper", "edge"])
        keep = min(WINDOW, n)
        behind = int(place[n - keep]) if n else 0
        held = rows.slice(n - keep, keep)
    if held is not None:
        for some in [*edge, held]:
            yield pa.RecordBatch.from_arrays([some.column("region"), some.column("rep"), pa.nulls(some.num_rows, kind.field("rep").type), some.column("deeper"), pa.array(np.ones(some.num_rows, bool))],
                                             names=["region", "rep", "beside", "deeper", "edge"])


def neighbours(leaves: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """Members of regions (region, rep), and pairs of neighbours (region, rep, beside), of all sorted orders."""
    kind = leaves.select("rep").schema[0].dataType.simpleString()
    shape = f"region long, rep {kind}, beside {kind}, deeper long, edge boolean"
    parts = max(int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")), count * TREES // TASK_LEAVES)
    ordered = leaves.repartitionByRange(parts, "region", "deeper", "rep").sortWithinPartitions("region", "deeper", "rep")
    found = saved(ordered.select("region", "deeper", "rep").mapInArrow(_neighbour_task, shape), "regions")
    # a few rows of each task, in one order: what meets where one task ends and the next begins
    border = found.where("edge").select("region", "deeper", "rep").distinct().repartition(1).sortWithinPartitions("region", "deeper", "rep")
    every = found.where("NOT edge").union(border.mapInArrow(_neighbour_task, shape).where("NOT edge"))
    every = saved(every.select("region", "rep", "beside").distinct(), "region-pairs")
    discard(found)
    return every.where("beside IS NULL").select("region", "rep"), every.where("beside IS NOT NULL")


def _pairs(left, right) -> list:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _confirm_task(batches):
    for batch in batches:
        for block in text_blocks(text_blocks(iter([batch]), "text_a"), "text_b"):
            count = block.num_rows
            (row_a, value_a), (row_b, value_b) = shingle_sets(block.column("text_a")), shingle_sets(block.column("text_b"))
            row, value = np.concatenate([row_a, row_b]), np.concatenate([value_a, value_b])
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
            twice = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
            both = np.bincount(row[1:][twice], minlength=count)
            union = np.bincount(row, minlength=count) - both
            near = (both > 0) & (100 * both >= PERCENT * union)
            kept = block.select(["a", "b"]).filter(pa.array(near))
            if kept.num_rows:
                yield kept


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full shingle sets are similar enough."""
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    kind = pairs.select("a").schema[0].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm_task, f"a {kind}, b {kind}")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    for end in ("a", "b"):
        side = groups.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(side, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb").select("a", "b")


def _shingle_task(batches):
    for block in text_blocks(batches):
        row, value = shingle_sets(block.column("text"))
        yield pa.RecordBatch.from_arrays([block.column("rep").take(pa.array(row)), pa.array(value.view(np.int64)), pa.array(np.bincount(row, minlength=block.num_rows)[row])],
                                         names=["rep", "shingle", "size"])


def _open_pairs(members: DataFrame, groups: DataFrame, texts: DataFrame, tried: DataFrame) -> DataFrame:
    """Untried pairs of different components among documents of open regions that may be similar enough.

    Two sets of that similarity share a shingle among the rarest quarter of the larger and the rarest seventh of the smaller
    (at 75 percent); rarity is counted among the documents of open regions.
    """
    placed = members.join(groups, members["rep"] == groups["id"], "left").select("region", "rep", F.coalesce("component", "rep").alias("component"))
    mixed = placed.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where(f"low < high AND n > {WINDOW + 1}").select("region")
    inside = placed.join(mixed, "region", "left_semi").select("rep", "component").distinct()
    kind = texts.select("rep").schema[0].dataType.simpleString()
    sets = saved(texts.join(inside.select("rep"), "rep", "left_semi").select("rep", "text").mapInArrow(_shingle_task, f"rep {kind}, shingle long, size long"), "open-sets")
    often = sets.groupBy("shingle").agg(F.count("*").alias("often")).where("often > 1")
    ranked = sets.join(often, "shingle", "left").withColumn("often", F.coalesce("often", F.lit(1)))
    place = F.row_number().over(W.partitionBy("rep").orderBy("often", "shingle"))
    prefix = ranked.withColumn("place", place).where(f"place <= size - ceil(size * {PERCENT} / 100) + 1 AND often > 1")
    prefix = saved(prefix.join(inside, "rep").select("rep", "shingle", "size", "place", "component"), "open-prefixes")
    discard(sets)
    # the smaller set needs a shorter prefix still, which keeps shingles that many sets share out of one side
    short = prefix.where(f"place <= size - ceil(size * {2 * PERCENT} / {100 + PERCENT}) + 1")
    a, b = (side.select("shingle", *[F.col(c).alias(f"{c}_{x}") for c in ("rep", "size", "place", "component")]) for side, x in ((prefix, "a"), (short, "b")))
    # what is left after a common shingle bounds the number of common ones
    met = a.join(b, "shingle").where(f"""component_a <> component_b AND (size_a > size_b OR size_a = size_b AND rep_a > rep_b)
        AND 100 * size_b >= {PERCENT} * size_a
        AND {100 + PERCENT} * (1 + least(size_a - place_a, size_b - place_b)) >= {PERCENT} * (size_a + size_b)""")
    return met.select(*_pairs(F.col("rep_a"), F.col("rep_b"))).distinct().join(tried, ["a", "b"], "left_anti")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row: one kept row for each group of near-duplicates."""
    sketched = saved(docs.select("doc_id", "text").mapInArrow(
        _sketch_task, f"doc_id {docs.select('doc_id').schema[0].dataType.simpleString()}, n_shingles long, k1 long, k2 long, sketch array<long>"), "sketches")
    facts = saved(sketched.drop("sketch"), "set-facts")
    reps = saved(facts.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    # joined by document too, so that a class of very many copies is spread over tasks
    first_of = reps.select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), "rep")
    leaves = _leaves(sketched.join(first_of, (F.col("doc_id") == F.col("rep")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2"))))
    members, beside = neighbours(leaves, reps.count())
    discard(sketched)

    heads = saved(members.groupBy("region").agg(F.min("rep").alias("head")), "region-heads")
    first = members.join(heads, "region").where("rep <> head").select(*_pairs(F.col("rep"), F.col("head"))).distinct()
    near = beside.select(*_pairs(F.col("rep"), F.col("beside"))).distinct()
    tried = saved(first.withColumn("turn", F.lit(0)).union(near.withColumn("turn", F.lit(1))).groupBy("a", "b").agg(F.min("turn").alias("turn")), "candidates")
    needed = saved(tried.select(F.col("a").alias("rep")).union(tried.select(F.col("b").alias("rep"))).distinct(), "candidate-ids")
    texts = docs.where("text IS NOT NULL").select(F.col("doc_id").alias("rep"), "text")
    texts = saved(sifted(texts, "rep", needed).join(needed, "rep", "left_semi").distinct(), "candidate-texts")

    links = saved(confirm(tried.where("turn = 0").select("a", "b"), texts), "confirmed")
    groups = saved(components(links), "groups")
    links = links.union(saved(confirm(_apart(tried.where("turn = 1").select("a", "b"), groups), texts), "confirmed"))
    groups = saved(components(links), "groups")
    last = saved(confirm(_open_pairs(members, groups, texts, tried.select("a", "b")), texts), "confirmed")
    groups = saved(components(links.union(last)), "groups")
    discard(texts)

    classes = reps.select("k1", "k2", "rep").join(groups, reps["rep"] == groups["id"], "left").select(
        F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.coalesce("component", "rep").alias("component"))
    linkable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    joined = facts.join(classes, linkable & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2")), "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


@carrying
def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, with all its columns; rows of an id that is kept stay."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
