"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections.

A text is cut at \\n into paragraphs, a paragraph into pieces of PIECE code points, and runs of SECTION paragraphs form
sections. Piece, paragraph and section hashes are SHA-256 over the hashes below; the root is the hash over the sections. The
fingerprint is the root in full, then the sections, each with its hash and its pieces' hashes, shortened. Equal roots mean
equal texts; where roots differ, differing sections and pieces locate the edit; the likeness of two fingerprints is the share
of pieces they have in common. All of it is DataFrame expressions on one row: no shuffle.

Nulls: a null text is an empty one, which is one empty paragraph with one empty piece.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.operators.numbering import range_slots

PIECE = 64
SECTION = 8
SHORT = 12  # hex digits of a shortened hash
SLOT_ROWS = 2_000  # rows that one task sorts, until there are MAX_SLOTS ranges
MAX_SLOTS = 4_096


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, "/"), 256)


def fingerprint(text: Column) -> Column:
    """root | section:piece.piece. ... | section:piece. ... as text."""
    paragraphs = F.split(F.coalesce(text, F.lit("")), "\n", -1)

    def pieces(paragraph):
        count = F.greatest(F.lit(1), F.ceil(F.char_length(paragraph) / F.lit(PIECE)).cast("int"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.sha2(F.substring(paragraph, k * PIECE + 1, F.lit(PIECE)), 256))

    def section(k):
        inside = F.transform(F.slice(paragraphs, k * SECTION + 1, SECTION), pieces)
        return F.struct(_hash(F.transform(inside, _hash)).alias("hash"), F.flatten(inside).alias("pieces"))

    count = F.ceil(F.size(paragraphs) / F.lit(SECTION)).cast("int")
    tree = F.transform(F.sequence(F.lit(0), count - 1), section)

    def show(s):
        return F.concat(F.substring(s["hash"], 1, SHORT), F.lit(":"), F.array_join(F.transform(s["pieces"], lambda p: F.substring(p, 1, SHORT)), "."))

    def assembled(t):
        return F.concat(_hash(F.transform(t, lambda s: s["hash"])), F.lit("|"), F.array_join(F.transform(t, show), "|"))

    # the tree is bound once by a one-element transform, so it is not computed for the root and again for the rest
    return F.element_at(F.transform(F.array(tree), assembled), 1)


def root(print_: Column) -> Column:
    return F.substring_index(print_, "|", 1)


def pieces_of(print_: Column) -> Column:
    """The shortened piece hashes of a fingerprint, in text order."""
    parts = F.split(print_, r"\|", -1)
    return F.flatten(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda s: F.split(F.substring_index(s, ":", -1), r"\.", -1)))


def likeness(one: Column, other: Column) -> Column:
    """Dice share of common pieces: 1 for equal fingerprints, 0 where no piece is common."""
    a, b = F.array_distinct(pieces_of(one)), F.array_distinct(pieces_of(other))
    return F.when(one == other, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def edited_sections(one: Column, other: Column) -> Column:
    """Numbers (from 0) of the sections of `one` whose hash `other` lacks at that place: where an edit is."""
    a, b = F.split(one, r"\|", -1), F.split(other, r"\|", -1)
    places = F.sequence(F.lit(1), F.size(a) - 1)
    head = lambda parts, k: F.substring_index(F.try_element_at(parts, k + 1), ":", 1)
    return F.transform(F.filter(places, lambda k: ~F.coalesce(head(a, k) == head(b, k), F.lit(False))), lambda k: k - 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """All columns and `fingerprint`."""
    return docs.withColumn("fingerprint", fingerprint(F.col("text")))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text: each text and the one of the next larger doc_id, the first after the last.

    Ids are dealt into ranges of about SLOT_ROWS rows, so the texts move once and each task sorts a bounded range; the first
    row of a range is also sent to the range before it, as its last row's successor. Null ids come last; equal ids are
    ordered by a hash of the text. Range limits and first ids, at most 4097 of each, pass the driver.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    slots = max(2, min(MAX_SLOTS, base.count() // SLOT_ROWS))
    ranged = range_slots(base, "doc_id", slots).withColumn("__slot", F.coalesce("__slot", F.lit(MAX_SLOTS + 1)))
    firsts = sorted((r["__slot"], r["first"]) for r in ranged.select("__slot", "doc_id").groupBy("__slot").agg(F.min("doc_id").alias("first")).collect())
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    guests = docs.sparkSession.createDataFrame([(firsts[i][1], firsts[i - 1][0]) for i in range(len(firsts))], f"__first {kind}, __before int")
    both = ranged.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("__first")), "left")
    own = F.struct(F.col("__slot").alias("slot"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("__before").alias("slot"), F.lit(1).alias("guest"))
    sent = both.select("doc_id", "text", F.explode(F.when(F.col("__before").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("to"))
    order = W.partitionBy("to.slot").orderBy("to.guest", F.asc_nulls_last("doc_id"), F.xxhash64("text"))
    return sent.withColumn("next_text", F.lead("text").over(order)).where("to.guest = 0").select("doc_id", "text", "next_text")


def against_next(docs: DataFrame) -> DataFrame:
    """Each document beside a half-edited version of itself and beside the next one.

    doc_id, n_chars, edited (its last half replaced by the beginning of the next document), fingerprint, edited_fingerprint,
    next_fingerprint.
    """
    beside = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.expr("int(floor(n_chars / 2))"))
    edited = F.concat(F.expr("substring(text, 1, int(n_chars) - half)"), F.expr("substring(next_text, 1, half)"))
    made = beside.select("doc_id", "n_chars", edited.alias("edited"), fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("next_text")).alias("next_fingerprint"))
    return made.withColumn("edited_fingerprint", fingerprint(F.col("edited")))
