"""Repair of the role structure of conversations at least cost, by a Viterbi search whose chunks run in parallel.

A repaired conversation's role initials are `(s?(ua)+)?`: four states (nothing yet, after s, after u, after a). Rows become
one byte each, conversations are cut into chunks of at most CHUNK rows, and every chunk computes its backward costs from a
speculative vector, the one that holds at a conversation's end. Fix-up passes hand each chunk the vector that its
successor's start really has and rerun it until old and new vectors differ by a constant only; what lies before is then right
already. When no chunk changes, the constants add up to the cost. Exit states of chunks compose by doubling, so every chunk
knows the state it begins in and traces its edits by the backward costs, least letter first.

Order within a conversation: turn (nulls first), role, MD5 of the text; rows equal in all of these are the same and are counted,
not compared. Nulls in role, text, conv_id or turn count as one space where text is made of them; rows with a null conv_id
belong to one conversation. An empty table gives an empty result. Texts of any length are hashed as they stream by; only a
conversation's SHA-256 goes through one task, which holds one letter for each of its edits (the result holds them too).
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyveil.llm.common import saved

CHUNK = 4096  # rows of a chunk
CELLS = 1 << 20  # rows of chunks that advance together in a task, padding included
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
DELETE, REROLE, INSERT = 2, 1, 5
TRUNCATED_COST = 5
_FAR = 1 << 40  # no edit of a row costs as much
EXPECTED = np.array([2, 2, 3, 2])  # state after the role that a state expects: u, u, a, u
_KEEP = np.full((4, 4), -1)  # [role initial: s, u, a, other; state] -> state after keeping the row, -1 where it is not allowed
_KEEP[0, 0], _KEEP[1, [0, 1, 3]], _KEEP[2, 2] = 1, 2, 3
TERMINAL = np.array([0, 10, 5, 0], np.int64)  # cheapest inserts that end a conversation in each state
_SPACE = r"[^\x20\x09-\x0D]"


def _costs() -> np.ndarray:
    """[symbol, state, next state] -> cost of one row, inserts before it included; symbol = 4 * role initial + fault."""
    out = np.full((16, 4, 4), _FAR, np.int64)
    for symbol in range(16):
        role, fault = divmod(symbol, 4)
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state in range(4):
            out[symbol, state, state] = DELETE
            if fault < BLANK:
                out[symbol, state, EXPECTED[state]] = min(out[symbol, state, EXPECTED[state]], REROLE + extra)
                if _KEEP[role, state] >= 0:
                    out[symbol, state, _KEEP[role, state]] = min(out[symbol, state, _KEEP[role, state]], extra)
        for _ in range(3):
            out[symbol] = np.minimum(out[symbol], INSERT + out[symbol][EXPECTED])
    return out


COSTS = _costs()


class Lanes:
    """Symbols of several chunks side by side, longest first."""

    def __init__(self, symbols: list[bytes]):
        sizes = np.array([len(s) for s in symbols], np.int64)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.width = int(self.sizes[0]) if len(sizes) else 0
        self.symbols = np.zeros((self.width, len(sizes)), np.uint8)
        for lane, at in enumerate(self.order):
            self.symbols[:sizes[at], lane] = np.frombuffer(symbols[at], np.uint8)

    def live(self, row: int) -> int:
        """Lanes that have this row."""
        return int(np.searchsorted(-self.sizes, -row, side="left"))

    def backward(self, end: np.ndarray, keep: bool = False):
        """Cost vectors at the start of each lane, given those at its end; all rows' vectors if asked for."""
        now = end[self.order].copy()
        held = np.zeros((self.width + 1, len(now), 4), np.int64) if keep else None
        for row in range(self.width - 1, -1, -1):
            n = self.live(row)
            if keep:
                held[row + 1, :n] = now[:n]
            now[:n] = (COSTS[self.symbols[row, :n]] + now[:n, None, :]).min(axis=2)
        if keep:
            held[0] = now
        out = np.empty_like(now)
        out[self.order] = now
        return (out, held) if keep else out

    def fix_up(self, old: np.ndarray, new: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Start vectors for the new end vectors: rerun each lane until old and new differ by a constant, then shift."""
        a, b, out = old[self.order].copy(), new[self.order].copy(), start[self.order].copy()
        open_ = np.ones(len(a), bool)
        for row in range(self.width - 1, -2, -1):
            gap = b - a
            level = open_ & (gap == gap[:, :1]).all(axis=1) & (self.sizes > row)
            out[level] += gap[level, :1]
            open_ &= ~level
            if row < 0 or not open_.any():
                break
            some = np.flatnonzero(open_[:self.live(row)])
            cost = COSTS[self.symbols[row, some]]
            a[some] = (cost + a[some][:, None, :]).min(axis=2)
            b[some] = (cost + b[some][:, None, :]).min(axis=2)
        out[open_] = b[open_]
        back = np.empty_like(out)
        back[self.order] = out
        return back

    def trace(self, held: np.ndarray, state: np.ndarray, letters: bool = False):
        """Follow the least letters of cheapest edits from a state: exit states, and the letters of each lane."""
        now = state[self.order].copy()
        made = np.zeros((self.width, len(now), 3), np.uint8) if letters else None
        for row in range(self.width):
            n = self.live(row)
            lane, symbol = np.arange(n), self.symbols[row, :n]
            role, fault = symbol >> 2, symbol & 3
            free, extra = fault < BLANK, np.where(fault == TRUNCATED, TRUNCATED_COST, 0)
            here, after, at = held[row, :n], held[row + 1, :n], now[:n].copy()
            for slot in range(2):  # two inserts reach every state that inserts reach
                add = (DELETE + after[lane, at] != here[lane, at]) & (INSERT + here[lane, EXPECTED[at]] == here[lane, at])
                at = np.where(add, EXPECTED[at], at)
                if letters:
                    made[row, :n, slot] = np.where(add, ord("I"), 0)
            drop = DELETE + after[lane, at] == here[lane, at]
            kept = _KEEP[role, at]
            keep = ~drop & free & (kept >= 0) & (extra + after[lane, np.maximum(kept, 0)] == here[lane, at])
            if letters:
                made[row, :n, 2] = np.where(drop, ord("D"), np.where(keep, ord("K"), ord("R")))
            now[:n] = np.where(drop, at, np.where(keep, kept, EXPECTED[at]))
        out = np.empty_like(now)
        out[self.order] = now
        if not letters:
            return out
        text: list[bytes] = [b""] * len(now)
        for lane, at in enumerate(self.order):
            text[at] = made[:self.sizes[lane], lane].tobytes().replace(b"\0", b"")
        return out, text


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the stated damage; a repeated row comes twice."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    role, text, code = F.coalesce("role", space), F.coalesce("text", space), F.crc32(key) % 20
    hurt = rows.select("conv_id", "turn", F.when(code == 4, "user").otherwise(role).alias("role"), code.alias("code"),
                       F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.where("code <> 0").select("conv_id", "turn", "role", "text", times.alias("copy")).drop("copy")


def _fact_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, digest) with their number n and a symbol that knows no duplicates yet."""
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(_SPACE), BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    facts = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), fault.alias("fault"), role.alias("initial"))
    return facts.groupBy("conv_id", "turn", "role", "digest", "fault", "initial").agg(F.count("*").alias("n"))


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def sequence_facts(rows: DataFrame) -> DataFrame:
    """The distinct rows with `again`: role and text were seen earlier in the conversation."""
    facts = saved(_fact_rows(rows), "turn-facts")
    first = facts.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("given"), "turn")).alias("first"), F.count("*").alias("times"))
    # only texts that come at several turns need the join; both sides are written tables, so Spark can split a hot key
    many = saved(first.where("times > 1").select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "first"), "turn-firsts")
    joined = facts.join(many, _same("conv_id", "__c") & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")), "left")
    return joined.select("conv_id", "turn", "role", "digest", "fault", "initial", "n",
                         (F.col("first").isNotNull() & ~_same("turn", "first.turn")).alias("again"))


_CHUNK_KIND = "{0}, part int, piece int, symbols binary, blank long, duplicate long, truncated long, illegal long"


def _chunk_task(batches, chunk: int = CHUNK):
    """Chunks of the sorted rows of this task: runs of at most `chunk` symbols of one conversation."""
    part, pieces = TaskContext.get().partitionId(), itertools.count()
    tail, held = None, np.zeros(0, np.uint8)
    kind = None

    def packed(conversations, runs):
        out = {k: [] for k in ("symbols", "blank", "duplicate", "truncated", "illegal")}
        for run in runs:
            fault, role = run & 3, run >> 2
            legal = (role[:-1], role[1:])
            fits = ((legal[0] == 0) & (legal[1] == 1)) | ((legal[0] == 1) & (legal[1] == 2)) | ((legal[0] == 2) & (legal[1] == 1))
            out["symbols"].append(run.tobytes())
            for name, value in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED)):
                out[name].append(int((fault == value).sum()))
            out["illegal"].append(int((~fits).sum()))
        return pa.RecordBatch.from_arrays(
            [pa.array(conversations, kind), pa.array([part] * len(runs), pa.int32()), pa.array([next(pieces) for _ in runs], pa.int32()),
             pa.array(out["symbols"], pa.binary()), *[pa.array(out[k], pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")]],
            names=["conv_id", "part", "piece", "symbols", "blank", "duplicate", "truncated", "illegal"])

    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch.schema.field("conv_id").type
        fault, role = batch.column("fault").to_numpy(), batch.column("initial").to_numpy()
        n, again = batch.column("n").to_numpy(), batch.column("again").to_numpy(zero_copy_only=False)
        head = (4 * role + np.where((fault != BLANK) & again, DUPLICATE, fault)).astype(np.uint8)
        rest = (4 * role + np.where(fault == BLANK, BLANK, DUPLICATE)).astype(np.uint8)
        symbols = np.repeat(rest, n)
        firsts = np.concatenate([[0], np.cumsum(n)])
        symbols[firsts[:-1]] = head
        ids = batch.column("conv_id").to_pylist()
        cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
        whose, runs = [], []
        for a, b in zip(cuts, cuts[1:]):
            some = symbols[firsts[a]:firsts[b]]
            if tail is not None and tail == (ids[a],):
                some = np.concatenate([held, some])
            elif tail is not None:
                whose.append(tail[0])
                runs.append(held)
            while len(some) > chunk:
                whose.append(ids[a])
                runs.append(some[:chunk])
                some = some[chunk:]
            tail, held = (ids[a],), some
        if runs:
            yield packed(whose, runs)
    if tail is not None:
        yield packed([tail[0]], [held])


def _chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Numbered chunks of all conversations: conv_id, place (0, 1, ...), last, symbols and counts of faults."""
    spark, facts = rows.sparkSession, saved(sequence_facts(rows), "turn-symbols")
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), facts.count() // 500_000)
    ranged = facts.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("conv_id", "fault", "initial", "n", "again")
    kind = f"conv_id {rows.select('conv_id').schema[0].dataType.simpleString()}"
    cut = saved(ranged.mapInArrow(partial(_chunk_task, chunk=chunk), _CHUNK_KIND.format(kind)), "turn-chunks")
    # a conversation has one row here for each task that met it
    held = cut.groupBy("conv_id", "part").agg(F.count("*").alias("held"), F.min("piece").alias("low"))
    line = W.partitionBy("conv_id").orderBy("part")
    held = held.select(F.col("conv_id").alias("__c"), F.col("part").alias("__p"), "low", F.coalesce(F.sum("held").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
                       F.sum("held").over(W.partitionBy("conv_id")).alias("chunks"))
    joined = cut.join(held, _same("conv_id", "__c") & (F.col("part") == F.col("__p")))
    return joined.select("conv_id", (F.col("before") + F.col("piece") - F.col("low")).alias("place"), "chunks", "symbols", "blank", "duplicate", "truncated", "illegal")


def _by_lanes(batches, work):
    for batch in batches:
        sizes, at = pc.binary_length(batch.column("symbols")).to_pylist(), 0
        while at < len(sizes):
            stop, widest = at, 0
            while stop < len(sizes) and (stop == at or (stop - at + 1) * max(widest, sizes[stop]) <= CELLS):
                stop, widest = stop + 1, max(widest, sizes[stop])
            some, at = batch.slice(at, stop - at), stop
            yield work(some, Lanes(some.column("symbols").to_pylist()))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, 4)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * 4), pa.array(values.ravel().astype(np.int64)))


def _with(batch: pa.RecordBatch, **columns) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *columns.values()], names=[*names, *columns])


def _speculate_task(batches):
    def work(batch, lanes):
        end = np.tile(TERMINAL, (batch.num_rows, 1))
        return _with(batch, end=_lists(end), start=_lists(lanes.backward(end)))

    return _by_lanes(batches, work)


def _fix_task(batches):
    def work(batch, lanes):
        old, new = _vectors(batch.column("end")), _vectors(batch.column("wanted"))
        return _with(batch, end=_lists(new), start=_lists(lanes.fix_up(old, new, _vectors(batch.column("start")))))

    return _by_lanes(batches, work)


def _exit_task(batches):
    def work(batch, lanes):
        _, held = lanes.backward(_vectors(batch.column("end")), keep=True)
        exits = np.stack([lanes.trace(held, np.full(batch.num_rows, s)) for s in range(4)], axis=1)
        return _with(batch, exits=_lists(exits))

    return _by_lanes(batches, work)


def _letter_task(batches):
    def work(batch, lanes):
        end = _vectors(batch.column("end"))
        start, held = lanes.backward(end, keep=True)
        entry = batch.column("entry").to_numpy()
        state, text = lanes.trace(held, entry, letters=True)
        last = batch.column("place").to_numpy() + 1 == batch.column("chunks").to_numpy()
        text = [t + b"I" * int(TERMINAL[s] // INSERT) if e else t for t, s, e in zip(text, state, last)]
        spent = start[np.arange(len(entry)), entry] - np.where(last, 0, end[np.arange(len(entry)), state])
        return _with(batch, letters=pa.array(text, pa.binary()), spent=pa.array(spent))

    return _by_lanes(batches, work)


def _extended(frame: DataFrame, **columns: str) -> str:
    return ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in frame.schema if f.name not in columns], *[f"{n} {k}" for n, k in columns.items()]])


def _level(vector: str):
    """A cost vector less its least cost."""
    return F.expr(f"transform({vector}, x -> x - array_min({vector}))")


def converge(first: DataFrame) -> DataFrame:
    """Fix-up passes over conversations of several chunks until every chunk ends with its successor's start."""
    while True:
        after = first.select(F.col("conv_id").alias("__c"), (F.col("place") - 1).alias("__p"), _level("start").alias("next"))
        beside = first.join(after, _same("conv_id", "__c") & (F.col("place") == F.col("__p")), "left")
        told = saved(beside.withColumn("wanted", F.coalesce("next", "end")).drop("__c", "__p", "next"), "turn-passes")
        if told.where(F.col("wanted") != F.col("end")).isEmpty():
            return told.drop("wanted")
        first = saved(told.mapInArrow(_fix_task, _extended(told, end="array<long>", start="array<long>")).drop("wanted"), "turn-passes")


def _entries(exits: DataFrame) -> DataFrame:
    """The state in which each chunk begins, from exit states composed over 1, 2, 4, ... chunks."""
    maps, span = exits.select("conv_id", "place", "exits"), 1
    longest = exits.agg(F.max("chunks")).first()[0] or 0
    while span < longest:  # maps: exits of this chunk by the state in which the chunk `span` places earlier began
        before = maps.select(F.col("conv_id").alias("__c"), (F.col("place") + span).alias("__p"), F.col("exits").alias("earlier"))
        joined = maps.join(before, _same("conv_id", "__c") & (F.col("place") == F.col("__p")), "left")
        whole = F.when(F.col("earlier").isNull(), F.col("exits")).otherwise(F.expr("transform(earlier, x -> exits[int(x)])"))
        maps, span = saved(joined.select("conv_id", "place", whole.alias("exits")), "turn-exits"), span * 2
    after = maps.select(F.col("conv_id").alias("__c"), (F.col("place") + 1).alias("__p"), F.expr("int(exits[0])").alias("entry"))
    return exits.drop("exits").join(after, _same("conv_id", "__c") & (F.col("place") == F.col("__p")), "left").drop("__c", "__p").withColumn("entry", F.coalesce("entry", F.lit(0)))


def edits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edit letters of each chunk of the given rows: conv_id, place, letters, spent and counts of faults."""
    chunks = _chunks(rows, chunk)
    begun = saved(chunks.mapInArrow(_speculate_task, _extended(chunks, end="array<long>", start="array<long>")), "turn-costs")
    long = converge(begun.where("chunks > 1"))
    exits = saved(long.mapInArrow(_exit_task, _extended(long, exits="array<long>")), "turn-exits")
    ready = begun.where("chunks = 1").withColumn("entry", F.lit(0)).unionByName(_entries(exits))
    # neighbours of chunks: the pair of roles where two chunks meet
    lettered = saved(ready.mapInArrow(_letter_task, _extended(ready, letters="binary", spent="long")), "turn-letters")
    edge = lettered.where("chunks > 1").select(F.col("conv_id").alias("__c"), (F.col("place") + 1).alias("__p"), F.substring("symbols", -1, 1).alias("before"))
    joined = lettered.join(edge, _same("conv_id", "__c") & (F.col("place") == F.col("__p")), "left")

    def role(symbol):
        return F.floor(F.conv(F.hex(symbol), 16, 10).cast("int") / 4)

    pair = role(F.col("before")) * 4 + role(F.substring("symbols", 1, 1))
    meets = F.when(F.col("before").isNull() | pair.isin(1, 6, 9), 0).otherwise(1)
    return joined.select("conv_id", "place", "letters", "spent", "blank", "duplicate", "truncated", (F.col("illegal") + meets).alias("illegal"))


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "spent")


class _Repair:
    """One conversation, row by row: its edits, its turns, and the hash of what is kept."""

    def __init__(self, conversation):
        self.conversation, self.letters, self.at, self.state = conversation, bytearray(), 0, 0
        self.sha, self.any, self.counts = hashlib.sha256(), False, dict.fromkeys(_COUNTS, 0)
        self.low = self.high = self.turns = None

    def write(self, role: str, text: str) -> None:
        self.sha.update(f"{'\n' if self.any else ''}{role}:{text}".encode())
        self.any = True

    def insert(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == 73:
            self.at, self.state = self.at + 1, int(EXPECTED[self.state])
            self.write("user" if self.state == 2 else "assistant", "")

    def row(self, turn, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns = 1 if self.turns is None else self.turns + (turn != self.high)
            self.high = turn
        self.insert()
        letter, self.at = self.letters[self.at], self.at + 1
        if letter == 75:
            self.state = int(_KEEP["sua".index(role[0]), self.state])
            self.write(role, text)
        elif letter == 82:
            self.state = int(EXPECTED[self.state])
            self.write("user" if self.state == 2 else "assistant", text)

    def result(self) -> tuple:
        self.insert()
        gaps = 0 if self.turns is None else self.high - self.low + 1 - self.turns
        c = self.counts
        return (self.conversation, gaps, c["blank"], c["duplicate"], c["truncated"], c["illegal"], c["spent"], self.letters.decode(), self.sha.hexdigest())


def _repair_task(batches):
    now, made, kind = None, [], None

    def out():
        columns = list(zip(*made))
        made.clear()
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", *[p.split()[0] for p in RESULT.split(", ")]])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        values = batch.to_pydict()
        for conversation, row, letters, turn, role, text, *counts in zip(*(values[c] for c in ("conv_id", "row", "letters", "turn", "role", "text", *_COUNTS))):
            if now is None or now.conversation != conversation:
                if now is not None:
                    made.append(now.result())
                now = _Repair(conversation)
            if row:
                now.row(turn, role, text)
            else:
                now.letters += letters
                for name, value in zip(_COUNTS, counts):
                    now.counts[name] += value
        if made:
            yield out()
    if now is not None:
        made.append(now.result())
        yield out()


def repair(original: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every conv_id of `original` with the faults of `rows`, the cheapest edits, and the hash of the repaired conversation."""
    kind = original.select("conv_id").schema[0].dataType.simpleString()
    turn = rows.select("turn").schema[0].dataType.simpleString()
    none = original.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("place"), F.lit(b"").alias("letters"), *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    heads = none.unionByName(edits(rows, chunk).select("conv_id", F.col("place").cast("long"), "letters", *_COUNTS)).select(
        "conv_id", F.lit(False).alias("row"), "place", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), "letters", *_COUNTS)
    texts = rows.select("conv_id", F.lit(True).alias("row"), F.lit(0).cast("long").alias("place"), "turn", "role", "text", F.lit(None).cast("binary").alias("letters"),
                        *[F.lit(None).cast("long").alias(c) for c in _COUNTS])
    placed = heads.unionByName(texts).repartition("conv_id").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), "row", "place", F.col("turn").asc_nulls_first(), "role", F.unhex(F.md5("text")))
    return placed.select("conv_id", "row", "letters", "turn", "role", "text", *_COUNTS).mapInArrow(_repair_task, f"conv_id {kind}, {RESULT}")
