"""Mixing sources to target weights by iterative proportional fitting (raking).

Token counts of source x language x topic cells are raked until their margins meet the targets; documents are then sampled
with the probability of their cell, so that KEEP of all tokens are kept in expectation and have the target margins. A cell
whose probability would pass 1 is held at 1 and the others are raked anew (bounded calibration); where all tokens of a value
are fewer than its target, all are kept and the lack is spread over the other values. So a small cell never sets the rate of
the others.

Values without a target of their own form the class `*`, which gets the share the named targets leave, or its share of the
observed tokens where they leave none (the named targets then share the rest). So the number of cells is bounded by the
targets, not by the data, and the driver fits them. Targets of values that do not occur are spread over those that do. Scarce values
and empty combinations of cells may keep the margins from being met; `margin_gap` then tells the largest relative miss.

Nulls: null source, language or topic belongs to `*`; a null text has no tokens and the weight of its cell. A null doc_id is
sampled like the text "null". Repeated rows are sampled alike, since the draw is a hash of doc_id. Texts of any length count
whole; an empty table gives no rows. `mix` replaces columns of the names it adds; `sample` carries all columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.common import carrying

OTHER = "*"
KEEP = 0.3  # expected share of the tokens that sampling keeps
SWEEPS = 1000  # bound where the margins cannot be met at once
TOLERANCE = 1e-13  # largest change of a cell in a sweep, over the largest cell, that ends the fit
CLOSE = 1e-9  # largest relative miss of margins that count as met
GIVE = 0.1  # a factor is the miss of its margin to the power 1 / GIVE at most, where not all can be met
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0))


def shape_topic(text, n_words):
    """A topic from the shape of a text: symbols, short, lists, long or prose."""
    symbols = F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "#*$%&|<>", "")), F.lit(0))
    breaks = F.coalesce(F.char_length(text) - F.char_length(F.translate(text, "\n", "")), F.lit(0))
    return (F.when(symbols * 10 > n_words, "symbols").when(n_words < 60, "short").when(breaks * 12 > n_words, "lists")
            .when(n_words > 1500, "long").otherwise("prose"))


def class_index(column, targets: dict[str, float]):
    """Position of a value among the named targets; all others and null come last."""
    names = F.array(*[F.lit(t) for t in targets])
    place = F.array_position(names, F.coalesce(column.cast("string"), F.lit(OTHER)))
    return F.when(place > 0, (place - 1).cast("int")).otherwise(F.lit(len(targets)))


def _shares(targets: dict[str, float]) -> list[float]:
    if OTHER in targets or any(v < 0 for v in targets.values()) or sum(targets.values()) > 1 + 1e-9:
        raise ValueError("targets are shares of named values with a sum of at most 1")
    return [*targets.values(), max(0.0, 1 - sum(targets.values()))]


def _with_unnamed(shares: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Shares in which the last class has its observed share, if the named targets leave it none."""
    if shares[-1] > 1e-9 or held[-1] == 0:
        return shares
    own = held[-1] / held.sum()
    return np.append(shares[:-1] * (1 - own), own)


def _supplied(wanted: np.ndarray, supply: np.ndarray, total: float) -> np.ndarray:
    """Targets in the proportions of `wanted` with the sum `total`, none above its supply; what some lack is spread over the others."""
    held = np.zeros(len(wanted))
    free = (wanted > 0) & (supply > 0)
    while free.any():
        scaled = wanted * ((total - held.sum()) / wanted[free].sum())
        over = free & (scaled >= supply)
        if not over.any():
            return np.where(free, scaled, held)
        held, free = np.where(over, supply, held), free & ~over
    return held


def _factors(base: np.ndarray, ratio: np.ndarray, wanted: np.ndarray, give: float) -> np.ndarray:
    """For each row of `base` the factor f with sum(base * min(1, f * ratio)) = wanted / f ** give, by bisection of its logarithm."""
    low, high = np.full(len(base), -80.0), np.full(len(base), 80.0)
    for _ in range(64):
        middle = (low + high) / 2
        f = np.exp(middle)
        over = (base * np.minimum(1.0, f[:, None] * ratio)).sum(axis=1) * f**give >= wanted
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    return np.where(wanted > 0, np.exp(high), 0.0)


def _fit(base: np.ndarray, wanted: list[np.ndarray], bounded: bool, sweeps: int, give: float = 0.0) -> np.ndarray:
    """Multiple of each cell, a product of three factors (at most 1 if `bounded`), that has the wanted margins."""
    factors, last = [np.ones(n) for n in base.shape], None
    for _ in range(sweeps):
        for d in range(3):
            a, b = [e for e in range(3) if e != d]
            own, ratio = np.moveaxis(base, d, 0).reshape(base.shape[d], -1), np.outer(factors[a], factors[b]).ravel()
            if bounded:
                factors[d] = _factors(own, ratio, wanted[d], give)
            else:
                factors[d] = np.divide(wanted[d], own @ ratio, out=np.zeros(len(own)), where=own @ ratio > 0)
        multiple = np.where(base > 0, np.einsum("i,j,k->ijk", *factors), 0.0)
        multiple = np.minimum(multiple, 1.0) if bounded else multiple
        if last is not None and np.abs(multiple - last).max() <= TOLERANCE * multiple.max():
            break
        last = multiple
    return multiple


def _margins(cube: np.ndarray) -> list[np.ndarray]:
    return [cube.sum(axis=tuple(e for e in range(3) if e != d)) for d in range(3)]


def _miss(cube: np.ndarray, wanted: list[np.ndarray]) -> float:
    return max((float((np.abs(m - w)[w > 0] / w[w > 0]).max()) for m, w in zip(_margins(cube), wanted) if (w > 0).any()), default=0.0)


def raked(base: np.ndarray, shares: list[np.ndarray], keep: float = KEEP, sweeps: int = SWEEPS):
    """(weight, probability, largest relative miss of a target) of a cube of token counts.

    Where the cells that occur cannot have all margins at once, factors grow by a bounded power of the miss instead of without
    end, so that no cell starves another, and are scaled to the kept share.
    """
    total, held = base.sum(), _margins(base)
    shares = [_with_unnamed(s, h) for s, h in zip(shares, held)]
    wanted = [np.where(h > 0, s, 0.0) for h, s in zip(held, shares)]
    wanted = [w * (total / w.sum()) if w.sum() > 0 else w for w in wanted]
    weight, aims = _fit(base, wanted, False, sweeps), [_supplied(w, h, keep * total) for w, h in zip(wanted, held)]
    probability = _fit(base, aims, True, sweeps)
    if _miss(base * probability, aims) > CLOSE:
        soft = _fit(base, aims, True, sweeps, GIVE)
        scale = _factors(base.reshape(1, -1), soft.ravel(), np.array([min(keep * total, base[soft > 0].sum())]), 0.0)
        probability = np.minimum(1.0, soft * scale[0])
    return weight, probability, _miss(base * probability, [keep * w for w in wanted])


def rake(cells: DataFrame, targets: list[dict[str, float]], keep: float = KEEP, sweeps: int = SWEEPS) -> DataFrame:
    """cell, weight (raked over observed tokens), probability, margin_gap for each cell that has tokens.

    `cells` has c0, c1, c2 (class indexes) and tokens, at most one row for each combination; they are few enough for the
    driver, which fits them here and hands the result out as literals.
    """
    base, shares = np.zeros([len(t) + 1 for t in targets]), [np.array(_shares(t)) for t in targets]
    for c0, c1, c2, tokens in cells.select("c0", "c1", "c2", "tokens").where("tokens > 0").collect():
        base[c0, c1, c2] = tokens
    weight, probability, gap = raked(base, shares, keep, sweeps)
    rows = [(int(i), weight.flat[i], probability.flat[i]) for i in np.flatnonzero(base)]
    values = ", ".join(f"({i}, {float(w)!r}D, {float(p)!r}D, {gap!r}D)" for i, w, p in [*rows, (-1, 0.0, 0.0)])
    return cells.sparkSession.sql(f"SELECT * FROM VALUES {values} AS raked(cell, weight, probability, margin_gap) WHERE cell >= 0")


def draw(doc_id, seed: int):
    """A number in [0, 1) from a hash of doc_id."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, source: dict[str, float], lang: dict[str, float], topic: dict[str, float] | None = None, topic_of=shape_topic, seed: int = 1, keep: float = KEEP) -> DataFrame:
    """Add __topic, __tokens, __weight, __probability, __gap and __sampled to the documents.

    Cells without tokens (only empty texts) have weight 0 and are not sampled. The table of cells is bounded by the targets,
    so its broadcast is bounded too.
    """
    targets = [source, lang, topic or {}]
    counted = docs.withColumn("__tokens", word_count(F.col("text")))
    counted = counted.withColumn("__topic", topic_of(F.col("text"), F.col("__tokens")))
    n1, n2 = len(targets[1]) + 1, len(targets[2]) + 1
    classes = [class_index(F.col(c), t) for c, t in zip(("source", "lang", "__topic"), targets)]
    cells = counted.groupBy(*[c.alias(f"c{d}") for d, c in enumerate(classes)]).agg(F.sum("__tokens").alias("tokens"))
    fitted = rake(cells, targets, keep).select(F.col("cell").alias("__cell"), F.col("weight").alias("__weight"), F.col("probability").alias("__probability"), F.col("margin_gap").alias("__gap"))
    placed = counted.withColumn("__cell", classes[0] * (n1 * n2) + classes[1] * n2 + classes[2])
    joined = placed.join(F.broadcast(fitted), "__cell", "left").drop("__cell")
    known = joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("__weight", "__probability", "__gap")})
    return known.withColumn("__sampled", draw(F.col("doc_id"), seed) < F.col("__probability"))


@carrying
def sample(docs: DataFrame, source: dict[str, float], lang: dict[str, float], topic: dict[str, float] | None = None, topic_of=shape_topic, seed: int = 1, keep: float = KEEP) -> DataFrame:
    """The sampled documents, with all their columns."""
    return mix(docs, source, lang, topic, topic_of, seed, keep).where("__sampled").select(*[F.col(f"`{c}`") for c in docs.columns])
