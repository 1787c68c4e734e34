"""Personal data: fixed base patterns, and further spans by gradient-boosted candidates.

Loose generators propose overlapping candidates of each kind. Boosted trees score a candidate from its format and the words
around it. Positive examples are base spans in their place with their format altered (VARIANTS); negative ones are candidates
beside all base spans that no word of their kind tells of. So what is learned is the look of a span that the base patterns
miss. Trees are fitted on a bounded sample of documents, one model for each half of the documents, and each document is scored
by the trees of the other half. Each kind's threshold comes from counts of scores over all documents: the lowest one at which
altered spans are PRECISION of what passes, were both labels equally frequent; so it does not depend on how rare a kind is.
A kind without base spans takes the threshold of all kinds together. Candidates over the threshold join the base spans, best
first, where they overlap nothing taken. Base spans always stay.

Offsets are code points, ends exclusive. Nulls: a null text has no spans; a null doc_id stays. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.blocks import text_blocks, utf8
from tallyveil.llm.boosting import fit

KINDS = ("email", "ip", "card", "phone")
# Fixed base patterns.
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BASE = {k: re.compile(p) for k, p in BASE.items()}
_LOOSE = {
    "email": re.compile(r"[^\s@<>()\[\]]{1,64}(?:@|\s?[\[(]at[\])]\s?)[^\s@<>()\[\],;]+(?:\s?[\[(]dot[\])]\s?[^\s@<>()\[\],;]+)*"),
    "ip": re.compile(r"[0-9]{1,4}(?:[.:][0-9]{1,4}){3,5}"),
    "card": re.compile(r"[0-9](?:[\x20.-]?[0-9]){11,21}"),
    "phone": re.compile(r"\+?[(0-9][\x20()./0-9-]{6,20}[0-9]"),
}
SAMPLE_DOCS = 40_000  # bound of the documents that the trees are fitted on
SAMPLE_CANDIDATES = 40_000  # bound of the examples that the trees are fitted on, in expectation
PRECISION = 0.95
BINS = 1000  # of scores, for thresholds
# Words that tell a kind, in several languages: fixed values.
HINTS = {
    "email": ("mail", "contact", "write", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "account"),
    "phone": ("tel", "phone", "call", "mobile", "fax", "anruf"),
}
# Formats in which a base span is written by people who evade its pattern, or have not heard of it.
VARIANTS = {
    "email": (lambda t: t.replace("@", " [at] ").replace(".", " [dot] "), lambda t: t.replace("@", "(at)"), lambda t: t.replace("@", " (at) ").replace(".", "(dot)")),
    "ip": (lambda t: t.replace(".", ":"),),
    "card": (lambda t: re.sub(r"[\x20-]", "", t), lambda t: ".".join(re.findall("[0-9]{1,4}", re.sub("[^0-9]", "", t))), lambda t: re.sub(r"[\x20]", "-", t)),
    "phone": (lambda t: t[1:], lambda t: re.sub(r"^\+[0-9]{1,3}[\x20.-]+", "", t), lambda t: re.sub(r"[\x20.-]+", "/", t[1:]), lambda t: "00" + t[1:]),
}
FEATURES = 18
_MARKED = np.isin(np.arange(256), [ord(c) for c in "0123456789@["])
_MARKED[ord("(")] = True


def luhn(digits: str) -> bool:
    total = 0
    for place, d in enumerate(reversed(digits)):
        v = int(d) * (1 + place % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))
    digits = re.sub(r"[^0-9]", "", text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 10 <= len(digits) <= 15


def _matches(kind: str, text: str):
    if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
        return ()
    if kind != "email":
        return _BASE[kind].finditer(text)
    return _emails(text)


def _emails(text: str):
    """Leftmost matches as a scan would find them, looked for only around each @."""
    pattern, done, at = _BASE["email"], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        found = pattern.match(text, begin) if begin < at else None
        if found:
            yield found
            done = found.end()
        else:
            done = max(done, begin)
        at = text.find("@", max(at + 1, done))


_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted; matches of a kind do not overlap, failing ones are dropped."""
    return sorted((m.start(), k, m.end()) for k, kind in enumerate(KINDS) for m in _matches(kind, text) if _valid(kind, m.group()))


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all loose matches; kinds may overlap."""
    found = []
    for k, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text and "(at)" not in text and "[at]" not in text:
            continue
        found += [(m.start(), k, m.end()) for m in _LOOSE[kind].finditer(text)]
    return found


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format of a candidate and of what stands around it."""
    span, before, after = text[start:end], text[max(0, start - 40):start].lower(), text[end:end + 1]
    digits = sum(c.isdigit() for c in span)
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    last = before[-1:]
    return [kind, len(span), digits, digits / max(1, len(span)), len(groups), max(sizes), min(sizes), span.count("."), span.count("-") + span.count("/"),
            span.count(" "), span.count("(") + span.count("["), float(span.startswith("+")), span.count("@"), float("." in span.rpartition("@")[2]),
            float(last.isalnum()) + 2 * (last == "" or last.isspace()), float(after.isalnum()) + 2 * (after == "" or after.isspace()),
            float(any(h in before for h in HINTS[KINDS[kind]])), float(any(h in before for k, hints in HINTS.items() if k != KINDS[kind] for h in hints))]


def _texts(block: pa.RecordBatch):
    """Row number and text of the rows that can hold a span."""
    data, offsets = utf8(block.column("text"))
    marked = np.concatenate([[0], np.cumsum(_MARKED[data])])
    for r in np.flatnonzero(marked[offsets[1:]] > marked[offsets[:-1]]).tolist():
        yield r, data[offsets[r]:offsets[r + 1]].tobytes().decode()


def _beside(c: tuple[int, int, int], known) -> bool:
    return not any(s < c[2] and c[0] < e for s, _, e in known)


def _told(text: str, c: tuple[int, int, int], known) -> bool:
    """Whether a word of its kind stands before a candidate, with no base span between."""
    begin = max([c[0] - 40, 0, *[e for _, _, e in known if e <= c[0]]])
    before = text[begin:c[0]].lower()
    return any(h in before for h in HINTS[KINDS[c[1]]])


def examples(text: str):
    """(kind, start, label, features) of altered base spans and of untold candidates beside base spans."""
    known = base_spans(text)
    for s, k, e in known:
        for change in VARIANTS[KINDS[k]]:
            span = change(text[s:e])
            if span == text[s:e]:
                continue
            near = text[max(0, s - 40):s]
            yield k, s, True, features(near + span + text[e:e + 1], len(near), k, len(near) + len(span))
    for c in candidates(text):
        if _beside(c, known) and not _told(text, c, known):
            yield c[1], c[0], False, features(text, *c)


def _feature_task(batches):
    for block in text_blocks(batches):
        x, kind, start, label, half, at = [], [], [], [], [], []
        halves, ids = block.column("half").to_pylist(), block.column("at").to_pylist()
        for r, text in _texts(block):
            for k, s, y, row in examples(text):
                x += row
                kind.append(k)
                start.append(s)
                label.append(y)
                half.append(halves[r])
                at.append(ids[r])
        if label:
            offsets = pa.array(np.arange(len(label) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(start, pa.int32()), pa.array(label), pa.array(half, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(x, pa.float64()))],
                                             names=["at", "kind", "start", "label", "half", "x"])


def _bins(score: np.ndarray) -> np.ndarray:
    return np.minimum((score * BINS).astype(np.int64), BINS - 1)


def _count_task(models):
    """Numbers of examples by kind, label and bin of the score."""
    def run(batches):
        for block in text_blocks(batches):
            counts = np.zeros((len(KINDS), 2, BINS), np.int64)
            halves = block.column("half").to_pylist()
            x, kind, label, half = [], [], [], []
            for r, text in _texts(block):
                for k, _, y, row in examples(text):
                    x.append(row)
                    kind.append(k)
                    label.append(int(y))
                    half.append(halves[r])
            if x:
                np.add.at(counts, (kind, label, _bins(_score(models, np.array(x), np.array(half)))), 1)
                at = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([*[pa.array(a.astype(np.int32)) for a in at], pa.array(counts[at])], names=["kind", "label", "bin", "n"])

    return run


def _score(models, x: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Scores by the trees of the other half, as if both labels of the kind were equally frequent among their examples."""
    score = np.zeros(len(x))
    for h in (0, 1):
        if (half == h).any():
            trees, share = models[1 - h]
            p, q = trees.probability(x[half == h]), share[x[half == h, 0].astype(np.int64)]
            score[half == h] = p * (1 - q) / (p * (1 - q) + (1 - p) * q)
    return score


def _trained(x: np.ndarray, y: np.ndarray):
    """Trees, and the share of positives of each kind they saw; None without both labels."""
    if not 0 < y.sum() < len(y):
        return None
    kind = x[:, 0].astype(np.int64)
    return fit(x, y), (np.bincount(kind, y, len(KINDS)) + 1) / (np.bincount(kind, minlength=len(KINDS)) + 2)


def threshold(counts: np.ndarray) -> int | None:
    """Lowest bin, of the upper half, from which on positives are PRECISION of the passing, both labels given equal mass.

    None without positives.
    """
    if not counts[1].sum():
        return None
    false, true = [np.cumsum(c[::-1])[::-1] / max(1, c.sum()) for c in counts]
    good = (true > 0) & (true >= PRECISION * (true + false)) & (np.arange(BINS) >= BINS // 2)
    return int(np.flatnonzero(good)[0]) if good.any() else BINS


def _halves(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"half": F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int"), "at": F.xxhash64("doc_id")})


def fit_model(docs: DataFrame, sample_docs: int = SAMPLE_DOCS):
    """(trees and shares of each half, lowest passing bin of each kind), or None where no half has examples of both labels.

    The trees' sample is chosen by hashes of doc_id and place and bounded by `sample_docs` and SAMPLE_CANDIDATES, in
    expectation. Thresholds are counted over all documents.
    """
    every = max(1, -(-docs.count() // sample_docs))
    keyed = _halves(docs.select("doc_id", "text"))
    chosen = keyed.where(F.pmod("at", F.lit(every)) == 0).select("text", "half", "at")
    found = chosen.mapInArrow(_feature_task, "at long, kind int, start int, label boolean, half int, x array<double>")
    share = SAMPLE_CANDIDATES / max(1, found.count())
    if share < 1:
        found = found.where(F.pmod(F.xxhash64("at", "start", "kind"), F.lit(1_000_000)) < int(share * 1_000_000))
    got = found.toArrow()
    if not got.num_rows:
        return None
    x, y = np.array(got["x"].combine_chunks().flatten()).reshape(-1, FEATURES), np.array(got["label"]).astype(float)
    order = np.lexsort([y, *x.T])  # rows arrive in any order
    x, y, half = x[order], y[order], np.array(got["half"])[order]
    models = [_trained(x[half == h], y[half == h]) for h in (0, 1)]
    if models == [None, None]:
        return None
    models = [m or models[1 - h] for h, m in enumerate(models)]
    summed = keyed.select("text", "half").mapInArrow(_count_task(models), "kind int, label int, bin int, n long").groupBy("kind", "label", "bin").agg(F.sum("n")).collect()
    counts = np.zeros((len(KINDS), 2, BINS), np.int64)
    for k, label, place, n in summed:
        counts[k, label, place] = n
    lowest = [threshold(c) for c in counts]
    together = threshold(counts.sum(axis=0))
    return models, [(BINS if together is None else together) if t is None else t for t in lowest]


def _shown(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _find_task(fitted):
    def run(batches):
        for block in text_blocks(batches):
            n = block.num_rows
            counts, base, spans = np.zeros((n, len(KINDS)), np.int64), [""] * n, [""] * n
            rows, places, texts, halves = [], [], {}, np.array(block.column("half"))
            for r, text in _texts(block):
                known = base_spans(text)
                for _, k, _ in known:
                    counts[r, k] += 1
                base[r] = spans[r] = _shown(known)
                texts[r] = known
                if fitted is not None:
                    for c in candidates(text):
                        if _beside(c, known):
                            rows.append(features(text, *c))
                            places.append((r, c))
            if rows:
                score = _score(fitted[0], np.array(rows), halves[[r for r, _ in places]])
                place = _bins(score)
                added: dict[int, list] = {}
                for i in np.argsort(-score, kind="stable").tolist():
                    r, c = places[i]
                    taken = added.setdefault(r, [])
                    if place[i] >= fitted[1][c[1]] and _beside(c, taken):
                        taken.append(c)
                for r, more in added.items():
                    if more:
                        spans[r] = _shown(sorted(texts[r] + more))
            digest = [hashlib.sha256(b.encode()).hexdigest() for b in base]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(counts[:, k]) for k in range(len(KINDS))], pa.array(digest), pa.array(spans)],
                                             names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return run


def find(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """doc_id, numbers of base spans, base_sha256 and all spans of each row."""
    model = fit_model(docs, sample_docs)  # a few thousand numbers, shipped with the task
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return _halves(docs.select("doc_id", "text")).mapInArrow(_find_task(model), f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind."""
    out, at = [], 0
    for kind, start, end in (s.split(":") for s in spans.split(",") if s):
        if int(start) >= at:
            out += [text[at:int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join([*out, text[at:]])
