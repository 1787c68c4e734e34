"""Main text of web pages: boosted trees over features of DOM nodes, then one consistent choice of nodes for each page.

A page is parsed into block elements and the texts directly inside them. Trees give every node the log odds that it holds main
text, from its tag, attribute tokens, depth, place, subtree density and siblings. Keep or drop is then decided top down by
the best sum of log odds in which a dropped element drops all below it and a kept one has kept ancestors, so ancestor and
descendant never contradict each other. The trees are fitted on a bounded sample (SAMPLE pages by hash): on these pages' own
texts set into made pages whose parts are known (`html_training`).

Character references are decoded, white space inside a block is one space, blocks are joined by a line break, in page order.
Nulls: null or empty html gives an empty text; null page_id and url stay. Repeated rows get equal results. Ties in a node's
odds drop it. An empty table gives an empty result. Pages of any length are read whole; elements nested deeper than DEEPEST
count as part of the one at that depth. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html as references
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyveil.llm.blocks import text_blocks
from tallyveil.llm.boosting import Trees, fit

SAMPLE = 300  # pages whose texts fill the training pages
TREES, DEPTH = 50, 4
DEEPEST = 200

# Element names of HTML, by what they mean for the text.
BLOCKS = set("""html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form
 h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption""".split())
RAW = {"script", "style"}  # everything up to the end tag is no markup; without one, up to the end of the page
SKIPPED = set("title textarea noscript iframe template svg math object select button datalist canvas audio video".split())
ENDS_PARAGRAPH = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "figcaption", "summary", "dd", "dt", "li"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
# Tag groups, each a feature of its own.
GROUPS = {"nav": "nav menu", "header": "header", "footer": "footer", "aside": "aside", "form": "form fieldset legend dialog", "article": "article main",
          "section": "section", "div": "div center", "p": "p", "h1": "h1 hgroup", "h2": "h2 h3", "h4": "h4 h5 h6", "list": "ul ol dl dir", "item": "li dt dd",
          "cell": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre", "figure": "figure figcaption", "page": "html body", "address": "address"}
# Words in class, id and role attributes that tell of main text or of what surrounds it.
MAIN_TOKENS = set("article content post entry story main body text hentry articlebody prose read blog page topic single news".split())
OTHER_TOKENS = {
    "menu": set("nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pagination pager tabs skip links toc sitemap".split()),
    "frame": set("header masthead banner footer foot copyright colophon legal contentinfo credits logo brand".split()),
    "side": set("sidebar side aside rail widget related recommended recommendations teaser more popular trending tags complementary archive".split()),
    "notice": set("cookie cookies consent notice alert gdpr modal popup overlay warning message dialog privacy paywall".split()),
    "advert": set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adslot affiliate".split()),
    "form": set("form newsletter subscribe subscription signup login search searchbox register contact poll share sharing social follow".split()),
    "comment": set("comment comments commentlist respond reply replies disqus discussion feedback reviews guestbook responses".split()),
}
KINDS = list(OTHER_TOKENS)
PUNCTUATION = re.compile(r"[.,;:!?…。，]")
NOTICE_SIGN = re.compile(r"©|\(c\)|all rights reserved", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_MARKS = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_SPLIT = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass
class Page:
    """Nodes in document order: elements, and texts as leaves. `until` is the number after a node's last descendant."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["html"])
    depth: list[int] = field(default_factory=lambda: [0])
    until: list[int] = field(default_factory=lambda: [0])
    marks: list[str] = field(default_factory=lambda: [""])
    text: list[str | None] = field(default_factory=lambda: [None])
    linked: list[int] = field(default_factory=lambda: [0])
    tags: list[int] = field(default_factory=lambda: [1])  # tags met inside the node itself, inline ones included


def parse(source: str) -> Page:
    page = Page()
    stack, pieces, where = [0], [], {"linked": 0, "in_link": False}

    def flush() -> None:
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            add(None, "", text)
        where["linked"] = 0

    def add(tag: str | None, marks: str, text: str | None) -> int:
        page.parent.append(stack[-1])
        page.tag.append(tag or page.tag[stack[-1]])
        page.depth.append(len(stack))
        page.until.append(len(page.until) + 1)
        page.marks.append(marks)
        page.text.append(text)
        page.linked.append(min(where["linked"], len(text)) if text else 0)
        page.tags.append(1 if tag else 0)
        return len(page.parent) - 1

    def close() -> None:
        page.until[stack.pop()] = len(page.parent)

    def words(chunk: str) -> None:
        if chunk:
            decoded = references.unescape(chunk)
            pieces.append(decoded)
            if where["in_link"]:
                where["linked"] += len(decoded.strip())

    at, end = 0, len(source)
    while at < end:
        found = _TOKEN.search(source, at)
        if found is None:
            words(source[at:])
            break
        words(source[at:found.start()])
        at = found.end()
        if found[1] is not None:
            name = found[1].lower()
            if name in BLOCKS:
                flush()
                if name not in ("html", "body") and any(page.tag[n] == name for n in stack[1:]):
                    while page.tag[stack[-1]] != name:
                        close()
                    close()
            elif name == "a":
                where["in_link"] = False
            continue
        name, attributes = (found[2], found[3]) if found[2] is not None else (found[4], found[5])
        if name is None:
            if source.startswith("<![CDATA[", found.start()):
                words(source[found.start() + 9:found.end() - 3])
            continue
        name = name.lower()
        if name in RAW or name in SKIPPED:
            stop = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if stop:
                at = stop.end()
            elif name in RAW:
                at = end
            continue
        page.tags[stack[-1]] += 1
        if name in BLOCKS:
            flush()
            if name in ("html", "body"):
                page.marks[0] += " " + attributes
                continue
            if name in ENDS_PARAGRAPH and page.tag[stack[-1]] == "p" and len(stack) > 1:
                close()
            if name in SAME:
                for depth in range(len(stack) - 1, 0, -1):
                    if page.tag[stack[depth]] in HOLDS[name]:
                        break
                    if page.tag[stack[depth]] in SAME[name]:
                        while len(stack) > depth:
                            close()
                        break
            if name != "hr" and len(stack) < DEEPEST:
                stack.append(add(name, attributes, None))
        elif name in ("br", "img", "wbr", "input"):
            pieces.append(" " if name == "br" else "")
        elif name == "a":
            where["in_link"] = True
    flush()
    while stack:
        close()
    return page


_CODE = {tag: n for n, tags in enumerate(GROUPS.values()) for tag in tags.split()}
_N_GROUPS = len(GROUPS)


def _own_marks(attributes: str) -> list[float]:
    """Whether the attributes name main text, each other kind, and hiding."""
    if not attributes:
        return [0.0] * (len(KINDS) + 2)
    found: set[str] = set()
    for match in _MARKS.finditer(attributes):
        value = match[1] or match[2] or match[3] or ""
        found.update(w.lower() for w in _SPLIT.findall(value))
        found.update(w.lower() for w in re.split(r"[^A-Za-z0-9]+", value))
    return [float(bool(found & MAIN_TOKENS)), *[float(bool(found & OTHER_TOKENS[k])) for k in KINDS], float(bool(_HIDDEN.search(attributes)))]


@dataclass
class Forest:
    """All nodes of several pages, one after the other."""

    parent: np.ndarray
    depth: np.ndarray
    page: np.ndarray
    leaf: np.ndarray
    features: np.ndarray


def nodes(pages: list[Page]) -> Forest:
    """Features of every node: its tag, marks of itself and its ancestors, subtree density, place, and siblings."""
    sizes = np.array([len(p.parent) for p in pages])
    firsts = np.cumsum(sizes) - sizes
    page = np.repeat(np.arange(len(pages)), sizes)
    base = np.repeat(firsts, sizes)
    parent = np.concatenate([np.array(p.parent) for p in pages]) + base
    parent[firsts] = firsts  # a root is its own parent
    depth, until = (np.concatenate([np.array(getattr(p, k)) for p in pages]) for k in ("depth", "until"))
    until = until + base
    texts = [t for p in pages for t in p.text]
    leaf = np.array([t is not None for t in texts])
    n = len(texts)
    facts = np.zeros((n, 7))  # characters, linked characters, words, punctuation, capitals, digits, notice signs
    known: dict[str, list[int]] = {}
    linked = [v for p in pages for v in p.linked]
    for i in np.flatnonzero(leaf).tolist():
        t = texts[i]
        if t not in known:
            ascii_ = np.frombuffer(t.encode("latin-1", "replace"), np.uint8)
            known[t] = [len(t), 0, t.count(" ") + 1, len(PUNCTUATION.findall(t)), int(((ascii_ >= 65) & (ascii_ <= 90)).sum()),
                        int(((ascii_ >= 48) & (ascii_ <= 57)).sum()), int(bool(NOTICE_SIGN.search(t)))]
        facts[i] = known[t]
        facts[i, 1] = linked[i]
    tags = np.concatenate([np.array(p.tags) for p in pages]).astype(float)
    sums = np.concatenate([np.zeros((1, 9)), np.cumsum(np.column_stack([facts, leaf, tags]), axis=0)])
    below = sums[until] - sums[:-1]
    whole = below[firsts][page]
    chars, texts_below, tags_below = below[:, 0], below[:, 7], np.maximum(below[:, 8], 1)
    size = np.maximum(chars, 1)
    before = sums[:-1][:, 0] - sums[firsts][page][:, 0]

    group = np.array([_CODE.get(t, _CODE["div"]) for p in pages for t in p.tag])
    own = np.zeros((n, _N_GROUPS))
    own[np.arange(n), group] = 1
    cache: dict[str, list[float]] = {}
    marks = np.array([cache[a] if a in cache else cache.setdefault(a, _own_marks(a)) for p in pages for a in p.marks])
    inherited = np.concatenate([own[:, [_CODE[k] for k in ("nav", "header", "footer", "aside", "form", "article")]], marks], axis=1)
    own_marks = inherited[:, 6:].copy()
    other = own_marks[:, 1:-1].any(axis=1) | own[:, [_CODE[k] for k in ("nav", "footer", "aside", "form")]].any(axis=1)
    nearest = np.where(other, 1.0, np.where((own_marks[:, 0] > 0) | (group == _CODE["article"]), -1.0, 0.0))  # what the nearest telling ancestor says
    nearest[leaf] = 0
    for level in range(1, int(depth.max(initial=0)) + 1):
        at = np.flatnonzero(depth == level)
        inherited[at] = np.maximum(inherited[at], inherited[parent[at]])
        nearest[at] = np.where(nearest[at] == 0, nearest[parent[at]], nearest[at])

    real = np.arange(n) != parent
    children = np.bincount(parent[real], minlength=n)
    order = np.lexsort((np.arange(n), parent))
    order = order[real[order]]
    same = parent[order][1:] == parent[order][:-1]
    previous, following, index = np.zeros(n), np.zeros(n), np.zeros(n)
    previous[order[1:][same]] = chars[order[:-1][same]]
    following[order[:-1][same]] = chars[order[1:][same]]
    starts = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.zeros(0, int)
    index[order] = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order)))) if len(order) else 0
    among = np.where(real, children[parent], 1)
    sibling = np.where(real, chars[parent], chars) / np.maximum(among, 1)
    twins = np.zeros(n)  # siblings of the same tag
    key = parent * _N_GROUPS + group
    _, code, times = np.unique(key[order], return_inverse=True, return_counts=True) if len(order) else (None, np.zeros(0, int), np.zeros(0, int))
    twins[order] = times[code]
    features = np.column_stack([
        leaf, own, own_marks, inherited, nearest, depth, children, np.log1p(chars), chars / np.maximum(whole[:, 0], 1), chars / tags_below,
        chars / np.maximum(texts_below, 1), below[:, 1] / size, np.log1p(below[:, 2]), below[:, 3] / np.maximum(below[:, 2], 1), below[:, 4] / size,
        below[:, 5] / size, below[:, 6], before / np.maximum(whole[:, 0], 1), (before + chars) / np.maximum(whole[:, 0], 1),
        among, index / np.maximum(among, 1), sibling, np.log1p(previous), np.log1p(following), twins])
    return Forest(parent, depth, page, leaf, features)


def decode(forest: Forest, odds: np.ndarray) -> np.ndarray:
    """The kept nodes: the best sum of log odds in which every kept node's ancestors are kept."""
    worth = odds.copy()
    root = np.arange(len(odds)) == forest.parent
    for level in range(int(forest.depth.max(initial=0)), 0, -1):
        at = np.flatnonzero(forest.depth == level)
        gain = np.maximum(worth[at], 0)
        worth += np.bincount(forest.parent[at], gain, len(worth))
    keep = root.copy()
    for level in range(1, int(forest.depth.max(initial=0)) + 1):
        at = np.flatnonzero(forest.depth == level)
        keep[at] = keep[forest.parent[at]] & (worth[at] > 0)
    return keep


def main_texts(pages: list[Page], model: Trees) -> list[str]:
    if not pages:
        return []
    forest = nodes(pages)
    p = np.clip(model.probability(forest.features), 1e-6, 1 - 1e-6)
    kept = np.flatnonzero(decode(forest, np.log(p / (1 - p))) & forest.leaf)
    texts = [t for p in pages for t in p.text]
    out: list[list[str]] = [[] for _ in pages]
    for i in kept.tolist():
        out[forest.page[i]].append(texts[i])
    return ["\n".join(t) for t in out]


def fit_model(pages: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on made pages; the texts in them come from `sample` pages, the same ones every time."""
    from tallyveil.llm.html_training import made_pages

    hashed = pages.where("html IS NOT NULL").select(F.xxhash64("html").alias("at"), "html")
    least = [r[0] for r in hashed.select("at").distinct().orderBy("at").limit(sample).collect()]  # only hashes are sorted
    some = hashed.where(F.col("at").isin(least)).groupBy("at").agg(F.min("html").alias("html")).collect() if least else []
    texts = sorted({t for r in some for t in parse(r.html).text if t})
    made = made_pages(texts)
    if not made:
        return None
    x, y = [], []
    for at in range(0, len(made), 200):
        parsed = [parse(page) for page, _ in made[at:at + 200]]
        forest = nodes(parsed)
        main = np.array([bool(t) and t in truth for p, (_, truth) in zip(parsed, made[at:at + 200]) for t in p.text])
        until = np.concatenate([np.array(p.until) for p in parsed]) + np.repeat(np.cumsum([len(p.until) for p in parsed]) - [len(p.until) for p in parsed], [len(p.until) for p in parsed])
        total = np.concatenate([[0], np.cumsum(main)])
        x.append(forest.features)
        y.append((total[until] > total[:-1]).astype(float))
    return fit(np.concatenate(x), np.concatenate(y), trees=TREES, depth=DEPTH)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(fit_model(pages))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)

    def run(batches):
        for block in text_blocks(batches, "html"):
            parsed = [parse(h or "") for h in block.column("html").to_pylist()]
            texts = main_texts(parsed, model.value) if model.value is not None else [""] * len(parsed)
            yield pa.RecordBatch.from_arrays([block.column("page_id"), block.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"{kinds}, text string, n_chars long")
