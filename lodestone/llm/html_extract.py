"""HTML extraction by a tree-structured graphical model.

The DOM is the graph: each element is content or boilerplate, parent-child potentials (by the kind of the child) connect
the elements, and each element's tag, class and id names, link share and amount of text give its own evidence.
Sum-product messages pass upward from the leaves and downward from the root, which on a tree is exact; an element whose
content marginal is over one half keeps its text. All potentials are counted from labelled pages.

Blocks: every block element starts one; white space inside it, line breaks included, becomes one space.

Formulas and drawings are read in line, as a sentence may go on after them.

Defined results: null or empty html gives an empty text; broken markup is closed as browsers do for the elements that
close each other, stray end tags are ignored, and only an unclosed script or style runs to the page's end; text outside
any element belongs to the root; repeated pages are judged row by row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, html_pages

#: Elements by their part in HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
FOREIGN = frozenset("svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split()) | FOREIGN
HIDDEN = RAW | frozenset("head button select option optgroup datalist object audio video canvas meta link base input noscript template annotation annotation-xml desc metadata defs".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
SCOPE = frozenset("html body table td th ul ol dl article section main div nav aside footer header form".split())
LIST_SCOPE = frozenset("ul ol dl table select".split())
TABLE_SCOPE = frozenset("table td th caption".split())
TABLE_PARTS = TABLE_SCOPE | frozenset("tr tbody thead tfoot".split())
KINDS = {**dict.fromkeys("h1 h2 h3 h4 h5 h6".split(), "heading"), **dict.fromkeys("ul ol dl menu dir".split(), "list"), **dict.fromkeys("li dt dd".split(), "item"), **dict.fromkeys("table tbody thead tfoot tr td th caption".split(), "table"), **dict.fromkeys("figure figcaption blockquote pre address details summary".split(), "quote"), **dict.fromkeys("article main section div p nav aside header footer form body html".split(), "")}
#: A tag, a comment or another declaration; an unfinished one runs to the end. Quotes only count right after "=".
_MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]+|=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)*+)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>][^\s=/>]*)\s*(?:=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>"'][^\s>]*))?)?""")
_NAMING = re.compile(r"class|id|role|data-y", re.I)
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
#: Weight of evidence that siblings share (amounts of text, links of leaves), so that many of them don't count as many witnesses.
TEMPER = 0.15
#: With more siblings than this, they share that evidence's weight.
SIBLINGS = 8
_PIECES = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")


class Dom:
    """Elements in page order, parents before children. Pieces of text are (element, text), with None for a block's edge."""

    def __init__(self, page: str, labels: bool = False) -> None:
        self.tags, self.parents, self.names, self.labels = ["html"], [-1], [()], [0]
        #: Whether an element is shown, and whether it stands in a formula or drawing (which is read in line).
        self.hidden, self.foreign = [False], [False]
        self.pieces: list[tuple[int, str | None]] = []
        self.keep_labels = labels
        self._read(page)

    def _open(self, tag: str, rest: str, parent: int) -> int:
        names, label = (), self.labels[parent]
        if _NAMING.search(rest):
            for m in _ATTRIBUTE.finditer(rest):
                key = m[1].lower()
                value = m[2] or m[3] or m[4] or ""
                if key == "data-y":
                    label = int(value) if self.keep_labels else label
                elif key in ("class", "id", "role"):
                    names += tuple(_PIECES.findall(value.lower()))
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.labels.append(label)
        self.hidden.append(tag in HIDDEN or self.hidden[parent])
        self.foreign.append(tag in FOREIGN or self.foreign[parent])
        return len(self.tags) - 1

    def _read(self, page: str) -> None:
        stack, at, endless = [0], 0, set()
        pieces, tags, foreign = self.pieces, self.tags, self.foreign
        # The depths at which each tag is open, so that an end tag finds its element at once.
        depths: dict[str, list[int]] = defaultdict(list)

        def deepest(names: Iterable[str]) -> int:
            return max((depths[t][-1] for t in names if depths.get(t)), default=0)

        def cut(depth: int) -> None:
            while len(stack) > depth:
                depths[tags[stack.pop()]].pop()

        def close(names: Iterable[str], scope: frozenset) -> None:
            depth = deepest(names)
            if depth and depth >= deepest(scope):
                pieces.append((0, None))
                cut(depth)

        while True:
            m = _MARKUP.search(page, at)
            if m is None:
                break
            if m.start() > at:
                pieces.append((stack[-1], page[at : m.start()]))
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                depth = depths[tag][-1] if depths.get(tag) else 0
                if depth and depth < deepest(SCOPE if tag in INLINE else () if tag in TABLE_PARTS else TABLE_SCOPE):
                    depth = 0
                if (depth or tag == "p") and tag not in INLINE and not foreign[stack[-1]]:
                    pieces.append((0, None))
                if depth:
                    cut(depth)
                continue
            if tag == "html":
                if self.keep_labels and 'data-y="1"' in m[3]:
                    self.labels[0] = 1
                continue
            if tag in CLOSES_P:
                close(("p",), SCOPE)
            if tag in CLOSES:
                close(CLOSES[tag], LIST_SCOPE)
            if tag == "br":
                pieces.append((stack[-1], " "))
                continue
            if tag not in INLINE and not foreign[stack[-1]]:
                pieces.append((0, None))
            node = self._open(tag, m[3], stack[-1])
            if tag in RAW:
                end = None if tag in endless else _RAW_END[tag].search(page, at)
                if end is not None:
                    at = end.end()
                else:
                    endless.add(tag)
                    if tag in ("script", "style"):
                        at = len(page)
            elif tag not in VOID and not (foreign[node] and m[3].endswith("/")):
                depths[tag].append(len(stack))
                stack.append(node)
        if at < len(page):
            pieces.append((stack[-1], page[at:]))


def _kind(dom: Dom, i: int) -> str:
    tag = dom.tags[i]
    if dom.hidden[i]:
        return "hidden"
    if tag in INLINE or dom.foreign[i]:
        return "inline"
    return KINDS.get(tag, "other") or tag


def _event(kind: str, seen: str) -> str:
    """Names speak for themselves, everything else with the element's kind."""
    return seen if seen.startswith("name ") else f"{kind} {seen}"


def evidence(dom: Dom) -> list[tuple[str, tuple[str, ...]]]:
    """For each element its kind and what is seen of it."""
    n = len(dom.tags)
    total, linked, own = [0] * n, [0] * n, [0] * n
    in_link = [False] * n
    for i in range(1, n):
        in_link[i] = dom.tags[i] == "a" or in_link[dom.parents[i]]
    for i, text in dom.pieces:
        if text is not None and not dom.hidden[i]:
            k = len(text) - text.count(" ")
            own[i] += k
            total[i] += k
            if in_link[i]:
                linked[i] += k
    for i in range(n - 1, 0, -1):
        p = dom.parents[i]
        total[p] += total[i]
        linked[p] += linked[i]
        if dom.tags[i] in INLINE or dom.foreign[i]:
            own[p] += own[i]
    out = []
    for i in range(n):
        kind = _kind(dom, i)
        seen = [f"name {w}" for w in dict.fromkeys(dom.names[i])] or ["bare"]
        if kind not in ("inline", "hidden"):
            seen.append(f"links {4 * linked[i] // total[i] if total[i] else 'none'}")
            seen.append(f"text {min(own[i], 2000).bit_length() // 2}")
        out.append((kind, tuple(seen)))
    return out


class Model:
    """Log potentials, counted from labelled pages."""

    def __init__(self, pages: Iterable[str], smooth: float = 0.5) -> None:
        pair, emit, of_kind, names = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), Counter()
        for page in pages:
            dom = Dom(page, labels=True)
            for i, (kind, seen) in enumerate(evidence(dom)):
                y = dom.labels[i]
                if i:
                    pair[kind][dom.labels[dom.parents[i]], y] += 1
                of_kind[kind][y] += 1
                names[y] += 1
                for s in seen:
                    emit[_event(kind, s)][y] += 1
        self.smooth = smooth
        self.pair = {k: tuple(tuple(math.log((c[a, y] + smooth) / (c[a, 0] + c[a, 1] + 2 * smooth)) for y in (0, 1)) for a in (0, 1)) for k, c in pair.items()}
        self.any_pair = tuple(tuple(math.log(p) for p in row) for row in ((0.9, 0.1), (0.1, 0.9)))
        # What is seen speaks relative to the kind (names: relative to all elements), as the pair potentials hold the rest.
        self.emit = {s: self._weight(s) * self._odds(c, names if s.startswith("name ") else of_kind[s.split(" ")[0]]) for s, c in emit.items()}

    @staticmethod
    def _weight(event: str) -> float:
        return TEMPER if " text " in event or event.startswith(("p links", "item links", "heading links")) else 1.0

    def _odds(self, c: Counter, base: Counter) -> float:
        k = self.smooth
        return max(-4.0, min(4.0, math.log((c[1] + k) / (base[1] + 2 * k)) - math.log((c[0] + k) / (base[0] + 2 * k))))

    def marginals(self, dom: Dom) -> list[float]:
        """P(content) of each element, by sum-product."""
        n, parents = len(dom.tags), dom.parents
        seen = evidence(dom)
        odds, pairs = [0.0] * n, [self.any_pair] * n
        kids = [0] * (n + 1)
        for p in parents:
            kids[p] += 1
        for i, (kind, what) in enumerate(seen):
            if dom.hidden[i]:
                odds[i] = -30.0
                continue
            crowd = SIBLINGS / max(SIBLINGS, kids[parents[i]])
            for s in what:
                event = _event(kind, s)
                odds[i] += self.emit.get(event, 0.0) * (crowd if crowd < 1 and self._weight(event) < 1 else 1.0)
            pairs[i] = self.pair.get(kind, self.any_pair)
        # Upward: up[i] is the log ratio that element i sends to its parent.
        up = [0.0] * n
        exp, log1p = math.exp, math.log1p

        def ratio(b: float, t) -> float:
            """log of (sum over y of exp(t[1][y] + b*y)) / (same with t[0])."""
            hi = max(b, 0.0)
            e1, e0 = exp(b - hi), exp(-hi)
            return math.log(exp(t[1][1]) * e1 + exp(t[1][0]) * e0) - math.log(exp(t[0][1]) * e1 + exp(t[0][0]) * e0)

        below = odds[:]
        for i in range(n - 1, 0, -1):
            up[i] = ratio(below[i], pairs[i])
            below[parents[i]] += up[i]
        # Downward: the parent's belief less the child's own message.
        belief = below[:]
        for i in range(1, n):
            from_parent = belief[parents[i]] - up[i]
            t = pairs[i]
            hi = max(from_parent, 0.0)
            e1, e0 = exp(from_parent - hi), exp(-hi)
            belief[i] += math.log(exp(t[1][1]) * e1 + exp(t[0][1]) * e0) - math.log(exp(t[1][0]) * e1 + exp(t[0][0]) * e0)
        return [1 / (1 + exp(-max(-60.0, min(60.0, b)))) for b in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        dom = Dom(page)
        keep = [p > 0.5 for p in self.marginals(dom)]
        blocks, held = [], []
        for i, text in (*dom.pieces, (0, None)):
            if text is None:
                if held:
                    block = _BLANK.sub(" ", "".join(held)).strip()
                    if block:
                        blocks.append(block)
                    held = []
            elif keep[i] and not dom.hidden[i]:
                held.append(entities.unescape(text) if "&" in text else text)
        return "\n".join(blocks)


def fit(pages: Iterable[str] | None = None) -> Model:
    """Train on labelled pages (`data-y` marks); without any on the seeded ones."""
    return Model(html_pages.labelled_pages() if pages is None else pages)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id, url, text, n_chars (code points)."""
    held = pages.sparkSession.sparkContext.broadcast(model or fit())
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        return common.row_batches(((i, u, t := model.extract(h), len(t)) for i, u, h in common.rows_of(batches, "id", "url", "html")), schema, 500)

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "id long, url string, text string, n_chars long")
