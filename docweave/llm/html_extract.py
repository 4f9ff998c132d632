"""Main-text extraction: gradient-boosted trees over DOM-node features, decoded down the tree.

Every element of a page gets features of its subtree (text and link density, tag mix), its attribute
tokens, depth and siblings. Boosted trees, trained on generated pages whose labels are known, say how
likely its own text is main text. Decoding chooses for every subtree whether it is kept whole,
dropped whole or decided child by child, so no kept element stands under a dropped one.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm._shared import slices

PIECE_BYTES = 2 << 20

# fixed values: element kinds of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe svg".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: A start tag of the key ends an open element of the value, unless one of SCOPE is nearer.
ENDS = {t: ("p",) for t in BLOCK if t not in ("br", "option", "html", "body", "li", "td", "th", "tr", "dd", "dt")} | {
    "li": ("li", "p"), "dd": ("dd", "dt", "p"), "dt": ("dd", "dt", "p"), "tr": ("tr", "td", "th", "p"),
    "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",),
}
SCOPE = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table ul".split())
CONTENT_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav header footer aside form button select label menu dialog".split())
INLINE = frozenset("a abbr b bdi cite code em i kbd mark q s small span strong sub sup time u var".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GOOD_TOKENS = frozenset("article body content entry main post story text prose page read".split())
BAD_TOKENS = frozenset(
    "ad ads adbox adslot advert advertisement banner bar breadcrumb breadcrumbs byline comment comments consent cookie "
    "copyright discuss disqus footer form gdpr header legal login masthead menu meta modal nav navbar navigation newsletter "
    "notice pager pagination popup promo recommended related replies respond search share sharing sidebar signup site social "
    "sponsor sponsored subscribe tags toolbar top widget".split()
)

_tag = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|[!?][^>]*(?:>|\Z))", re.S)
_attribute = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_label = re.compile(r"data-y=(\d)")
_token = re.compile(r"[a-z]+")
_marks = re.compile(r"[.,;:!?]")


class Page:
    """The elements of a page in order, and its text as (element, text) runs; element -1 is a block edge."""

    def __init__(self, source: str):
        self.tags, self.parents, self.tokens, self.labels = [], [], [], []
        self.runs: list[tuple[int, str]] = []
        self._open("html", "", -1)
        stack, at, end = [0], 0, len(source)
        while at < end:
            found = source.find("<", at)
            match = _tag.match(source, found) if found >= 0 else None
            if found < 0:
                self._text(stack[-1], source[at:])
                break
            if found > at:
                self._text(stack[-1], source[at:found])
            if match is None:  # a lone "<" is text
                self._text(stack[-1], "<")
                at = found + 1
                continue
            at = match.end()
            name = (match[3] or "").lower()
            if not name:
                continue
            if name in BLOCK:
                self.runs.append((-1, ""))
            if match[2]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[depth]] == name:
                        del stack[depth:]
                        break
                    if self.tags[stack[depth]] in SCOPE and name not in SCOPE:
                        break
                continue
            if name in ("html", "body", "head"):
                continue
            if name in RAW:
                if not match[4].rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(source, at)
                    at = close.end() if close else end
                continue
            for other in ENDS.get(name, ()):
                for depth in range(len(stack) - 1, 0, -1):
                    tag = self.tags[stack[depth]]
                    if tag == other:
                        del stack[depth:]
                        break
                    if tag in SCOPE:
                        break
            node = self._open(name, match[4], stack[-1])
            if name not in VOID and not match[4].endswith("/"):
                stack.append(node)

    def _open(self, name: str, attributes: str, parent: int) -> int:
        self.tags.append(name)
        self.parents.append(parent)
        tokens = set()
        if attributes and "=" in attributes:
            for groups in _attribute.findall(attributes):
                tokens.update(_token.findall("".join(groups).lower()))
        self.tokens.append(tokens)
        y = _label.search(attributes) if attributes else None
        self.labels.append(int(y[1]) if y else -1)
        return len(self.tags) - 1

    def _text(self, node: int, raw: str) -> None:
        self.runs.append((node, html.unescape(raw) if "&" in raw else raw))

    def features(self) -> tuple[np.ndarray, np.ndarray]:
        """One row per element, and the length of each element's own text."""
        n = len(self.tags)
        own, marks, links = [0] * n, [0] * n, [0] * n
        in_link = [False] * n
        depth, good, bad, boiler, content = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        own_good, own_bad = [len(t & GOOD_TOKENS) for t in self.tokens], [len(t & BAD_TOKENS) for t in self.tokens]
        parents = self.parents
        for i, tag in enumerate(self.tags):
            p = parents[i]
            in_link[i] = tag == "a" or (p >= 0 and in_link[p])
            if p >= 0:
                depth[i] = depth[p] + 1
                good[i], bad[i] = good[p] + (own_good[p] > 0), bad[p] + (own_bad[p] > 0)
                boiler[i] = boiler[p] + (self.tags[p] in BOILER_TAGS)
                content[i] = content[p] + (self.tags[p] in CONTENT_TAGS)
        for node, text in self.runs:
            if node >= 0 and (size := len(text.strip())):
                own[node] += size
                marks[node] += len(_marks.findall(text))
                if in_link[node]:
                    links[node] += size
        text, nodes, mark, link = own[:], [1] * n, marks[:], links[:]
        paragraphs, anchors, items, fields = (
            [int(t == "p") for t in self.tags], [int(t == "a") for t in self.tags], [int(t == "li") for t in self.tags],
            [int(t in ("input", "button", "select", "label", "form")) for t in self.tags],
        )
        kids: dict[int, list[int]] = {}
        for i in range(n - 1, 0, -1):
            p = parents[i]
            for total in (text, nodes, mark, link, paragraphs, anchors, items, fields):
                total[p] += total[i]
            kids.setdefault(p, []).append(i)
        siblings, same, mean = [1] * n, [1.0] * n, [0.0] * n
        for group in kids.values():
            tags = [self.tags[i] for i in group]
            average = sum(text[i] for i in group) / len(group)
            counts = {t: tags.count(t) for t in set(tags)}
            for i, tag in zip(group, tags):
                siblings[i], same[i], mean[i] = len(group), counts[tag] / len(group), average
        whole = max(1, text[0])
        rows = []
        for i, tag in enumerate(self.tags):
            size, p = max(1, text[i]), max(0, parents[i])
            rows.append((
                depth[i], i / n, math.log1p(text[i]), link[i] / size, math.log1p(own[i]), text[i] / whole, math.log1p(nodes[i]),
                math.log1p(text[i] / nodes[i]), mark[i] / size, math.log1p(paragraphs[i]), anchors[i] / nodes[i], items[i] / nodes[i],
                fields[i], own_good[i], own_bad[i], good[i], bad[i], tag == "p", tag in HEADINGS, tag in ("div", "section"),
                tag in BOILER_TAGS, tag in CONTENT_TAGS, tag in INLINE, tag in ("li", "ul", "ol", "dl", "dt", "dd"), boiler[i],
                content[i], siblings[i], same[i], math.log1p(mean[i]), text[p] / whole, link[p] / max(1, text[p]),
            ))
        return np.array(rows, np.float32), np.array(own, np.float32)

    def decode(self, logits: np.ndarray, own: np.ndarray, price: float = 2.0) -> list[bool]:
        """Whether each element's own text is kept; a subtree is kept, dropped, or mixed at a price."""
        score = (logits * np.sqrt(own + (own > 0))).tolist()
        n = len(score)
        total, best = score[:], [abs(s) for s in score]  # best holds the mixed value until it is settled
        choice = [0] * n
        for i in range(n - 1, -1, -1):
            value, choice[i] = max((total[i], 1), (-total[i], -1), (best[i] - price, 0), key=lambda x: x[0])
            if i:
                total[self.parents[i]] += total[i]
                best[self.parents[i]] += value
        keep, forced = [False] * n, [0] * n
        for i in range(n):
            p = self.parents[i]
            forced[i] = (forced[p] if p >= 0 else 0) or choice[i]
            keep[i] = forced[i] > 0 or (forced[i] == 0 and score[i] > 0)
        return keep

    def text(self, keep: list[bool]) -> str:
        """Kept runs in page order, white space as one space, blocks joined by one space."""
        return " ".join("".join(" " if node < 0 else text for node, text in self.runs if node < 0 or keep[node]).split())


class Boosted:
    """Gradient-boosted regression trees of fixed depth on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, bins: int = 32):
        self.depth, self.rate = depth, rate
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        logit = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-logit))
            tree, leaf = self._grow(binned, y - p, p * (1 - p), bins)
            self.trees.append(tree)
            logit += rate * tree[2][leaf]

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray, bins: int) -> tuple[tuple, np.ndarray]:
        features = np.zeros(2**self.depth - 1, np.int64)
        cuts = np.full(2**self.depth - 1, np.inf)
        at = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            width, first = 2**level, 2**level - 1
            gain = np.full(width, 1e-9)
            pick, cut = np.zeros(width, np.int64), np.full(width, bins, np.int64)
            for f in range(binned.shape[1]):
                cell = at * bins + binned[:, f]
                gs = np.bincount(cell, g, width * bins).reshape(width, bins).cumsum(axis=1)
                hs = np.bincount(cell, h, width * bins).reshape(width, bins).cumsum(axis=1)
                all_g, all_h = gs[:, -1:], hs[:, -1:]
                win = gs**2 / (hs + 1) + (all_g - gs) ** 2 / (all_h - hs + 1) - all_g**2 / (all_h + 1)
                b = win.argmax(axis=1)
                better = win[np.arange(width), b] > gain
                gain[better], pick[better], cut[better] = win[np.arange(width), b][better], f, b[better]
            for node in range(width):
                edges = self.edges[pick[node]]
                features[first + node] = pick[node]
                cuts[first + node] = edges[cut[node]] if cut[node] < len(edges) else np.inf
            at = 2 * at + (binned[np.arange(len(g)), pick[at]] > cut[at])
        leaves = np.bincount(at, g, 2**self.depth) / (np.bincount(at, h, 2**self.depth) + 1)
        return (features, cuts, leaves), at

    def logits(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for features, cuts, leaves in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, features[at]] >= cuts[at])
            out += self.rate * leaves[at - (2**self.depth - 1)]
        return out


def random_page(rng: random.Random) -> str:
    """A page with known labels (attribute data-y) on its elements: 1 for main text, 0 for the rest."""

    def words(n: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñ") for _ in range(rng.randint(1, 9))) for _ in range(n))

    def prose(n: int) -> str:
        parts, left = [], n
        while left > 0:
            k = min(left, rng.randint(3, 16))
            parts.append(words(k).capitalize() + rng.choice([".", ".", ".", ",", "!", "?", ""]))
            left -= k
        return " ".join(parts)

    def element(tag: str, label: int, inner: str, names: str = "", close: bool = True) -> str:
        named = ""
        if names and rng.random() < 0.85:
            token = rng.choice(names.split())
            token = rng.choice([token, token, f"{token}-{rng.choice(['box', 'area', 'wrap', 'inner', 'x1'])}", f"{rng.choice(['site', 'js', 'c'])}-{token}"])
            named = f' {rng.choice(["class", "class", "id"])}="{token}"'
        return f"<{tag}{named} data-y={label}>{inner}" + (f"</{tag}>" if close else "")

    def links(label: int, n: int, size: int = 2) -> str:
        return element("ul", label, "".join(element("li", label, element("a", label, words(rng.randint(1, size)))) for _ in range(n)))

    def paragraph() -> str:
        inner = prose(int(rng.lognormvariate(3.2, 1)) + 1)
        if rng.random() < 0.25:
            inner = element("b", 1, inner, close=rng.random() < 0.5) + (rng.choice(["<br>", ""]))
        if rng.random() < 0.2:
            inner += " " + element(rng.choice(["a", "em", "strong", "span"]), 1, words(rng.randint(1, 4))) + " " + prose(5)
        return element("p", 1, inner, close=rng.random() < 0.8)

    def body_part() -> str:
        kind = rng.random()
        if kind < 0.78:
            return paragraph()
        if kind < 0.84:
            return element(rng.choice(["h2", "h3"]), 1, words(rng.randint(1, 8)))
        if kind < 0.89:
            return element(rng.choice(["ul", "ol"]), 1, "".join(element("li", 1, prose(rng.randint(2, 20))) for _ in range(rng.randint(2, 6))))
        if kind < 0.93:
            return element("blockquote", 1, paragraph())
        if kind < 0.96:
            return element("table", 1, "".join(element("tr", 1, element("td", 1, words(2)) + element("td", 1, words(3))) for _ in range(3)))
        if kind < 0.98:
            return element("figure", 1, "<img src=x>" + element("figcaption", 1, prose(8)))
        return element("pre", 1, words(12))

    def advert() -> str:
        return element(rng.choice(["div", "aside", "section"]), 0, rng.choice([prose(rng.randint(2, 25)), element("p", 0, prose(12)), element("a", 0, words(4))]), "ad ads advert banner sponsored promo adbox advertisement")

    def notice() -> str:
        return element(rng.choice(["div", "section", "aside", "dialog"]), 0, element("p", 0, prose(rng.randint(5, 30))) + element("button", 0, words(1)), "cookie consent notice gdpr popup modal banner newsletter")

    def form() -> str:
        return element("form", 0, element("label", 0, words(2)) + "<input>" + element("button", 0, words(1)) + (element("p", 0, prose(8)) if rng.random() < 0.3 else ""), "search login signup subscribe form respond newsletter")

    def sidebar() -> str:
        inner = "".join(rng.choice([lambda: element("h3", 0, words(2)) + links(0, rng.randint(3, 7), 7), lambda: element("p", 0, prose(15)), advert, form])() for _ in range(rng.randint(1, 3)))
        return element(rng.choice(["aside", "aside", "div", "section"]), 0, inner, "sidebar widget related recommended promo")

    def comments() -> str:
        one = lambda: element(rng.choice(["div", "li", "article"]), 0, element(rng.choice(["b", "span", "cite", "h4"]), 0, words(1), "meta") + element("p", 0, prose(rng.randint(2, 40))), "comment replies")
        inner = element(rng.choice(["h2", "h3"]), 0, words(2)) + "".join(one() for _ in range(rng.randint(1, 8))) + (form() if rng.random() < 0.4 else "")
        return element(rng.choice(["section", "div"]), 0, inner, "comments discuss disqus comments replies")

    def navigation() -> str:
        return element(rng.choice(["nav", "nav", "nav", "div", "menu"]), 0, links(0, rng.randint(2, 9)), "menu nav navbar navigation breadcrumb")

    def header() -> str:
        return element(rng.choice(["header", "header", "div"]), 0, element(rng.choice(["div", "span", "h1", "p"]), 0, words(rng.randint(1, 5))) + (navigation() if rng.random() < 0.6 else ""), "header masthead top site")

    def footer() -> str:
        return element(rng.choice(["footer", "footer", "footer", "div"]), 0, rng.choice([lambda: "&copy; " + prose(rng.randint(2, 14)), lambda: links(0, 5), lambda: element("p", 0, "&copy; " + prose(10))])(), "footer copyright legal")

    sometimes = lambda share, make: make() if rng.random() < share else ""
    head = element("h1", 1, words(rng.randint(2, 12)))
    if rng.random() < 0.2:
        head = element("header", 1, head + sometimes(0.4, lambda: element("p", 1, prose(12))))
    parts = [head] * (rng.random() < 0.93) + [body_part() for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 9, 16]))] or [paragraph()]
    for make, share in ((advert, 0.2), (form, 0.08), (sidebar, 0.1), (notice, 0.06)):
        if rng.random() < share:
            parts.insert(rng.randint(1, len(parts)), make())
    if rng.random() < 0.12:
        parts.append(comments())
    main = "".join(parts)
    kind = rng.random()
    if kind < 0.6:
        main = element("article", 1, main, rng.choice(["", "post entry story article"]))
    elif kind < 0.75:
        main = element("main", 1, main, "content main")
    else:
        main = element(rng.choice(["div", "section"]), 1, main, "content post entry article story main text body")
    if rng.random() < 0.25:
        main = element(rng.choice(["div", "main"]), 1, main, "page wrap main")
    after = sometimes(0.25, comments)
    page = (
        sometimes(0.35, header) + sometimes(0.75, navigation) + sometimes(0.2, notice) + sometimes(0.5, advert)
        + sometimes(0.12, sidebar) + main + after + sometimes(0.3, sidebar) + sometimes(0.12, advert)
        + sometimes(0.12, form) + sometimes(0.85, footer)
    )
    return page[: rng.randint(len(page) // 2, len(page))] if rng.random() < 0.05 else page


@lru_cache(maxsize=4)
def trained(pages: int = 700, seed: int = 11) -> Boosted:
    """The trees, trained on that many generated pages."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        page = Page(random_page(rng))
        x, own = page.features()
        label = np.array(page.labels)
        use = (label >= 0) & (own > 0)
        xs.append(x[use])
        ys.append(label[use])
    return Boosted(np.concatenate(xs), np.concatenate(ys).astype(float))


def main_texts(model: Boosted, sources: list[bytes]) -> list[str]:
    """The main text of each page."""
    pages = [Page(s.decode("utf-8", "replace")) for s in sources]
    features = [p.features() for p in pages]
    logits = model.logits(np.concatenate([f[0] for f in features])) if pages else np.zeros(0)
    ends = np.cumsum([len(f[0]) for f in features])
    return [p.text(p.decode(logits[e - len(x) : e], own)) for p, (x, own), e in zip(pages, features, ends)]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: (id_col, url_col, text, n_chars long).

    text is the main text of the whole page, character references decoded, white space inside a block
    as one space, blocks joined by one space; null or blank html and pages without main text give the
    empty text. Repeated rows give equal results; an empty table gives no rows.
    """
    held = pages.sparkSession.sparkContext.broadcast(trained())
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kinds = dict(slim.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sources in slices(batch, "html", PIECE_BYTES):
                texts = main_texts(held.value, sources)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    [id_col, url_col, "text", "n_chars"],
                )

    return slim.mapInArrow(run, f"{id_col} {kinds['id']}, {url_col} {kinds['url']}, text string, n_chars long")
