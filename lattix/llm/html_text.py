"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element is a binary variable: main content or not. Its own features (tag, words of class,
id and role, length, share of linked text, punctuation) give a unary potential; a parent and child
share a pairwise potential, with parameters for the child's kind of element. Since the graph is a tree, one sum-product pass upward
and one downward give exact marginals; the text of blocks with a marginal of 1/2 or more is the
result. The parameters maximise the likelihood of labelled pages (gradients are observed minus
expected counts, from the same marginals). Pages are labelled by generation: `labelled_pages` makes
them from many layouts, with the label of every block known.

Character references are decoded; white space inside a block becomes one space; blocks follow in
page order, joined by one space. Scripts, styles, comments of the markup and other elements that a
browser doesn't show, by tag, attribute or style, are skipped by the parser, which takes time in proportion to the page. Tags that are never closed, stray end tags and cut
pages are parsed as browsers do in the main: whatever is open ends where its parent ends. Null and
empty html, and pages without content, give an empty text. Equal pages give equal texts. Other
columns play no part.
"""

from __future__ import annotations

import math
import random
import re
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Fixed values of HTML: elements without content, whose content isn't shown, and that stay within a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg math head title textarea select option datalist audio video canvas".split())
RAW = frozenset("script style textarea title iframe noscript".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: An opening tag ends an open element of these kinds, unless one of the barriers stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
#: What a labelled page begins with if the text outside all blocks is content.
MAIN_PAGE = "<!--data-main-->"
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Block:
    __slots__ = ("tag", "parent", "names", "label", "chars", "linked", "text", "score")

    def __init__(self, tag: str, parent: int, names: tuple[str, ...], label: bool = False):
        self.tag, self.parent, self.names, self.label = tag, parent, names, label
        self.chars = self.linked = 0
        self.text, self.score = "", 0.0


class Open:
    """The open elements, innermost last; each step takes time in proportion to the elements it closes, however many are open."""

    def __init__(self):
        #: (tag, its block or the block around it, hidden?, inside a link?).
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self._at: dict[str, list[int]] = defaultdict(list)
        self._solid = [0]

    def push(self, tag: str, block: int, hidden: bool, linked: bool) -> None:
        self._at[tag].append(len(self.stack))
        if tag not in INLINE:
            self._solid.append(len(self.stack))
        self.stack.append((tag, block, hidden, linked))

    def _cut(self, size: int) -> None:
        while len(self.stack) > size:
            tag = self.stack.pop()[0]
            self._at[tag].pop()
            if tag not in INLINE:
                self._solid.pop()

    def _last(self, tags: set[str]) -> int:
        return max((self._at[t][-1] for t in tags if self._at.get(t)), default=0)

    def close(self, tag: str) -> None:
        if self._at.get(tag):
            self._cut(self._at[tag][-1])

    def make_way(self, tag: str) -> None:
        """Close what ends where a block element of this kind begins."""
        if self.stack[self._solid[-1]][0] == "p":
            self._cut(self._solid[-1])
        if tag in CLOSES:
            tags, barriers = CLOSES[tag]
            if self._last(tags) > self._last(barriers):
                self._cut(self._last(tags))


def _attributes(text: str) -> dict[str, str]:
    """Values by name; of a name that repeats the first counts."""
    out: dict[str, str] = {}
    for name, x, y, z in ATTRIBUTE.findall(text) if text.strip() else ():
        out.setdefault(name.lower(), unescape(x or y or z))
    return out


def _is_hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDING.search(attributes.get("style", "")))


def parse(html: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """(blocks, parents before children; (block, text) of each run of text, in page order)."""
    blocks = [Block("", -1, (), html.startswith(MAIN_PAGE))]
    runs: list[tuple[int, list[str]]] = []
    opened = Open()
    at = 0

    def add(text: str) -> None:
        _, block, hidden, linked = opened.stack[-1]
        if hidden or not text:
            return
        text = unescape(text)
        shown = len(text) if not text.isspace() else 0
        blocks[block].chars += shown
        blocks[block].linked += shown * linked
        if shown:
            blocks[block].text = text
        if runs and runs[-1][0] == block:
            runs[-1][1].append(text)
        else:
            runs.append((block, [text]))

    while m := TAG.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        closing, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            opened.close(tag)
            if tag not in INLINE:
                runs.append((-1, []))
            continue
        if tag == "br" or tag == "hr":
            add(" ")
        if tag in VOID:
            continue
        if tag not in INLINE and tag not in HIDDEN:
            opened.make_way(tag)
            runs.append((-1, []))
        _, block, hidden, linked = opened.stack[-1]
        attributes = _attributes(rest)
        hidden = hidden or tag in HIDDEN or _is_hidden(attributes)
        if tag not in INLINE and not hidden:
            names = tuple(x.lower() for a in ("class", "id", "role") for x in NAME.findall(attributes.get(a, "")))
            blocks.append(Block(tag, block, names, "data-main" in attributes))
            block = len(blocks) - 1
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
        elif not rest.endswith("/") or tag not in ("svg", "math"):
            opened.push(tag, block, hidden, linked or tag == "a")
    add(html[at:])
    return blocks, [(block, "".join(parts)) for block, parts in runs]


def _features(block: Block) -> list[str]:
    out = ["bias", f"tag={block.tag}"]
    out += [f"name={x}" for x in block.names]
    if block.chars:
        out.append(f"chars={min(6, int(math.log2(block.chars + 1)) // 2)}")
        out.append(f"linked={(4 * block.linked) // block.chars}")
        out.append(f"tag={block.tag} linked={2 * block.linked >= block.chars}")
        last = block.text.rstrip()[-1:]
        out.append("ends=" + ("stop" if last in ".!?…。\"”»" else "other"))
        if "©" in block.text[:400]:
            out.append("copyright")
    return out


def _logaddexp(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


KINDS = ("text", "links", "frame")


class TreeModel:
    """Log-odds weights of features, and a 2 x 2 log-potential of (parent, child) for the child's kind."""

    def __init__(self):
        self.weights: dict[str, float] = defaultdict(float)
        self.pairs: dict[str, list[float]] = defaultdict(lambda: [0.0] * 4)

    @staticmethod
    def kind(block: Block) -> str:
        return "frame" if not block.chars else "links" if 2 * block.linked >= block.chars else "text"

    def marginals(self, blocks: list[Block], features: list[list[str]], pairwise: bool = False):
        """Probability of content for each block by sum-product; with ``pairwise`` also of (parent, child)."""
        get = self.weights.get
        own = [sum(get(f, 0.0) for f in fs) for fs in features]
        belief, message = own[:], [0.0] * len(blocks)
        for i in range(len(blocks) - 1, 0, -1):
            a, b, c, d = self.pairs[self.kind(blocks[i])]  # (0,0) (0,1) (1,0) (1,1)
            x = belief[i]
            message[i] = _logaddexp(c, d + x) - _logaddexp(a, b + x)
            belief[blocks[i].parent] += message[i]
        p, joint = [0.0] * len(blocks), [None] * len(blocks)
        for i, block in enumerate(blocks):
            if i:
                a, b, c, d = self.pairs[self.kind(block)]
                rest = belief[block.parent] - message[i]  # the parent's belief without this child
                if pairwise:
                    x = belief[i]
                    logs = [a, b + x, rest + c, rest + d + x]
                    most = max(logs)
                    terms = [math.exp(v - most) for v in logs]
                    joint[i] = [v / sum(terms) for v in terms]
                belief[i] += _logaddexp(b, rest + d) - _logaddexp(a, rest + c)
            p[i] = 1 / (1 + math.exp(-max(-700.0, min(700.0, belief[i]))))
        return (p, joint) if pairwise else p

    def fit(self, pages: list[str], epochs: int = 12, rate: float = 0.3, seed: int = 2) -> TreeModel:
        """Stochastic gradient ascent (Adagrad) of the likelihood of the labels in ``pages``."""
        rng = random.Random(seed)
        data = []
        for html in pages:
            blocks, _ = parse(html)
            data.append((blocks, [_features(b) for b in blocks]))
        seen: dict[object, float] = defaultdict(lambda: 1e-3)
        for _ in range(epochs):
            rng.shuffle(data)
            for blocks, features in data:
                p, joint = self.marginals(blocks, features, True)
                grads: dict[object, float] = defaultdict(float)
                for i, block in enumerate(blocks):
                    for f in features[i]:
                        grads[f] += block.label - p[i]
                    if i:
                        kind = self.kind(block)
                        for k in range(4):
                            grads[kind, k] -= joint[i][k]
                        grads[kind, 2 * blocks[block.parent].label + block.label] += 1
                for key, g in grads.items():
                    seen[key] += g * g
                    step = rate * g / math.sqrt(seen[key])
                    if isinstance(key, tuple):
                        self.pairs[key[0]][key[1]] += step
                    else:
                        self.weights[key] += step
        self.weights, self.pairs = dict(self.weights), {kind: self.pairs[kind] for kind in KINDS}
        return self

    def extract(self, html: str | None) -> str:
        blocks, runs = parse(html or "")
        p = self.marginals(blocks, [_features(b) for b in blocks])
        return " ".join(t for i, text in runs if i >= 0 and p[i] >= 0.5 and (t := " ".join(text.split())))


# ---------------------------------------------------------------- labelled pages

#: Names that web pages give to blocks that are not part of an article, and to the article.
ASIDE_NAMES = {
    "menu": "menu nav navbar navigation topnav main-menu breadcrumb breadcrumbs pagination toc-links tabs",
    "header": "header site-header masthead topbar banner logo branding page-header",
    "footer": "footer site-footer copyright colophon bottom legal page-footer",
    "sidebar": "sidebar side aside related recommended widget trending most-read popular tags read-more teaser",
    "notice": "cookie cookie-notice consent gdpr notice alert banner-notice popup modal privacy-notice overlay",
    "advert": "ad ads advert advertisement sponsored promo adsbygoogle banner-ad ad-slot sponsor commercial",
    "form": "newsletter subscribe signup login search search-box contact-form paywall",
    "comments": "comments comment comment-list reply disqus responses comment-body discussion user-comments reader-comments",
    "share": "share social sharing share-buttons social-links follow author-box byline-links",
}
WRAPPER_NAMES = "wrap wrapper container page site layout outer app root row columns grid"
MAIN_NAMES = "article post entry content main story article-body post-content entry-content main-content story-body text body-copy"


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    """Made-up pages of many layouts; blocks of the article carry the attribute data-main."""
    rng = random.Random(seed)

    def words(lo: int, hi: int) -> str:
        made = ["".join(rng.choice("aeiou") + rng.choice("bcdfglmnrstv") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi))]
        return " ".join(made).capitalize() + rng.choice([".", ".", ".", "", "!", "?"])

    def named(kind: str) -> str:
        name = rng.choice((ASIDE_NAMES[kind] if kind in ASIDE_NAMES else MAIN_NAMES).split())
        if rng.random() < 0.2:  # a name of no meaning, as made by style tools: shape and place must tell
            name = rng.choice("bcdfgmrst") + "".join(rng.choice("aeioubcdfgklm") for _ in range(rng.randint(2, 6)))
        return rng.choice([f' class="{name}"', f' class="{name}"', f' id="{name}"', f' class="x-{name} col-{rng.randint(1, 9)}"'])

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n)) + "</ul>"

    def aside(kind: str) -> str:
        tag = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}.get(kind, "div")
        plain = tag != "div" and rng.random() < 0.5
        tag = tag if plain or rng.random() < 0.5 else rng.choice(["div", "section"])
        start = f"<{tag}{'' if plain else named(kind)}>"
        if kind in ("menu", "share"):
            inner = links(rng.randint(2, 8)) if rng.random() < 0.7 else rng.choice([" ", " | ", " &middot; ", ", ", " / "]).join(f'<a href="#">{words(1, 2)}</a>' for _ in range(rng.randint(1, 6)))
        elif kind == "header":
            inner = rng.choice([f"<h1>{words(1, 4)}</h1>", f"<div><a href='/'>{words(1, 3)}</a></div>", f"<p>{words(2, 8)}</p>", words(1, 6)]) + rng.choice(["", links(4)])
        elif kind == "footer":
            inner = rng.choice(["&copy; ", "© 2024 ", "", "Copyright "]) + words(2, 25) + rng.choice(["", links(3), f"<p>{words(5, 30)}</p>"])
        elif kind == "sidebar":
            inner = rng.choice([f"<h3>{words(1, 4)}</h3>" + links(5), f"<p>{words(8, 40)}</p>", words(4, 30), f"<h2>{words(1, 3)}</h2><p>{words(5, 30)}</p>"])
        elif kind == "form":
            inner = f"<label>{words(1, 4)}</label><input name=q><button>{words(1, 2)}</button>" + rng.choice(["", f"<p>{words(4, 20)}</p>"])
        elif kind == "comments":
            inner = rng.choice(["", f"<h3>{words(1, 3)}</h3>"]) + "".join(rng.choice(["<div{0}><p>{1}</p></div>", "<p{0}>{1}</p>", "<li{0}>{1}</li>"]).format(rng.choice(["", named("comments")]), words(3, 60)) for _ in range(rng.randint(1, 5)))
        else:
            inner = rng.choice([words(2, 40), f"<p>{words(2, 40)}</p>", f"<span>{words(2, 20)}</span><button>OK</button>"])
        return f"{start}{inner}</{tag}>"

    def paragraph() -> str:
        text = words(*rng.choice([(1, 1), (2, 6), (5, 30), (20, 80), (40, 150)]))
        if rng.random() < 0.2:
            text += f' <a href="/x">{words(1, 4)}</a> {words(1, 20)}'
        kind = rng.random()
        if kind < 0.7:
            return f"<p data-main>{text}</p>"
        if kind < 0.76:
            return f"<h2 data-main>{words(1, 6)}</h2>"
        if kind < 0.82:
            return "<ul data-main>" + "".join(f"<li data-main>{words(2, 20)}</li>" for _ in range(3)) + "</ul>"
        if kind < 0.86:
            return f"<blockquote data-main><p data-main>{text}</p></blockquote>"
        if kind < 0.9:
            return f"<table data-main><tr data-main><td data-main>{words(1, 5)}</td><td data-main>{words(1, 5)}</td></tr></table>"
        if kind < 0.94:
            return f"<pre data-main>{text}</pre>"
        return f"<div data-main>{text}</div>"

    pages = []
    for _ in range(count):
        if rng.random() < 0.08:  # no layout at all: bare text, paragraphs or lines, in a body or not
            inner = rng.choice([words(1, 200), "<br>".join(words(3, 40) for _ in range(3)), f"<b>{words(1, 5)}</b> {words(5, 90)}"])
            bare = "".join(f"<p data-main>{words(1, 60)}</p>" for _ in range(rng.randint(1, 6)))
            pages.append(MAIN_PAGE + rng.choice([inner, f"<body data-main>{inner}", bare, f"<html data-main><body data-main>{bare}</body></html>", f"<h1 data-main>{words(1, 6)}</h1>{bare}"]))
            continue
        inside = [paragraph() for _ in range(rng.choice([1, 1, 2, 4, 8, 15]))]
        if rng.random() < 0.35:
            inside.insert(rng.randint(0, len(inside)), aside(rng.choice(["advert", "share", "sidebar", "form", "notice"])))
        if rng.random() < 0.2:
            inside.append(aside("comments"))
        title = f"<h1 data-main>{words(1, 9)}</h1>" if rng.random() < 0.85 else ""
        holder = rng.random()
        tag, name = ("article", "") if holder < 0.5 else ("main", "") if holder < 0.6 else (rng.choice(["div", "section", "article"]), named("main"))
        body = f"<{tag}{name} data-main>{title}{''.join(inside)}</{tag}>"
        if rng.random() < 0.2:
            body = f"<div class='{rng.choice(WRAPPER_NAMES.split())}' data-main>{body}</div>"
        before = [aside(k) for k in rng.sample(["menu", "header", "notice", "advert", "sidebar", "form", "share"], rng.randint(0, 4))]
        after = [aside(k) for k in rng.sample(["footer", "sidebar", "comments", "advert", "share", "form", "notice", "menu"], rng.randint(0, 5))]
        if rng.random() < 0.15:  # wrappers without a name around single parts
            before, after = ([f"<div>{x}</div>" for x in xs] for xs in (before, after))
        inner = "".join(before) + body + "".join(after)
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):  # wrappers around all parts
            inner = f"<{rng.choice(['div', 'div', 'section', 'main'])}{rng.choice(['', *(f' {k}={n}' for k in ('id', 'class') for n in WRAPPER_NAMES.split())])} data-main>{inner}</div>"
        whole = f"<html data-main><head><title>t</title></head><body data-main>{inner}</body></html>"
        pages.append(MAIN_PAGE + (whole if rng.random() < 0.8 else rng.choice([inner, f"<body data-main>{inner}</body>"])))
    return pages


#: Labelled pages that the parameters are fitted to.
TRAIN_PAGES = 500


def extract_pages(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    model = model or TreeModel().fit(labelled_pages(TRAIN_PAGES))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [model.extract(h.as_py()) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read(spark, sf_dir, "pages"))
