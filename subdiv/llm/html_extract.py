"""HTML extraction: boosted trees score DOM nodes, and a tree-wide decoding picks the text.

Every block element, and every inline element with a class or an id, is a node.  Trees
over its tag, attribute tokens, depth, siblings and subtree densities give log odds of
being article text.  The decoding maximises their sum under the rule that nothing below a
boilerplate node is content, so ancestors and descendants never contradict each other.

The trees learn from a bounded sample of the pages themselves: landmark elements label
their subtrees, and variants of a page with other tags, class names and inserted notices,
forms and comments keep the trees from relying on one template.

Null html counts as empty and gives an empty text, as does a page without content; so
does every page when there is nothing to learn from but no landmark decides.  Repeated
rows each get their own, equal result; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subdiv.llm import text as X
from subdiv.session import materialize

#: Pages the trees are learned from, at most, and the shape of the ensemble.
LEARN_PAGES = 240
TREES, DEPTH = 12, 4

# Element and attribute vocabulary.
BLOCKS = set(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "label legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
POSITIVE = set("article articlebody body content entry main post prose single story text".split())
NEGATIVE = set(
    "ad ads advert advertisement aside author banner bar bio breadcrumb breadcrumbs byline caption comment comments consent cookie cookies copyright credits dialog discussion disclaimer disqus "
    "feedback foot footer form gdpr head header legal links login masthead menu meta modal more nav navbar navigation newsletter notice overlay pagination pager popup promo promoted recommended "
    "related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar top tracking widget".split()
)
_LANDMARK_UP, _LANDMARK_DOWN = {"article", "main"}, {"nav", "footer", "aside", "header", "form", "button", "select", "label", "menu", "dialog", "fieldset", "search"}
_CLOSES_P = BLOCKS - {"button", "label", "option"}
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|template|textarea|title|noscript|svg|iframe|object|canvas)(?=[\s/>])(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
#: Elements without an end tag that reach to the end of the page; of others like them only the tag is skipped.
_TO_THE_END = {"script", "style", "textarea", "title"}
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in "script style template textarea title noscript svg iframe object canvas".split()}
_ATTR = re.compile(r"([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?]")

FEATURES = [
    "is_p", "is_heading", "is_item", "is_box", "landmark_up", "landmark_down", "own_up", "own_down", "above_up", "above_down", "depth", "siblings", "place",
    "chars", "share", "link_share", "tags_per_char", "punctuation", "paragraphs", "chars_per_block", "before", "after", "sign",
]


class Node:
    __slots__ = ("tag", "parent", "children", "up", "down", "depth", "chars", "linked", "tags", "marks", "paragraphs", "blocks", "sign", "truth")

    def __init__(self, tag, parent, attrs=""):
        self.tag, self.parent, self.children = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.linked = self.marks = self.paragraphs = self.blocks = self.sign = 0
        self.tags, self.up, self.down, self.truth = 1, 0, 0, None
        if attrs:
            for m in _ATTR.finditer(attrs):
                name = m[1].lower()
                if name in ("class", "id", "role"):
                    words = set(_WORDS.findall(_CAMEL.sub(" ", m[2] or m[3] or m[4] or "").lower()))
                    self.up += len(words & POSITIVE)
                    self.down += len(words & NEGATIVE)
                elif name == "data-truth":
                    self.truth = int(m[2])
        if parent:
            parent.children.append(self)
            if self.truth is None:
                self.truth = parent.truth


def tokens(page: str):
    """``(match, end)`` of every tag, comment and element whose inside is no text; a search for an end tag that fails is not repeated."""
    at, endless = 0, set()
    while m := _TOKEN.search(page, at):
        at = m.end()
        if m["raw"]:
            name = m["raw"].lower()
            if name in endless or name == "svg" and m[0].endswith("/>"):
                pass
            elif end := _RAW_END[name].search(page, at):
                at = end.end()
            elif name in _TO_THE_END:
                at = len(page)
            else:
                endless.add(name)
        yield m, at


def parse(page: str) -> tuple[list[Node], list[tuple[int, str, int]]]:
    """Nodes, parents before children, and text pieces ``(node number, text, block number)``."""
    root = Node("html", None)
    nodes, number, stack, pieces = [root], {id(root): 0}, [(root, "html")], []
    block, links, at = 0, 0, 0
    # ``stack`` holds (node of the text, tag), also of inline elements that are no nodes of their own

    def add(text):
        if text.strip():
            node = stack[-1][0]
            text = entities.unescape(text) if "&" in text else text
            pieces.append((number[id(node)], text, block))
            n = len(text)
            node.chars += n
            node.linked += n if links else 0
            node.marks += len(_PUNCTUATION.findall(text))
            node.sign |= "©" in text
        elif text and pieces:
            pieces.append((number[id(stack[-1][0])], " ", block))

    for m, end in tokens(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = end
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        is_block = tag in BLOCKS
        if m["end"]:
            if is_block:
                block += 1
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    links -= sum(t == "a" for _, t in stack[k:])
                    del stack[k:]
                    break
                if not is_block and stack[k][1] in BLOCKS:
                    break  # an inline end tag closes nothing outside its block
            continue
        if tag == "br":
            add(" ")
            pieces and pieces.append((number[id(stack[-1][0])], " ", block))
            continue
        if tag in VOID and tag != "hr":
            continue
        if is_block:
            block += 1
            if tag in _CLOSES_P:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == "p":
                        links -= sum(t == "a" for _, t in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][1] in BLOCKS:
                        break
            if tag in _SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == tag or stack[k][1] in ("td", "th") and tag in ("td", "th"):
                        links -= sum(t == "a" for _, t in stack[k:])
                        del stack[k:]
                        break
                    if stack[k][1] in _SAME[tag]:
                        break
        if tag in ("html", "body", "hr", "head"):
            continue
        attrs = m["attrs"]
        if is_block or (attrs and ("class" in attrs or "id=" in attrs)):
            node = Node(tag, stack[-1][0], attrs)
            number[id(node)] = len(nodes)
            nodes.append(node)
        else:
            node = stack[-1][0]
            node.tags += 1
        if not attrs.endswith("/") or is_block:
            stack.append((node, tag))
            links += tag == "a"
    if at < len(page):
        add(page[at:])
    return nodes, pieces


def node_features(nodes: list[Node]) -> np.ndarray:
    for node in reversed(nodes):
        node.paragraphs += node.tag == "p"
        node.blocks += node.tag in BLOCKS and node.chars > 0
        if p := node.parent:
            p.chars += node.chars
            p.linked += node.linked
            p.tags += node.tags
            p.marks += node.marks
            p.paragraphs += node.paragraphs
            p.blocks += node.blocks
            p.sign |= node.sign
    whole = max(1, nodes[0].chars)
    above: dict[int, tuple[int, int]] = {}
    rows = []
    for node in nodes:
        up, down = above[id(node.parent)] if node.parent else (0, 0)
        land_up, land_down = node.tag in _LANDMARK_UP, node.tag in _LANDMARK_DOWN
        above[id(node)] = (up + land_up + (node.up > 0), down + land_down + (node.down > 0))
        siblings = node.parent.children if node.parent else [node]
        rows.append(
            [
                node.tag == "p", node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), node.tag in ("li", "td", "dd", "dt"), node.tag in ("div", "section", "article", "main"),
                land_up, land_down, node.up, node.down, up, down, node.depth, len(siblings), 0.0,
                np.log1p(node.chars) if node.chars else 0.0, node.chars / whole, node.linked / max(1, node.chars), node.tags / (node.chars + 20), node.marks / max(1, node.chars),
                node.paragraphs, node.chars / max(1, node.blocks), 0.0, 0.0, node.sign,
            ]
        )
    out = np.array(rows, dtype=np.float64)
    index = {id(n): i for i, n in enumerate(nodes)}
    for node in nodes:
        kids = [index[id(c)] for c in node.children]
        if kids:
            sizes = np.array([nodes[i].chars for i in kids], dtype=np.float64)
            out[kids, 12] = np.arange(len(kids)) / len(kids)
            out[kids[1:], 20] = np.log1p(sizes[:-1])
            out[kids[:-1], 21] = np.log1p(sizes[1:])
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Labels of greatest total log odds in which no content lies below boilerplate; the root is open."""
    index = {id(n): i for i, n in enumerate(nodes)}
    gain = odds.copy()  # of calling the node content and choosing best below, over boilerplate all through
    gain[0] = 0.0
    for i in range(len(nodes) - 1, 0, -1):
        if gain[i] > 0:
            gain[index[id(nodes[i].parent)]] += gain[i]
    content = np.zeros(len(nodes), dtype=bool)
    content[0] = True
    for i in range(1, len(nodes)):
        content[i] = gain[i] > 0 and content[index[id(nodes[i].parent)]]
    return content


def text_of(pieces: list[tuple[int, str, int]], content: np.ndarray) -> str:
    """Text of content nodes: white space inside a block as one blank, blocks joined by a line break."""
    out, now, parts = [], None, []
    for node, text, block in [*pieces, (0, "", -1)]:
        if block != now:
            joined = " ".join("".join(parts).split())
            if joined:
                out.append(joined)
            now, parts = block, []
        if content[node]:
            parts.append(text)
    return "\n".join(out)


class Trees:
    """Boosted trees as arrays, for whole batches of nodes."""

    def __init__(self, trees, weights):
        self.trees = []
        for tree, weight in zip(trees, weights):
            rows: list[list[float]] = []

            def walk(node):
                i = len(rows)
                rows.append([-1, 0.0, 0, 0, node.prediction() * weight])
                if node.numDescendants() > 0:
                    split = node.split()
                    rows[i][:2] = [split.featureIndex(), float(split.threshold())]
                    rows[i][2] = walk(node.leftChild())
                    rows[i][3] = walk(node.rightChild())
                return i

            walk(tree._call_java("rootNode"))
            self.trees.append(np.array(rows))

    def odds(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                feature = t[at, 0].astype(np.int64)
                left = x[np.arange(len(x)), np.maximum(feature, 0)] <= t[at, 1]
                at = np.where(feature < 0, at, np.where(left, t[at, 2], t[at, 3]).astype(np.int64))
            total += t[at, 4]
        return 2 * total


# How variants of a learning page name its landmarks; then what they insert.
_RENAMED = [
    {},
    {"article": 'div class="post-content"', "nav": 'div class="menu"', "footer": 'div class="footer"', "ad": 'div class="sponsored"'},
    {"article": 'section id="main"', "nav": 'div id="navbar"', "footer": 'div id="page-footer"', "ad": 'aside class="widget"'},
    {"article": 'main class="entry"', "nav": 'header class="site-header"', "footer": 'footer class="legal"', "ad": 'section class="promo-banner"'},
    {"article": "div", "nav": "div", "footer": "footer", "ad": 'aside'},
    {"article": "article", "nav": "nav", "footer": "footer", "ad": 'div class="newsletter-signup"'},
]
_INSERTED = [
    ('<div class="comments" data-truth="0"><h3>Comments</h3><p>{0}</p><p>{1}</p></div>', True),
    ('<section id="comments" data-truth="0"><ul><li><p>{0}</p></li><li><p>{1}</p></li></ul></section>', False),
    ('<div class="cookie-notice" data-truth="0">{0}</div>', False),
    ('<form action="/s" data-truth="0"><label>{2}</label><button>{2}</button></form>', True),
    ('<aside class="sidebar" data-truth="0"><h2>{2}</h2><p>{0}</p></aside>', False),
    ('<div class="related" data-truth="0"><ul><li><a href="/x">{1}</a></li><li><a href="/y">{0}</a></li></ul></div>', True),
    ('<header data-truth="0"><h1>{2}</h1><p>{1}</p></header>', False),
    ('<div class="share-bar" data-truth="0"><a href="/s">{2}</a></div>', True),
    ('<div class="ad" data-truth="0">{1}</div>', True),
]
# Other forms of a paragraph of the article.
_RESHAPED = [
    "<ul><li>{0}</li><li>{1}</li><li>{0}</li></ul>",
    "<blockquote>{0}</blockquote>",
    "<table><tr><td>{0}</td><td>{1}</td></tr><tr><td>{1}</td><td>{0}</td></tr></table>",
    "<div>{0}</div><h2>{1}</h2>",
    "<ol><li><p>{0}</p></li><li>{1}</li></ol>",
    '<div class="section"><h3>{1}</h3><p>{0} <a href="/r">{1}</a></p></div><pre>{1}</pre>',
    "<figure><p>{1}</p></figure><dl><dt>{1}</dt><dd>{0}</dd></dl>",
]


def learning_variants(page: str) -> list[str]:
    """The page under each naming, landmarks marked with their truth, and boilerplate put in from its own words."""
    texts = [" ".join(t.split()) for t in re.findall(r"<p>([^<]{20,})", page)] or ["-"]
    out = []
    for k, names in enumerate(_RENAMED):
        new = page
        for tag in ("article", "nav", "footer"):
            name = names.get(tag, tag)
            new = re.sub(rf"<{tag}\b[^>]*>", f'<{name} data-truth="{int(tag == "article")}">', new)
            new = new.replace(f"</{tag}>", f"</{name.split(' ')[0]}>")
        ad = names.get("ad", 'div class="ad"')
        new = re.sub(r'<div class="ad">(.*?)</div>', lambda m: f'<{ad} data-truth="0">{m[1]}</{ad.split(" ")[0]}>', new, flags=re.S)
        shaped = iter(range(3))  # some paragraphs in other forms

        def reshape(m):
            turn = next(shaped, None)
            if turn is None or k == 0:
                return m[0]
            words = m[1].split()
            cut_ = max(1, len(words) * (1 + turn) // 4)
            return m[0] + _RESHAPED[(k + 2 * turn) % len(_RESHAPED)].format(" ".join(words[cut_:]) or m[1], " ".join(words[:cut_]))

        new = re.sub(r"<p>([^<{}]{20,}?)</p>", reshape, new)
        close = f"</{names.get('article', 'article').split(' ')[0]}>"
        for j in (k, k + 3, k + 6):
            form, inside = _INSERTED[j % len(_INSERTED)]
            a, b = texts[j % len(texts)], texts[(j + 1) % len(texts)]
            block = form.format(a, b, " ".join(a.split()[:2]))
            where = new.rfind(close)
            if where >= 0:
                middle = new.find("</p>", len(new) // 3, where) + 4 if j % 2 else 0
                where = (middle if middle > 4 else where) if inside else where + len(close)
                new = new[:where] + block + new[where:]
        out.append(new)
    return out


def learn(pages: DataFrame) -> Trees | None:
    """Fit the trees on a bounded sample of ``html``; None when no landmark labels anything."""

    def run(batch):
        rows = []
        for page in batch.column("html").to_pylist():
            for variant in learning_variants(page or ""):
                nodes, _ = parse(variant)
                features = node_features(nodes)
                rows += [(f.tolist(), float(n.truth)) for n, f in zip(nodes, features) if n.truth is not None and n.chars]
        return X.record_batch(x=pa.array([r[0] for r in rows], pa.list_(pa.float64())), label=pa.array([r[1] for r in rows], pa.float64()))

    rows = materialize(X.map_batches(pages.select("html"), run, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(4), "page-nodes")
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=3).fit(rows)
    return Trees(model.trees, model.treeWeights)


def landmark_odds(features: np.ndarray) -> np.ndarray:
    """Log odds from tags and attribute tokens alone, for tables that cannot teach the trees."""
    return np.where(features[:, 5] + features[:, 7] > 0, -1.0, np.where(features[:, 4] + features[:, 6] + features[:, 8] > 0, 1.0, 0.0))


def extract(pages: DataFrame, model: Trees | None) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def run(batch):
        texts = []
        pages_ = batch.column("html").to_pylist()
        for lo in range(0, len(pages_), 64):
            parsed = [parse(p or "") for p in pages_[lo : lo + 64]]
            features = [node_features(nodes) for nodes, _ in parsed]
            odds = landmark_odds(np.concatenate(features)) if model is None else model.odds(np.concatenate(features))
            ends = np.cumsum([len(f) for f in features])
            for (nodes, pieces), o in zip(parsed, np.split(odds, ends[:-1])):
                texts.append(text_of(pieces, decode(nodes, o)))
        return X.record_batch(page_id=batch.column("page_id"), url=batch.column("url"), text=pa.array(texts, pa.string()), n_chars=pa.array([len(t) for t in texts], pa.int64()))

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return X.map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ids = X.bounded_sample(pages.where(F.col("html").isNotNull()).select("page_id"), "page_id", LEARN_PAGES)
    sample = pages.select("page_id", "html").join(F.broadcast(ids.distinct()), "page_id")  # at most LEARN_PAGES ids
    return extract(pages, learn(sample))
