"""Main text of web pages by a tree-structured graphical model.

Each element that can hold a block of text is a node that is content or not. A node's own features give its unary
potential, and each parent-child edge a pairwise potential. Messages are passed from the leaves to the root and back
(sum-product), so a node's marginal takes in its own evidence, that of everything around it, and is exact on the tree.
Text of nodes whose marginal is at least one half is the main text.

The model is trained on pages that label themselves: in a bounded sample, elements under a sectioning element that says
what it holds (article, main; nav, header, footer, aside, form, ...) take its label, all others stay open. Weights start
from a prior over tag and class words and move only as far as the sample asks, so pages without such elements are
judged by the same features.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm.common import Memo, bounded_ids, table, texts
from gleaner.llm.registry import query

#: Pages the model learns from, all their nodes.
TRAIN_PAGES = 2_000

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
NAMES = re.compile(r"(?i)\b(?:class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "noembed", "noframes", "xmp", "svg", "math", "select", "button", "object", "canvas"}
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.IGNORECASE) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr", "param"}
BLOCKS = {
    "html", "body", "head", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt",
    "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address",
    "nav", "header", "footer", "aside", "form", "fieldset", "legend", "details", "summary", "center", "dialog", "menu", "hgroup", "search",
}
#: What a start tag ends if it is open: a paragraph ends at any block, an item or cell at the next one.
CLOSED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that an inner start tag's search for open ones does not leave.
SCOPES = {"table", "ul", "ol", "dl", "div", "article", "section", "main", "nav", "aside", "body", "html", "td", "th", "blockquote"}
LABELS = {
    "article": 1, "main": 1, "nav": 0, "header": 0, "footer": 0, "aside": 0, "form": 0, "menu": 0, "dialog": 0, "search": 0,
}

#: Prior weights of features, in log odds for content.
GOOD = "article main content post entry story body text paragraph blog news page prose"
BAD = (
    "nav navbar navigation menu menubar footer foot header head masthead topbar sidebar side aside ad ads adv advert adverts advertisement "
    "banner sponsor sponsored promo promotion notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus reply replies discussion respond related recommended share sharing social breadcrumb "
    "breadcrumbs pagination pager toolbar tags widget copyright legal disclaimer search form skip meta byline"
)
PRIOR = {f"name:{w}": 1.5 for w in GOOD.split()} | {f"name:{w}": -7.0 for w in BAD.split()} | {
    "tag:body": 4.0, "tag:article": 4.0, "tag:main": 4.0, "tag:p": 1.0, "tag:li": 1.2, "tag:ul": 1.0, "tag:ol": 1.0, "tag:td": 1.0, "tag:tr": 0.5, "tag:table": 0.5, "tag:h1": 1.0, "tag:h2": 0.5, "tag:blockquote": 1.0, "tag:pre": 1.0, "tag:nav": -8.0,
    "tag:header": -5.0, "tag:footer": -8.0, "tag:aside": -6.0, "tag:form": -6.0, "tag:menu": -6.0, "tag:dialog": -6.0, "tag:search": -6.0,
    "tag:address": -1.0, "tag:fieldset": -4.0, "links:most": -2.0, "links:some": -0.5, "length:long": 1.0, "length:middle": 0.5,
}
#: Prior log potentials of (parent, child). What holds content counts as content, so menus and notices do stand below it,
#: but content hardly ever stands below what is none.
EDGE = np.log(np.array([[0.995, 0.005], [0.4, 0.6]]))
#: Log odds of the root: most pages hold content.
ROOT_PRIOR = 6.0
#: Nodes that the sample weighs as much as, against the prior of the weights and of the edges.
SAMPLE_NODES, SAMPLE_EDGES, PRIOR_EDGES = 50.0, 5.0, 20.0


class Node:
    __slots__ = ("tag", "parent", "features", "label", "chars", "linked")

    def __init__(self, tag: str, parent: int, names: str, label: int | None):
        self.tag, self.parent, self.label = tag, parent, label
        self.features = [f"tag:{tag}", *sorted({f"name:{w.lower()}" for w in NAME_PARTS.findall(names)})] if names else [f"tag:{tag}"]
        self.chars = self.linked = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Nodes in page order, parents first, and the text runs (node, text) between block edges; one pass over the page."""
    nodes, runs = [Node("html", -1, "", None)], []
    open_: list[tuple[str, int]] = [("html", 0)]  # open blocks: tag, node
    times: Counter = Counter()  # how often a tag is open below the root
    held: list[str] = []
    linked, at, end = 0, 0, len(html)

    def flush() -> None:
        if held:
            text = " ".join(unescape("".join(held)).split())
            held.clear()
            if text:
                runs.append((open_[-1][1], text))
                nodes[open_[-1][1]].chars += len(text)

    def end_one() -> str:
        flush()
        tag = open_.pop()[0]
        times[tag] -= 1
        return tag

    def close(tag: str) -> None:
        if times[tag]:  # an end tag that ends nothing costs nothing, any other takes blocks off for good
            while end_one() != tag:
                pass

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            held.append(html[at:])
            break
        if lt > at:
            held.append(html[at:lt])
            if linked:
                nodes[open_[-1][1]].linked += lt - at
        m = TAG.match(html, lt)
        if m is None:
            following = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                stop = html.find("-->", lt + 4)
                at = end if stop < 0 else stop + 3
            elif following in ("!", "?") or (following == "/" and not html[lt + 2 : lt + 3].isspace()):
                stop = html.find(">", lt)
                at = end if stop < 0 else stop + 1
            elif following.isalpha():
                stop = html.find(">", lt)  # an unclosed quote: the tag ends at the first bracket, or with the page
                at = end if stop < 0 else stop + 1
            else:
                held.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m.group(2).lower()
        if m.group(1):
            if tag == "a":
                linked = max(0, linked - 1)
            elif tag in BLOCKS:
                close(tag)
            continue
        if tag in RAW:
            if not m.group(3).endswith("/") or tag not in ("svg", "math"):
                stop = RAW_END[tag].search(html, at)
                if stop is None:
                    at = end
                else:
                    gt = html.find(">", stop.start())
                    at = end if gt < 0 else gt + 1
            held.append(" ")
        elif tag == "br" or tag == "hr":
            held.append("\n")
        elif tag == "a":
            linked += 1
        elif tag in BLOCKS and tag != "html":
            if open_[-1][0] == "p":
                end_one()
            ended = CLOSED_BY.get(tag)
            if ended:
                while open_[-1][0] in ended:
                    end_one()
            flush()
            linked = 0
            parent = open_[-1][1]
            names = ""
            if m.group(3):
                names = " ".join(next(filter(None, n), "") for n in NAMES.findall(m.group(3)))
            label = LABELS.get(tag)
            if label is None or (nodes[parent].label == 0):
                label = nodes[parent].label
            nodes.append(Node(tag, parent, names, label))
            open_.append((tag, len(nodes) - 1))
            times[tag] += 1
    flush()
    for node in nodes:
        if node.chars:
            share = node.linked / node.chars
            node.features.append("links:most" if share > 0.6 else "links:some" if share > 0.2 else "links:few")
            node.features.append("length:long" if node.chars > 160 else "length:middle" if node.chars > 40 else "length:short")
    return nodes, runs


class Model:
    def __init__(self, weights: dict[str, float], edge: np.ndarray):
        self.weights = weights
        self.edge = np.exp(edge).tolist()
        self.unary = Memo(lambda key: float(np.exp(min(30.0, max(-30.0, sum(weights.get(f, 0.0) for f in key))))), 50_000)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Probability of content for every node: sum-product, leaves to root, then root to leaves."""
        (e00, e01), (e10, e11) = self.edge
        n = len(nodes)
        own = [self.unary[tuple(node.features)] for node in nodes]
        zero, one = [1.0] * n, own[:]
        one[0] *= float(np.exp(ROOT_PRIOR))
        up0, up1 = [1.0] * n, [1.0] * n
        for i in range(n - 1, 0, -1):
            s = zero[i] + one[i]
            z, o = zero[i] / s, one[i] / s
            up0[i], up1[i] = e00 * z + e01 * o, e10 * z + e11 * o
            p = nodes[i].parent
            zero[p] *= up0[i]
            one[p] *= up1[i]
            s = zero[p] + one[p]
            zero[p], one[p] = zero[p] / s, one[p] / s
        belief = [0.0] * n
        belief[0] = one[0] / (zero[0] + one[0])
        for i in range(1, n):
            p = nodes[i].parent
            # the parent's belief without what this child told it
            z, o = (1.0 - belief[p]) / up0[i], belief[p] / up1[i]
            down0, down1 = z * e00 + o * e10, z * e01 + o * e11
            z, o = zero[i] * down0, one[i] * down1
            belief[i] = o / (z + o)
        return belief

    def extract(self, html: str | None) -> str:
        if not html:
            return ""
        nodes, runs = parse(html)
        belief = self.marginals(nodes)
        return "\n".join(text for node, text in runs if belief[node] >= 0.5)


def labelled_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(features, parent label, label, n) over labelled nodes of the sample, equal ones counted together."""
    seen: dict[tuple, int] = {}
    for batch in batches:
        for html in texts(batch.column(0)):
            nodes, _ = parse(html or "")
            for node in nodes:
                if node.label is not None:
                    above = nodes[node.parent].label
                    key = (" ".join(node.features), -1 if above is None else above, node.label)
                    seen[key] = seen.get(key, 0) + 1
        if len(seen) > 50_000:
            yield _rows(seen)
            seen = {}
    yield _rows(seen)


def _rows(seen: dict[tuple, int]) -> pa.RecordBatch:
    columns = zip(*seen) if seen else ((), (), ())
    kinds = (pa.string(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [*(pa.array(c, t) for c, t in zip(columns, kinds)), pa.array(list(seen.values()), pa.int64())], names=["features", "above", "label", "n"],
    )


def train(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = TRAIN_PAGES) -> Model:
    """Fit on the pages of at most ``rows`` ids of the smallest hash; without labelled pages the prior stands.

    Weights are the maximum of the logistic likelihood of the labelled nodes under a Gaussian prior around ``PRIOR``; edge
    potentials are smoothed counts of labelled parents and children.
    """
    ids = bounded_ids(pages, key, rows)
    sample = pages.join(F.broadcast(ids), F.col(key) == F.col("_key"), "left_semi").select(html)
    counted = sample.mapInArrow(labelled_nodes, "features string, above int, label int, n bigint").groupBy("features", "above", "label")
    found = counted.agg(F.sum("n").alias("n")).orderBy("features", "above", "label").collect()  # nodes of ``rows`` pages at most
    names = sorted({f for r in found for f in r.features.split(" ")} | PRIOR.keys())
    place = {f: i for i, f in enumerate(names)}
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    if not found:
        return Model(dict(PRIOR), EDGE)
    at = [np.array([place[f] for f in r.features.split(" ")]) for r in found]
    flat, owner = np.concatenate(at), np.repeat(np.arange(len(at)), [len(a) for a in at])
    n = np.array([r.n for r in found], float)
    n *= min(1.0, SAMPLE_NODES / n.sum())
    label = np.array([r.label for r in found], float)
    weights = prior.copy()
    for _ in range(500):
        odds = np.bincount(owner, weights[flat], len(at))
        miss = n * (label - 1 / (1 + np.exp(-odds)))
        weights += 0.05 * (np.bincount(flat, miss[owner], len(names)) - (weights - prior))
    edge = np.exp(EDGE) * PRIOR_EDGES
    pairs = [r for r in found if r.above >= 0]
    for r in pairs:
        edge[r.above, r.label] += SAMPLE_EDGES * r.n / sum(x.n for x in pairs)
    return Model(dict(zip(names, weights.tolist())), np.log(edge / edge.sum(axis=1, keepdims=True)))


def extract_text(df: DataFrame, model: Model, html: str = "html", out: str = "text") -> DataFrame:
    """Add ``out``: the main text, blocks in page order joined by a line feed; empty for null, empty or text-free pages.

    Only the page is read: equal pages give equal texts, other columns pass as they are. Pages never meet; a page is read
    once, from its first to its last character.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights, np.log(model.edge)))

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.array([own.extract(t) for t in texts(batch)], pa.string())

    return df.withColumn(out, run(F.col(html)))


@query("op5_html_extraction")
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_text(pages, train(pages))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
