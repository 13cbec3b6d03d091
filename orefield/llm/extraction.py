"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded over the tree.

No page says what its main text is, so the trees learn from what markup itself tells: in a bounded
sample of the pages, the text under ``article`` or ``main`` is main text, unless an element that never
holds it (``nav``, ``footer``, ``aside``, ``form`` ...) lies between. Each sampled page is also used in
changed forms: with the telling elements renamed to ``div`` and with boilerplate of other pages put
beside and into the article, so that the model has to learn from density, links, attribute tokens,
depth and siblings, and meets notices, comments and forms that the sample may lack.

Decoding chooses the best labels of a whole tree, where below boilerplate there is only boilerplate.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm import dom
from orefield.llm.common import by_bytes, prepare, sampled

#: Pages of the sample, and the longest page in it (characters).
SAMPLE, SAMPLE_CHARS = 300, 20_000
ROUNDS, DEPTH, RATE, BINS, LEAF = 40, 4, 0.3, 32, 12.0
#: Characters of pages that are held as trees at once.
BATCH_CHARS = 1 << 20
#: Cost of taking a child out of main text, in log odds: a doubt alone does not tear an article.
CHANGE = 1.0


@dataclass
class Forest:
    """Trees of fixed depth over binned features."""

    edges: list[np.ndarray]
    features: np.ndarray  # round, inner node
    cuts: np.ndarray
    leaves: np.ndarray  # round, leaf
    base: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.features, self.cuts, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += leaf[at - len(feature)]
        return out


def boosted(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
    """Newton boosting of the logistic loss on histograms of the features."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
    n, d = binned.shape
    share = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
    base = float(np.log(share / (1 - share)))
    z, inner, found = np.full(n, base), 2**DEPTH - 1, []
    flat = binned + np.arange(d) * BINS
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(DEPTH):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                keys = flat[rows].ravel()
                gs = np.bincount(keys, np.repeat(g[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                hs = np.bincount(keys, np.repeat(h[rows], d), d * BINS).reshape(d, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                gain[(hs < LEAF / 4) | (ht - hs < LEAF / 4)] = 0
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-3 and b < len(edges[f]):
                    feature[node], cut[node] = f, edges[f][b]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaf = at - inner
        values = -np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
        z += RATE * values[leaf]
        found.append((feature, cut, RATE * values))
    return Forest(edges, *map(np.array, zip(*found, strict=True)), base)


NEVER = set("nav footer aside form menu dialog header".split())


def truth(tree: dom.Tree) -> np.ndarray:
    """Whether each node is main text, by its own element and those above; a marked node by its tokens."""
    out = np.zeros(len(tree.nodes), np.int64)
    for i, x in enumerate(tree.nodes):
        inside = out[x.parent.order] if x.parent else 0
        if x.tag in NEVER or x.bad > x.good:
            out[i] = -1
        elif inside < 0:
            out[i] = -1
        elif x.tag in ("article", "main") or inside:
            out[i] = 1
    return (out > 0).astype(float)


# Examples of what a page may hold beside its text; {0} is text of some page, {1} a token.
AROUND = [
    '<div class="{1}">{0}</div>', '<aside class="{1}"><h3>{0}</h3><ul><li><a href="#">{0}</a></li><li><a href="#">{0}</a></li></ul></aside>',
    '<section id="{1}"><p>{0}</p><p>{0}</p></section>', '<form class="{1}"><label>{0}</label><p>{0}</p></form>',
    '<div class="{1}"><div><p>{0}</p></div><div><p>{0}</p></div></div>', '<header class="{1}"><p>{0}</p></header>', '<div id="{1}"><a href="#">{0}</a> <a href="#">{0}</a></div>',
]
TOKENS = "ad advert banner comments comment-list cookie-notice footer header login menu nav newsletter notice promo related reader-comments search share sidebar social sponsored subscribe widget".split()


def variants(html: str, texts: list[str], rng: random.Random) -> list[str]:
    """The page, and two with boilerplate in and beside its article, the last to be ``renamed``."""

    def extra():
        words = rng.choice(texts).split()
        at = rng.randrange(max(1, len(words) - 5))
        return rng.choice(AROUND).format(" ".join(words[at : at + rng.randrange(4, 60)]), rng.choice(TOKENS))

    def put(page, mark, new, after=False):
        at = page.find(mark)
        at += len(mark) if after else 0
        return page if page.find(mark) < 0 else page[:at] + new + page[at:]

    full = put(put(put(html, "<article", extra()), "</article>", extra()), "</article>", extra(), True)
    full = put(full, "</p>", extra(), True) if rng.random() < 0.5 else full
    return [html, full, full]


def renamed(tree: dom.Tree, rng: random.Random) -> dom.Tree:
    """The same tree with telling elements as ``div``, some with telling tokens; called after ``truth``."""
    for x in tree.nodes:
        if x.tag in ("article", "main"):
            x.tag, x.good = "div", rng.choice((0, 0, 1, 2))
        elif x.tag in NEVER and rng.random() < 0.5:
            x.tag, x.bad = "div", rng.choice((0, 1, 1, 2))
    return tree


def learned(pages: DataFrame) -> Forest | None:
    """The model of a bounded sample: SAMPLE pages in order of a hash of the html."""
    short = pages.where(F.char_length("html").between(1, SAMPLE_CHARS))
    rows = sorted(sampled(short.select("html"), F.col("html"), SAMPLE).toArrow().column(0).to_pylist())
    rng, texts = random.Random(7), []
    for html in rows:
        texts += ["".join(parts) for _, parts in dom.parsed(html).runs if len("".join(parts)) > 30][:5]
    x, y, weight = [], [], []
    for html in rows if texts else []:
        for i, page in enumerate(variants(html, texts, rng)):
            tree = dom.parsed(page)
            labels = truth(tree)
            if not labels.any():
                break  # a page that does not tell is no example
            if i == 2:
                tree = renamed(tree, rng)
            x.append(dom.table(tree))
            y.append(labels)
            weight.append(np.array([1.0 + np.log1p(n.chars) if n.chars else 0.2 for n in tree.nodes]))
    if not y or not 0 < np.concatenate(y).mean() < 1:
        return None
    return boosted(np.concatenate(x), np.concatenate(y), np.concatenate(weight))


def decoded(tree: dom.Tree, odds: np.ndarray) -> np.ndarray:
    """Which nodes are main text, at the best sum of log odds over the tree.

    A node is a frame (its own text is none), main text or boilerplate. Below a frame there may be
    anything, below main text no frame, below boilerplate only boilerplate.
    """
    n = len(tree.nodes)
    weight = np.array([np.log1p(x.chars) for x in tree.nodes])
    frame, main, out = -odds * weight, odds * weight, -odds * weight
    for i in range(n - 1, 0, -1):
        up = tree.nodes[i].parent.order
        frame[up] += max(frame[i], main[i], out[i])
        main[up] += max(main[i], out[i] - CHANGE)
        out[up] += out[i]
    state = np.zeros(n, np.int64)  # 0 frame, 1 main, 2 boilerplate
    state[0] = int(np.argmax((frame[0], main[0], out[0])))
    for i in range(1, n):
        above = state[tree.nodes[i].parent.order]
        if above == 0:
            state[i] = int(np.argmax((frame[i], main[i], out[i])))
        elif above == 1:
            state[i] = 1 if main[i] >= out[i] - CHANGE else 2
        else:
            state[i] = 2
    return state == 1


def main_texts(pages: list[str], model: Forest | None) -> list[str]:
    """The main text of each page; the nodes of all pages go through the trees together."""
    trees = [dom.parsed(x) for x in pages]
    if model is None:  # nothing to learn from: what the elements say
        return [dom.blocks(t, truth(t) > 0) for t in trees]
    odds = model.odds(np.concatenate([dom.table(t) for t in trees]))
    ends = np.cumsum([len(t.nodes) for t in trees])
    return [dom.blocks(t, decoded(t, odds[end - len(t.nodes) : end])) for t, end in zip(trees, ends, strict=True)]


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row, from the whole page.

    A null or empty page, and one without main text, gives an empty text. Broken markup is read as far
    as it goes; unclosed elements end with their parent. Repeated rows are extracted each. An empty
    table gives no rows, and a table without any ``article`` or ``main`` is read by its element names.
    """
    prepare(pages.sparkSession)
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    model = learned(own)
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            pages, texts = batch.column(2).to_pylist(), []
            for some in by_bytes([len(x) for x in pages], BATCH_CHARS):
                texts += main_texts(pages[some], model)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    found = own.mapInArrow(run, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
