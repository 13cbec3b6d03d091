"""Pages as trees of block elements, their features and their text."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
SILENT = set("head script style noscript template svg iframe object select textarea button title option datalist canvas audio video math".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
HEADS = set("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the value ends an open element of the key.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}}
KEEPS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
TAGS = (
    "article main section div p h1 h2 h3 li ul ol nav header footer aside form table td blockquote pre figure dd dl body html"
).split()
#: Attribute tokens that speak for or against main text, as whole tokens: in singular and plural, and a few compounds.
GOOD = frozenset(
    "article articles content contents entry entries main post posts story stories text texts body page pages prose lead leads paragraph "
    "paragraphs articlebody articlecontent articletext bodytext entrycontent maincontent maintext pagecontent postbody postcontent storybody".split()
)
BAD = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner banners breadcrumb breadcrumbs byline bylines comment "
    "comments commentform commentlist contact contacts cookie cookies consent disqus foot footer footers form forms gdpr head header headers "
    "hidden legal login masthead menu menus menubar meta metadata modal modals nav navs navbar navigation newsletter newsletters notice notices "
    "outbrain overlay overlays pager pagers pagination popup popups promo promos promotion promotions reader readers recommend recommended "
    "recommendation recommendations related reply replies respond response responses search searchbar searchbox searchform share shares sharebar "
    "sharing shop shops side sidebar sidebars signup skip skiplink skiplinks social sponsor sponsors sponsored subscribe subscription tag tags "
    "tagcloud taboola teaser teasers toolbar toolbars tracking widget widgets".split()
)
TOKEN = re.compile(r"[A-Za-z]+")
WORD = re.compile(r"\w+")


class Node:
    __slots__ = ("tag", "parent", "children", "pieces", "good", "bad", "depth", "chars", "link", "order")

    def __init__(self, tag, parent, good=0, bad=0):
        self.tag, self.parent, self.good, self.bad = tag, parent, good, bad
        self.children, self.pieces, self.chars, self.link = [], [], 0, 0
        self.depth = parent.depth + 1 if parent else 0


def attribute_tokens(attrs) -> tuple[int, int]:
    good = bad = 0
    for name, value in attrs:
        if name in ("class", "id", "role", "itemprop", "aria-label") and value:
            for x in TOKEN.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value)):
                good += x.lower() in GOOD
                bad += x.lower() in BAD
    return good, bad


class Tree(HTMLParser):
    """Block elements only; the text of inline elements belongs to the block around it.

    ``runs`` lists (node, text) in page order: consecutive text of one block without a block between.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", None)
        self.nodes, self.stack, self.runs, self.silent, self.links = [self.root], [], [], 0, 0
        #: Places in the stack of each open tag, of blocks and of silent elements: what an end tag meets is found at once.
        self.places, self.blocks, self.mute = defaultdict(list), [], []
        self.push("html", self.root)
        self.fresh = True

    def push(self, tag, node):
        at = len(self.stack)
        self.stack.append((tag, node))
        self.places[tag].append(at)
        if tag in BLOCKS:
            self.blocks.append(at)
        if node is None:
            self.mute.append(at)

    def last(self, tags) -> int:
        """The innermost open element with one of these tags, not counting the root; 0 where there is none."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def handle_starttag(self, tag, attrs):
        if self.silent:
            if tag in SILENT and tag not in VOID:
                self.push(tag, None)
                self.silent += 1
            return
        if tag == "br":
            self.text(" ")
            return
        if tag in VOID:
            self.fresh |= tag == "hr"
            return
        if tag in SILENT:
            self.push(tag, None)
            self.silent = 1
            return
        if tag in ("html", "body") and self.places[tag]:
            return
        if tag in BLOCKS:
            self.implied(tag)
            node = Node(tag, self.stack[-1][1], *attribute_tokens(attrs))
            node.parent.children.append(node)
            self.nodes.append(node)
            self.push(tag, node)
            self.fresh = True
        else:
            self.links += tag == "a"
            self.push(tag, self.stack[-1][1])

    def implied(self, tag):
        """Close what a new block ends: an open paragraph, and items of the same list."""
        inner = self.blocks[-1]
        if self.stack[inner][0] == "p":
            self.cut(inner)
        if tag in ENDS and (open_ := self.last(ENDS[tag])) > self.last(KEEPS[tag]):
            self.cut(open_)

    def cut(self, i):
        for tag, node in self.stack[i:]:
            self.links -= tag == "a"
            self.silent -= node is None and self.silent > 0
            self.fresh |= tag in BLOCKS
            self.places[tag].pop()
        for found in (self.blocks, self.mute):
            while found and found[-1] >= i:
                found.pop()
        del self.stack[i:]

    def handle_endtag(self, tag):
        if tag == "br":
            self.text(" ")
            return
        self.fresh |= tag == "p"  # also one that closes nothing
        at = self.last((tag,))
        # An inline end tag does not reach out of its block, nor another one out of a silent element.
        if not at or (tag not in BLOCKS and self.blocks[-1] > at):
            return
        if self.silent and tag not in ("body", "html") and self.mute and self.mute[-1] > at:
            return
        self.cut(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if not self.silent:
            self.text(data)

    def text(self, data):
        node = self.stack[-1][1]
        if self.silent or node is None:
            return
        if self.runs and not self.fresh and self.runs[-1][0] is node:
            self.runs[-1][1].append(data)
        else:
            self.runs.append((node, [data]))
        self.fresh = False
        n = len(data.strip())
        node.chars += n
        node.link += n if self.links else 0


def parsed(html: str) -> Tree:
    tree = Tree()
    tree.feed(html)
    tree.close()
    for i, x in enumerate(tree.nodes):
        x.order = i
    return tree


def blocks(tree: Tree, chosen) -> str:
    """The text of the chosen nodes: white space of a block as one space, blocks joined by new lines."""
    found = (" ".join("".join(parts).split()) for node, parts in tree.runs if chosen[node.order])
    return "\n".join(x for x in found if x)


FEATURES = [
    "depth", "good", "bad", "good above", "bad above", "chars", "subtree chars", "subtree density", "link share", "subtree link share",
    "words per block", "end marks", "share of page", "place in page", "siblings", "place among siblings", "share of siblings' text",
    "same tag siblings", "before", "after", *(f"tag {t}" for t in TAGS), *(f"above {t}" for t in TAGS[:17]),
]


def table(tree: Tree) -> np.ndarray:
    """A row of FEATURES for each node."""
    nodes, n = tree.nodes, len(tree.nodes)
    own = np.array([[x.chars, x.link] for x in nodes], float)
    marks, words = np.zeros(n), np.zeros(n)
    for node, parts in tree.runs:
        t = "".join(parts)
        marks[node.order] += t.count(". ") + t.count("! ") + t.count("? ") + t.rstrip().endswith((".", "!", "?"))
        words[node.order] += t.count(" ") + 1
    sums = np.column_stack((own, marks, words, np.ones(n)))
    for i in range(n - 1, 0, -1):  # children come after their parent
        sums[nodes[i].parent.order] += sums[i]
    page, out = max(1.0, sums[0, 0]), np.zeros((n, len(FEATURES)))
    seen = 0.0
    at = len(FEATURES) - len(TAGS) - 17
    above = np.zeros((n, 17))
    places, same = [0] * n, [1] * n
    for x in nodes:
        tags = Counter(c.tag for c in x.children)
        for j, c in enumerate(x.children):
            places[c.order], same[c.order] = j, tags[c.tag]
    for i, x in enumerate(nodes):
        p = x.parent
        k, place, alike = len(p.children) if p else 1, places[i], same[i]
        near = [sums[p.children[j].order, 0] if p and 0 <= j < k else 0.0 for j in (place - 1, place + 1)]
        up = p.order if p else 0
        if p:
            above[i] = above[up]
            if p.tag in TAGS[:17]:
                above[i, TAGS.index(p.tag)] = 1
        out[i, :at] = (
            x.depth, x.good, x.bad, out[up, 3] + (p.good if p else 0), out[up, 4] + (p.bad if p else 0), own[i, 0], sums[i, 0],
            sums[i, 0] / sums[i, 4], own[i, 1] / max(1.0, own[i, 0]), sums[i, 1] / max(1.0, sums[i, 0]), sums[i, 3] / sums[i, 4],
            sums[i, 2] / max(1.0, sums[i, 3]), sums[i, 0] / page, seen / page, k, place / k,
            sums[i, 0] / max(1.0, sums[up, 0]), alike / k, near[0], near[1],
        )
        if x.tag in TAGS:
            out[i, at + TAGS.index(x.tag)] = 1
        seen += own[i, 0]
    out[:, at + len(TAGS):] = above
    return out
