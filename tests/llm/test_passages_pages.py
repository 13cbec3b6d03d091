import random

import numpy as np

from orefield.llm import decontamination as dc
from orefield.llm import dom, extraction


def sentence(rng, n):
    return [f"{rng.choice(['ka', 'lo', 'mi', 'tu'])}{rng.randrange(400)}" for _ in range(n)]


def edits(words, k, rng):
    out = list(words)
    for _ in range(k):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[at : at + (kind != 0)] = [] if kind == 1 else [f"new{rng.randrange(10**6)}"]
    return out


def brute(docs, items):
    out = {}
    for key, text in docs:
        words = dc.words_of(text or "")
        for item, it in items:
            own = dc.words_of(it or "")
            if not own:
                continue
            ids = {w: i + 1 for i, w in enumerate(dict.fromkeys(own))}
            n, _ = dc.best_match(np.array([ids[w] for w in own]), np.array([ids.get(w, 0) for w in words], np.int64))
            if n <= dc.edit_limit(len(own)):
                out[key, item] = n
    return out


def test_exact_edit_distance():
    rng = random.Random(1)
    for _ in range(200):
        a = [rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))]
        b = [rng.randrange(0, 5) for _ in range(rng.randrange(0, 14))]
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        edits_found, end = dc.best_match(np.array(a), np.array(b, np.int64))
        assert edits_found == min(row) and (end == row.index(min(row)) or edits_found == len(a))


def test_recall_against_brute_force(spark, table):
    rng = random.Random(2)
    items = [(i, " ".join(sentence(rng, n))) for i, n in enumerate([16, 20, 25, 33, 40, 59] * 4)] + [(90, "tiny one here"), (91, None), (92, " ")]
    docs = []
    for i in range(300):
        item = items[rng.randrange(24)][1].split()
        k = rng.randrange(dc.edit_limit(len(item)) + 4)
        docs.append((i, " ".join(sentence(rng, rng.randrange(60)) + edits(item, k, rng) + sentence(rng, rng.randrange(60))).title()))
    docs += [(900, "well, Tiny ONE: here!"), (901, "tiny other one here"), (902, items[3][1]), (903, None), (904, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in dc.passages(table(docs), bench).collect()}
    want = brute(docs, items)
    assert set(found) <= set(want)
    assert all(found[k].edits == want[k] for k in found)
    assert len(found) >= 0.95 * len(want) and all(k in found for k, n in want.items() if n == 0)
    r = found[902, 3]
    assert (r.start, r.end, r.edits) == (0, 33, 0)
    kept = {r.doc_id for r in dc.clean(table(docs), bench).collect()}
    assert kept == {k for k, _ in docs} - {k for k, _ in found}


def test_items_in_several_blocks(spark, table, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    rng = random.Random(3)
    items = [(i, " ".join(sentence(rng, 20))) for i in range(12)]
    docs = [(i, " ".join(sentence(rng, 9)) + " " + t) for i, t in items]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in dc.passages(table(docs), bench).collect()} == {(i, i) for i in range(12)}


def test_recall_for_every_length():
    """Passages at the edit limit, in a text of 3,000 words; beyond the reach of the keys all windows are verified."""
    rng = np.random.default_rng(12)
    for n, least in ((15, 0.9), (100, 0.9), (400, 0.9), (1000, 1.0)):
        items = [" ".join(f"w{v}" for v in rng.integers(0, 5000, n)) for _ in range(10)]
        index = dc.Index.of(list(range(10)), items)
        group = index.classes[n]
        assert bool(group.keys) == (group.reached >= dc.RECALL) and (n > 100 or group.keys)
        hits = 0
        for i in range(10):
            own = index.items[i].tolist()
            for _ in range(dc.edit_limit(n)):
                kind, at = rng.integers(3), int(rng.integers(len(own)))
                own[at : at + (kind != 0)] = [] if kind == 1 else [0]
            text = np.concatenate([np.zeros(800, np.int64), own, np.zeros(2000 - n, np.int64)])
            rows = dc.matches(index, text, np.zeros(len(text), np.int64), np.array([0]), np.array([len(text)]))
            hits += any(item == i and edits <= dc.edit_limit(n) for _, item, _, _, edits in rows)
        least = least if group.keys else 1.0
        assert hits >= least * 10, (n, hits, group.reached)


def test_passages_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the same words in the same order make the very same text")], "item_id long, text string")
    empty = bench.limit(0)
    assert sorted(r.doc_id for r in dc.passages(odd, bench).collect()) == [4, 5, 5]
    assert dc.passages(odd, empty).count() == 0 and dc.passages(none, bench).count() == 0
    assert dc.clean(odd, bench).count() == 7 and dc.clean(odd, empty).count() == 10


PAGE = (
    "<html><head><title>t {0}</title><style>p{{}}</style><script>var x='<p>no</p>';</script></head><body>"
    "<nav><ul><li><a href='/'>Home {0}</a></li><li><a href='/b'>Shop</a></li></ul></nav>"
    "<article><h1>Title {0}</h1><p><b>First &amp; foremost, page {0} tells of many\n  things.<br><p>Second&nbsp;part with words enough to look like prose, {0}.</p>"
    "<p>Third part goes on, and on, with more to read in page {0}. It ends here.</p></article>"
    "<footer>&copy; site {0} <a href='/c'>Imprint</a></footer></body></html>"
)
TEXT = "Title {0}\nFirst & foremost, page {0} tells of many things.\nSecond part with words enough to look like prose, {0}.\nThird part goes on, and on, with more to read in page {0}. It ends here."


def pages(spark, htmls):
    rows = [(i, f"http://h/{i}", h, "x", 1) for i, h in enumerate(htmls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")


def test_main_text(spark):
    htmls = [PAGE.format(i) for i in range(60)]
    cut = PAGE.format(77).split("</article>")[0]
    htmls += [cut, PAGE.format(78).replace("<article>", '<div class="post-content">').replace("</article>", "</div>"), "", None, "just text", "<p>", "<script>x"]
    extra = '<aside class="sidebar"><h3>More</h3><ul><li><a href="#">Other thing</a></li></ul></aside><div class="cookie-notice">We use cookies.</div>'
    comments = '<section class="comments"><p>I liked it a lot, said a reader.</p><p>Me too!</p></section><form><label>Name</label><input></form>'
    htmls.append(PAGE.format(79).replace("<article>", extra + "<article>").replace("</article>", comments + "</article>"))
    found = {r.page_id: r for r in extraction.extracted(pages(spark, htmls)).collect()}
    assert len(found) == len(htmls)
    for i in range(60):
        assert found[i].text == TEXT.format(i) and found[i].n_chars == len(found[i].text)
    assert found[60].text == TEXT.format(77)
    assert found[61].text == TEXT.format(78)
    assert found[62].text == found[63].text == found[65].text == found[66].text == ""
    assert found[67].text == TEXT.format(79)


def test_tokens_speak_as_a_whole():
    own = '<h1 class="headline">A</h1><h2 id="heading">B</h2><div class="address">C</div><p class="adventure formatted">D</p><ol class="footnotes"><li>E</ol>'
    for page in (f"<article>{own}</article>", f'<main class="shareholders">{own}</main>'):
        assert extraction.main_texts([page], None) == ["A\nB\nC\nD\nE"]
    out = "".join(f'<div class="{x}">no</div>' for x in (*extraction.TOKENS, "share-tags", "siteFooter", "ads"))
    assert extraction.main_texts([f"<article>{out}<p>yes</p></article>"], None) == ["yes"]
    assert dom.attribute_tokens([("class", "article-body leaderboard mainstream"), ("id", "postContent")]) == (4, 0)


def test_siblings_of_any_number_have_their_features():
    at = {x: i for i, x in enumerate(dom.FEATURES)}
    for n in (49, 50, 500):
        tree = dom.parsed("<article>" + "".join(f"<h2>{'x' * (i + 1)}</h2>" if i % 7 == 3 else f"<p>{'x' * (i + 1)}</p>" for i in range(n)) + "</article>")
        rows, heads = dom.table(tree), len(range(3, n, 7))
        assert len(rows) == n + 2
        for i, (x, row) in enumerate(zip(tree.nodes[2:], rows[2:], strict=True)):
            assert row[at["siblings"]] == n and row[at["place among siblings"]] == i / n
            assert row[at["same tag siblings"]] == (heads if x.tag == "h2" else n - heads) / n
            assert (row[at["before"]], row[at["after"]]) == (i, i + 2 if i + 1 < n else 0)


def test_pages_without_rows_or_telling_elements(spark):
    assert extraction.extracted(pages(spark, [])).count() == 0
    assert [r.text for r in extraction.extracted(pages(spark, ["<p>a</p>", None])).collect()] == ["", ""]


def test_decoding_has_no_main_text_below_boilerplate():
    tree = dom.parsed("<div><div><p>aaaa</p><p>bbbb</p></div><div><p>cccc</p></div></div>")
    rng = np.random.default_rng(4)
    for _ in range(200):
        odds = rng.normal(0, 3, len(tree.nodes))
        for x in tree.nodes:
            x.chars = int(rng.integers(0, 90))
        chosen = extraction.decoded(tree, odds)
        weight = np.array([np.log1p(x.chars) for x in tree.nodes])
        states = best_by_enumeration(tree, odds * weight)
        assert abs(states[0] - value(tree, odds * weight, chosen)) < 1e-9


def best_by_enumeration(tree, gain):
    from itertools import product

    best = None
    for s in product((0, 1, 2), repeat=len(tree.nodes)):
        total = legal(tree, gain, s)
        if total is not None and (best is None or total > best[0]):
            best = (total, s)
    return best


def legal(tree, gain, s):
    total = 0.0
    for i, x in enumerate(tree.nodes):
        total += gain[i] if s[i] == 1 else -gain[i]
        if x.parent:
            up = s[x.parent.order]
            if up == 2 and s[i] != 2 or up == 1 and s[i] == 0:
                return None
            total -= extraction.CHANGE if up == 1 and s[i] == 2 else 0
    return total


def value(tree, gain, chosen):
    """The best legal total with exactly these nodes as main text."""
    from itertools import product

    totals = [
        legal(tree, gain, s) for s in product((0, 1, 2), repeat=len(tree.nodes)) if all((a == 1) == bool(b) for a, b in zip(s, chosen, strict=True))
    ]
    return max(t for t in totals if t is not None)


def test_unclosed_and_nested_markup():
    tree = dom.parsed("<ul><li>a<li>b <i>c</i>d<ul><li>e</ul></ul><table><tr><td>x<td>y<tr><td>z</table><p>p<div>q</div>r</p>s")
    assert dom.blocks(tree, [True] * len(tree.nodes)).split("\n") == ["a", "b cd", "e", "x", "y", "z", "p", "q", "r", "s"]
    deep = dom.parsed("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert extraction.decoded(deep, np.ones(len(deep.nodes))).sum() >= 1


def test_parse_is_linear_in_odd_tags():
    """End tags that close nothing and unclosed elements, which an end tag must not walk through one by one."""
    import time

    def seconds(html):
        start = time.process_time()
        dom.parsed(html)
        return time.process_time() - start

    for odd in ("<span>x</i>", "<div><b>x</i></p>", "<p><i>x</b></li>", "<td></tr>x"):
        small, large = min(seconds(odd * 5000) for _ in range(3)), seconds(odd * 50000)
        assert large < 40 * small + 0.5, odd
