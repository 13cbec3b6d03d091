import hashlib
import random

import numpy as np
import xxhash

from orefield.llm import debruijn, simhash
from orefield.llm.common import components


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in ("", " ", "One", "a B c", "A b c d", "x y z x y z x y z x y z x y z", "É é\x1cx y and more words"):
        assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps, radius=4):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def planted_fingerprints(n, seed=5):
    rng = random.Random(seed)
    fps = [rng.getrandbits(64) for _ in range(n)]
    for i in range(0, n, 3):  # chains: each within the radius of the one before
        fps[i] = fps[max(0, i - 3)] ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6)))
    return [*dict.fromkeys(f % (1 << 64) for f in fps)]


def linked_roots(spark, fps):
    df = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    edges = simhash.links(df, 4)
    roots = {r.node: r.root for r in components(edges).collect()}
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(roots.get(simhash.signed(f), f"alone{i}"), set()).add(i)
    return sorted(map(sorted, groups.values()))


def wanted_groups(fps):
    groups = {}
    for i, r in enumerate(brute_components(fps)):
        groups.setdefault(r, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_links_are_exact(spark):
    fps = planted_fingerprints(400)
    assert linked_roots(spark, fps) == wanted_groups(fps)


def test_links_over_many_tiles(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "STRIPE", 4)
    monkeypatch.setattr(simhash, "plan_blocks", lambda n, radius: (5, 1))
    rng = random.Random(2)
    base = rng.getrandbits(64) & ~0xFFFF  # all share most blocks: one busy group
    fps = [*dict.fromkeys(base | rng.getrandbits(16) for _ in range(120))] + planted_fingerprints(60, 9)
    assert linked_roots(spark, fps) == wanted_groups(fps)


def test_more_blocks_for_more_fingerprints():
    for n in (10, 10**6, 10**9, 10**12):
        blocks, keys = simhash.plan_blocks(n, 4)
        assert blocks - keys == 4  # any 4 differing bits leave so many blocks alike
    assert simhash.plan_blocks(10**9, 4)[1] > simhash.plan_blocks(10**4, 4)[1]


def test_near_duplicates_of_odd_rows(odd, none):
    rows = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(odd).collect()}
    assert {rows[k, 0] for k in (0, 1, 2)} == {0}
    assert {c for (k, _), c in rows.items() if k in (4, 5)} == {4}
    assert simhash.near_duplicates(odd).count() == 10
    assert simhash.near_duplicates(none).count() == 0


def test_one_document_of_each_group_stays(odd, none, table):
    kept = simhash.distinct_documents(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, i) for i in (0, 3, 4, 8, 9)] + [(True, None)]
    assert simhash.distinct_documents(none).count() == 0
    unique = table(["a b c d e", "a b c d e", "other words stand here now"])
    assert sorted(r.doc_id for r in simhash.distinct_documents(unique).collect()) == [0, 2]


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}


def brute_removal(docs, size):
    """docs: [(doc_id, text)] in order of doc_id."""
    seen, out = set(), {}
    for key, text in docs:
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            gone |= set(range(i, i + size)) if k in seen else set()
            seen.add(k)
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[key] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def random_texts(n, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9)}" for _ in range(400)]
    texts = []
    for _ in range(n):
        words = []
        while len(words) < 80:
            if rng.random() < 0.6:
                at = rng.randrange(380)
                words += base[at : at + rng.randrange(5, 45)]
            else:
                words += [f"v{rng.randrange(500)}" for _ in range(rng.randrange(20))]
        texts.append(" ".join(words))
    return texts + ["a " * 100, "a b " * 60, "a " * 100]


def test_repeats_equal_brute_force(table):
    docs = [*enumerate(random_texts(40, 1))]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.without_repeats(table(docs)).collect()}
    assert found == brute_removal(docs, 20)


def test_wide_coordinates(table):
    docs = [(-(1 << 60) + i if i % 2 else (1 << 61) + i, t) for i, t in enumerate(random_texts(12, 2))]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in debruijn.without_repeats(table(docs)).collect()}
    assert found == brute_removal(sorted(docs), 20)


def test_repeats_of_odd_rows(odd, none):
    rows = debruijn.without_repeats(odd).collect()
    assert len(rows) == 10 and debruijn.without_repeats(none).count() == 0
    removed = sorted((r.doc_id, r.n_removed) for r in rows if r.doc_id in (0, 3, 4, 5))
    assert removed == [(0, 0), (3, 0), (4, 0), (5, 21), (5, 21)]
    assert [r.text for r in rows if r.doc_id == 8] == ["one"]


def test_rolled_hashes_tell_runs_apart():
    h = np.arange(50, dtype=np.uint64) % np.uint64(7)
    r = debruijn.rolled(h, 20)
    assert len(r) == 31 and r[0] == r[7] and r[0] != r[1]
    assert debruijn.least(np.array([3, 1, 1, 5, 0], np.uint64), 3).tolist() == [1, 1, 4]
