import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orefield.llm import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, longest=5, percent=100):
    """The definition, word by word: rows (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for i in range(len(words)):
                for k in range(1, longest + 1):
                    if i + k <= len(words):
                        f[lang, tuple(words[i : i + k])] += 1
    out = {}
    often = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    for (lang, p), a in often.items():
        within = any(
            lang == other and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) and 100 * b >= percent * a
            for (other, q), b in often.items()
        )
        if not within:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in sorted(out.items())
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    ]


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "a", "b", "é", "É", "in", "x1", "hot-dog"] + [f"w{i}" for i in range(40)]
    weights = [30, 30, 12, 12, 9, 9, 5, 5, 9, 5, 3] + [1] * 40
    marks = [" ", " ", " ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "\x0b", " .", "! ", "\x1c", " "]
    return [(rng.choice(["en", "en", "en", "de", None]), "".join(w + rng.choice(marks) for w in rng.choices(words, weights, k=rng.randrange(0, 80)))) for _ in range(n)]


def frame(spark, rows, parts=3):
    full = [(i, t, lang, "s", 1, 2) for i, (lang, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n int, w1 long").repartition(parts)


def got(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("least,top", [(3, 2000), (10, 7)])
def test_equals_brute_force(spark, least, top):
    rows = texts(1, 300) + [("en", "new york in the") for _ in range(40)] + [("en", None), (None, ""), ("xx", "only once here")]
    assert got(collocations.collocations(frame(spark, rows), least, top)) == brute(rows, least, top)


def test_any_partitioning_full_filter_and_split_pairs(spark, monkeypatch):
    """Small buffers, a filter that says yes to all, and every leading pair routed by its whole suffix."""
    rows = texts(2, 200)
    want = brute(rows, 4, 50)
    monkeypatch.setattr(collocations, "HELD", 200)
    monkeypatch.setattr(collocations, "MOST_BITS", 64)
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.0)
    assert got(collocations.collocations(frame(spark, rows, 1), 4, 50)) == want
    assert got(collocations.collocations(frame(spark, rows, 9), 4, 50)) == want


def test_repeats_of_one_word_and_other_shares(spark):
    rows = [("en", "go " * 50)] * 3 + [("en", "a b c. a b c. a b. a b d")] * 5
    for percent in (100, 60, 50):
        assert got(collocations.collocations(frame(spark, rows), 5, 100, percent=percent)) == brute(rows, 5, 100, percent=percent)


def test_products_beyond_64_bits(spark):
    a = spark.sql(f"SELECT {collocations.SCORE} AS s FROM (SELECT 9000000000000L AS a, 90000000000000L AS n, 9000000000001L AS l, 9000000000002L AS r)").first()["s"]
    assert a == 9000000000000 * 90000000000000 * 1000 // (9000000000001 * 9000000000002)


def test_words_that_meet_in_one_hash_are_told_apart(spark, monkeypatch):
    real = collocations.word_hash
    monkeypatch.setattr(collocations, "word_hash", lambda lang, word, seed: real(lang, word[:1] if seed == 0 else word, seed))
    rows = [("en", "apple pie. april pie. apple tart")] * 6
    # The workers import the module afresh, so the collision is made in the words that come back.
    counted = collocations.counted_words
    monkeypatch.setattr(collocations, "counted_words", lambda docs, seed: counted(docs, seed).withColumn("w", F.lit(7).cast("long")) if seed == 0 else counted(docs, seed))
    assert got(collocations.collocations(frame(spark, rows), 6, 10)) == brute(rows, 6, 10)


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(5)
    rows = rng.integers(1, 4, (400, 5)).astype(np.uint64)
    rows[rng.random(400) < 0.3, 3:] = 0
    weight = rng.integers(1, 5, 400)
    want = Counter()
    for r, w in zip(rows.tolist(), weight.tolist(), strict=True):
        for d in range(1, 6):
            if r[d - 1]:
                want[tuple(r[:d])] += w
    columns = [rows[:, i] for i in range(5)]
    at, depth, n = collocations.frequent_prefixes(columns, weight, 12, 3)
    assert {tuple(rows[i, :d].tolist()): c for i, d, c in zip(at, depth, n, strict=True)} == {k: c for k, c in want.items() if len(k) >= 3 and c >= 12}
    at, depth, n = collocations.prefix_sums(columns, weight, 3)
    assert {tuple(rows[i, :d].tolist()): c for i, d, c in zip(at, depth, n, strict=True)} == {k: c for k, c in want.items() if len(k) >= 3}


def test_odd_rows(spark, odd, none):
    assert collocations.collocations(none).count() == 0
    assert collocations.collocations(odd).count() == 0
    rows = odd.select("lang", "text").collect()
    assert got(collocations.collocations(odd, least=3)) == brute([tuple(r) for r in rows], 3, 2000)
