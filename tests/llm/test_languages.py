import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from orefield.llm import languages

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def brute(texts, learned, dimensions=64):
    """Letter by letter: prototypes and the cosine of each text with each of them."""

    def grams(text):
        out, word = [], ""
        for c in f"{text} ":
            if c.isalpha():
                word += c.lower() if len(c.lower()) == 1 else c
            elif word:
                out += [f" {word} "[i : i + 3] for i in range(len(word))]
                word = ""
        return out

    def letter(c):
        code = 0 if c == " " else ord(c)
        return 2 * np.random.Generator(np.random.PCG64([languages.SEED, code])).integers(0, 2, dimensions, np.int8).astype(np.int64) - 1

    def vector(text):
        return sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in grams(text)), np.zeros(dimensions, np.int64))

    sums = {}
    for lang, text in learned:
        if lang is not None and text:
            sums[lang] = sums.get(lang, 0) + vector(text)
    sums = {k: v for k, v in sums.items() if np.any(v)}
    out = []
    for text in texts:
        if not text or not grams(text) or not sums:
            out.append(("und", 0.0))
            continue
        v = vector(text)
        near = [(max(0.0, min(1.0, v @ p / max(1e-9, np.linalg.norm(v)) / np.linalg.norm(p))), lang) for lang, p in sorted(sums.items())]
        score = max(s for s, _ in near)
        out.append((next(lang for s, lang in near if s == score), score))
    return out


TEXTS = [
    (0, "the cat and the dog; THE end", "en"), (1, "der Hund und die Katze", "de"), (2, "le chat et le chien", "fr"), (3, "Straße İstanbul ǅ 漢字", "de"),
    (4, None, "en"), (5, "", "en"), (6, "123 !!! 4", "en"), (7, "the then there", None), (8, "the", "en"), (8, "the", "en"), (None, "und die der", "de"), (11, "x", "zz"),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("held_out", F.lit(1))
    held = F.col("doc_id") == 8
    found = languages.predicted(docs, held, dimensions=64).collect()
    want = brute([t for _, t, _ in TEXTS], [(lang, t) for i, t, lang in TEXTS if i != 8])
    own = sorted((str(r.doc_id), r.lang_pred, round(r.score, 4)) for r in found)
    assert own == sorted((str(i), p, round(s, 4)) for (i, _, _), (p, s) in zip(TEXTS, want, strict=True))
    assert {r.doc_id for r in found if r.held_out} == {8}


def test_long_texts_and_small_stores_change_nothing(monkeypatch):
    text = " ".join(f"wort{chr(97 + i % 26)}{chr(97 + i * 7 % 26)} 12" for i in range(900))
    whole = languages.Letters(32)
    keys, n = whole.counts(text)
    for size in (1, 7, 64):
        monkeypatch.setattr(languages, "SLICE", size)
        other = languages.Letters(32).counts(text)
        assert np.array_equal(keys, other[0]) and np.array_equal(n, other[1])
    monkeypatch.setattr(languages, "KEPT_GRAMS", 40)
    monkeypatch.setattr(languages, "KEPT_LETTERS", 3)
    assert np.array_equal(whole.bundled(keys, n), languages.Letters(32).bundled(keys, n))


def test_nothing_to_learn_from(spark, odd, none):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in languages.predicted(docs, F.lit(True)).collect()} == {("und", 0.0)}
    assert languages.predicted(none, languages.in_fold(4, 2)).count() == 0
    rows = languages.predicted(odd, languages.in_fold(4, 2)).collect()
    assert len(rows) == 10 and {r.lang_pred for r in rows} <= {"en", "und"} and all(0 <= r.score <= 1 for r in rows)


def test_folds_follow_crc32(spark):
    import zlib

    ids = spark.range(200).withColumnRenamed("id", "doc_id")
    assert {r[0] for r in ids.where(languages.in_fold(4, 2)).collect()} == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2}


@pytest.mark.parametrize("folder,least", [(MIDDLE, 0.97)])
def test_held_out_accuracy(spark, folder, least):
    found = contract.queries()["op12_language_id"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = found.where("held_out").join(docs, "doc_id")
    right = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert found.count() == docs.count() and right >= least
