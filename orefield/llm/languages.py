"""Language of a text by hyperdimensional profiles.

Every letter has a fixed random vector of signs, made from its code point alone. A trigram binds the
vectors of its letters, each rotated by its place, by multiplication; a text or a language bundles its
trigrams by addition. A document is compared with the prototype of each language by cosine.

Bundling is linear, so tasks count trigrams and bundle counts: training hands on one vector of whole
numbers for each task and language, which Spark adds up. Prototypes are (languages x ``DIMENSIONS``)
numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import sys
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import by_bytes, id_and_text, prepare

DIMENSIONS, SEED = 1024, 12
#: Trigrams whose vectors a task keeps, and letters likewise: bounds of memory, never of results.
KEPT_GRAMS, KEPT_LETTERS = 12_000, 20_000
#: Characters of a long text that are counted at a time.
SLICE = 1 << 20
#: Languages are held apart at the ends of words: no letter, so nothing else has this code.
EDGE = 0
NO_LANGUAGE = "und"


@cache
def letter_table() -> np.ndarray:
    """For each code point its lower-case letter, or ``EDGE`` where it is no letter."""
    out = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Letters:
    """What a task knows: the table of letters, and vectors of the letters and trigrams it has met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.table, self.letters, self.grams = dimensions, letter_table(), {}, {}
        self.vectors, self.filled = np.empty((256, dimensions), np.float32), 0

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) >= KEPT_LETTERS:
                self.letters.clear()
            bits = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def vector(self, gram: int) -> np.ndarray:
        """Letters bound in order: the first rotated twice, the second once."""
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """These trigrams' vectors, one in each row."""
        if len(self.grams) + len(grams) > KEPT_GRAMS:
            self.grams.clear()
            self.filled = 0
        out = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            at = self.grams.get(g)
            if at is None:
                at, self.filled = self.filled, self.filled + 1
                self.grams[g] = at
                if at == len(self.vectors):
                    self.vectors = np.concatenate([self.vectors, np.empty_like(self.vectors)])
                self.vectors[at] = self.vector(g)
            out[i] = at
        return self.vectors[out]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams of letters (words with an edge on either side) and their numbers."""
        found = Counter() if len(text) > SLICE else None
        last = np.zeros(0, np.uint32)
        for at in range(0, max(1, len(text)), SLICE):
            own = self.table[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)]
            end = np.zeros(1 if at + SLICE >= len(text) else 0, np.uint32)
            own = np.concatenate([last if at else np.zeros(1, np.uint32), own, end])
            # Runs of other characters are one edge.
            own = own[np.append(True, (own[1:] != EDGE) | (own[:-1] != EDGE))] if len(own) else own
            wide = own.astype(np.uint64)
            grams = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
            # An edge in the middle would join two words.
            keys, n = np.unique(grams[own[1:-1] != EDGE], return_counts=True)
            if found is None:
                return keys, n
            found.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            last = own[-2:]
        keys = np.array(sorted(found), np.uint64)
        return keys, np.array([found[k] for k in keys.tolist()], np.int64)

    def bundled(self, keys: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, a block at a time; whole numbers, exact in double."""
        out, step = np.zeros(self.dimensions), KEPT_GRAMS // 2
        for at in range(0, len(keys), step):
            out += n[at : at + step].astype(np.float64) @ self.of(keys[at : at + step]).astype(np.float64)
        return out


@cache
def letters_of(dimensions: int) -> Letters:
    """One for each worker process; Spark reuses workers for many tasks."""
    return Letters(dimensions)


def prototypes(docs: DataFrame, learned: Column, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and the bundle of all their trigrams, from the ``learned`` rows with a lang."""
    names = ["lang", "at", "own"]

    def batches(found):
        letters, own = letters_of(dimensions), {}

        def flush():
            for lang, counts in own.items():
                keys = np.array(list(counts), np.uint64)
                vector = letters.bundled(keys, np.array(list(counts.values()), np.int64))
                if np.any(vector):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(vector.astype(np.int64))], names
                    )
            own.clear()

        for batch in found:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, n = letters.counts(text)
                own.setdefault(lang, Counter()).update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
            if sum(map(len, own.values())) > 500_000:
                yield from flush()
        yield from flush()

    rows = id_and_text(docs.where(learned & F.col("lang").isNotNull()).withColumn("doc_id", F.col("lang").cast("string")))
    sums = rows.mapInArrow(batches, "lang string, at int, own long").groupBy("lang", "at").agg(F.sum("own").alias("own")).toArrow()
    langs = sorted(set(sums["lang"].to_pylist()))
    out = np.zeros((len(langs), dimensions))
    out[[langs.index(x) for x in sums["lang"].to_pylist()], sums["at"].to_numpy()] = sums["own"].to_numpy()
    return langs, out


def predicted(docs: DataFrame, held_out: Column, dimensions: int = DIMENSIONS, batch_bytes: int = 4 << 20) -> DataFrame:
    """Every row's doc_id, held_out, lang_pred and score, learned from the rows that are not ``held_out``.

    A null text, or one without a letter, is ``und`` with score 0; so is every row where nothing can be
    learned. Rows without a lang, or whose language has no letter, teach nothing but are predicted.
    Repeated rows teach and are predicted each. Of equally similar languages the first in order is taken.
    The score is the cosine, 0 where it is negative. An empty table gives no rows.
    """
    langs, sums = prototypes(docs, ~F.coalesce(held_out, F.lit(False)), dimensions)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    shared = docs.sparkSession.sparkContext.broadcast((langs, sums / np.where(norm == 0, 1, norm)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "lang_pred", "score"]

    def batches(found):
        langs, unit = shared.value
        letters = letters_of(dimensions)
        for batch in found:
            texts, preds, scores = batch.column(1).to_pylist(), [], []
            for some in by_bytes([len(x) for x in texts], batch_bytes):
                for text in texts[some]:
                    keys, n = letters.counts(text)
                    pred, score = NO_LANGUAGE, 0.0
                    if len(keys) and langs:
                        vector = letters.bundled(keys, n) if len(keys) > KEPT_GRAMS // 2 else n.astype(np.float32) @ letters.of(keys)
                        near = unit @ (vector / max(np.linalg.norm(vector), 1e-9))
                        pred, score = langs[int(near.argmax())], float(np.clip(near.max(), 0, 1))
                    preds.append(pred)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names)

    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(batches, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def in_fold(modulus: int, rest: int) -> Column:
    """Whether crc32 of the doc_id as text leaves ``rest``; a null id is in no fold."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == rest
