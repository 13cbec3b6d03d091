"""Phrases of two to five words that hold together, counted by sorting suffix pointers.

A text is cut into pieces at punctuation and line ends; every place in a piece points at the suffix of
up to ``longest`` words that starts there. Three passes count what can be frequent, each leaving out
what the one before has shown to be infrequent:

1. words, by a sum of what each task has counted;
2. leading pairs of words that are both frequent, likewise;
3. suffixes whose pairs are all frequent. Equal suffixes of a task become one row with its number, rows
   are routed by their leading pair, and each partition sorts its pointers by multikey three-way
   quicksort: what is equal in the first d words is a partition whose size is the count of those words;
   partitions below the threshold are abandoned. A leading pair that alone would fill a good part of a
   partition is routed by its whole suffix, and the counts of its parts are added up afterwards.

"Frequent" reaches the tasks as a Bloom filter of bounded size. A wrong yes costs a row that the counts
then drop, never a phrase; a full filter prunes less and changes nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.common import prepare, stored, width

#: Pieces end at these bytes, words at blank and tab. Fixed values.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
#: Letters A-Z in lower case, tab as blank, every end of a piece as a full stop.
TABLE = bytes(0x2E if c in PIECE_ENDS else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Places of text that a task holds before it hands on its counts, and rows of a sorted partition.
HELD, SORTED = 3_000_000, 1_000_000
#: The largest Bloom filter, in bits (32 MB), and its bits for each key below that.
MOST_BITS, BITS_A_KEY = 1 << 28, 16
PROBES = 4
#: A leading pair that fills more than this part of a mean partition is routed by its whole suffix.
HOT_SHARE = 0.25
#: Decimals, for products that pass 64 bits; beyond 38 digits Spark raises an error.
SCORE = "(CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) * 1000BD) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"


def words_of(text: bytes) -> list[bytes]:
    """The words of a text, and a full stop for each end of a piece."""
    return text.translate(TABLE).replace(b".", b" . ").split()


def word_hash(lang: str, word: bytes, seed: int) -> int:
    name = lang.encode()
    return xxhash.xxh3_64_intdigest(b"%d:%s%s" % (len(name), name, word), seed)


def mixed(*columns: np.ndarray) -> np.ndarray:
    """One unsigned 64-bit hash of several columns of such hashes."""
    out = np.zeros(len(columns[0]), np.uint64)
    with np.errstate(over="ignore"):
        for c in columns:
            out = (out ^ c) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
            out ^= out >> np.uint64(32)
    return out


def bits_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The places of each hash in a filter of ``bits`` (a power of two), one row for each probe."""
    step = mixed(hashes) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([(hashes + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bits_of(hashes, 64 * len(bitmap))
    return np.all((bitmap[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1), axis=0)


def bloom(keys: DataFrame, n: int):
    """A broadcast Bloom filter of the rows' long columns; tasks set bits, equal words of bits are joined."""
    bits = 1 << 10
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2

    def batches(found):
        own = np.zeros(bits // 64, np.uint64)
        for batch in found:
            at = bits_of(mixed(*(column(batch, i) for i in range(batch.num_columns))), bits).ravel()
            np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["at", "own"])

    rows = keys.mapInArrow(batches, "at long, own long").groupBy("at").agg(F.bit_or("own").alias("own")).toArrow()
    bitmap = np.zeros(bits // 64, np.uint64)
    bitmap[rows["at"].to_numpy()] = rows["own"].to_numpy().view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(bitmap)


def column(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)


def texts(docs: DataFrame) -> DataFrame:
    """(lang, text): a null text is empty, a null lang is ``und``; the text as its bytes."""
    prepare(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    )


def counted_words(docs: DataFrame, seed: int) -> DataFrame:
    """(w, lang, word, n): every word of a language, its hash and its occurrences."""
    names = ["w", "lang", "word", "n"]

    def batches(found):
        from collections import Counter

        own: dict[str, Counter] = {}

        def flush():
            for lang, counts in own.items():
                counts.pop(b".", None)
                hashes = np.fromiter((word_hash(lang, x, seed) for x in counts), np.uint64, len(counts)).view(np.int64)
                held = pa.array(list(counts), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array([lang] * len(counts), pa.string()), held, pa.array(list(counts.values()), pa.int64())], names
                )
            own.clear()

        for batch in found:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, own.values())) > HELD // 4:
                yield from flush()
        yield from flush()

    found = texts(docs).mapInArrow(batches, "w long, lang string, word string, n long")
    return found.groupBy("w", "lang", "word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """word -> number in this task, in order of arrival; 0 is the end of a piece."""

    def __init__(self, lang: str, hashes: list[int], seed: int):
        self.lang, self.hashes, self.seed = lang, hashes, seed
        self[b"."] = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(word_hash(self.lang, word, self.seed))
        return n


def numbered(found, seed: int):
    """(numbers, hashes) for about ``HELD`` places at a time: texts as word numbers, a 0 after each text."""
    own, hashes, parts, held = {}, [0], [], 0
    for batch in found:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            if lang not in own:
                own[lang] = Vocabulary(lang, hashes, seed)
            parts += [np.fromiter(map(own[lang].__getitem__, words), np.int32, len(words)), np.zeros(1, np.int32)]
            held += len(words) + 1
            if held > HELD:
                yield np.concatenate(parts).astype(np.int64), np.array(hashes, np.uint64)
                own, hashes, parts, held = {}, [0], [], 0
    if parts:
        yield np.concatenate(parts).astype(np.int64), np.array(hashes, np.uint64)


def pairs_at(numbers: np.ndarray, hashes: np.ndarray, words: np.ndarray):
    """The code of the pair at each place, and whether both words may be frequent."""
    kept = contains(words, mixed(hashes))
    kept[0] = False
    good = kept[numbers]
    return (numbers[:-1] << 32) | numbers[1:], good[:-1] & good[1:]


def counted_pairs(docs: DataFrame, seed: int, words, least: int) -> DataFrame:
    """(w1, w2, n) of the pairs that are frequent."""

    def batches(found):
        for numbers, hashes in numbered(found, seed):
            code, good = pairs_at(numbers, hashes, words.value)
            own, n = np.unique(code[good], return_counts=True)
            signed = hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed[own >> 32]), pa.array(signed[own & 0xFFFFFFFF]), pa.array(n.astype(np.int64))], ["w1", "w2", "n"]
            )

    found = texts(docs).mapInArrow(batches, "w1 long, w2 long, n long")
    return found.groupBy("w1", "w2").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def suffixes_at(numbers: np.ndarray, code: np.ndarray, good: np.ndarray, hashes: np.ndarray, pairs: np.ndarray, longest: int):
    """Distinct suffixes of three words or more whose pairs may all be frequent (hashes, 0 behind the end), and their numbers."""
    own, back = np.unique(code[good], return_inverse=True)
    passed = np.zeros(len(numbers) + longest, bool)
    passed[np.flatnonzero(good)] = contains(pairs, mixed(hashes[own >> 32], hashes[own & 0xFFFFFFFF]))[back]
    at = np.flatnonzero(passed[:-1] & passed[1:])
    padded = np.concatenate([numbers, np.zeros(longest, np.int64)])
    rows, open_ = [padded[at], padded[at + 1]], np.ones(len(at), bool)
    for d in range(2, longest):
        open_ &= passed[at + d - 1]
        rows.append(np.where(open_, padded[at + d], 0))
    keys = [(rows[i] << 32) | (rows[i + 1] if i + 1 < longest else 0) for i in range(0, longest, 2)]
    order = np.lexsort(keys[::-1])
    changed = np.ones(len(at), bool)
    if len(at):
        changed[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    first = np.flatnonzero(changed)
    n = np.diff(np.append(first, len(at)))
    return [hashes[r[order[first]]] for r in rows], n


def frequent_prefixes(words: list[np.ndarray], weight: np.ndarray, least: int, first: int):
    """(rows, depths, counts): a row that starts with each frequent sequence of ``first`` words or more.

    Multikey three-way quicksort of pointers: each step parts the pointers of a segment by their word at
    the segment's depth. The size of the equal part is the count of the sequence so far, which goes on one
    word deeper; segments that weigh less than ``least`` are abandoned.
    """
    out, stack = [], [(np.arange(len(weight)), 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == len(words) or weight[rows].sum() < least:
            continue
        own = words[depth][rows]
        pivot = np.sort(own[[0, len(own) // 2, -1]])[1]
        equal, less = own == pivot, own < pivot
        stack += [(rows[less], depth), (rows[~(less | equal)], depth)]
        rows = rows[equal]
        n = weight[rows].sum()
        if pivot and n >= least:
            if depth + 1 >= first:
                out.append((rows[0], depth + 1, n))
            stack.append((rows, depth + 1))
    rows, depths, counts = (np.array([x[i] for x in out], np.int64) for i in range(3))
    return rows, depths, counts


def prefix_sums(words: list[np.ndarray], weight: np.ndarray, first: int):
    """(rows, depths, counts) of all prefixes of ``first`` words or more, as far as these rows go."""
    order, out = np.lexsort(words[::-1]), []
    changed = np.zeros(len(order), bool)
    changed[:1] = True
    for depth, own in enumerate(words, 1):
        own = own[order]
        changed[1:] |= own[1:] != own[:-1]
        if depth >= first and len(order):
            at = np.flatnonzero(changed)
            n = np.add.reduceat(weight[order], at)
            real = own[at] != 0
            out.append((order[at][real], np.full(real.sum(), depth), n[real]))
    return tuple(np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]).astype(np.int64) for i in range(3))


def counted_suffixes(docs: DataFrame, seed: int, words, pairs, hot: np.ndarray, parts: int, least: int, longest: int) -> DataFrame:
    """(w1, .., n) of the phrases of three words or more that are frequent."""
    names = [f"w{i + 1}" for i in range(longest)]
    fields = ", ".join(f"{x} long" for x in names)
    hot = docs.sparkSession.sparkContext.broadcast(hot)

    def batch_of(columns, rest, labels):
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns), *map(pa.array, rest)], [*names, *labels])

    def batches(found):
        for numbers, hashes in numbered(found, seed):
            code, good = pairs_at(numbers, hashes, words.value)
            own, n = suffixes_at(numbers, code, good, hashes, pairs.value, longest)
            pair = mixed(own[0], own[1])
            busy = np.isin(pair, hot.value)
            route = np.where(busy, mixed(*own), pair).view(np.int64)
            yield batch_of(own, [n.astype(np.int64), route, busy], ["n", "route", "busy"])

    def sort(found):
        table = pa.Table.from_batches(found)
        if not len(table):
            return
        own = [table.column(x).to_numpy().view(np.uint64) for x in names]
        n, busy = table.column("n").to_numpy(), table.column("busy").to_numpy()
        for which, of in ((~busy, lambda w, n: frequent_prefixes(w, n, least, 3)), (busy, lambda w, n: prefix_sums(w, n, 3))):
            held, weight = [w[which] for w in own], n[which]
            rows, depths, counts = of(held, weight)
            yield batch_of([np.where(depths > i, w[rows], np.uint64(0)) for i, w in enumerate(held)], [counts], ["n"])

    def sorted_(found):
        first = next(found, None)
        if first is not None:
            yield from sort([first, *found])

    rows = texts(docs).mapInArrow(batches, f"{fields}, n long, route long, busy boolean").repartition(parts, "route")
    return rows.mapInArrow(sorted_, f"{fields}, n long").groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def counted_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (w, lang, word, n), phrases (w1, .., a), both of at least ``least`` occurrences, and totals (lang, n)."""
    spark, seed = docs.sparkSession, 0
    while True:
        words = stored(counted_words(docs, seed), "words")
        if not words.groupBy("w").count().where("count > 1 OR w = 0").take(1):
            break
        seed += 1  # two words met in one hash
    often = words.where(F.col("n") >= least)
    word_filter = bloom(often.select("w"), often.count())
    pairs = stored(counted_pairs(docs, seed, word_filter, least), "pairs")
    n, places = pairs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    names = [f"w{i + 1}" for i in range(longest)]
    phrases = pairs.select("w1", "w2", *(F.lit(0).cast("long").alias(x) for x in names[2:]), F.col("n").alias("a"))
    if longest > 2 and n:
        parts = max(width(spark), -(-places // SORTED))
        # At most parts / HOT_SHARE pairs can hold more than that share of a partition each.
        hot = pairs.where(F.col("n") > max(least, HOT_SHARE * places / parts)).select("w1", "w2").toArrow()
        hot = mixed(*(hot[x].to_numpy().view(np.uint64) for x in ("w1", "w2"))) if len(hot) else np.zeros(0, np.uint64)
        pair_filter = bloom(pairs.select("w1", "w2"), n)
        more = counted_suffixes(docs, seed, word_filter, pair_filter, hot, parts, least, longest)
        phrases = phrases.unionByName(more.withColumnRenamed("n", "a"))
    return often, stored(phrases, "phrases"), totals


def keyed(words: list, longest: int):
    """A list of word columns as key columns k1, .., 0 behind the end."""
    return [(words[i] if i < len(words) else F.lit(0).cast("long")).alias(f"k{i + 1}") for i in range(longest)]


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, longest: int = 5, percent: int = 100) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Words, counts and scores are per language, a null lang is ``und`` and a null text empty. A phrase
    of at least ``least`` occurrences is scored by floor(1000 a n / (l r)) at the cut where that is
    least, the first such cut. It is dropped if a longer such phrase that holds it has at least
    ``percent`` of its occurrences. Ties go by a, then by the bytes of the phrase. Repeated rows count
    again; an empty table, or one without frequent phrases, gives no rows.
    """
    often, phrases, totals = counted_phrases(docs, least, longest)
    names, keys = [f"w{i + 1}" for i in range(longest)], [f"k{i + 1}" for i in range(longest)]
    length = sum(((F.col(x) != 0).cast("int") for x in names), F.lit(0))
    w = [F.col(x) for x in names]
    counts = stored(
        phrases.select(*keyed(w, longest), F.col("a").alias("f")).unionByName(often.select(*keyed([F.col("w")], longest), F.col("n").alias("f"))), "counts"
    )
    # Parts of a phrase: every proper run of its words, with the count of the phrase that holds it.
    held = [
        F.when(length >= max(k + 1, s + k), F.struct(*keyed(w[s : s + k], longest)))
        for k in range(2, longest)
        for s in range(longest - k + 1)
    ]
    within = phrases.where(length > 2).select("a", F.explode(F.array_compact(F.array(*held))).alias("p")) if longest > 2 else None
    own = phrases
    if within is not None:
        most = within.groupBy("p").agg(F.max("a").alias("most")).select("most", *(F.col(f"p.{k}").alias(n) for k, n in zip(keys, names, strict=True)))
        own = phrases.join(most, names, "left").where(F.coalesce(F.col("most") * 100 < F.col("a") * percent, F.lit(True))).drop("most")
    cuts = [
        F.when(length > k, F.struct(F.lit(k).alias("k"), F.struct(*keyed(w[:k], longest)).alias("first"), F.struct(*keyed(w[k:], longest)).alias("rest")))
        for k in range(1, longest)
    ]
    cut = own.select(*names, "a", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select(
        *names, "a", "c.k", *(F.col(f"c.first.{k}").alias(f"l{k}") for k in keys), *(F.col(f"c.rest.{k}").alias(f"r{k}") for k in keys)
    )
    for side in ("l", "r"):
        part = counts.select(*(F.col(k).alias(f"{side}{k}") for k in keys), F.col("f").alias(side))
        cut = cut.join(part, [f"{side}{k}" for k in keys])
    langs = often.select(F.col("w").alias("w1"), "lang").join(totals, "lang")
    scored = cut.join(langs, "w1").withColumn("score", F.expr(SCORE))
    best = scored.groupBy(*names, "lang", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    ties = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"))
    near = stored(best.withColumn("tied", F.rank().over(ties)).where(F.col("tied") <= top), "near")
    # Only what can be among the first gets its words back.
    spelled = near.select(*names, F.posexplode(F.array(*w)).alias("i", "w")).where("w <> 0").join(often.select("w", "word"), "w")
    spelled = spelled.groupBy(*names).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), F.asc("phrase"))
    return (
        near.join(spelled, names).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", "n", "best.score")
    )
