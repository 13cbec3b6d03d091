"""Benchmark passages in documents, up to word edits.

Windows as long as an item are embedded by CGK random walks, which turn a small edit distance into a
small Hamming distance; repeated samples of embedded coordinates are the keys of a locality-sensitive
index over the items; candidates are verified by their exact edit distance. Walks and samples are
repeated until simulated edits of the items themselves are found at the target recall; for lengths where
``WALKS`` walks do not reach it (long items, with many edits) every window that can match is verified.

Only windows that can match are embedded: an item within k edits keeps one of its k + 1 segments
whole, so a window without any such segment on its diagonal is out, and none that matches is lost.

Items come to the tasks in blocks of bounded bytes; a larger benchmark takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from orefield.llm.common import by_bytes, id_and_text

SIMILARITY, RECALL = 0.8, 0.97
#: Coordinates of a key; keys of a walk; the most walks. Every item is simulated at its edit limit.
SAMPLED, KEYS, WALKS, TRIALS = 3, 8, 24, 4
BLOCK_BYTES = 16 << 20
PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
GOLD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    """Words in lower case without punctuation."""
    return text.lower().encode().translate(PUNCTUATION).split()


def mixed(x):
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def edit_limit(n: int) -> int:
    return int(n * (1 - SIMILARITY) + 1e-9)


def segments(n: int) -> list[tuple[int, int]]:
    """(offset, length) of the parts of an item of ``n`` words, one of which no match changes."""
    k = edit_limit(n) + 1
    edges = [n * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def embedded(x: np.ndarray, walk: int, places: np.ndarray) -> np.ndarray:
    """Coordinates ``places`` of the CGK embedding of each row of ``x`` under one random walk.

    Each step writes the symbol under the pointer; a random bit of step and symbol moves it on.
    """
    m, n = x.shape
    padded = np.column_stack((x, np.zeros(m, x.dtype))).astype(np.uint64)
    rows, at = np.arange(m), np.zeros(m, np.int64)
    out = np.zeros((m, len(places)), np.uint64)
    wanted = {int(p): i for i, p in enumerate(places)}
    for step in range(int(places.max()) + 1):
        now = padded[rows, at]
        if step in wanted:
            out[:, wanted[step]] = now + (at >= n)
        salt = np.uint64((walk * 1_000_003 + step * 7919 + 1) * int(GOLD) % (1 << 64))
        at = np.minimum(n, at + (mixed(now * GOLD + salt) >> np.uint64(63)).astype(np.int64))
    return out


def keys_of(x: np.ndarray, walk: int) -> np.ndarray:
    """The keys (rows, KEYS) of one walk: hashes of the sampled coordinates."""
    n = x.shape[1]
    rng = np.random.default_rng([walk, n])
    # Most pointers have left the text after two steps for each word.
    drawn = [rng.choice(2 * n, min(SAMPLED, 2 * n), replace=False) for _ in range(KEYS)]
    places = np.unique(np.concatenate(drawn))
    found = embedded(x, walk, places)
    out = np.zeros((len(x), KEYS), np.uint64)
    for i, some in enumerate(drawn):
        h = np.full(len(x), i + 1, np.uint64)
        for p in np.searchsorted(places, some):
            h = mixed(h * GOLD + found[:, p] + np.uint64(p + 1))
        out[:, i] = h
    return out


@dataclass
class Class:
    """The items of one length: their words as numbers, and their sorted keys of every walk.

    ``reached`` is the share of simulated edits that the keys find; below the target they are not used.
    """

    rows: np.ndarray
    owner: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]
    reached: float = 1.0

    def add_walk(self) -> None:
        k = keys_of(self.rows, len(self.keys))
        flat, owner = k.ravel(), np.repeat(np.arange(len(self.rows)), KEYS)
        order = np.argsort(flat, kind="stable")
        self.keys.append((flat[order], owner[order]))

    def candidates(self, windows: np.ndarray) -> np.ndarray:
        """Distinct pairs (window, row) that share a key."""
        found = []
        for walk, (keys, owner) in enumerate(self.keys):
            k = keys_of(windows, walk).ravel()
            lo, hi = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
            n = hi - lo
            hit = np.flatnonzero(n)
            at = np.repeat(lo[hit], n[hit]) + np.arange(n.sum()) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit])
            found.append(np.repeat(hit // KEYS, n[hit]) * len(self.rows) + owner[at])
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.column_stack(np.divmod(pairs, len(self.rows)))


def edited(row: np.ndarray, edits: int, rng) -> np.ndarray:
    """``row`` after random word edits, cut or filled to its length as a window would be."""
    out = row.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(out))))
        out[at : at + (kind != 0)] = [] if kind == 1 else [0]
    return np.array((out + [0] * len(row))[: len(row)], row.dtype)


@dataclass
class Index:
    """A block of items, ready for tasks."""

    vocabulary: dict[bytes, int]
    items: list[np.ndarray]
    ids: list
    classes: dict[int, Class]
    grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # length -> sorted keys, item, offset

    @classmethod
    def of(cls, ids: list, texts: list[str]) -> Index:
        vocabulary, items, own = {}, [], []
        for key, text in zip(ids, texts, strict=True):
            words = words_of(text)
            if words:
                items.append(np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64))
                own.append(key)
        grams: dict[int, list] = {}
        for i, x in enumerate(items):
            for offset, n in segments(len(x)):
                grams.setdefault(n, []).append((gram(x[offset : offset + n], n)[0], i, offset))
        packed = {}
        for n, found in grams.items():
            keys, item, offset = np.array([g for g, _, _ in found], np.uint64), *np.array([(i, o) for _, i, o in found]).T
            order = np.argsort(keys, kind="stable")
            packed[n] = keys[order], item[order], offset[order]
        lengths = np.array([len(x) for x in items], np.int64)
        classes = {}
        for n in np.unique(lengths).tolist():
            owner = np.flatnonzero(lengths == n)
            classes[n] = Class(np.array([items[i] for i in owner]), owner, [])
        index = cls(vocabulary, items, own, classes, packed)
        for group in classes.values():
            index.repeat_walks(group)
        return index

    def repeat_walks(self, group: Class) -> None:
        """Walks until items at their edit limit are found at the target recall, as far as ``WALKS`` go."""
        n = group.rows.shape[1]
        if not edit_limit(n):
            group.add_walk()
            return
        rng = np.random.default_rng(n)
        some = group.rows[: 256 // TRIALS]
        tries = np.array([edited(r, edit_limit(n), rng) for r in some for _ in range(TRIALS)])
        truth = np.repeat(np.arange(len(some)), TRIALS)
        while len(group.keys) < WALKS:
            group.add_walk()
            pairs = group.candidates(tries)
            found = np.unique(pairs[pairs[:, 1] == truth[pairs[:, 0]], 0])
            group.reached = len(found) / len(tries)
            if group.reached >= RECALL:
                return
        group.keys.clear()


def gram(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` numbers."""
    m = len(x) - n + 1
    h = np.zeros(max(m, 0), np.uint64)
    for i in range(n if m > 0 else 0):
        h = mixed(h * GOLD + x[i : i + m].astype(np.uint64))
    return h


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(edits, end): the least edit distance of ``item`` to a part of ``text``, and where the first such part ends."""
    n = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, (n, 0)
    for j, w in enumerate(text.tolist()):
        eq = masks.get(w, 0) if w else 0
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | (~(xh | plus) & full), plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best


def matches(index: Index, x: np.ndarray, owner: np.ndarray, first: np.ndarray, size: np.ndarray):
    """(text, item, start, end, edits) of the verified passages in texts laid end to end."""
    diagonals: dict[int, set] = {}
    sure: dict[tuple[int, int], set] = {}
    for n, (keys, item, offset) in index.grams.items():
        m = len(x) - n + 1
        if m <= 0:
            continue
        known = np.flatnonzero(np.convolve(x > 0, np.ones(n, int), "valid") == n)
        known = known[owner[known] == owner[known + n - 1]]
        if not len(known):
            continue
        h = np.zeros(len(known), np.uint64)
        for i in range(n):
            h = mixed(h * GOLD + x[known + i].astype(np.uint64))
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        for j in np.flatnonzero(hi > lo).tolist():
            for q in range(lo[j], hi[j]):
                length = len(index.items[item[q]])
                text = owner[known[j]]
                # Near the ends of a text the window is moved inside.
                start = max(first[text], min(known[j] - offset[q], first[text] + size[text] - length))
                if index.classes[length].keys:
                    diagonals.setdefault(length, set()).add(int(start))
                else:
                    sure.setdefault((int(text), int(item[q])), set()).add(int(start))
    found: dict[tuple[int, int], tuple] = {}

    def verify(t: int, i: int, low: int, high: int) -> None:
        """The item in the text, for windows that begin from ``low`` to ``high``."""
        item = index.items[i]
        limit = edit_limit(len(item))
        a, b = max(first[t], low - limit), min(first[t] + size[t], high + len(item) + limit)
        edits, end = best_match(item, x[a:b])
        if edits <= limit:
            back, before = best_match(item[::-1], x[a : a + end][::-1])
            start = int(a + end - before - first[t])
            new = (edits, start, int(a + end - first[t]))
            found[t, i] = min(new, found.get((t, i), new))

    for (t, i), starts in sure.items():
        low = high = None
        for start in sorted(starts):
            if low is not None and start - low > edit_limit(len(index.items[i])):
                verify(t, i, low, high)
                low = None
            low, high = start if low is None else low, start
        verify(t, i, low, high)
    for length, starts in diagonals.items():
        group = index.classes[length]
        at = np.array(sorted(starts))
        for some in range(0, len(at), 4096):
            part = at[some : some + 4096]
            places = part[:, None] + np.arange(length)
            text = owner[part]
            last = (first + size)[text]
            windows = np.where(places < last[:, None], x[np.minimum(places, len(x) - 1)], 0)
            for w, row in group.candidates(windows).tolist():
                verify(int(text[w]), int(group.owner[row]), int(part[w]), int(part[w]))
    return [(t, i, start, end, edits) for (t, i), (edits, start, end) in sorted(found.items())]


def blocks(benchmark: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items in blocks of about BLOCK_BYTES, read one partition after the other."""
    rows = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, n))))
    for i in range(n):
        found = dealt.where(F.col("block") == i).orderBy("item_id", "text").toArrow()
        yield found.column("item_id").to_pylist(), found.column("text").to_pylist()


def passages(docs: DataFrame, benchmark: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, start, end, edits, n_words): every item found in every document.

    An item of n words is found where some passage lies within 20 % of n word edits; start and end
    count words of the document. Null and empty texts and items without words match nothing; an item
    of under five words has to occur unchanged. The best passage of each pair counts, the first among
    equals. Repeated rows are searched each. Empty tables give no rows.
    """
    spark, docs = docs.sparkSession, id_and_text(docs)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, edits int, n_words int"
    out = None
    for ids, texts in blocks(benchmark):
        index = Index.of(ids, texts)
        sent = spark.sparkContext.broadcast(index)

        def run(batches, sent=sent):
            index = sent.value
            known = index.vocabulary.get
            for batch in batches:
                texts, keys = batch.column(1).to_pylist(), batch.column(0)
                for some in by_bytes([len(t) for t in texts], batch_bytes):
                    lists = [words_of(t) for t in texts[some]]
                    size = np.array([len(w) for w in lists], np.int64)
                    x = np.fromiter((v for w in lists for v in map(known, w, repeat(0))), np.int64, int(size.sum()))
                    rows = matches(index, x, np.repeat(np.arange(len(lists)), size), np.cumsum(size) - size, size)
                    t, i, start, end, edits = map(list, zip(*rows, strict=True)) if rows else ([],) * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array([some.start + v for v in t], pa.int64())),
                            pa.array([index.ids[v] for v in i], item_type), pa.array(start, pa.int64()), pa.array(end, pa.int64()),
                            pa.array(edits, pa.int32()), pa.array([len(index.items[v]) for v in i], pa.int32()),
                        ],
                        ["doc_id", "item_id", "start", "end", "edits", "n_words"],
                    )

        found = docs.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns."""
    bad = passages(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")
