"""Removal of repeated word windows, with windows compacted as paths of a de Bruijn graph.

A window of ``size`` words is an edge of the graph. Each edge belongs to its minimizer, the
``MINIMIZER``-word gram of least hash in it; the consecutive edges of a text that share one form a
path without branch inside the text. Equal windows have equal minimizers, so:

1. paths whose minimizer occurs once in all texts hold no repeat and are dropped after a count;
2. the others are compacted: equal paths become one, known by its earliest source coordinate, and all
   later copies of the path are repeats as a whole;
3. where one minimizer has several different paths the graph branches: the earliest copy of each of
   these paths is read again at its source coordinates and split into its edges, which are compared
   one by one.

Hashes are only ever compared among paths or edges of one minimizer: equal means equal in two
independent 64-bit hashes, of the minimizer and of the content.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import by_bytes, id_and_text, stored

MINIMIZER = 6
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


def rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` words, by doubling."""
    out, have, step, power, factor = None, 0, h, 1, int(BASE)
    while power <= size:
        if size & power:
            if out is None:
                out = step
            else:
                n = len(h) - have - power + 1
                out = out[: max(n, 0)] * np.uint64(factor) + step[have : have + max(n, 0)]
            have += power
        nxt = len(step) - power
        step = step[: max(nxt, 0)] * np.uint64(factor) + step[power : power + max(nxt, 0)]
        factor, power = factor * factor % (1 << 64), power * 2
    return out


def least(g: np.ndarray, span: int) -> np.ndarray:
    """For each start, the index of the leftmost smallest value among ``span`` consecutive ones."""
    at, have = np.arange(len(g)), 1
    while have < span:
        step = min(have, span - have)
        left, right = at[:-step], at[step:]
        at = np.where(g[left] <= g[right], left, right)
        have += step
    return at


@dataclass
class Words:
    """The words of several texts, end to end: hash, text number and place of each text's first word."""

    hashes: np.ndarray
    owner: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Words:
        lists = [x.encode().split() for x in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        h = np.fromiter((xxhash.xxh3_64_intdigest(w) for x in lists for w in x), np.uint64, int(sizes.sum()))
        return cls(h, np.repeat(np.arange(len(lists)), sizes), np.cumsum(sizes) - sizes)

    def edges(self, size: int):
        """Starts of the windows that lie in one text, and the hash of every window."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return np.flatnonzero(self.owner[:n] == self.owner[size - 1 :]), mixed(rolled(self.hashes, size))

    def paths(self, size: int):
        """(text number, start in the text, edges, minimizer, content) of each path."""
        starts, h = self.edges(size)
        if not len(starts):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        g = mixed(rolled(self.hashes, MINIMIZER))
        at = least(g, size - MINIMIZER + 1)[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(starts)))
        first, last = starts[begin], starts[begin] + n - 1
        content = mixed(h[first] * BASE + h[last] + n.astype(np.uint64))
        own = self.owner[first]
        return own, first - self.first[own], n, g[at[begin]], content


@dataclass(frozen=True)
class Places:
    """A source coordinate (document, word) as one number that sorts like it."""

    lowest: int
    bits: int
    wide: bool

    @classmethod
    def of(cls, docs: DataFrame) -> Places:
        low, high, size = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
        low, high, bits = (low or 0) - 1, high or 0, max(1, (size or 0).bit_length())
        return cls(low, bits, (high - low).bit_length() + bits > 62)

    def document(self) -> Column:
        """The document's number from 0 on; a null doc_id comes before all others."""
        kind = "decimal(38,0)" if self.wide else "long"
        return F.coalesce(F.col("doc_id").cast(kind) - F.lit(self.lowest).cast(kind), F.lit(0).cast(kind))

    def put(self, document: Column, word: Column) -> Column:
        place = document * F.lit(1 << self.bits) + word
        return place.cast("decimal(38,0)") if self.wide else place

    def split(self, place: str) -> tuple[Column, Column]:
        word = F.pmod(F.col(place), F.lit(1 << self.bits)).cast("long")
        if self.wide:
            return ((F.col(place) - word) / F.lit(1 << self.bits)).cast("decimal(38,0)"), word
        return F.shiftright(place, self.bits), word


def paths(docs: DataFrame, size: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """(document, start, n, minimizer, content) of every path of every text."""

    def run(batches):
        for batch in batches:
            texts, keys = batch.column(1).to_pylist(), batch.column(0)
            for some in by_bytes([len(x) for x in texts], batch_bytes):
                own, start, n, m, c = Words.of(texts[some]).paths(size)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(own + some.start)), *map(pa.array, (start, n, m.view(np.int64), c.view(np.int64)))],
                    ["document", "start", "n", "minimizer", "content"],
                )

    kind = docs.schema["document"].dataType.simpleString()
    return docs.mapInArrow(run, f"document {kind}, start long, n long, minimizer long, content long")


def branch_edges(found: DataFrame, size: int) -> DataFrame:
    """(document, start, minimizer, edge) of the edges of the paths listed with each text."""

    def run(batches):
        for batch in batches:
            for key, text, listed in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                _, h = Words.of([text]).edges(size)
                at = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in listed])
                m = np.repeat([p["minimizer"] for p in listed], [p["n"] for p in listed])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(at), batch.column(0).type), pa.array(at), pa.array(m, pa.int64()), pa.array(h[at].view(np.int64))],
                    ["document", "start", "minimizer", "edge"],
                )

    kind = found.schema["document"].dataType.simpleString()
    return found.mapInArrow(run, f"document {kind}, start long, minimizer long, edge long")


def repeats(docs: DataFrame, places: Places, size: int) -> DataFrame:
    """(document, start, n): runs of windows that also start earlier. ``docs``: (document, text)."""
    own = paths(docs, size)
    # Stored, so that the join below meets two plain shuffles and may split a busy minimizer.
    shared = stored(own.groupBy("minimizer").count().where("count > 1").select("minimizer"), "shared")
    place = places.put(F.col("document"), F.col("start"))
    kept = stored(own.join(shared, "minimizer").select("minimizer", "content", "n", place.alias("place")), "paths")
    compact = stored(
        kept.groupBy("minimizer", "content").agg(F.min("place").alias("first"), F.max("n").alias("n"), F.max("place").alias("last")), "compact"
    )
    copies = kept.join(compact.where("first < last").select("minimizer", "content", "first"), ["minimizer", "content"])
    copies = copies.where("place > first").select("place", "n")
    branching = compact.groupBy("minimizer").count().where("count > 1").select("minimizer")
    document, word = places.split("first")
    ends = compact.join(branching, "minimizer").select(
        document.alias("document"), F.struct(word.alias("start"), "n", "minimizer").alias("path")
    )
    ends = ends.groupBy("document").agg(F.collect_list("path").alias("paths"))
    edges = branch_edges(docs.join(ends, "document").select("document", "text", "paths"), size)
    edges = stored(edges.select("minimizer", "edge", place.alias("place")), "edges")
    firsts = edges.groupBy("minimizer", "edge").agg(F.min("place").alias("first"), F.max("place").alias("last"))
    firsts = stored(firsts.where("first < last").drop("last"), "firsts")
    later = edges.join(firsts, ["minimizer", "edge"]).where("place > first")
    document, word = places.split("place")
    return copies.unionByName(later.select("place", F.lit(1).cast("long").alias("n"))).select(
        document.alias("document"), word.alias("start"), "n"
    )


def kept_words(words: list[bytes], runs, size: int) -> list[bytes]:
    """The words that no window of ``runs`` (start, n) covers."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    np.add.at(depth, [r["start"] for r in runs], 1)
    np.add.at(depth, [r["start"] + r["n"] + size - 1 for r in runs], -1)
    return [w for w, d in zip(words, np.cumsum(depth[:-1]).tolist(), strict=True) if not d]


def without_repeats(docs: DataFrame, size: int = 20, text: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, text]) per row, text being what is left.

    Words covered by a window of ``size`` words that also starts earlier (in a smaller doc_id, or
    earlier in the document) are removed; the rest is joined by single blanks. A null or empty text has
    no words. A repeated row (same doc_id) is the same document: neither copy is earlier, both keep
    their words. A null doc_id counts as the smallest. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = id_and_text(docs)
    places = Places.of(docs)
    docs = docs.withColumn("document", places.document())
    # Copies of a repeated row have the same coordinates.
    found = repeats(docs.select("document", "text"), places, size).distinct()
    found = found.groupBy("document").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def run(batches):
        for batch in batches:
            out = []
            for body, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = body.encode().split()
                kept = kept_words(words, runs, size)
                left = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if text else ""))
            n, gone, sha, left = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(left, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "text"],
            )

    joined = docs.join(found, "document", "left").select("doc_id", "text", "runs")
    done = joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, text string")
    return done if text else done.drop("text")
