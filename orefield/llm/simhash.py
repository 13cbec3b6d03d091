"""SimHash near-duplicates: fingerprints in tiles, compared exactly by exclusive-or and bit counts.

Fingerprints within ``radius`` bits agree in full on ``keys`` of any ``keys + radius`` blocks of their
bits. So the tiles to compare are those that share some such choice of blocks: no linked pair is lost,
and a tile holds a fraction of all fingerprints that shrinks with the number of chosen bits. A group
over ``TILE`` fingerprints is cut into tiles along their bit counts; pairs of tiles whose counts differ
by more than the radius are skipped, the others are compared in a task each. A task returns a star for
each of its components, never its pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orefield.llm.common import components, id_and_text, prepare, stored

BITS = 64
#: Fingerprints of a tile, and rows that one group of tiles brings to a task.
TILE, TASK_ROWS = 2048, 16384
#: Stripe of the comparison matrix.
STRIPE = 256


def fingerprint(text: str, size: int = 4, seed: int = 42) -> int:
    """The SimHash of the word shingles of ``text``, as an unsigned integer."""
    words = text.encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) >= size:
        starts, ends = starts[: len(words) - size + 1], ends[size - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, n = np.zeros(BITS, np.int64), len(starts)
    for at in range(0, n, 65536):
        spans = zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist(), strict=True)
        h = np.array([xxhash.xxh64_intdigest(joined[s:e], seed) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long. A text without words has fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def plan_blocks(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agreeing blocks): the fewest with which a random group is expected within one tile."""
    for keys in range(1, 5):
        blocks = radius + keys
        if n >> (BITS * keys // blocks) <= TILE:
            break
    return blocks, keys


def block_masks(radius: int, n: int) -> list[int]:
    blocks, keys = plan_blocks(n, radius)
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(own[i] for i in chosen) for chosen in combinations(range(blocks), keys)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def keyed(fps: DataFrame, masks: list[int]) -> DataFrame:
    pairs = [F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("value")) for i, m in enumerate(masks)]
    return fps.select("fp", F.explode(F.array(*pairs)).alias("k")).select("k.band", "k.value", "fp", F.bit_count("fp").alias("ones"))


def tiled(keys: DataFrame, radius: int) -> DataFrame:
    """Rows (band, value, left, right, side, fp): the members of every pair of tiles to compare."""
    sizes = keys.groupBy("band", "value", "ones").agg(F.count("*").alias("n"))
    own = Window.partitionBy("band", "value")
    sizes = sizes.withColumns(
        {"total": F.sum("n").over(own), "before": F.sum("n").over(own.orderBy("ones")) - F.col("n")}
    ).where("total > 1")
    small = keys.join(sizes.where(F.col("total") <= TILE).select("band", "value").distinct(), ["band", "value"])
    small = small.select("band", "value", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(0).alias("side"), "fp")
    large = keys.join(sizes.where(F.col("total") > TILE), ["band", "value", "ones"])
    rank = F.col("before") + F.pmod(F.xxhash64("fp"), F.col("n"))
    large = stored(large.select("band", "value", "fp", "ones", F.floor(rank / TILE).cast("int").alias("tile")), "tiles")
    tiles = large.groupBy("band", "value", "tile").agg(F.min("ones").alias("low"), F.max("ones").alias("high"))
    t, u = tiles.alias("t"), tiles.alias("u")
    near = (F.col("t.tile") <= F.col("u.tile")) & (F.col("u.low") - F.col("t.high") <= radius)
    pairs = t.join(u, [F.col("t.band") == F.col("u.band"), F.col("t.value") == F.col("u.value"), near]).select(
        "t.band", "t.value", F.col("t.tile").alias("left"), F.col("u.tile").alias("right")
    )
    ends = pairs.select("band", "value", "left", "right", F.explode(
        F.when(F.col("left") == F.col("right"), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    ).alias("side"))
    ends = ends.withColumn("tile", F.when(F.col("side") == 0, F.col("left")).otherwise(F.col("right")))
    return small.unionByName(
        large.join(ends, ["band", "value", "tile"]).select("band", "value", "left", "right", "side", "fp")
    )


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Which members of a and of b have a partner in the other; a is b for a single tile.

    Both are sorted by bit count, so a stripe meets only the range of counts within the radius.
    """
    same = a is b
    hit_a, hit_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ones_a, ones_b = np.bitwise_count(a).astype(np.int16), np.bitwise_count(b).astype(np.int16)
    for at in range(0, len(a), STRIPE):
        to = min(len(a), at + STRIPE)
        lo = max(at if same else 0, np.searchsorted(ones_b, ones_a[at] - radius))
        hi = np.searchsorted(ones_b, ones_a[to - 1] + radius, "right")
        if lo >= hi:
            continue
        close = np.bitwise_count(a[at:to, None] ^ b[None, lo:hi]) <= radius
        if same:
            close[np.arange(max(lo, at), to) - at, np.arange(max(lo, at), to) - lo] = False
        hit_a[at:to] |= close.any(1)
        hit_b[lo:hi] |= close.any(0)
    return hit_a, hit_b


def stars(nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of each component of ``nodes``, by breadth-first search."""
    out, rest = [], np.sort(nodes)
    while len(rest) > 1:
        seen, queue, rest = [int(rest[0])], [rest[0]], rest[1:]
        while queue and len(rest):
            close = np.bitwise_count(rest ^ queue.pop()) <= radius
            queue += list(rest[close])
            seen += rest[close].tolist()
            rest = rest[~close]
        out += [(x, seen[0]) for x in seen[1:]]
    return out


def compare(rows: pd.DataFrame, radius: int) -> pd.DataFrame:
    """The stars of all pairs of tiles in ``rows``."""
    out: set = set()
    fps = rows["fp"].to_numpy().view(np.uint64)
    side = rows["side"].to_numpy()
    for at in rows.groupby(["band", "value", "left", "right"], sort=False).indices.values():
        a = fps[at[side[at] == 0]]
        a = a[np.argsort(np.bitwise_count(a), kind="stable")]
        b = fps[at[side[at] == 1]]
        b = b[np.argsort(np.bitwise_count(b), kind="stable")] if len(b) else a
        hit_a, hit_b = linked(a, b, radius)
        if hit_a.any():
            active = np.unique(np.concatenate((a[hit_a], b[hit_b])))
            out.update(stars(active, radius))
    pairs = np.array(sorted(out), np.uint64).reshape(-1, 2).view(np.int64)
    return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(a, b) edges that connect exactly the distinct fingerprints linked within ``radius`` bits."""
    n = fps.count()
    rows = stored(tiled(stored(keyed(fps, block_masks(radius, n)), "blocks"), radius), "members")
    groups = max(1, rows.count() // TASK_ROWS)
    spread = rows.withColumn("part", F.pmod(F.xxhash64("band", "value", "left", "right"), F.lit(groups)))
    return spread.groupBy("part").applyInPandas(lambda x: compare(x, radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of at most ``radius`` bits.

    Null and empty texts have fingerprint 0 and are linked like any other; equal texts share their
    fingerprint, so copies never multiply. Rows with a null doc_id keep it and count as the largest.
    """
    own = stored(fingerprints(docs), "fingerprints")
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = stored(components(links(firsts.select("fp"), radius)), "roots")
    least = (
        firsts.join(roots, firsts["fp"] == roots["node"]).groupBy("root").agg(F.min("first").alias("component_id"))
    )
    found = stored(
        firsts.join(roots.join(least, "root"), firsts["fp"] == F.col("node"), "left")
        .select("fp", F.coalesce("component_id", "first").alias("component_id")),
        "members",
    )
    return own.join(found, "fp").select("doc_id", "fp", "component_id")


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that come first in their component; repeated rows stay once."""
    found = near_duplicates(docs)
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id", "fp").agg(F.count("*").alias("n"))
    first = stored(first, "first")
    columns = docs.columns
    own = docs.select(F.struct(*columns).alias("r"), F.col("doc_id").alias("key"))
    if first.agg(F.max("n"), F.count("*") - F.countDistinct("doc_id")).first() in ((1, 0), (None, 0)):
        first = first.select("doc_id")
        return own.join(first, F.col("key").eqNullSafe(first["doc_id"]), "left_semi").select("r.*")
    # Some doc_id repeats: its rows are told apart by their fingerprints, and equal ones stay once.
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(x or "") for x in batch.column(columns.index("text")).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], [*columns, name])

    name = max(columns, key=len) + "_fp"
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])
    marked = docs.mapInArrow(run, schema)
    marked = marked.select(F.struct(*columns).alias("r"), F.col("doc_id").alias("key"), F.col(name).alias("own"))
    once = Window.partitionBy("key", "own").orderBy(F.xxhash64("r"))
    marked = marked.withColumn("nth", F.row_number().over(once)).where("nth = 1")
    return marked.join(first, F.col("key").eqNullSafe(first["doc_id"]) & (F.col("own") == first["fp"]), "left_semi").select("r.*")


def hex16(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
