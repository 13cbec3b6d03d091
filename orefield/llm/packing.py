"""Packing of documents into sequences of bounded length by a grouping genetic algorithm on islands.

Documents become pieces (only those over the capacity are cut). Pieces are dealt by hash into blocks
of about ``BLOCK`` pieces. Several islands evolve packings of each block from random groupings; a
chromosome is a list of whole bins. Crossover injects well-filled bins of one parent into another,
removes the bins that repeat their documents and best-fits the displaced ones, long ones first; after
each epoch an island's elite migrates to the next island through a join. Bins that a level leaves
unfilled are packed once more over all blocks together, so that the loss is about one bin for the last
block, not one for each.
"""

from __future__ import annotations

import bisect
import random
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from orefield.llm import tokens
from orefield.llm.common import by_bytes, id_and_text, stored, width

END = (1).to_bytes(4, "little")
BLOCK = 4096
ISLANDS, EPOCHS, POPULATION, GENERATIONS = 2, 2, 4, 6
#: Small blocks evolve longer: this many placed pieces at most, and as many generations.
EFFORT, MOST_GENERATIONS = 6 * 4096, 200
#: A bin filled to this share is final after its first level.
FILLED = 0.999
#: Another level follows while it would pack at most this share of what the last one had.
WORTH = 0.75


def pieces(docs: DataFrame, vocabulary: str, capacity: int, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, slot); slot deals pieces out evenly.

    A slot depends on the piece alone (its document, place and ids), not on how the table is
    partitioned. Rows that a task meets again get a slot of their own, so that copies of one row,
    however many, are dealt out too.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spark_schema = docs.sparkSession.createDataFrame(
        [], f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, again long"
    ).schema
    schema = to_arrow_schema(spark_schema)
    step = 4 * capacity

    def batches(found):
        met = Counter()
        for batch in found:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in by_bytes([len(x) for x in texts], batch_bytes):
                columns = [[] for _ in schema.names]
                own, piece, start, length, crc, again = columns
                for key, ids in zip(keys[some], tokens.ids(texts[some], vocabulary), strict=True):
                    ids += END
                    first = zlib.crc32(ids[:step])
                    met[(key, len(ids), first)] += 1
                    for i, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step] if i else ids[:step]
                        own.append(key)
                        piece.append(i)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part) if i else first)
                        again.append(met[(key, len(ids), first)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema.names)

    slot = F.xxhash64("doc_id", "piece", "length", "ids_crc32", "again").bitwiseAND((1 << 62) - 1)
    return id_and_text(docs).mapInArrow(batches, spark_schema).withColumn("slot", slot).drop("again")


def best_fit(bins: list[list], fills: list[int], items, lengths, capacity: int) -> None:
    """Put each item into the fullest bin that has room; open a bin where none has."""
    room = sorted((capacity - f, i) for i, f in enumerate(fills))
    for item in items:
        n = lengths[item]
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            bins.append([])
            fills.append(0)
            i = len(bins) - 1
        else:
            i = room.pop(at)[1]
        bins[i].append(item)
        fills[i] += n
        bisect.insort(room, (capacity - fills[i], i))


def fitness(fills: list[int], capacity: int) -> tuple:
    """Fewer bins first, then unevenly filled ones: a nearly empty bin is nearly gone."""
    return -len(fills), sum((f / capacity) ** 2 for f in fills) / max(1, len(fills))


def crossover(a, b, lengths, capacity: int, rng: random.Random):
    """Inject well-filled bins of ``b`` into ``a``: up to half of its bins, from among the best."""
    (bins_a, fills_a), (bins_b, fills_b) = a, b
    order = sorted(range(len(bins_b)), key=fills_b.__getitem__, reverse=True)
    taken = order[: max(1, round(len(order) * rng.uniform(0.25, 0.5)))]
    injected = {x for i in taken for x in bins_b[i]}
    bins, fills, loose = [list(bins_b[i]) for i in taken], [fills_b[i] for i in taken], []
    for items, fill in zip(bins_a, fills_a, strict=True):
        if injected.isdisjoint(items):
            bins.append(list(items))
            fills.append(fill)
        else:
            loose += [x for x in items if x not in injected]
    best_fit(bins, fills, sorted(loose), lengths, capacity)
    return bins, fills


def mutated(a, lengths, capacity: int, rng: random.Random):
    """Empty the worst-filled bin and a few others, and best-fit what they held."""
    order = sorted(range(len(a[0])), key=a[1].__getitem__)
    gone = {*order[:1], *(rng.choice(order) for _ in range(1 + len(order) // 20))}
    bins = [list(x) for i, x in enumerate(a[0]) if i not in gone]
    fills = [f for i, f in enumerate(a[1]) if i not in gone]
    best_fit(bins, fills, sorted(x for i in gone for x in a[0][i]), lengths, capacity)
    return bins, fills


def from_assignment(assigned, lengths):
    bins = [[] for _ in range(max(assigned, default=-1) + 1)]
    for item, i in enumerate(assigned):
        bins[i].append(item)
    return bins, [sum(lengths[x] for x in items) for items in bins]


def to_assignment(bins, n: int) -> list[int]:
    out = [0] * n
    for i, items in enumerate(bins):
        for x in items:
            out[x] = i
    return out


def evolve(lengths, capacity: int, guests, seed: int, population=POPULATION, generations=None):
    """The best packing that one island finds: the bin of each item, bins, score, crossovers made.

    ``lengths`` descend. An island starts from its guests and from random groupings (items taken in random
    order), and ends early where a packing meets the lower bound of bins.
    """
    rng, n, bound, crossed = random.Random(seed), len(lengths), -(-sum(lengths) // capacity), 0
    generations = max(GENERATIONS, min(MOST_GENERATIONS, EFFORT // max(1, n))) if generations is None else generations
    crowd = [from_assignment(x, lengths) for x in guests]

    def grown():
        bins, fills = [], []
        best_fit(bins, fills, rng.sample(range(n), n), lengths, capacity)
        return bins, fills

    def rank(x):
        return fitness(x[1], capacity)

    if not any(len(x[0]) <= bound for x in crowd):
        crowd += [grown() for _ in range(population - len(crowd))]
    for _ in range(generations):
        crowd.sort(key=rank, reverse=True)
        if len(crowd[0][0]) <= bound:
            break
        child = crossover(crowd[rng.randrange(len(crowd))], crowd[0], lengths, capacity, rng)
        other = crossover(crowd[0], crowd[rng.randrange(len(crowd))], lengths, capacity, rng)
        crossed += 2
        crowd = [*crowd, child, mutated(other, lengths, capacity, rng)]
        crowd.sort(key=rank, reverse=True)
        crowd = crowd[:population]
    best = max(crowd, key=rank, default=([], []))
    return to_assignment(best[0], n), float(len(best[0])), rank(best)[1], crossed


def epoch(islands: DataFrame, capacity: int, number: int, parallel: int) -> DataFrame:
    """(block, island, lengths, guests, crossed) -> the same with the island's elite and its fitness."""
    schema = "block long, island int, lengths array<long>, elite array<int>, bins double, score double, crossed long"

    def run(found):
        for batch in found:
            out = []
            for r in batch.to_pylist():
                elite, bins, score, crossed = evolve(r["lengths"], capacity, r["guests"], hash((r["block"], r["island"], number)))
                out.append((r["block"], r["island"], r["lengths"], elite, bins, score, crossed + r["crossed"]))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return stored(islands.repartition(parallel, "block", "island").mapInArrow(run, schema), "islands")


def evolved_blocks(dealt: DataFrame, capacity: int) -> DataFrame:
    """(block, island, lengths, elite, bins, score, crossed) of the last epoch, from items with their block."""
    parallel = width(dealt.sparkSession)
    held = dealt.groupBy("block").agg(F.sort_array(F.collect_list("length"), asc=False).alias("lengths"))
    none, zero = F.array().cast("array<array<int>>"), F.lit(0).cast("long")
    islands = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "lengths", none.alias("guests"), zero.alias("crossed"))
    for number in range(EPOCHS):
        evolved = epoch(islands, capacity, number, parallel)
        guests = evolved.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("elite").alias("guest"))
        islands = evolved.join(guests, ["block", "island"]).select("block", "island", "lengths", F.array("elite", "guest").alias("guests"), "crossed")
    return evolved


def pack_level(items: DataFrame, capacity: int, blocks: int) -> DataFrame:
    """``items`` with block and bin, bin being dense in its block."""
    dealt = items.withColumn("block", F.pmod(F.col("slot"), F.lit(blocks)))
    evolved = evolved_blocks(dealt, capacity)
    best = evolved.groupBy("block").agg(F.max_by("elite", F.struct(-F.col("bins"), F.col("score"), -F.col("island"))).alias("elite"))
    placed = best.select("block", F.posexplode("elite").alias("rank", "bin"))
    # A total order but for equal rows, so that a recomputed task gives the ranks that it gave before.
    order = Window.partitionBy("block").orderBy(F.desc("length"), "slot", "doc_id", "piece")
    return dealt.withColumn("rank", F.row_number().over(order) - 1).join(placed, ["block", "rank"]).drop("rank")


def pack(items: DataFrame, capacity: int = 4096) -> DataFrame:
    """Rows of ``items`` (with columns length and slot) with sequence_id and offset, gapless from 0."""
    left, done, level, n = items, [], 0, items.count()
    while True:
        blocks = max(1, -(-n // BLOCK))
        found = pack_level(left, capacity, blocks)
        bins = Window.partitionBy("block", "bin")
        number = F.lit(level << 56) + F.col("block") * F.lit(1 << 24) + F.col("bin")
        found = stored(
            found.withColumn("fill", F.sum("length").over(bins))
            .withColumn("offset", F.sum("length").over(bins.orderBy("slot", "doc_id", "piece").rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("offset", F.coalesce("offset", F.lit(0)))
            .withColumn("sequence_id", number)
            .drop("block", "bin"),
            "packed",
        )
        filled = F.col("fill") >= F.lit(FILLED * capacity)
        left = found.where(~filled).select(items.columns)
        before, n, level = n, 0 if blocks == 1 else left.count(), level + 1
        if not n or n > WORTH * before:
            done.append(found)
            break
        done.append(found.where(filled))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("fill", "slot")


def packed_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = 4096) -> DataFrame:
    """Each piece of each document with its sequence: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. A repeated row is a document of its own. An empty table
    gives no rows. Pieces of equal length are interchangeable, so ties only choose among equal packings;
    they go by slot, id and piece, whatever the partitioning. Levels end with one block, or where most
    pieces cannot be put into full bins: then up to one bin for each block is left open.
    """
    return pack(stored(pieces(docs, vocabulary, capacity), "pieces"), capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
