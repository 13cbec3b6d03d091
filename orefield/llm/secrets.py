"""Secret scans in DataFrame functions only: patterns, and Shannon entropy over sliding windows.

Positions come from the lengths of what lies between the matches, summed by a window over the parts of
one text, so that a text with very many matches needs no growing array.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orefield.llm.common import prepare

# The kinds in their order, their patterns, and the group and length a match needs.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": (ASSIGN, 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
KINDS = [*PATTERNS, "entropy"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
SPAN = 20
#: Bits a character must carry: random hex reaches about 3.3 in 20 characters, random base64 about 4.0.
HEX_BITS, MIXED_BITS = 2.9, 3.6
#: Candidates that are no secrets whatever their entropy: placeholders, and words or paths without digits.
ALLOWED = r"(?i)example|sample|placeholder|x{6,}|^[a-z_/=+-]+$|^[0-9+/_=-]+$|^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def parts(docs: DataFrame, kind: str, pattern: str, group: int, judge=None) -> DataFrame:
    """(row, kind, start, end, found): the matches of one pattern with code point positions.

    ``judge`` turns the rows with their ``found`` text into what is kept of it, before any shuffle.
    """
    t = F.col("text")
    d = docs.where(t.rlike(pattern)).select(
        "row",
        F.transform(F.split(t, pattern, -1), F.char_length).alias("gap"),
        F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), F.char_length).alias("len"),
        F.regexp_extract_all(t, F.lit(pattern), F.lit(group)).alias("found"),
    )
    d = d.select("row", F.posexplode(F.arrays_zip("gap", "len", "found")).alias("at", "x")).select("row", "at", "x.*")
    d = judge(d) if judge else d
    before = Window.partitionBy("row").orderBy("at")
    end = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(before)
    return d.withColumn("end", end).where("len IS NOT NULL").select(
        "row", F.lit(kind).alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end", "found"
    )


def term(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def dense_runs(chars: str) -> Column:
    """Runs (start, end) of characters covered by windows whose entropy reaches the limit of their class.

    ``total`` is the sum of c * log2(c) over the counts c in the window; moving by one character
    changes two counts. Entropy is log2(SPAN) - total / SPAN.
    """
    c = F.col(chars)
    window = F.slice(c, 1, SPAN)

    def times(some, x):
        return F.size(F.filter(some, lambda y: y == x)).cast("double")

    first = F.aggregate(F.array_distinct(window), F.lit(0.0), lambda a, x: a + term(times(window, x)))
    runs = F.array().cast("array<struct<start:int,end:int>>")
    state = F.struct(first.alias("total"), F.lit(-1).alias("open"), F.lit(-1).alias("shut"), runs.alias("runs"))

    def step(a, i):
        old = F.slice(c, i, SPAN)  # the window before, from i - 1
        out, into = c[i - 1], c[i + SPAN - 1]
        n_out, n_in = times(old, out), times(old, into)
        moved = F.when(out == into, F.lit(0.0)).otherwise(
            term(n_out - 1) - term(n_out) + term(n_in + 1) - term(n_in)
        )
        total = F.when(i == 0, a["total"]).otherwise(a["total"] + moved)
        now = F.slice(c, i + 1, SPAN)
        hexed = ~F.exists(now, lambda x: ~x.rlike("[0-9a-f]"))
        bits = F.lit(math.log2(SPAN)) - total / SPAN
        dense = bits >= F.when(hexed, F.lit(HEX_BITS)).otherwise(F.lit(MIXED_BITS)) - 1e-9
        mixed = F.exists(now, lambda x: x.rlike("[0-9]")) & F.exists(now, lambda x: x.rlike("[A-Za-z]"))
        hit = dense & mixed
        starts = hit & ((a["open"] < 0) | (i > a["shut"]))
        ended = F.when(starts & (a["open"] >= 0), F.concat(a["runs"], F.array(F.struct(a["open"].alias("start"), a["shut"].alias("end"))))).otherwise(a["runs"])
        return F.struct(
            total.alias("total"), F.when(starts, i).otherwise(a["open"]).alias("open"),
            F.when(hit, i + SPAN).otherwise(a["shut"]).alias("shut"), ended.alias("runs"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.size(c) - SPAN), state, step,
        lambda a: F.when(a["open"] < 0, a["runs"]).otherwise(F.concat(a["runs"], F.array(F.struct(a["open"].alias("start"), a["shut"].alias("end"))))),
    )


def with_runs(found: DataFrame) -> DataFrame:
    """The dense runs of each candidate that is not on the allow list, in place of its text."""
    chars = F.when(~F.col("found").rlike(ALLOWED), F.filter(F.split("found", ""), lambda x: x != ""))
    found = found.withColumn("chars", chars)
    runs = F.when(F.size("chars") >= SPAN, dense_runs("chars"))
    return found.withColumn("found", runs).drop("chars")


def entropy_spans(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end) of the dense runs of all candidate strings."""
    d = parts(docs, "entropy", CANDIDATE, 0, with_runs).select("row", "kind", "start", F.explode("found").alias("r"))
    return d.select("row", "kind", (F.col("start") + F.col("r.start")).alias("start"), (F.col("start") + F.col("r.end")).alias("end"))


def spans(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end) of all kinds; ``docs``: (row, text). Ends are exclusive."""
    out = None
    for kind, (pattern, group, least) in PATTERNS.items():
        own = parts(docs, kind, pattern, group).where(F.char_length("found") >= least).drop("found")
        out = own if out is None else out.unionByName(own)
    return out.unionByName(entropy_spans(docs))


def joined(found: str, kinds: list[str]) -> Column:
    """kind:start:end of the listed kinds, by start, then kind as listed."""
    some = F.filter(found, lambda x: x["nth"] <= KINDS.index(kinds[-1]))
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", names[x["nth"]], x["start"], x["end"])), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy, one row per row.

    A null or empty text has no spans. Rows that repeat a doc_id with the same text get the same
    spans, each its own row; with another text they keep their own. An empty table gives no rows.
    Entropy spans may lie within pattern spans: both are reported.
    """
    prepare(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("doc_id", text.alias("text")).withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("sig")))
    found = spans(own.select("row", "text")).distinct()
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    lists = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", nth.alias("nth"), "end"))).alias("found"))
    lists = lists.select(F.col("row.doc_id").alias("d"), F.col("row.sig").alias("s"), "found")
    keys = own.select("doc_id", F.col("row.sig").alias("sig"))
    all_rows = keys.join(lists, keys["doc_id"].eqNullSafe(lists["d"]) & (keys["sig"] == lists["s"]), "left").select(
        "doc_id", F.coalesce("found", F.array().cast("array<struct<start:bigint,nth:int,end:bigint>>")).alias("found")
    )

    def n(kind):
        return F.size(F.filter("found", lambda x: x["nth"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return all_rows.select(
        "doc_id", *map(n, PATTERNS), F.sha2(joined("found", [*PATTERNS]), 256).alias("base_sha256"),
        joined("found", KINDS).alias("spans"), n("entropy"),
    )
