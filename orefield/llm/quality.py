"""Quality rules with cross-document line frequency, in DataFrame functions only.

Each line is normalised and hashed; for each host the documents that hold it are counted, and lines in
more documents than the host's limit are removed. A document that keeps too little is rejected. Exact
copies count as one document, among those that hold a line and among those of the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import prepare, stored

#: White space between words, as characters and as a class of a pattern.
BLANKS = " \t\n\x0b\f\r"
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A line is removed if more documents of its host than both of these hold it.
LINE_DOCUMENTS, LINE_PERCENT = 20, 1
#: A document is depleted if it keeps fewer words than MIN_WORDS or than this share.
KEPT_PERCENT = 30


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def repeated_words(h: str, ordered: str) -> Column:
    """Words in windows whose hash occurs twice or more, from the windows (h, at) in order of hash."""
    s = F.col(ordered)

    def twin(x, k):
        return (s[F.greatest(k - 1, F.lit(0))][h] == x[h]) & (k > 0) | (
            s[F.least(k + 1, F.size(s) - 1)][h] == x[h]
        ) & (k < F.size(s) - 1)

    starts = F.sort_array(F.transform(F.filter(s, twin), lambda x: x["at"]))
    none = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        starts, none,
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.coalesce(covered, F.lit(0).cast("long"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, sig (of the text) and the base counts of every text, without a shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", text.alias("text")).select(
        "doc_id", "text", words(F.col("text")).alias("w"),
        F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "").alias("lines"),
    )
    w = F.col("w")
    last = F.size(w) - WINDOW
    windows = F.when(
        last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[w[i + j] for j in range(WINDOW)]))
    ).otherwise(F.array().cast("array<long>"))
    d = d.withColumn("h", windows)
    # Sorted only where a window occurs twice.
    pairs = F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("at")))
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(pairs)))
    return d.select(
        "doc_id",
        F.xxhash64("text").alias("sig"),
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("h", "ordered").alias("n_repeat_words"),
    )


def line_key(line: Column) -> Column:
    """60 bits of the hash of a line in lower case with single blanks."""
    plain = F.lower(F.trim(F.regexp_replace(line, SPACE, " ")))
    return F.conv(F.substring(F.md5(plain), 1, 15), 16, 10).cast("long")


def host(docs: DataFrame) -> Column:
    own = F.coalesce(F.col("source"), F.lit("")) if "source" in docs.columns else F.lit("")
    return own.alias("host")


def line_rows(docs: DataFrame) -> DataFrame:
    """(host, doc_id, sig, at, line, n): every line with a word, and its words."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    d = docs.select(
        host(docs), "doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    d = d.select("host", "doc_id", F.xxhash64("text").alias("sig"), lines.alias("lines"))
    d = d.withColumn("keys", F.transform("lines", line_key))
    d = d.select("host", "doc_id", "sig", F.posexplode(F.arrays_zip("lines", "keys")).alias("at", "x"))
    return d.select("host", "doc_id", "sig", "at", F.col("x.keys").alias("line"), F.size(words(F.col("x.lines"))).cast("long").alias("n"))


def frequent_lines(rows: DataFrame) -> DataFrame:
    """(host, line) in more documents than the limit of the host."""
    seen = rows.groupBy("host", "line", "sig").agg(F.lit(1).alias("one"))
    seen = seen.groupBy("host", "line").agg(F.count("*").alias("held"))
    # Of a host's documents, exact copies count once as well.
    hosts = rows.where("at = 0").select("host", "sig").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    common = seen.where(F.col("held") > LINE_DOCUMENTS)
    return common.join(hosts, "host").where(F.col("held") * 100 > F.col("documents") * LINE_PERCENT).select("host", "line")


def removals(docs: DataFrame) -> DataFrame:
    """(d, s, n_removed, gone): per document and text, the words in removed lines and those lines (host, line)."""
    rows = stored(line_rows(docs), "lines")
    # Stored, so that the join is a broadcast of few lines, or one of two plain shuffles that may split a busy line.
    gone = rows.join(stored(frequent_lines(rows), "frequent"), ["host", "line"]).distinct()
    by_host = gone.groupBy(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "host").agg(
        F.sum("n").alias("n"), F.collect_set(F.struct("host", "line")).alias("lines")
    )
    # A text under two hosts (a repeated row) is judged by the stricter one.
    return by_host.groupBy("d", "s").agg(F.max("n").alias("n_removed"), F.flatten(F.collect_list("lines")).alias("gone"))


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, sig, the base counts, base_failed, kept, n_removed and the removed lines of every row."""
    prepare(docs.sparkSession)
    gone = removals(docs)
    found = measured(docs)
    found = found.join(gone, found["doc_id"].eqNullSafe(gone["d"]) & (found["sig"] == gone["s"]), "left")
    found = found.withColumn("n_removed", F.coalesce("n_removed", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    left = F.col("n_words") - F.col("n_removed")
    depleted = (left < MIN_WORDS) | (left * 100 < F.col("n_words") * KEPT_PERCENT)
    return found.select(
        "doc_id", "sig", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), "n_removed", "gone",
    )


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and n_removed (words in removed lines), one row per row.

    A null or empty text has no words and fails the base rules; a null source is a host of its own.
    Repeated rows get the same verdict each. An empty table gives no rows. A line is in or out for the
    whole host, so ties do not arise; a line exactly at the limit stays.
    """
    return verdicts(docs).drop("sig", "gone")


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns, without their removed lines; n_chars follows."""
    # Stored, since a filter on them would be pushed down and repeat the measuring expressions.
    found = stored(verdicts(docs), "verdicts").where("kept").select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "gone").distinct()
    own = docs.select(
        F.struct(*docs.columns).alias("r"), F.col("doc_id").alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), host(docs)
    )
    kept = own.join(found, own["key"].eqNullSafe(found["d"]) & (own["sig"] == found["s"]))
    here = F.transform(F.filter("gone", lambda x: x["host"] == F.col("host")), lambda x: x["line"])
    left = F.array_join(F.filter(F.split("r.text", "\n"), lambda x: (F.translate(x, BLANKS, "") == "") | ~F.array_contains("bad", line_key(x))), "\n")
    kept = kept.withColumn("bad", here).withColumn(
        "left", F.when(F.coalesce(F.size("bad"), F.lit(0)) < 1, F.col("r.text")).otherwise(left)
    )

    def column(c):
        if c == "text":
            return F.col("left").alias(c)
        if c == "n_chars":
            return F.char_length(F.coalesce("left", F.lit(""))).cast(docs.schema[c].dataType).alias(c)
        return F.col("r")[c].alias(c)

    return kept.select(*map(column, docs.columns))
