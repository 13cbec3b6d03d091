"""The numbered queries: each operator over its whole table, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from orefield.llm import (
    alignment, collocations, debruijn, decontamination, extraction, languages, packing, personal, quality, secrets, simhash, tokens, toxicity,
)
from orefield.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op1_best_fit_packing(spark, sf_dir):
    return packing.packed_documents(read(spark, sf_dir, "documents"))


@query()
def op2_benchmark_decontamination(spark, sf_dir):
    return decontamination.passages(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query()
def op3_html_extraction(spark, sf_dir):
    return extraction.extracted(read(spark, sf_dir, "pages"))


OP4 = """
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i : i + 4], ' ') AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM again, range(5) AS r(j) GROUP BY 1
), keyed AS (
  SELECT doc_id, host, text, lines,
    list_transform(lines, lambda x: left(md5(lower(trim(regexp_replace(x, '[\\x20\\x09-\\x0D]+', ' ', 'g')))), 15)) AS keys FROM d
), line AS (
  SELECT doc_id, host, text, unnest(lines) AS body, unnest(keys) AS k FROM keyed
), seen AS (
  SELECT host, k, count(DISTINCT text) AS held FROM line GROUP BY 1, 2
), hosts AS (
  SELECT host, count(DISTINCT text) AS documents FROM d WHERE len(lines) > 0 GROUP BY 1
), common AS (
  SELECT host, k FROM seen JOIN hosts USING (host) WHERE held > 20 AND held * 100 > documents
), gone AS (
  SELECT doc_id, sum(len(list_filter(string_split_regex(body, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))) AS n_removed
  FROM line JOIN common USING (host, k) GROUP BY 1
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, coalesce(n_removed, 0)::BIGINT AS n_removed
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id)
), b AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND n_words - n_removed >= 10 AND (n_words - n_removed) * 100 >= n_words * 30 AS kept FROM b
"""


@query(OP4)
def op4_quality_rules(spark, sf_dir):
    return quality.judged(read(spark, sf_dir, "documents"))


OP5 = """
WITH w AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), []) AS words FROM documents
), k AS (
  SELECT doc_id, i, array_to_string(words[i : i + 19], ' ') AS edge FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM w)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY edge ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, i + j AS place FROM later, range(20) AS r(j)
), left_over AS (
  SELECT doc_id, words, len(words) AS n, list(place) FILTER (WHERE place IS NOT NULL) AS places FROM w LEFT JOIN gone USING (doc_id) GROUP BY ALL
), kept AS (
  SELECT doc_id, n, list_transform(list_filter(list_zip(words, range(1, n + 1)), lambda x: NOT coalesce(list_contains(places, x[2]), false)), lambda x: x[1]) AS kept FROM left_over
)
SELECT doc_id, n::BIGINT AS n_words, (n - len(kept))::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM kept
"""


@query(OP5)
def op5_substring_dedup(spark, sf_dir):
    return debruijn.without_repeats(read(spark, sf_dir, "documents"), text=False)


OP6 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p(kind, nth, pattern, grp, least) AS (VALUES ('assign', 0, $re${secrets.ASSIGN}$re$, 1, 6),
  ('access', 1, $re${secrets.PATTERNS["access"][0]}$re$, 0, 20), ('hex', 2, $re${secrets.PATTERNS["hex"][0]}$re$, 0, 24), ('entropy', 3, $re${secrets.CANDIDATE}$re$, 0, 20)),
a AS (
  SELECT doc_id, kind, nth, least, regexp_extract_all(text, pattern, 0) AS whole,
    CASE grp WHEN 1 THEN regexp_extract_all(text, pattern, 1) ELSE regexp_extract_all(text, pattern, 0) END AS part,
    string_split_regex(text, pattern) AS gaps FROM d, p WHERE regexp_matches(text, pattern)
), f AS (
  SELECT doc_id, kind, nth, least, whole[i] AS body, part[i] AS part,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM a)
), windows AS (
  SELECT doc_id, start, i, substr(body, i + 1, {secrets.SPAN}) AS w
  FROM (SELECT *, unnest(range(0, length(body) - {secrets.SPAN - 1})) AS i FROM f WHERE kind = 'entropy' AND NOT regexp_matches(body, $re${secrets.ALLOWED}$re$))
), hits AS (
  SELECT doc_id, start, i, i > lag(i) OVER (PARTITION BY doc_id, start ORDER BY i) + {secrets.SPAN} AS far FROM windows
  WHERE regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]') AND list_aggregate(string_split(w, ''), 'entropy')
    >= CASE WHEN regexp_matches(w, '^[0-9a-f]+$') THEN {secrets.HEX_BITS} ELSE {secrets.MIXED_BITS} END - 1e-9
), runs AS (
  SELECT doc_id, start, i, sum(coalesce(far, false)::INTEGER) OVER (PARTITION BY doc_id, start ORDER BY i) AS run FROM hits
), spans AS (
  SELECT doc_id, kind, nth, start::BIGINT AS start, (start + length(body))::BIGINT AS stop FROM f WHERE kind <> 'entropy' AND length(part) >= least
  UNION ALL SELECT doc_id, 'entropy', 3, (start + min(i))::BIGINT, (start + max(i) + {secrets.SPAN})::BIGINT FROM runs GROUP BY doc_id, start, run
), texts AS (
  SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth, stop) AS spans,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth, stop) FILTER (WHERE nth < 3) AS base,
    count(*) FILTER (WHERE nth = 0) AS n_assign, count(*) FILTER (WHERE nth = 1) AS n_access, count(*) FILTER (WHERE nth = 2) AS n_hex,
    count(*) FILTER (WHERE nth = 3) AS n_entropy FROM spans GROUP BY 1
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_entropy, 0)::BIGINT AS n_entropy
FROM d LEFT JOIN texts USING (doc_id)
"""


@query(OP6)
def op6_secret_scan(spark, sf_dir):
    return secrets.scanned(read(spark, sf_dir, "documents"))


@query()
def op7_simhash_near_dedup(spark, sf_dir):
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


@query()
def op8_pii(spark, sf_dir):
    return personal.found_in(read(spark, sf_dir, "documents"))


@query()
def op9_toxicity(spark, sf_dir):
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op10_token_counts(spark, sf_dir):
    return tokens.token_counts(read(spark, sf_dir, "documents"))


OP11 = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), piece AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS body FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(body, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM piece
), places AS (
  SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w
), f AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM places, range(1, 6) AS r(k) WHERE i + k - 1 <= len(words) GROUP BY 1, 2, 3
), total AS (
  SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1
), c AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k > 1 AND f >= 100
), part AS (
  SELECT lang, array_to_string(words[s : s + m - 1], ' ') AS phrase, max(a) AS most FROM c, range(1, 5) AS x(s), range(2, 5) AS y(m)
  WHERE m < k AND s + m - 1 <= k GROUP BY 1, 2
), cut AS (
  SELECT c.lang, c.phrase, c.words, c.a, j, array_to_string(c.words[: j], ' ') AS first, array_to_string(c.words[j + 1 :], ' ') AS rest
  FROM c LEFT JOIN part USING (lang, phrase), range(1, 5) AS t(j) WHERE j < k AND (most IS NULL OR 100 * most < 100 * a)
), scored AS (
  SELECT cut.lang, cut.phrase, cut.a, j, x.f AS l, y.f AS r, n, (1000::HUGEINT * cut.a * n) // (x.f::HUGEINT * y.f) AS score
  FROM cut JOIN f AS x ON x.lang = cut.lang AND x.phrase = cut.first JOIN f AS y ON y.lang = cut.lang AND y.phrase = cut.rest JOIN total ON total.lang = cut.lang
), least AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""


@query(OP11)
def op11_phrase_collocations(spark, sf_dir):
    return collocations.collocations(read(spark, sf_dir, "documents"))


@query()
def op12_language_id(spark, sf_dir):
    return languages.predicted(read(spark, sf_dir, "documents"), languages.in_fold(4, 2))


@query()
def op13_tokenizer_alignment(spark, sf_dir):
    return alignment.aligned(read(spark, sf_dir, "documents"))
