"""The pipeline stage by stage against plain Python, and the registered queries."""

import random
import re

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as contract
import corpus_pipeline
from orefield.llm.common import stored


def corpus(spark, table):
    rng = random.Random(11)

    def prose(n):
        return "\n".join(" ".join(f"{rng.choice('abcdefghijk')}{rng.randrange(900)}" for _ in range(14)) for _ in range(n))

    item = " ".join(f"bench{i}" for i in range(30))
    long = prose(300)
    docs = [prose(5), long, long, long.replace("a1", "zz", 1), "short one", "again and again " * 30, prose(2) + " " + item, prose(3) + " mail me@mail.example.org", None, ""]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return table(docs), bench


def test_stages(spark, table, folder):
    docs, bench = corpus(spark, table)
    bench.write.parquet(f"{folder}/benchmark.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    steps, now = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = stored(stage(spark, now, folder), "step")
        steps[name] = {r.doc_id for r in now.collect()}
        assert steps[name] <= {r.doc_id for r in before.collect()}
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
            last = {r.doc_id: r for r in now.collect()}
    assert [steps[n] for n, _ in corpus_pipeline.STAGES] == [{0, 1, 2, 3, 6, 7}, {0, 1, 6, 7}, {0, 1, 7}, {0, 1, 7}, {0, 1, 7}]
    assert "[EMAIL]" in last[7].text and "@" not in last[7].text and last[0].text == docs.where("doc_id = 0").first().text
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sum(len(own.encode(r.text, add_special_tokens=False)) + 1 for r in last.values())
    assert now.agg({"length": "sum"}).first()[0] == want
    whole = corpus_pipeline.run(spark, folder)
    assert whole.select("doc_id", "piece", "length", "ids_crc32").exceptAll(now.select("doc_id", "piece", "length", "ids_crc32")).isEmpty()


def test_empty_tables(spark, none, folder):
    none.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_operator_is_registered():
    names = {re.match(r"op\d+", n)[0] for n in contract.queries() if re.match(r"op\d+_", n)}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in contract.queries()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
