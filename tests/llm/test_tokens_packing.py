import math
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from orefield.llm import packing, tokens

AWKWARD = [
    "plain words here", "  two  blanks  ", "tab\tand\nline \n\n breaks", "a <|endoftext|> b<|endoftext|>c", "don't we're  it's",
    "é́   nbsp em", "x" * 5000, "1234567 12 3", "emoji 🙂🙂 end", "\x1c sep \x85 nel", "word​zero", "Σίσυφος ΣΑΣ İ", " ", "",
]


def test_counts_equal_the_library():
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [len(own.encode(x, add_special_tokens=False)) for x in AWKWARD]
    assert tokens.counts(AWKWARD, "byte_bpe_50k.json") == want
    assert tokens.counts(AWKWARD[::-1], "byte_bpe_50k.json") == want[::-1]


def test_ids_equal_the_library():
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = [np.array(own.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in AWKWARD]
    assert tokens.ids(AWKWARD, "word_bpe_49k.json") == want


def test_cores_and_tails_are_encoded_as_the_whole():
    import random

    rng = random.Random(8)
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    letters = "aAbBzZéÉñÑßØøıſKÅÅşŞͅΣσς漢'’\u0301\u0345.,;:!?%-19 \n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [f"{a}{b}{c}" for a in ("A", "Don't", "it's", "X1", "É", "a\u0301", "") for b in ",.;:!?" for c in ("", ".", " ,", "'s")]
    want = [np.array(own.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert tokens.ids(texts, "word_bpe_49k.json") == want
    assert tokens.ids(texts[::-1], "word_bpe_49k.json") == want[::-1]


def test_full_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    tokens.remembered.cache_clear()
    want = [len(x) for x in load_all(AWKWARD)]
    assert tokens.counts(AWKWARD, "byte_bpe_50k.json") == want
    assert len(tokens.remembered("byte_bpe_50k.json", "counts").kept) <= 100
    tokens.remembered.cache_clear()


def load_all(texts):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [own.encode(x, add_special_tokens=False) for x in texts]


def test_counts_of_odd_rows(odd, none):
    rows = tokens.token_counts(odd).collect()
    assert len(rows) == 10
    assert {r.doc_id: r.n_tokens for r in rows if r.doc_id in (0, 1)} == {0: 0, 1: 0}
    assert [r.over_limit for r in rows if r.doc_id == 3] == [True]
    assert tokens.token_counts(none).count() == 0


def test_packing_of_odd_rows(odd, none):
    rows = packing.packed_documents(odd, capacity=64).collect()
    by_bin, by_doc = {}, {}
    for r in rows:
        by_bin.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 64
    assert by_doc[0] == [(0, 0, 1)] and len(by_doc[5]) == 2 and None in by_doc
    for key, parts in by_doc.items():
        if key != 5:
            assert all(n == 64 for _, _, n in sorted(parts)[:-1])
    assert len(by_bin) <= math.ceil(sum(r.length for r in rows) / 64) + 1
    assert packing.packed_documents(none).count() == 0


def test_pieces_carry_their_ids(table):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = " ".join(f"number{i}" for i in range(50))
    ids = [*own.encode(text, add_special_tokens=False).ids, 1]
    found = packing.pieces(table([text]), "word_bpe_49k.json", 32).orderBy("piece").collect()
    want = [zlib.crc32(np.array(ids[i : i + 32], "<u4").tobytes()) for i in range(0, len(ids), 32)]
    assert [r.ids_crc32 for r in found] == want


def test_crossover_keeps_every_item_once():
    import random

    rng = random.Random(3)
    lengths = sorted((rng.randrange(1, 60) for _ in range(300)), reverse=True)
    parents = []
    for order in (range(300), rng.sample(range(300), 300)):
        bins, fills = [], []
        packing.best_fit(bins, fills, order, lengths, 100)
        parents.append((bins, fills))
    for child in (packing.crossover(*parents, lengths, 100, rng), packing.mutated(parents[0], lengths, 100, rng)):
        assert sorted(x for b in child[0] for x in b) == list(range(300))
        assert child[1] == [sum(lengths[x] for x in b) for b in child[0]] and max(child[1]) <= 100


def test_islands_are_no_worse_than_their_guest():
    lengths = sorted([51, 49] * 20 + [26, 27, 23, 24] * 20, reverse=True)
    alone, n, _, crossed = packing.evolve(lengths, 100, [], 1)
    again, m, _, _ = packing.evolve(lengths, 100, [alone], 2)
    assert crossed > 0 and m <= n and -(-sum(lengths) // 100) <= m


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for each item."""
    best = len(lengths)

    def place(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(lengths):
            best = len(fills)
            return
        for f in set(fills):
            if f + lengths[i] <= capacity:
                rest = list(fills)
                rest.remove(f)
                place(i + 1, [*rest, f + lengths[i]])
        place(i + 1, [*fills, lengths[i]])

    place(0, [])
    return best


def test_small_blocks_reach_the_optimum():
    import random

    rng = random.Random(11)
    for case in range(60):
        lengths = sorted((rng.choice([rng.randrange(1, 100), rng.randrange(30, 60)]) for _ in range(8)), reverse=True)
        own, n, _, _ = packing.evolve(lengths, 100, [], case)
        fills = {}
        for i, b in enumerate(own):
            fills[b] = fills.get(b, 0) + lengths[i]
        assert max(fills.values()) <= 100 and len(fills) == n == fewest(lengths, 100), lengths


def many(table, spark, parts):
    rows = table([" ".join(["word"] * (1 + 7 * i % 50)) for i in range(300)])
    return rows.repartition(parts, "text")


def test_blocks_and_levels(table, spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 40)
    found = []
    for parts in (3, 30):
        rows = packing.packed_documents(many(table, spark, parts), capacity=64).collect()
        assert len(rows) == len({(r.doc_id, r.piece) for r in rows}) == 300
        fill = {}
        for r in rows:
            fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
        assert max(fill.values()) <= 64 and len(fill) <= math.ceil(sum(fill.values()) / 64) + 2
        found.append(sorted(map(tuple, rows)))
    assert found[0] == found[1]


def test_islands_cross(table, spark):
    from pyspark.sql import functions as F

    items = packing.pieces(many(table, spark, 3), "word_bpe_49k.json", 64).withColumn("block", F.lit(0).cast("long"))
    rows = packing.evolved_blocks(items, 64).collect()
    assert len(rows) == packing.ISLANDS and all(r.crossed > 0 for r in rows)


def test_copies_of_one_row_are_dealt_out(spark, table):
    rows = packing.pieces(table([(7, "the same text")] * 400), "word_bpe_49k.json", 64)
    assert rows.select("slot").distinct().count() >= 100
