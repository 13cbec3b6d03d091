import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orefield.llm import alignment

ODD = [
    None, "", "  lead", "a  b\tc", "▁x y", "a▁ b", "é漢字☃ \x00 z  ", "<|endoftext|> b </s> <s><unk>", " ", "x" * 900 + " " + "ab" * 900, "it's don't  \n\n x",
    "naïve ﬁ １２３ ١٢ 　 \xa0 ﻿ a​b", "\n", "word " * 400, "漢字かな" * 60 + " end of it " * 60, "é \U0001f642\U0001f642", "same text", "same text",
]


@pytest.fixture(scope="module")
def library():
    a = Tokenizer.from_file(public_tokenizers.path(alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(alignment.VOCABULARY_B))
    alphabet = alignment.byte_alphabet()
    names = {i: s for s, i in a.get_vocab(with_added_tokens=True).items()}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        """Both libraries on the whole text, and one walk over its bytes."""
        if not text:
            return []
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a, bytes_b = [bytes(alphabet[c] for c in names[i]) for i in ids_a], [piece(i) for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            return []
        ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b))
        out, low = [], 0
        for end in sorted(set(ends_a) & set(ends_b)):
            out.append(([i for i, e in zip(ids_a, ends_a, strict=True) if low < e <= end], [i for i, e in zip(ids_b, ends_b, strict=True) if low < e <= end]))
            low = end
        return out

    return groups


def brute(rows, groups):
    found, counts = [], Counter()
    for key, text in rows:
        g = groups(text)
        links = Counter((x, y) for a, b in g for x in a for y in b)
        counts.update(set(links))
        found.append((key, g, links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    text = lambda g: ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
    return sorted(
        (
            str(key), sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(links.values()), sum(n for p, n in links.items() if counts[p] == best[p[0]]),
            sum(n * counts[p] for p, n in links.items()), hashlib.sha256(text(g).encode()).hexdigest() if g else "",
        )
        for key, g, links in found
    )


def own(df):
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((str(r["doc_id"]), *(r[n] for n in names)) for r in df.collect())


@pytest.mark.parametrize("chunk,block", [(alignment.CHUNK, alignment.BLOCK_PAIRS), (300, 40), (17, 10**6)])
def test_equals_brute_force(spark, library, table, chunk, block):
    """Short and long chunks, one and many blocks of counts, a tree of several levels."""
    rng = random.Random(3)
    prose = [" ".join(rng.choice(["the", "cat", "Straße", "naïve", "12", "(x)", "don't"]) for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rows = [*enumerate(ODD + prose), (3, "again"), (None, "no id")]
    assert own(alignment.aligned(table(rows).repartition(3), chunk=chunk, block_pairs=block)) == brute(rows, library)


def test_composition_is_associative():
    """Any tree over any cuts gives the fragment of the whole; the empty one changes nothing."""
    pair, rng = alignment.runs_of(alignment.VOCABULARY_A, alignment.VOCABULARY_B).pair, random.Random(4)
    text = "The naïve cats, 12345 of them, weren't overwhelmingly transmogrified 漢字かな " * 3
    tokens = pair.encoded([text])[0]
    size, n = pair.size_b, len(text.encode()) + 1
    whole = alignment.done(alignment.fragment(tokens, 0, n, True, pair), size)
    for _ in range(30):
        ends = sorted(rng.sample(range(1, n), rng.randrange(1, 25))) + [n]
        parts = [alignment.fragment(tokens, low, high, low == 0, pair) for low, high in zip([0, *ends], ends, strict=False)]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [alignment.composed(parts[i], parts[i + 1], size)]
        assert alignment.done(alignment.composed(alignment.Fragment(), parts[0], size), size) == whole
        assert alignment.done(alignment.composed(parts[0], alignment.Fragment(), size), size) == whole


def test_chunks_cover_each_byte_once():
    rng = random.Random(5)
    for size in (5, 16, 64):
        text = "".join(rng.choice(["a", "é", "漢", " ", " ", "\n", "xyzxyzxyzxyzxyz"]) for _ in range(300))
        high = 0
        for part, skip, end in alignment.chunks(text, size):
            at = high - skip
            assert (" " + text).encode()[at:].startswith((" " + part).encode() if at == 0 or text.encode()[at - 1 : at] == b" " else part.encode())
            assert end > skip >= 0
            high = at + end
        assert high == len(text.encode()) + 1


def test_large_groups_and_full_memory(spark, library, table, monkeypatch):
    rows = [*enumerate(["漢字" * 50, "a b c", "漢字 " * 20, "zebra stripes"])]
    monkeypatch.setattr(alignment, "LARGE", 1)
    runs = alignment.Runs(alignment.VOCABULARY_A, alignment.VOCABULARY_B)
    monkeypatch.setattr(alignment, "KEPT_RUNS", 2)
    for _ in range(2):
        parts = [alignment.SAFE.split(t) for _, t in rows]
        runs.learn(parts)
        got = [alignment.done(runs.of(p), runs.pair.size_b) for p in parts]
        runs.forget()
        assert len(runs.at) <= 2
        want = brute(rows, library)
        assert [(str(i), x["n_a"], x["n_b"], x["n_groups"], x["n_links"], x["groups_sha256"]) for i, x in enumerate(got)] == [(w[0], *w[1:5], w[7]) for w in want]


def test_odd_rows(spark, odd, none, library):
    assert alignment.aligned(none).count() == 0
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id != 3]
    found = own(alignment.aligned(odd))
    assert len(found) == 10 and [x[:5] for x in found if x[0] != "3"] == [x[:5] for x in brute(rows, library)]
