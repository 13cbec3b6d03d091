"""Token counts and ids by the library's vocabularies, in Arrow batches.

A text is cut at safe boundaries, where the library's own splitting of the text cannot reach across,
so the parts may be encoded alone. Parts recur often; each worker keeps what it has encoded, up to
``CACHE_PARTS`` parts, and hands the others to the library in one batch.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import by_bytes, id_and_text

#: Parts that a worker remembers, by frequency of arrival; a bound of memory, never of results.
CACHE_PARTS = 500_000
#: The same for words in the word vocabulary, which take less room.
CACHE_WORDS = 1_200_000
#: Longer parts are not remembered.
CACHE_CHARS = 64
#: A single blank between two characters that are no white space: byte-level BPE puts it at the start
#: of the next token and no token of its pattern reaches over it.
SAFE = re.compile(r"(?<=\S) (?=\S)")


@cache
def load(vocabulary: str):
    """The tokenizer of a file name in public_tokenizers, or of a path."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))


class Remembered:
    """What ``of`` makes of the library's encoding of a part, kept for parts that come again."""

    def most(self) -> int:
        return CACHE_PARTS

    def __init__(self, vocabulary: str, prefix: str, of: Callable):
        self.tokenizer, self.prefix, self.of, self.kept = load(vocabulary), prefix, of, {}

    def encoded(self, parts: list[str]) -> dict:
        found = self.tokenizer.encode_batch_fast([self.prefix + x for x in parts], add_special_tokens=False)
        return dict(zip(parts, map(self.of, found), strict=True))

    def fresh(self, parts: list[str]) -> dict:
        """The values of parts that are not kept."""
        return self.encoded(parts)

    def of_all(self, lists: list[list[str]]) -> list[list]:
        """The value of each part of each list; parts not seen before go to the library together."""
        kept = self.kept
        new = list(set().union(*lists).difference(kept))
        own = self.fresh(new) if new else {}
        room = max(0, self.most() - len(kept))
        kept.update(own)
        found = [list(map(kept.__getitem__, x)) for x in lists]
        fit = 0
        for x in own:
            fit += len(x) <= CACHE_CHARS
            if len(x) > CACHE_CHARS or fit > room:
                del kept[x]
        return found


class RememberedWords(Remembered):
    """Ids by a vocabulary of words in small letters, whose last token of a word shows its end.

    A part is put together from a core and an end mark, which the library parts as well; cores come in
    fewer forms. Plain cores are one word each, so they are encoded as one text and parted at word ends.
    """

    def most(self) -> int:
        return CACHE_WORDS

    def __init__(self, vocabulary: str):
        super().__init__(vocabulary, "", little_endian)
        entries = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(1 + max(entries.values()), bool)
        self.ends[[i for x, i in entries.items() if x.endswith("</w>")]] = True
        self.tails: dict = {}

    def fresh(self, parts: list[str]) -> dict:
        cut = list(map(core_and_tail, parts))
        new = {core for core, _ in cut}.difference(self.kept)
        plain = [x for x in new if PLAIN.fullmatch(x)]
        out = self.encoded(list(new.difference(plain)))
        out |= self.one_text(plain)
        self.tails |= self.encoded(list({tail for _, tail in cut}.difference(self.tails)))
        kept, tails = self.kept, self.tails
        own = {x: (out[core] if core in out else kept[core]) + tails[tail] for x, (core, tail) in zip(parts, cut, strict=True)}
        return out | own

    def one_text(self, words: list[str]) -> dict:
        if not words:
            return {}
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self.encoded(words)
        held = ids.tobytes()
        return {x: held[i:j] for x, i, j in zip(words, [0, *ends], ends, strict=False)}


@cache
def remembered(vocabulary: str, kind: str) -> Remembered:
    """One memory for each worker process; Spark reuses workers for many tasks."""
    if kind == "counts":
        return Remembered(vocabulary, " ", len)
    return RememberedWords(vocabulary)


#: Marks that end words, which the word vocabulary's splitting parts from letters before them.
TAILS = frozenset(",.;:!?")
#: One word, whatever is done to case and composed letters.
PLAIN = re.compile("[a-zß-öø-ÿ]+")


def core_and_tail(part: str) -> tuple[str, str]:
    """A part in the word vocabulary, which knows small letters only: the first letter small, an end mark apart.

    Only plain cases are taken apart: a mark behind a letter below U+0250, a first letter A-Z.
    """
    tail = ""
    if len(part) > 1 and part[-1] in TAILS and part[-2] < "\u0250" and part[-2].isalpha():
        part, tail = part[:-1], part[-1]
    if part and "A" <= part[0] <= "Z":
        part = part[0].lower() + part[1:]
    return part, tail


def little_endian(encoding) -> bytes:
    """Ids as unsigned 32-bit numbers, little-endian."""
    own = array("I", encoding.ids)
    if sys.byteorder != "little":
        own.byteswap()
    return own.tobytes()


def counts(texts: list[str], vocabulary: str) -> list[int]:
    """Tokens of each text by a byte-level BPE vocabulary."""
    memory = remembered(vocabulary, "counts")
    parts = [SAFE.split(x) for x in texts]
    heads = memory.tokenizer.encode_batch_fast([x[0] for x in parts], add_special_tokens=False)
    rest = memory.of_all([x[1:] for x in parts])
    return [len(h) + sum(r) for h, r in zip(heads, rest, strict=True)]


def ids(texts: list[str], vocabulary: str) -> list[bytes]:
    """Ids (little-endian unsigned 32 bit) of each text by the word vocabulary, which drops white space."""
    memory = remembered(vocabulary, "ids")
    parts = [x.replace("\n", " ").split(" ") for x in texts]
    return list(map(b"".join, memory.of_all(parts)))


def with_counts(docs: DataFrame, vocabulary: str, batch_bytes: int = 4 << 20) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one per row of ``docs``.

    A null or empty text counts 0. Repeated rows are counted each. Special strings inside a text are
    handled as the library does by default. An empty table gives no rows.
    """
    rows = id_and_text(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")

    def batches(found):
        for batch in found:
            texts, sizes, out = batch.column(2).to_pylist(), batch.column(1).to_pylist(), []
            for some in by_bytes(sizes, batch_bytes):
                out += counts(texts[some], vocabulary)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["doc_id", "n_bytes", "n_tokens"]
            )

    return rows.mapInArrow(batches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long")


def over(limit: int) -> Column:
    return F.col("n_tokens") > F.lit(limit)


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """``with_counts`` and whether a text has more than ``limit`` tokens."""
    return with_counts(docs, vocabulary).withColumn("over_limit", over(limit))
