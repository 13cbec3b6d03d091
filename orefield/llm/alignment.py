"""Alignment of two tokenizers' tokens over the bytes of each text.

The text's tokens by vocabulary A (byte-level BPE of a blank and the text) and B (pieces, whose library
adds the blank) are cut into groups where a token of each ends at the same byte. The tokens that end in
a range of bytes make a fragment: an open prefix up to the first common end, closed groups, an open
suffix behind the last. Fragments compose associatively (a suffix and the next prefix close a group), so a
long document is dealt out in chunks of bytes over many tasks and put together by a tree of joins of 16.

Texts are encoded in runs between safe boundaries, where neither library's own splitting reaches across;
runs recur, so each worker keeps those it has encoded. A chunk that ends inside a run encodes the whole
run and takes the tokens that end in its range, as does the next chunk.

How many documents hold a pair linked is summed over tasks, each of which counts its own documents.
Those counts come back to the tasks in blocks of A ids of bounded size, one block after the other.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass, field
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import by_bytes, prepare, stored
from orefield.llm.tokens import CACHE_CHARS, SAFE

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a chunk; longer documents are dealt out over tasks.
CHUNK = 32 << 10
#: Fragments that one step of the tree puts together.
FAN = 16
#: Pairs of a broadcast block of counts, 16 bytes each; one A id's pairs are never parted.
BLOCK_PAIRS = 2_000_000
#: Runs that a worker keeps; a bound of memory, never of results.
KEPT_RUNS = 150_000
#: Links of a group beyond which they are counted by ids.
LARGE = 4096
NOTHING = np.zeros(0, np.int64)


class Pair:
    """Both vocabularies: ids and byte ends of a run's tokens."""

    def __init__(self, a: str, b: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        where = [x if "/" in x else public_tokenizers.path(x) for x in (a, b)]
        self.a = Tokenizer.from_file(where[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=where[1])
        self.size_b = self.b.get_piece_size()
        self.size_a = self.a.get_vocab_size(with_added_tokens=True)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.size_a
        for entry, i in self.a.get_vocab(with_added_tokens=True).items():
            self.bytes_a[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.bytes_b = [self.piece(i) for i in range(self.size_b)]
        self.length_a, self.length_b = (list(map(len, x)) for x in (self.bytes_a, self.bytes_b))
        #: For each id: itself and a comma, the bar behind a group's last a, the semicolon behind its last b.
        self.marks = [f"{i}{mark}" for i in range(max(self.size_a, self.size_b)) for mark in ",|;"]

    def piece(self, i: int) -> bytes:
        entry = self.b.id_to_piece(i)
        return bytes([int(entry[3:5], 16)]) if self.b.is_byte(i) else entry.replace("▁", " ").encode()

    def encoded(self, runs: list[str]):
        """(a ids, b ids) of a blank and each run, or None where its bytes are not all there."""
        found_a = self.a.encode_batch_fast([" " + x for x in runs], add_special_tokens=False)
        found_b = self.b.encode(runs, num_threads=1)
        of_a, of_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        found_a = [e.ids for e in found_a]
        whole = b"".join([b" " + x.encode() for x in runs])
        # As a rule all are whole; else each is looked at.
        if b"".join(map(of_a, chain.from_iterable(found_a))) == whole == b"".join(map(of_b, chain.from_iterable(found_b))):
            return list(zip(found_a, found_b, strict=True))
        own = (b" " + x.encode() for x in runs)
        return [(a, b) if b"".join(map(of_a, a)) == x == b"".join(map(of_b, b)) else None for x, a, b in zip(own, found_a, found_b, strict=True)]

    def parted(self, tokens, low: int, high: int):
        """Of the tokens that end in (low, high]: lists of a ids and of b ids up to each common end, and what is left behind."""
        length_a, length_b = self.length_a, self.length_b
        ids_a, ids_b = tokens
        end_a = end_b = i = j = 0
        groups, a, b = [], [], []
        while True:
            if end_a <= end_b:
                if i == len(ids_a):
                    break
                x = ids_a[i]
                i, end_a = i + 1, end_a + length_a[x]
                if low < end_a <= high:
                    a.append(x)
            else:
                if j == len(ids_b):
                    break
                x = ids_b[j]
                j, end_b = j + 1, end_b + length_b[x]
                if low < end_b <= high:
                    b.append(x)
            if end_a == end_b and low < end_a <= high:
                groups.append((a, b))
                a, b = [], []
            elif min(end_a, end_b) > high:
                break
        return groups, (a, b)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in entries of a byte-level vocabulary: printable ones stand
    for themselves, the others, in order, are the characters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [x for x in range(256) if x not in set(plain)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(others)}


@dataclass
class Fragment:
    """The tokens that end in a range of bytes. ``open`` if no common end lies in it: all is in the head then.

    The head is empty where the range begins at a known common end. ``codes`` are the linked id pairs
    of the closed groups (a * size of B + b) and ``times`` how often each is linked.
    """

    open: bool = True
    valid: bool = True
    head_a: list[int] = field(default_factory=list)
    head_b: list[int] = field(default_factory=list)
    groups: str = ""
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    codes: np.ndarray = field(default_factory=lambda: NOTHING)
    times: np.ndarray = field(default_factory=lambda: NOTHING)
    tail_a: list[int] = field(default_factory=list)
    tail_b: list[int] = field(default_factory=list)


def summed(codes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(times[order], first) if len(codes) else times


def linked_ids(groups: list, size_b: int) -> dict[int, int]:
    """The id pairs of groups, in each every a with every b, and how often each comes."""
    out: dict[int, int] = {}
    for a, b in groups:
        if len(a) * len(b) > 64:
            a, b = Counter(a), Counter(b)
            for x, n in a.items():
                for y, m in b.items():
                    out[x * size_b + y] = out.get(x * size_b + y, 0) + n * m
        else:
            for x in a:
                for y in b:
                    out[x * size_b + y] = out.get(x * size_b + y, 0) + 1
    return out


def written(groups: list) -> str:
    return ";".join([",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups])


def fragment(tokens, low: int, high: int, begun: bool, pair: Pair) -> Fragment:
    """The tokens of a run that end in (low, high]. ``begun``: low is a known common end."""
    if tokens is None:
        return Fragment(valid=False)
    groups, (a, b) = pair.parted(tokens, low, high)
    if not groups and not begun:
        return Fragment(head_a=a, head_b=b)
    out = Fragment(open=False, tail_a=a, tail_b=b)
    if not begun:
        out.head_a, out.head_b = groups.pop(0)
    return closed(out, groups, pair.size_b)


def closed(out: Fragment, groups: list, size_b: int) -> Fragment:
    """``out`` with these groups behind its own."""
    if groups:
        found = linked_ids(groups, size_b)
        codes, times = np.fromiter(found, np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
        out.codes, out.times = summed(np.concatenate([out.codes, codes]), np.concatenate([out.times, times]))
        text = written(groups)
        out.groups = f"{out.groups};{text}" if out.groups else text
        out.n_a, out.n_b = out.n_a + sum(len(a) for a, _ in groups), out.n_b + sum(len(b) for _, b in groups)
        out.n_groups += len(groups)
    return out


def composed(x: Fragment, y: Fragment, size_b: int) -> Fragment:
    """``x`` and then ``y``. Associative; the empty open fragment changes nothing."""
    valid = x.valid and y.valid
    if x.open:
        return Fragment(**{**vars(y), "valid": valid, "head_a": x.head_a + y.head_a, "head_b": x.head_b + y.head_b})
    if y.open:
        return Fragment(**{**vars(x), "valid": valid, "tail_a": x.tail_a + y.head_a, "tail_b": x.tail_b + y.head_b})
    out = Fragment(**{**vars(x), "valid": valid, "tail_a": y.tail_a, "tail_b": y.tail_b})
    middle = x.tail_a + y.head_a
    out = closed(out, [(middle, x.tail_b + y.head_b)] if middle else [], size_b)
    if y.n_groups:
        out.codes, out.times = summed(np.concatenate([out.codes, y.codes]), np.concatenate([out.times, y.times]))
        out.groups = f"{out.groups};{y.groups}" if out.groups else y.groups
        out.n_a, out.n_b, out.n_groups = out.n_a + y.n_a, out.n_b + y.n_b, out.n_groups + y.n_groups
    return out


def grouped(tokens: list, pair: Pair):
    """All runs at once, as if their texts were one: counts (tokens of A, of B, groups, pairs), pairs, their numbers, texts.

    Every run ends at a common end, so no group reaches from one run into the next.
    """
    n_a, n_b = (np.array([len(x[i]) for x in tokens], np.int64) for i in (0, 1))
    a, b = (np.array(list(chain.from_iterable(x[i] for x in tokens)), np.int64) for i in (0, 1))
    ends_a, ends_b = np.cumsum(np.array(pair.length_a)[a]), np.cumsum(np.array(pair.length_b)[b])
    last_a, last_b = (np.isin(x, y, assume_unique=True) for x, y in ((ends_a, ends_b), (ends_b, ends_a)))
    of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    run_a = np.repeat(np.arange(len(tokens)), n_a)
    run = run_a[last_a]
    n = len(run)
    size_a, size_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    # Each a with each b of its group; large groups by the numbers of their ids.
    large = size_a * size_b > LARGE
    times_a = np.where(large, 0, size_b)[of_a]
    total = np.cumsum(times_a)
    place = np.arange(total[-1] if len(total) else 0) - np.repeat(total - times_a, times_a) + np.repeat((np.cumsum(size_b) - size_b)[of_a], times_a)
    code = np.repeat(a, times_a) * pair.size_b + b[place]
    span = pair.size_a * pair.size_b
    keys, times = np.unique(np.repeat(run_a, times_a) * span + code, return_counts=True)
    for g in np.flatnonzero(large).tolist():
        found = linked_ids([(a[of_a == g].tolist(), b[of_b == g].tolist())], pair.size_b)
        keys = np.concatenate([keys, run[g] * span + np.fromiter(found, np.int64, len(found))])
        times = np.concatenate([times, np.fromiter(found.values(), np.int64, len(found))])
    if large.any():
        keys, times = summed(keys, times)
    counts = np.column_stack([n_a, n_b, np.bincount(run, minlength=len(tokens)), np.bincount(keys // span, minlength=len(tokens))])
    # Ids in the order of the digest: a group's a, then its b, each with the mark that follows.
    order = np.empty(len(a) + len(b), np.int64)
    marks = pair.marks
    before_b = np.cumsum(size_b) - size_b
    order[np.arange(len(a)) + before_b[of_a]] = a * 3 + last_a
    order[np.arange(len(b)) + np.cumsum(size_a)[of_b]] = b * 3 + 2 * last_b
    words, ends = list(map(marks.__getitem__, order.tolist())), np.cumsum(n_a + n_b).tolist()
    texts = ["".join(words[i:j])[:-1] for i, j in zip([0, *ends], ends, strict=False)]
    return counts, keys % span, times, texts


class Runs:
    """Encoded runs of a worker; ``of`` puts whole runs together as one closed fragment.

    Runs are numbered; their groups are texts, their counts and linked pairs lie in common arrays.
    """

    def __init__(self, a: str, b: str):
        self.pair = Pair(a, b)
        self.at: dict[str, int] = {}
        self.texts: list[str] = []
        #: For each run: tokens of A and of B, groups, where its pairs begin, how many there are, whether it is valid.
        self.numbers = np.zeros((1024, 6), np.int64)
        self.pairs = np.zeros((1024, 2), np.int64)
        self.used, self.passing = 0, []

    def learn(self, lists: list[list[str]]) -> None:
        """Encode, in one call, the runs that are not known yet. Long ones, and those that no longer fit, pass with ``forget``."""
        new = list(set().union(*lists).difference(self.at))
        room = max(0, KEPT_RUNS - len(self.at))
        kept = [x for x in new if len(x) <= CACHE_CHARS]
        passing = [*(x for x in new if len(x) > CACHE_CHARS), *kept[room:]]
        self._add(kept[:room])
        self.mark = (len(self.texts), self.used)
        self._add(passing)
        self.passing = passing

    def _add(self, runs: list[str]) -> None:
        if not runs:
            return
        pair, first = self.pair, len(self.texts)
        tokens = pair.encoded(runs)
        self.at.update(zip(runs, range(first, first + len(runs)), strict=True))
        counts, codes, times, texts = grouped([x or ([], []) for x in tokens], pair)
        valid = np.array([x is not None for x in tokens])
        starts = self.used + np.cumsum(counts[:, 3]) - counts[:, 3]
        numbers = np.column_stack([counts[:, :3], starts, counts[:, 3], valid])
        self.texts += texts
        self.numbers = self._put(self.numbers, first, numbers)
        self.pairs = self._put(self.pairs, self.used, np.column_stack([codes, times]))
        self.used += len(codes)

    @staticmethod
    def _put(held: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
        if at + len(new) > len(held):
            held = np.concatenate([held, np.zeros((max(len(held), at + len(new) - len(held)), held.shape[1]), np.int64)])
        held[at : at + len(new)] = new
        return held

    def forget(self) -> None:
        for x in self.passing:
            del self.at[x]
        self.passing = []
        n, self.used = self.mark
        del self.texts[n:]

    def of(self, runs: list[str]) -> Fragment:
        if not runs:
            return Fragment(open=False)
        at = list(map(self.at.__getitem__, runs))
        own, n = np.unique(np.array(at), return_counts=True)
        numbers = self.numbers[own]
        if not numbers[:, 5].all():
            return Fragment(open=False, valid=False)
        n_a, n_b, n_groups = (n @ numbers[:, :3]).tolist()
        starts, sizes = numbers[:, 3], numbers[:, 4]
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(starts - ends + sizes, sizes)
        codes, times = summed(self.pairs[places, 0], self.pairs[places, 1] * np.repeat(n, sizes))
        groups = ";".join(map(self.texts.__getitem__, at))
        return Fragment(open=False, groups=groups, n_a=n_a, n_b=n_b, n_groups=n_groups, codes=codes, times=times)


@cache
def runs_of(a: str, b: str) -> Runs:
    """One for each worker process; Spark reuses workers for many tasks."""
    return Runs(a, b)


def chunks(text: str, size: int):
    """(text, skip, high) of each chunk: its runs, and the bytes of a blank and them among which its tokens end."""
    runs = SAFE.split(text)
    ends = np.cumsum([1 + len(x.encode()) for x in runs]).tolist()
    low = first = 0
    while first < len(runs):
        start = ends[first - 1] if first else 0
        last = first
        while ends[last] < low + size and last + 1 < len(runs):
            last += 1
        # A run that is long itself is not cut, so that no run is encoded more than twice.
        high = low + size if ends[last] > low + size and ends[last] - (ends[last - 1] if last else 0) <= size // 2 else ends[last]
        yield " ".join(runs[first : last + 1]), low - start, high - start
        low, first = high, last if high < ends[last] else last + 1


def chunk_fragment(runs: Runs, text: str, skip: int, high: int) -> Fragment:
    """The fragment of one chunk: a first run from ``skip`` on, whole runs, a last one up to ``high``."""
    parts, size = SAFE.split(text), runs.pair.size_b
    lengths = [1 + len(x.encode()) for x in parts]
    rest = sum(lengths) - high
    own, before = list(parts), Fragment()
    if skip:
        stop = lengths[0] if len(parts) > 1 else high
        before = fragment(runs.pair.encoded(own[:1])[0], skip, stop, False, runs.pair)
        own = own[1:]
    behind = Fragment()
    if rest and own:
        behind = fragment(runs.pair.encoded(own[-1:])[0], 0, lengths[-1] - rest, True, runs.pair)
        own = own[:-1]
    runs.learn([own])
    middle = runs.of(own) if own or not skip else Fragment()
    runs.forget()
    return composed(composed(before, middle, size), behind, size)


LINKS = "codes binary, times binary"
PART = (
    "open boolean, valid boolean, head_a array<long>, head_b array<long>, groups string, n_a long, n_b long, n_groups long, "
    f"{LINKS}, tail_a array<long>, tail_b array<long>"
)
DONE = f"n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {LINKS}"


def packed(f: Fragment) -> dict:
    return vars(f) | {"codes": f.codes.astype("<i8").tobytes(), "times": f.times.astype("<i8").tobytes()}


def unpacked(row: dict) -> Fragment:
    return Fragment(**{k: np.frombuffer(v, "<i8") if k in ("codes", "times") else v for k, v in row.items()})


def done(f: Fragment, size_b: int) -> dict:
    """The numbers of a whole document; its first group is the head, if it came in parts."""
    f = composed(Fragment(open=False), f, size_b)
    if not f.valid or f.tail_a or f.tail_b or not f.n_groups:
        return {"n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": "", "codes": b"", "times": b""}
    return {
        "n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "n_links": int(f.times.sum()), "groups_sha256": hashlib.sha256(f.groups.encode()).hexdigest(),
        "codes": f.codes.astype("<i8").tobytes(), "times": f.times.astype("<i8").tobytes(),
    }


def schema_of(spark, fields: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    spark_schema = spark.createDataFrame([], fields).schema
    return spark_schema, to_arrow_schema(spark_schema)


def short_documents(rows: DataFrame, kind: str, a: str, b: str, batch_bytes: int) -> DataFrame:
    spark_schema, schema = schema_of(rows.sparkSession, f"doc_id {kind}, {DONE}")

    def batches(found):
        runs = runs_of(a, b)
        for batch in found:
            texts, out = batch.column(1).to_pylist(), []
            for some in by_bytes([len(x) for x in texts], batch_bytes):
                parts = [SAFE.split(x) if x else [] for x in texts[some]]
                runs.learn(parts)
                out += [done(runs.of(x), runs.pair.size_b) for x in parts]
                runs.forget()
            own = pa.Table.from_pylist(out, pa.schema(list(schema)[1:])).combine_chunks()
            arrays = [batch.column(0), *(c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in own.columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return rows.mapInArrow(batches, spark_schema)


def long_documents(rows: DataFrame, kind: str, a: str, b: str, chunk: int) -> DataFrame:
    """Chunks dealt out over the tasks, and a tree that puts each document's fragments together."""
    spark = rows.sparkSession
    cut_schema, cut_arrow = schema_of(spark, f"doc_id {kind}, doc long, at long, text string, skip long, high long")
    part_schema, part_arrow = schema_of(spark, f"doc_id {kind}, doc long, at long, {PART}")
    done_schema, done_arrow = schema_of(spark, f"doc_id {kind}, {DONE}")
    names, size_b = part_arrow.names[3:], runs_of(a, b).pair.size_b

    def cut(found):
        for batch in found:
            for r in batch.to_pylist():
                out = [{"doc_id": r["doc_id"], "doc": r["doc"], "at": i, "text": t, "skip": s, "high": h} for i, (t, s, h) in enumerate(chunks(r["text"], chunk))]
                yield pa.RecordBatch.from_pylist(out, cut_arrow)

    def parts(found):
        runs = runs_of(a, b)
        for batch in found:
            for r in batch.to_pylist():
                f = chunk_fragment(runs, r["text"], r["skip"], r["high"])
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in ("doc_id", "doc", "at")} | packed(f)], part_arrow)

    def joined(table: pa.Table) -> tuple[dict, Fragment]:
        own, f = sorted(table.to_pylist(), key=lambda r: r["at"]), Fragment()
        for r in own:
            f = composed(f, unpacked({k: r[k] for k in names}), size_b)
        return own[0], f

    def join(table: pa.Table) -> pa.Table:
        r, f = joined(table)
        return pa.Table.from_pylist([{"doc_id": r["doc_id"], "doc": r["doc"], "at": r["at"] // FAN} | packed(f)], part_arrow)

    def finish(table: pa.Table) -> pa.Table:
        r, f = joined(table)
        return pa.Table.from_pylist([{"doc_id": r["doc_id"]} | done(f, size_b)], done_arrow)

    numbered = rows.withColumn("doc", F.monotonically_increasing_id())
    dealt = stored(numbered.select("doc_id", "doc", "text").mapInArrow(cut, cut_schema), "chunks")
    most = dealt.agg(F.max("at")).first()[0]
    found = dealt.repartition(F.col("doc"), F.col("at")).mapInArrow(parts, part_schema)
    while most and most >= FAN:
        found = found.groupBy("doc", F.expr(f"at div {FAN}")).applyInArrow(join, part_schema)
        most //= FAN
    return found.groupBy("doc").applyInArrow(finish, done_schema)


def linked(docs: DataFrame, a: str, b: str, chunk: int = CHUNK, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, counts, digest of the groups and linked pairs of every row, before any count of the corpus."""
    prepare(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    short = short_documents(rows.where(size <= chunk), kind, a, b, batch_bytes)
    return short.unionByName(long_documents(rows.where(size > chunk), kind, a, b, chunk))


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, n): how many documents hold a pair linked."""

    def batches(batches_):
        held, size = [], 0

        def flush():
            own, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n.astype(np.int64))], ["code", "n"])

        for batch in batches_:
            for x in batch.column(0):
                held.append(np.frombuffer(x.as_buffer(), "<i8"))
                size += len(held[-1])
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return found.select("codes").mapInArrow(batches, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def with_counts(found: DataFrame, counts: DataFrame, low: int, high: int, size_b: int) -> DataFrame:
    """``found`` with the counts of the pairs of A ids from ``low`` to ``high`` added to n_best and count_sum."""
    own = counts.where(F.col("code").between(low * size_b, (high + 1) * size_b - 1)).toArrow()
    codes, n = own["code"].to_numpy(), own["n"].to_numpy()
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    starts = np.flatnonzero(np.append(True, np.diff(codes // size_b) != 0))
    most = np.repeat(np.maximum.reduceat(n, starts), np.diff(np.append(starts, len(n))))
    shared = found.sparkSession.sparkContext.broadcast((codes, n, n == most))
    names, places = found.columns, [found.columns.index(x) for x in ("codes", "times", "n_best", "count_sum")]

    def batches(found):
        codes, n, best = shared.value
        for batch in found:
            mine, times, n_best, count_sum = (batch.column(i) for i in places)
            better, sums = n_best.to_numpy().copy(), count_sum.to_numpy().copy()
            for i, (x, t) in enumerate(zip(mine, times, strict=True)):
                x, t = np.frombuffer(x.as_buffer(), "<i8"), np.frombuffer(t.as_buffer(), "<i8")
                inside = slice(*np.searchsorted(x, [low * size_b, (high + 1) * size_b]))
                at, t = np.searchsorted(codes, x[inside]), t[inside]
                sums[i] += int((n[at] * t).sum())
                better[i] += int(t[best[at]].sum())
            columns = [*batch.columns]
            columns[places[2]], columns[places[3]] = pa.array(better), pa.array(sums)
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.mapInArrow(batches, found.schema)


def aligned(docs: DataFrame, a: str = VOCABULARY_A, b: str = VOCABULARY_B, chunk: int = CHUNK, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text that is null, empty or not reproduced by the tokens of either vocabulary has no tokens: zeros and
    an empty digest. A repeated row is a document of its own and counts again. An empty table gives no rows.
    A text without a safe boundary is encoded in one piece, as the libraries must see it whole.
    """
    size_b = runs_of(a, b).pair.size_b
    found = stored(linked(docs, a, b, chunk), "linked")
    counts = stored(pair_counts(found), "pairs")
    # At most one row for each id of A.
    each = counts.groupBy(F.expr(f"code div {size_b}").alias("a")).count().orderBy("a").toArrow()
    blocks, held = [], 0
    for x, n in zip(each["a"].to_pylist(), each["count"].to_pylist(), strict=True):
        if not blocks or held + n > block_pairs:
            blocks.append([x, x])
            held = 0
        blocks[-1][1] = x
        held += n
    zero = F.lit(0).cast("long")
    out = found.withColumns({"n_best": zero, "count_sum": zero})
    for i, (low, high) in enumerate(blocks):
        out = with_counts(out, counts, low, high, size_b)
        if i + 1 < len(blocks):
            out = stored(out, "aligned")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
