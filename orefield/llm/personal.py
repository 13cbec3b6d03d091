"""Personal data: patterns, and a skip-chain conditional random field that carries labels across a document.

The field runs over the lines that hold a digit, an at sign, or the words at and dot as signs. Its chain joins neighbouring words; its
skip edges join repeats of a word in the document, and words with the same digits or the same letters,
one to the next, so that any number of repeats adds as many edges. Loopy sum-product messages spread
the evidence: a number that the patterns accept in one place lifts its repeats elsewhere.

The weights are fitted piece by piece (word features, chain, skip edges) on a bounded sample of
documents whose labels are the pattern matches. The sample is read three times: as it is, with the telling
characters blanked, and with its matches written as people hide them (``hidden``), so that context, shape and
disguise have to speak as well. What the field adds has to be possible data of its kind (``possible``).
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orefield.llm.common import id_and_text, prepare, sampled

# The kinds in their order and what their matches must look like.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MASKS = {k: f"[{k.upper()}]" for k in KINDS}

SAMPLE, SAMPLE_CHARS = 600, 20_000
HASHED, STEPS, RATE, DECAY = 4096, 150, 1.0, 1e-4
#: Ways to hide a match; how much more a word of personal data may count than one without, in fitting.
WAYS, MOST_WEIGHT = 4, 30.0
DAMPING, CERTAIN = 0.3, 0.95
#: Messages that move by less are settled. An edge that has had so many turns more than the longest line or chain of
#: repeats has words is in a loop that does not settle by itself: from then on it moves less by COOLING each turn.
SETTLED, TURNS, COOLING = 1e-4, 100, 0.9
#: Log odds of the label of a word under a pattern match.
MATCHED = 9.0
LABELS = len(KINDS) + 1  # 0 is no personal data
WORD = re.compile(r"\S+")
#: The words at and dot where they stand for signs: in brackets, or dot as a word.
SIGN = r"[\[({<]\s*(?:at|dot|\.)\s*[\])}>]"
TELLING = re.compile(r"[0-9@]")
DOT_WORD = re.compile(r"\sdot\s", re.IGNORECASE)
BRACKETED = re.compile(SIGN, re.IGNORECASE)
DOTTED = r"(?:\.|\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\sdot\s)"
# Ends of domains that make an at and a dot in plain words an address.
ENDINGS = "com org net edu gov mil int info biz io co dev app me tv us uk de fr es it nl eu ch be ca au jp cn in br ru".replace(" ", "|")
#: What an added span must look like; digits are counted besides.
POSSIBLE = [
    re.compile(rf"(?<![\w.%+-])[\w.%+-]++(?:@[\w-]+(?:{DOTTED}[\w-]+)*|\s*[\[({{<]\s*at\s*[\])}}>]\s*[\w-]+(?:{DOTTED}[\w-]+)+|\sat\s[\w-]+(?:{DOTTED}[\w-]+)*{DOTTED}(?:{ENDINGS})\b)", re.IGNORECASE),
    re.compile(rf"(?<![0-9])[0-9]++(?:(?:{DOTTED}|[,:])[0-9]++){{3}}(?::[0-9]++)?", re.IGNORECASE),
    re.compile(r"[0-9](?:[\x20./_-]*[0-9])+"),
    re.compile(r"\+?[(]?[0-9](?:[\x20()./_-]*[0-9])+"),
]
#: Other words of a run need this much; one has to be CERTAIN.
LIKELY = 0.5
#: The least probability of a span's own kind; what the kind must look like decides between kinds.
LEAST = 0.02


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, read from each at sign to the left and to the right."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text, start - 1):
            start -= 1
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) << (i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def digits_of(x: str) -> str:
    return "".join(c for c in x if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    found = ((m.span(), digits_of(m[0])) for m in CARD.finditer(text))
    return [s for s, d in found if 16 <= len(d) <= 19 and luhn(d)]


def ips(text: str) -> list[tuple[int, int]]:
    # A longer number with zeros in front is over four digits, or small enough to read.
    return [m.span() for m in IP.finditer(text) if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the pattern matches, by kind, then start."""
    out = [(0, *s) for s in emails(text)] if "@" in text else []
    if TELLING.search(text):
        for k, find in ((1, ips), (2, cards), (3, phones)):
            out += [(k, *s) for s in find(text)]
    return out


def telling(text: str) -> bool:
    """Whether a text or line may hold data: a digit, an at sign, or a word for a sign. Cheap looks come first."""
    if TELLING.search(text):
        return True
    if any(x in text for x in ("dot", "Dot", "DOT")) and DOT_WORD.search(text):
        return True
    return any(x in text for x in "([{<") and bool(BRACKETED.search(text))


def possible(kind: int, span: str) -> bool:
    """Whether a span may be data of its kind, other marks of writing aside."""
    if not POSSIBLE[kind].fullmatch(span):
        return False
    digits = digits_of(span)
    if kind == 1:
        parts = re.findall("[0-9]+", span)[:4]
        return all(int(p.lstrip("0")[:4] or 0) <= 255 for p in parts)
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    # Without a plus there are too many other numbers of eight or nine digits, dates among them.
    return kind == 0 or (8 if span[0] == "+" else 10) <= len(digits) <= 15


def hidden(text: str, found: list[tuple[int, int, int]], way: int = 0) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its matches written otherwise, and where they are then: one of ``WAYS`` ways, from the ``way``-th on."""
    out, spans, at, size = [], [], 0, 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a < at:
            continue
        own, digits = text[a:b], digits_of(text[a:b])
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        if k == 0:
            local, _, domain = own.partition("@")
            ways = [f"{local} at {domain.replace('.', ' dot ')}", f"{local} (at) {domain}", f"{local}[at]{domain.replace('.', '[dot]')}", f"{local}@{domain.split('.')[0]}"]
        elif k == 1:
            ways = [own.replace(".", x) for x in ("[.]", " dot ", "(.)")]
        elif k == 2:
            ways = [x.join(fours) for x in (".", "/", "_")]
        else:
            ways = [own[1:], digits, f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}"]
            ways = [x for x in ways if x[:1].isdigit() or x[1:2].isdigit()]
        new = ways[way % len(ways)]
        out += [text[at:a], new]
        size += a - at
        spans.append((k, size, size + len(new)))
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), sorted(spans)


def shape(word: str) -> str:
    if word.isalpha() and len(word) > 3:
        return "a"
    if len(word) < 12:
        plain = word.strip("[](){}<>").lower()
        if plain in ("at", "dot"):
            return f"<{plain}>"
    if any(x in word for x in "([{<"):
        word = BRACKETED.sub(lambda m: "@" if "a" in m[0].lower() else "[.]", word)
    x = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]", "9", word))
    return re.sub(r"(9{4})9+", r"\1+", x)[:24]


@dataclass
class Words:
    """The words of the telling lines of one text."""

    spans: list[tuple[int, int]]
    texts: list[str]
    joined: np.ndarray  # the word before is the neighbour in the same line

    @classmethod
    def of(cls, text: str) -> Words:
        spans, joined, at = [], [], 0
        for line in text.split("\n"):
            if telling(line):
                found = [(at + m.start(), at + m.end()) for m in WORD.finditer(line)]
                joined += [i > 0 for i in range(len(found))]
                spans += found
            at += len(line) + 1
        return cls(spans, [text[a:b] for a, b in spans], np.array(joined, bool))

    def features(self, hide: bool = False) -> np.ndarray:
        """Hashed features of each word: own shape, ends and length, and the shapes beside it."""
        shapes = [shape(w) for w in self.texts]
        out = []
        for i, (w, s) in enumerate(zip(self.texts, shapes, strict=True)):
            before = shapes[i - 1] if self.joined[i] else "^"
            after = shapes[i + 1] if i + 1 < len(shapes) and self.joined[i + 1] else "$"
            if hide:
                s = s.replace("@", "a").replace("+", "")
            n = sum(c.isdigit() for c in w)
            marks = "".join(sorted(set(re.sub(r"[\w]", "", w)))) if not hide else ""
            own = (f"s{s}", f"b{before}", f"a{after}", f"n{min(n, 20)}", f"m{marks}", f"c{w[:1].isdigit()}{w[-1:].isdigit()}", "1")
            out.append([xxhash.xxh32_intdigest(x) % HASHED for x in own])
        return np.array(out, np.int64).reshape(-1, 7)

    def skips(self) -> np.ndarray:
        """Pairs (i, j): each telling word and the next one like it, by text, by digits or by letters."""
        last: dict[str, int] = {}
        out = set()
        for i, w in enumerate(self.texts):
            if TELLING.search(w):
                plain = w.strip(".,;:!?()[]\"'").lower()
                n = digits_of(plain)
                keys = [f"w{plain}"] + ([f"d{n}"] if len(n) >= 7 else []) + ([f"l{re.sub('[^a-z]', '', plain)}"] if "@" in plain else [])
                for k in keys:
                    if k in last and last[k] != i:
                        out.add((last[k], i))
                    last[k] = i
        return np.array(sorted(out), np.int64).reshape(-1, 2)

    def longest(self, skips: np.ndarray) -> int:
        """Words of the longest line, or of the longest chain of repeats if it has more."""
        repeats = [1] * len(self.spans)
        for i, j in skips.tolist():  # in order, so that i is complete
            repeats[j] = max(repeats[j], repeats[i] + 1)
        lines = np.diff(np.append(np.flatnonzero(~self.joined), len(self.spans)))
        return max([*repeats, *lines.tolist()], default=0)

    def labels(self, found: list[tuple[int, int, int]]) -> np.ndarray:
        """The label of each word: the kind of a span that covers most of it."""
        out = np.zeros(len(self.spans), np.int64)
        starts = np.array([a for a, _ in self.spans])
        for kind, a, b in found:
            for i in range(max(0, int(np.searchsorted(starts, a, "right")) - 1), len(self.spans)):
                s, e = self.spans[i]
                if s >= b:
                    break
                if 2 * (min(e, b) - max(s, a)) > e - s and not out[i]:
                    out[i] = kind + 1
        return out


def apart(spans) -> list[tuple[int, int]]:
    """The spans in order, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def free_parts(a: int, b: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts from ``a`` to ``b`` outside of ``taken``, spans in order and apart."""
    out, k = [], bisect_right(taken, a, key=lambda x: x[1])
    while k < len(taken) and taken[k][0] < b:
        out.append((a, taken[k][0]))
        a, k = taken[k][1], k + 1
    return [(x, y) for x, y in [*out, (a, b)] if x < y]


def worth_asking(text: str, taken: list[tuple[int, int]]) -> bool:
    """Whether some telling line holds possible data outside of ``taken``: else nothing could be added."""
    at = 0
    for line in text.split("\n"):
        if telling(line):
            for a, b in free_parts(at, at + len(line), taken):
                part = text[a:b]
                if any(possible(k, m[0]) for k, pattern in enumerate(POSSIBLE) for m in pattern.finditer(part)):
                    return True
        at += len(line) + 1
    return False


@dataclass
class Field:
    """Log potentials of features, neighbours and skip edges."""

    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def marginals(self, words: Words, base: list[tuple[int, int, int]] = ()) -> np.ndarray:
        """Label probabilities of each word, by loopy sum-product messages with damping.

        The words under ``base`` have their kind as given. Messages go on where one that they depend on
        has moved, until all are settled, so that evidence reaches repeats at any distance.
        """
        n = len(words.spans)
        unary = self.weights[words.features()].sum(1)
        unary -= np.logaddexp.reduce(unary, 1, keepdims=True)
        given = words.labels(base)
        unary[given > 0] = MATCHED * (np.eye(LABELS)[given[given > 0]] - 1)
        right = np.flatnonzero(words.joined)
        skips = words.skips()
        left_ends = np.concatenate((right - 1, skips[:, 0]))
        right_ends = np.concatenate((right, skips[:, 1]))
        potentials = np.concatenate((np.repeat(self.chain[None], len(right), 0), np.repeat(self.skip[None], len(skips), 0)))
        ahead, back = np.zeros((len(left_ends), LABELS)), np.zeros((len(left_ends), LABELS))

        most = TURNS + words.longest(skips)
        b, turns, live = unary.copy(), np.zeros(len(left_ends)), np.arange(len(left_ends))
        while len(live):
            left, right = left_ends[live], right_ends[live]
            to_right = np.logaddexp.reduce((b[left] - back[live])[:, :, None] + potentials[live], 1)
            to_left = np.logaddexp.reduce((b[right] - ahead[live])[:, None, :] + potentials[live], 2)
            to_right -= np.logaddexp.reduce(to_right, 1, keepdims=True)
            to_left -= np.logaddexp.reduce(to_left, 1, keepdims=True)
            turns[live] += 1
            step = (1 - DAMPING) * COOLING ** np.maximum(0, turns[live] - most)[:, None]
            to_right, to_left = step * (to_right - ahead[live]), step * (to_left - back[live])
            ahead[live] += to_right
            back[live] += to_left
            np.add.at(b, right, to_right)
            np.add.at(b, left, to_left)
            moved = np.zeros(n, bool)
            moved[right[abs(to_right).max(1) > SETTLED]] = True
            moved[left[abs(to_left).max(1) > SETTLED]] = True
            live = np.flatnonzero(moved[left_ends] | moved[right_ends])
        return np.exp(b - np.logaddexp.reduce(b, 1, keepdims=True)) if n else b

    def more_spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Possible data in runs of words that are likely data, one of them surely; cut at the pattern matches.

        Where a run may be read in several ways, the likelier kind goes first. What is left of a word beside a
        match within it has to be sure as a word of its own.
        """
        taken = apart((a, b) for _, a, b in base)
        if not worth_asking(text, taken):
            return []
        words = Words.of(text)
        p = self.marginals(words, base)
        data = 1 - p[:, 0]
        out, i = [], 0
        while i < len(data):
            j = i + 1
            while j < len(data) and words.joined[j] and (data[j] >= LIKELY) == (data[i] >= LIKELY):
                j += 1
            if data[i] >= LIKELY and data[i:j].max() >= CERTAIN:
                for a, b in free_parts(words.spans[i][0], words.spans[j - 1][1], taken):
                    whole = [k for k in range(i, j) if a <= words.spans[k][0] and words.spans[k][1] <= b]
                    first, last = (words.spans[whole[0]][0], words.spans[whole[-1]][1]) if whole else (b, b)
                    for start, end in ((a, first), (last, b)):
                        if telling(text[start:end]):
                            out += [(k, start + x, start + y) for k, x, y in self.more_spans(text[start:end], [])]
                    out += self.readings(text, words, p, whole, first, last)
            i = j
        return out

    def readings(self, text: str, words: Words, p: np.ndarray, run: list[int], first: int, last: int) -> list[tuple[int, int, int]]:
        """The likeliest possible spans from ``first`` to ``last`` that do not overlap, each with a sure word."""
        found, starts = [], [words.spans[k][0] for k in run]
        for kind, pattern in enumerate(POSSIBLE):
            for m in pattern.finditer(text, first, last):
                if not possible(kind, m[0]):
                    continue
                low, high = max(0, bisect_right(starts, m.start()) - 1), bisect_left(starts, m.end())
                held = p[run[low:high]]
                if held[:, 0].min() <= 1 - CERTAIN and held[:, kind + 1].max() >= LEAST:
                    found.append((-held[:, kind + 1].mean(), kind, *m.span()))
        out: list[tuple[int, int, int]] = []
        taken: list[tuple[int, int]] = []
        for _, kind, a, b in sorted(found):
            at = bisect_left(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                out.append((kind, a, b))
        return out


def spans_of(text: str, field: Field | None) -> tuple[list, list]:
    """(base spans, all spans), each by kind, then start."""
    base = base_spans(text)
    more = field.more_spans(text, base) if field and telling(text) else []
    return base, sorted(base + more)


def learned(texts: list[str]) -> Field | None:
    """The potentials of a sample of texts, labelled by the patterns."""
    features, labels, chain, skip = [], [], np.full((LABELS, LABELS), 0.5), np.full((LABELS, LABELS), 0.5)
    for text in texts:
        base = base_spans(text)
        # Disguises are learned from the lines with matches alone.
        matched = "\n".join(line for line in text.split("\n") if base_spans(line)) if base else ""
        for way in range(WAYS if matched else 0):
            other, moved = hidden(matched, base_spans(matched), way)
            disguised = Words.of(other)
            if not disguised.spans:
                continue
            features.append(disguised.features())
            labels.append(y := disguised.labels(moved))
            at = np.flatnonzero(disguised.joined)
            np.add.at(chain, (y[at - 1], y[at]), 1)
        words = Words.of(text)
        if not words.spans:
            continue
        y = words.labels(base)
        for hide in (False, True):
            features.append(words.features(hide))
            labels.append(y)
        at = np.flatnonzero(words.joined)
        np.add.at(chain, (y[at - 1], y[at]), 1)
        pairs = words.skips()
        np.add.at(skip, (y[pairs[:, 0]], y[pairs[:, 1]]), 1)
        np.add.at(skip, (y[pairs[:, 1]], y[pairs[:, 0]]), 1)
    if not labels or not np.concatenate(labels).any():
        return None
    x, y = np.concatenate(features), np.concatenate(labels)
    w, n, target = np.zeros((HASHED, LABELS)), len(y), np.eye(LABELS)[y]
    # Personal data is rare: its kinds count as much as all other words, as far as the weight goes.
    share = np.bincount(y, minlength=LABELS) / n
    weight = np.minimum(MOST_WEIGHT, share[0] / np.maximum(share, 1e-9))[y]
    weight /= weight.mean()
    seen = np.bincount(x.ravel(), np.repeat(weight, x.shape[1]), HASHED) / n
    rate = RATE / (x.shape[1] * np.sqrt(seen + 1e-3))[:, None]
    for _ in range(STEPS):
        z = w[x].sum(1)
        p = np.exp(z - np.logaddexp.reduce(z, 1, keepdims=True))
        g = np.column_stack([np.bincount(x.ravel(), np.repeat((p - target)[:, k] * weight, x.shape[1]), HASHED) for k in range(LABELS)]) / n
        w -= rate * (g + DECAY * w)

    def lift(counts):
        """How much likelier two labels meet than by chance: features have counted each label's own share."""
        joint = counts / counts.sum()
        return np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))

    return Field(w, np.clip(lift(chain), -4, 4), np.clip(lift(skip), -4, 4))


def model_of(docs: DataFrame) -> Field | None:
    """The field of SAMPLE documents that hold a digit or an at sign, in order of a hash of the text."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= SAMPLE_CHARS))
    texts = sampled(some.select("text"), F.col("text"), SAMPLE).toArrow().column(0).to_pylist()
    return learned(sorted(texts))


def listed(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def found_in(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans for every row.

    A null or empty text has none. Repeated rows are searched each. Matches of different kinds may
    overlap and are all reported. A table without any match has no field to learn: the patterns alone
    count. An empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = id_and_text(docs)
    field = model_of(docs)
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]

    def run(batches):
        for batch in batches:
            counts, shas, lists = [], [], []
            for text in batch.column(1).to_pylist():
                base, every = spans_of(text, field)
                counts.append([sum(s[0] == k for s in base) for k in range(len(KINDS))])
                shas.append(hashlib.sha256(listed(base).encode()).hexdigest())
                lists.append(listed(every))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(shas, pa.string()), pa.array(lists, pa.string())], names)

    return docs.mapInArrow(run, f"doc_id {kind}, " + "".join(f"n_{k} long, " for k in KINDS) + "base_sha256 string, spans string")


def masked_text(text: str, found: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by the mark of its kind; of overlapping spans the first counts and is widened."""
    out, at, end = [], 0, 0
    for a, b, k in sorted((a, b, k) for k, a, b in found):
        if a >= end:
            out += [text[at:a], MASKS[KINDS[k]]]
        at = end = max(end, b)
    return "".join(out) + text[at:]


def masked(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, with personal data masked in the text; n_chars follows."""
    prepare(docs.sparkSession)
    field = model_of(docs.select("text"))
    columns, sized = docs.columns, "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            texts = [None if t is None else masked_text(t, spans_of(t, field)[1]) for t in batch.column(columns.index("text")).to_pylist()]
            new = {"text": texts} | ({"n_chars": [len(t or "") for t in texts]} if sized else {})
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], batch.schema.types[i]) if c in new else batch.column(i) for i, c in enumerate(columns)], columns
            )

    return docs.mapInArrow(run, docs.schema)
