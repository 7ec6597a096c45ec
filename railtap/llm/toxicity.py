"""Toxicity scores of texts restored by a noisy-channel decoder.

Words may be disguised: letters written as look-alikes ("1d10t"), spaced out or
cut by signs ("s t u p i d", "s.t.u.p.i.d"), or repeated ("stuuupid").  A span
that shows any of this becomes a lattice of characters: each sign may stand for
a letter, for a gap or for nothing, a repeated character for itself or for
nothing, at a cost each.  The Viterbi path that is cheapest together with a
character language model is the restored text.  A span without such a sign has
one path only, itself, and is not searched.

The language model counts runs of four characters over all documents; its table
has a fixed size.  What marks a text as toxic is learned from labelled documents:
how many toxic and other texts hold a restored word, or words that begin alike,
counted in two hashed tables (the weaker of two cells counts, so that a shared
cell does not speak for both), and a logistic regression on a text's strongest
words.  Labelled texts are scored without their own counts for that fit.  It
takes at most ``SAMPLE`` labelled documents, those with the smallest hashed ids;
equal texts count once.

Edge cases: a null, empty or wordless text gets the score of a text without
marked words.  Without documents of both labels every score is the share of toxic
ones (0 without any).  Several labels for one document count as toxic if any is;
null labels and ids are left out.  A null id is held out.  Long texts are scored
whole; repeated rows are scored each for itself.
"""

from __future__ import annotations

import math
import re
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from railtap.llm.common import bounded_sample, need, stored

SAMPLE = 40_000
CELLS = 1 << 20
FOLDS = 5

# Letters that digits and signs are commonly used for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
}
#: Costs, in nats, of a look-alike, of a sign or blank inside a word, and of a repeated character.
LOOKALIKE, GAP, REPEAT = 2.5, 1.5, 2.0

_MEMO = 250_000
_DULL = 700_000
_LONG = 64
_LETTERS = 0x250
_OTHER = 27
_EDGE = 28
_STARTS = (4, 5, 6)


def code(letter: str) -> int:
    """1 to 26 for Latin letters, whatever their accents, 27 for other letters, 0 for everything else."""
    if not letter.isalpha():
        return 0
    base = unicodedata.normalize("NFKD", letter)[0].lower()
    return ord(base) - 96 if "a" <= base <= "z" else _OTHER


def _table() -> np.ndarray:
    return np.array([_EDGE, *[code(chr(i)) for i in range(1, 0x3000)], _OTHER], np.uint8)


# the language model

def _runs(texts: list[str], table: np.ndarray) -> np.ndarray:
    """Numbers of the runs of four codes of texts, gaps taken as one; those with ``_EDGE`` reach from text to text."""
    joined = "\0".join(f" {t} ".replace("\0", " ") for t in texts).lower()
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    codes = table[np.minimum(points, len(table) - 1)]
    kept = codes != 0
    kept[1:] |= kept[:-1]  # a gap stays after a letter
    kept[0] = True
    codes = codes[kept].astype(np.int32)
    pairs = codes[:-1] << 5 | codes[1:]
    return pairs[:-2] << 10 | pairs[2:]


def character_counts(docs: DataFrame) -> DataFrame:
    """run, n: how often each run of four codes occurs in all texts; at most 2^20 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = _table(), np.zeros(1 << 20, np.int64)
        for batch in batches:
            some, size = [], 0
            for text in filter(None, batch.column("text").to_pylist()):
                some.append(text)
                size += len(text)
                if size > 1 << 20:  # a few MB at a time
                    n += np.bincount(_runs(some, table), minlength=1 << 20)
                    some, size = [], 0
            if some:
                n += np.bincount(_runs(some, table), minlength=1 << 20)
        for axis in range(4):  # runs inside a text only
            np.moveaxis(n.reshape(32, 32, 32, 32), axis, 0)[_EDGE] = 0
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["run", "n"])

    return docs.select("text").mapInArrow(run, "run long, n long").groupBy("run").agg(F.sum("n").alias("n"))


def language_model(n: np.ndarray, lean: float = 4.0) -> np.ndarray:
    """Costs -log P(last code | three before) by run number; each order leans on the next lower one."""
    n = n.reshape(32, 32, 32, 32).astype(np.float64)
    p = np.full(32, 1 / 28)
    for order in range(4):
        seen = n.sum(axis=tuple(range(3 - order)))
        p = (seen + lean * p) / (seen.sum(axis=-1, keepdims=True) + lean)
    return -np.log(p).reshape(-1).astype(np.float32)


# the channel

_SEARCH = re.compile(r"(.)\1|[^\W\d_][\W\d_]+[^\W\d_]|[0-9@$!|+(<€£¡¥][^\W\d_]|[^\W\d_][0-9@$!|+(<€£¡¥]").search
_WORDS = re.compile(r"[^\W\d_]+").findall
_HAS_LETTER = re.compile(r"[^\W\d_]").search
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")

# Stretches of choices that lie less than three letters apart, with three letters behind; of letters only, and of any of the first 2^16 characters.
_NUMBERS = "".join(c for c in map(chr, range(1 << 16)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_SIGN, _LETTER = rf"[\W\d_{_NUMBERS}]", rf"[^\W\d_{_NUMBERS}]"
_DOUBLED = re.compile(r"(.)\1+(?:.{0,2}(.)\2+)*.{0,3}").sub
_STRETCHES = re.compile(rf"(?:{_SIGN}+|({_LETTER})\1+)(?:{_LETTER}{{0,2}}(?:{_SIGN}+|({_LETTER})\2+))*{_LETTER}{{0,3}}").sub
_RARE = re.compile(r"[^\0-\uffff]").search


class Decoder:
    """Cheapest reading of a span under the language model ``costs`` (as of :func:`language_model`)."""

    def __init__(self, costs: np.ndarray):
        self._costs = array("f", costs.tobytes())
        self._codes = _CodeOf()
        self._read: dict[str, str] = {}

    def _options(self, c: str, again: bool) -> list[tuple[str, int | None, float]]:
        of = self._codes[c]
        if of:
            found: list = [(c, of, 0.0)]
        else:
            found = [(" ", 0, 0.0)]
            if c in LOOKALIKES:
                found += [(x, self._codes[x], LOOKALIKE) for x in LOOKALIKES[c]]
            else:
                found.append(("", None, GAP))
        if again and not c.isspace():
            found.append(("", None, REPEAT))
        return found

    def read(self, span: str, context: int = 0, before: str = "") -> str:
        """The restored span, after the three codes of ``context``; words stand between blanks."""
        costs, codes = self._costs, self._codes
        states: dict[int, tuple[float, tuple]] = {context: (0.0, ())}
        for c in span:
            if len(states) == 1 and c != before and (of := codes[c]):  # one path, one way on
                (context, (cost, path)), = states.items()
                run = context << 5 | of
                states = {run & 0x7FFF: (cost + costs[run], (path, c))}
                before = c
                continue
            reached: dict[int, tuple[float, tuple]] = {}
            if c != before and (of := codes[c]):  # one way on from each
                before = c
                for context, (cost, path) in states.items():
                    run = context << 5 | of
                    total, to = cost + costs[run], run & 0x7FFF
                    if to not in reached or total < reached[to][0]:
                        reached[to] = (total, (path, c))
                states = reached
                continue
            options = self._options(c, c == before)
            before = c
            for context, (cost, path) in states.items():
                for text, of, more in options:
                    total, to = cost + more, context
                    if of or of == 0 and context & 31:
                        run = context << 5 | of
                        total += costs[run]
                        to = run & 0x7FFF
                    elif of == 0:
                        text = ""  # one gap
                    if to not in reached or total < reached[to][0]:
                        reached[to] = (total, (path, text) if text else path)
            states = reached
        path = min((cost + (costs[context << 5] if context & 31 else 0.0), path) for context, (cost, path) in states.items())[1]
        out = []
        while path:
            path, text = path
            out.append(text)
        return "".join(reversed(out))

    def read_token(self, token: str) -> str:
        """As :func:`read`, of a token without blanks, by stretches.

        Three letters without a choice lead all paths to one context, so what
        lies between them is read for itself, and the same for all tokens.
        """
        if token.isalpha():
            return _DOUBLED(self._stretch, token)
        return self.read(token) if not token.isascii() and _RARE(token) else _STRETCHES(self._stretch, token)

    def _stretch(self, m: re.Match) -> str:
        token, (start, end) = m.string, m.span()
        key = token[start - 3:end] if start > 2 else f" {token[:end]}"
        text = self._read.get(key)
        if text is None:
            context = 0
            for c in token[max(0, start - 3):start]:
                context = context << 5 | self._codes[c]
            text = self.read(m[0], context, token[start - 1:start])
            if len(key) <= _LONG and len(self._read) < _MEMO:
                self._read[key] = text
        return text

    def words(self, token: str) -> list[str]:
        """The words of a token in lower case: restored where its signs leave a choice."""
        if token.isalpha():
            return [self.read_token(token)]
        return _WORDS(self.read_token(token)) if _SEARCH(token) and _HAS_LETTER(token) else _WORDS(token)

    def words_of(self, tokens: list[str]) -> list[list[str]]:
        """The words of each of the tokens; letters without a repeated one need no reading."""
        points = np.frombuffer("".join(f"{t} " for t in tokens).encode("utf-32-le"), np.uint32)
        doubled = np.zeros(len(tokens) + 1, bool)
        doubled[np.searchsorted(np.flatnonzero(points == 32), np.flatnonzero(points[1:] == points[:-1]))] = True
        return [[t] if not again and t.isalpha() else self.words(t) for t, again in zip(tokens, doubled.tolist())]

    def spaced(self, text: str) -> list[str]:
        """The words of the runs of single characters of a text."""
        return [w for m in _SPACED.finditer(text) if _HAS_LETTER(m[0]) for w in _WORDS(self.read(m[0]))]


class _CodeOf(dict):
    def __missing__(self, letter: str) -> int:
        value = code(letter)
        if len(self) < _LETTERS:
            self[letter] = value
        return value


# what words say

class Tokens:
    """What stands between white space in the lower-cased texts of a batch (and '' at ends): ``own`` without repeats, ``codes`` by place."""

    def __init__(self, texts: list[str | None]):
        self.texts = [(t or "").lower() for t in texts]
        split = pc.utf8_split_whitespace(pa.array(self.texts, pa.large_string()))
        coded = split.values.dictionary_encode()
        self.own: list[str] = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self.codes, self.ends = coded.indices.to_numpy(), split.offsets.to_numpy()

    def each(self) -> Iterator[np.ndarray]:
        """The codes of each text."""
        return (self.codes[a:b] for a, b in pairwise(self.ends.tolist()))

    def places(self, some: np.ndarray) -> tuple[list[int], list[int]]:
        """Text and code of every place that holds one of ``some``."""
        flags = np.zeros(len(self.own), bool)
        flags[some] = True
        at = np.flatnonzero(flags[self.codes])
        return (np.searchsorted(self.ends, at, "right") - 1).tolist(), self.codes[at].tolist()

    def spaced(self) -> list[int]:
        """The texts with three tokens of one character in a row."""
        single = np.fromiter(map(len, self.own), np.int64, len(self.own)) == 1
        at = single[self.codes]
        first = np.flatnonzero(at[:-2] & at[1:-1] & at[2:])
        row = np.searchsorted(self.ends, first, "right") - 1
        return np.unique(row[first + 2 < self.ends[row + 1]]).tolist()


def cells(parts: list[str], size: int = CELLS) -> np.ndarray:
    """Parts x 2: the two cells of each part, in one table after the other."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    return np.stack([h & np.uint64(size - 1), size + (h >> np.uint64(32) & np.uint64(size - 1))], axis=1).astype(np.int32)


def starts(words: list[str]) -> set[str]:
    """The starts of words that count beside the words themselves."""
    return {w[:n] for n in _STARTS for w in words if len(w) >= n}


class Marks:
    """The cells of the restored words of texts; those of the first ``_MEMO`` tokens are kept."""

    def __init__(self, decoder: Decoder):
        self._decoder = decoder
        self._cells: dict[str, bytes] = {}

    @staticmethod
    def _of_words(groups: list[list[str]]) -> list[bytes]:
        """The cells of the words and starts of each group; a short word fills the places of its starts."""
        kept = [[w for w in words if len(w) > 1] for words in groups]
        every = [w for words in kept for w in words]
        parts = [f"{w}$" for w in every], *[[w[:n] if len(w) >= n else f"{w}$" for w in every] for n in _STARTS]
        raw = np.concatenate([cells(p) for p in parts], axis=1).tobytes()
        size = 8 * len(parts)
        ends = [0, *accumulate(size * len(words) for words in kept)]
        return [raw[a:b] for a, b in pairwise(ends)]

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The cells of each text's words and of their starts; some come twice."""
        tokens = Tokens(texts)
        known = [self._cells.get(t) for t in tokens.own]
        new = [i for i, at in enumerate(known) if at is None]
        for i, at in zip(new, self._of_words(self._decoder.words_of([tokens.own[i] for i in new]))):
            known[i] = at
            if len(tokens.own[i]) <= _LONG and len(self._cells) < _MEMO:
                self._cells[tokens.own[i]] = at
        rows = tokens.spaced()
        runs = dict(zip(rows, self._of_words([self._decoder.spaced(tokens.texts[i]) for i in rows])))
        for i, codes in enumerate(tokens.each()):
            yield np.frombuffer(b"".join([known[c] for c in {*codes.tolist()}] + [runs.get(i, b"")]), np.int32)


class Finder:
    """The words of texts that say something, with their weights.

    Most tokens say nothing and are kept as such; what the tokens of a batch
    that are new say is looked up together.
    """

    def __init__(self, decoder: Decoder, weights: np.ndarray):
        self._decoder, self._weights = decoder, weights
        self._dull: set[str] = set()
        self._marked: dict[str, tuple] = {}

    def _strong(self, parts: list[str]) -> dict[int, float]:
        """Place and weight of the parts that say something."""
        found = self._weights[cells(parts)].min(axis=1)
        return {i: float(found[i]) for i in np.flatnonzero(found > 1.0).tolist()}

    def _weigh(self, words: list[str]) -> dict[str, float]:
        heads = [*starts(words)]
        by_head = {heads[i]: w for i, w in self._strong(heads).items()}
        found = {words[i]: w for i, w in self._strong([f"{w}$" for w in words]).items()}
        for n in _STARTS:
            for word in [w for w in words if w[:n] in by_head]:
                found[word] = max(found.get(word, 0.0), by_head[word[:n]])
        return found

    def of(self, texts: list[str | None]) -> list[dict[str, float]]:
        tokens = Tokens(texts)
        own = tokens.own
        left = [i for i, t in enumerate(own) if t not in self._dull]
        new = [i for i in left if own[i] not in self._marked]
        words = dict(zip(new, self._decoder.words_of([own[i] for i in new])))
        spaced = {i: self._decoder.spaced(tokens.texts[i]) for i in tokens.spaced()}
        every = list({w for ws in (*words.values(), *spaced.values()) for w in ws if len(w) > 1})
        weighed: dict[str, float] = {}
        for i in range(0, len(every), 1 << 16):
            weighed.update(self._weigh(every[i:i + (1 << 16)]))
        marked = {i: self._marked[own[i]] for i in left if i not in words}
        for i, ws in words.items():
            t, got = own[i], tuple((w, weighed[w]) for w in ws if w in weighed)
            if got:
                marked[i] = got
                if len(t) <= _LONG and len(self._marked) < _MEMO:
                    self._marked[t] = got
            elif len(t) <= _LONG and len(self._dull) < _DULL:
                self._dull.add(t)
        found: list[dict[str, float]] = [{} for _ in texts]
        for i, ws in spaced.items():
            found[i].update((w, weighed[w]) for w in ws if w in weighed)
        for i, c in zip(*tokens.places(np.fromiter(marked, np.int64, len(marked)))):
            found[i].update(marked[c])
        return found


@lru_cache(maxsize=1)
def _decoder(costs: bytes) -> Decoder:
    """Kept by a worker from task to task."""
    return Decoder(np.frombuffer(costs, np.float32))


@lru_cache(maxsize=1)
def _kept(costs: bytes, kind: str = "f4", *weights: bytes) -> list:
    """Finders for the weights, or marks without any; kept until a task needs others."""
    return [Finder(_decoder(costs), np.frombuffer(w, kind)) for w in weights] or [Marks(_decoder(costs))]


def evidence(toxic: np.ndarray, other: np.ndarray, share: float, lean: float = 4.0) -> np.ndarray:
    """Log ratio of toxic to other texts over that of all texts; 0 where nothing speaks for toxic."""
    ratio = np.log((toxic + lean * share) / (other + lean * (1 - share))) - math.log(share / (1 - share))
    return np.where(toxic > 0, np.maximum(ratio, 0.0), 0.0)


def summary(weights: list[float]) -> list[float]:
    """What the regression sees of a text: its three strongest words, and how much lies behind them."""
    some = sorted((w for w in weights if w > 1.0), reverse=True)
    top = some[:3]
    return [*top, *[0.0] * (3 - len(top)), math.log1p(float(np.array(some).sum())) if some else 0.0, math.log1p(len(some))]


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    keep = np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    """Language model costs, weight of each cell, regression weights, share of toxic texts."""
    costs: np.ndarray
    weights: np.ndarray | None
    regression: np.ndarray | None
    share: float

    def score(self, seen: list[float]) -> float:
        if self.regression is None:
            return self.share
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, np.dot(seen, self.regression[:-1]) + self.regression[-1])))))


def held_out(doc_id: Column) -> Column:
    """Whether a document's labels may not be learned from: one in ``FOLDS`` by its id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, toxic, text of at most ``sample`` labelled documents outside the held-out part, one of equal texts."""
    one = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(
        (F.max("toxic") > 0).alias("toxic"))
    some = bounded_sample(one, "doc_id", sample, labels.count())
    # at most ``sample`` rows of ids and flags: a proven bound for the broadcasts
    with_text = docs.join(F.broadcast(some), "doc_id")
    first = with_text.groupBy(F.xxhash64("text"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return with_text.join(F.broadcast(first), "doc_id", "left_semi").select("doc_id", "toxic", "text")


def _cell_counts(rows: DataFrame, costs: np.ndarray) -> DataFrame:
    """cell, toxic, other: texts with a word or start in the cell, where at least two toxic ones have."""
    known = costs.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (marks,), n = _kept(known), np.zeros((2, 2 * CELLS), np.int32)
        for batch in batches:
            for at, toxic in zip(marks.of(batch.column("text").to_pylist()), batch.column("toxic").to_pylist()):
                n[0 if toxic else 1, at] += 1  # a cell that comes twice counts once
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(c[some].astype(np.int64)) for c in n]], ["cell", "toxic", "other"])

    partial = rows.select("toxic", "text").mapInArrow(run, "cell long, toxic long, other long")
    return partial.groupBy("cell").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).filter("toxic > 1")


def _summaries(rows: DataFrame, costs: np.ndarray, n: np.ndarray, share: float) -> DataFrame:
    """toxic, seen: of the labelled texts, each scored without its own counts."""
    known = costs.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, weights = np.flatnonzero(n[0]), np.zeros((2, n.shape[1]))
        for toxic in (0, 1):
            # cells that two toxic texts do not share are left out of the table
            left = n[0, some] - toxic, n[1, some] - (1 - toxic)
            weights[toxic, some] = evidence(np.where(left[0] > 1, left[0], 0), np.maximum(left[1], 0), share)
        finders = _kept(known, "f8", *[w.tobytes() for w in weights])
        del weights
        for batch in batches:
            labels, texts = batch.column("toxic").to_pylist(), batch.column("text").to_pylist()
            found = [iter(f.of([t for t, y in zip(texts, labels) if y == toxic])) for toxic, f in enumerate(finders)]
            seen = [summary([*next(found[y]).values()]) for y in labels]
            yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(seen, pa.list_(pa.float64()))], ["toxic", "seen"])

    return rows.select("toxic", "text").mapInArrow(run, "toxic boolean, seen array<double>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The language model over all documents and the marks of toxic texts among the labelled ones."""
    docs = need(docs, "doc_id", "text")
    n = np.zeros(1 << 20, np.int64)
    runs = character_counts(docs).toArrow()  # at most 2^20 rows
    n[runs["run"].to_numpy()] = runs["n"].to_numpy()
    costs = language_model(n)
    rows = stored(labelled(docs, need(labels, "doc_id", "toxic"), sample), "toxicity-labelled")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    share = toxic / total if total else 0.0
    if not 0 < toxic < total:
        return Model(costs, None, None, share)
    counts = np.zeros((2, 2 * CELLS), np.int64)
    got = _cell_counts(rows, costs).toArrow()  # at most 2 * CELLS rows
    counts[:, got["cell"].to_numpy()] = got["toxic"].to_numpy(), got["other"].to_numpy()
    # rows repeat where ids do; they go to the driver summed, by what the regression sees of them
    seen = (_summaries(rows, costs, counts.astype(np.int32), share).groupBy("toxic", F.transform("seen", lambda v: F.round(v, 3)).alias("seen"))
            .agg(F.count("*").alias("n")).toArrow())
    x = np.array(seen["seen"].to_pylist()).reshape(-1, 5)
    y, times = np.asarray(seen["toxic"].to_pylist(), float), seen["n"].to_numpy()
    w = regression(np.repeat(x, np.minimum(times, 1000), axis=0), np.repeat(y, np.minimum(times, 1000)))
    return Model(costs, evidence(*counts, share).astype(np.float32), w, share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    kind = dict(docs.dtypes)["doc_id"]
    costs, weights = model.costs.tobytes(), model.weights.tobytes() if model.weights is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, unmarked = _kept(costs, "f4", weights)[0] if weights else None, model.score(summary([]))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = finder.of(texts) if finder else ({} for _ in texts)
            scores = [model.score(summary([*f.values()])) if f else unmarked for f in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    scored = need(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Score and prediction for every document (doc_id, text); ``labels`` hold doc_id and toxic."""
    return score(docs, fit(docs, labels, sample))
