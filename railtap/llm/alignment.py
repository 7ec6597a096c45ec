"""Alignment of two tokenizers' tokens of the same bytes, by divide and conquer at shared cuts.

A text with a blank before it is encoded by a byte-level vocabulary (A) and by a
piece model (B, which adds that blank itself).  Both give the ends of their
tokens as byte offsets.  An interval is cut near its middle at a byte where a
token of A and a token of B both end, found by bisecting one list of ends in the
other, and both halves are taken up in turn; an interval without a shared end
inside is a leaf: a group of tokens of A and B over the same bytes.  Inside a
group the links are the pairs of tokens whose byte ranges overlap.

Neither vocabulary has a token that goes on past a single blank between two
other characters (:func:`cut_safe` proves it for B), so such blanks are shared
cuts known without a search: the text falls into units there, and a bounded memo
keeps what an alignment of a unit gives.  A text without such blanks is one unit.

How often two ids are linked is counted over all documents: each document's
distinct links are stored with their numbers, summed before they are shuffled.
The links counted most often (``HOT`` of them) go to every task as a table of
fixed size and are looked up there; all other links join the counts by a
shuffle, where none can be common.

Edge cases: a text that is null, empty, or that B does not give back byte for
byte (it holds the piece model's own blank mark, say) has no tokens: zeros and
an empty digest.  Special strings are plain text to both.  Texts are aligned
whole, whatever their length.  Rows are independent, so repeated rows and null
ids are rows of their own; in the counts every row's links count.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railtap.llm.byte_bpe import _KNOWN, PATTERN, _spec, is_byte_level
from railtap.llm.common import need, stored

HOT = 1 << 17
MEMO = 300_000

_LONG_UNIT = 200
_TOGETHER = 50_000
_BITS = 32
_COUNT = 40
_ONES = (1 << _COUNT) - 1
_BLANKS = re.compile("(?<=[^ ]) (?=[^ ])")


def cut_safe(pieces: list[str]) -> bool:
    """Whether no piece goes on past a blank that follows another character."""
    return not any(re.search("[^▁]▁", p) for p in pieces)


class Vocabularies:
    """Ids and token lengths of texts under a byte-level vocabulary file and a piece model."""

    def __init__(self, bytes_path: str, pieces_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer
        ranks, _ = _spec(bytes_path)
        self._merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._library = Tokenizer.from_file(bytes_path)
        self._library.encode_special_tokens = True
        self._token = {i: raw for raw, i in ranks.items()}
        self.bytes_length = {i: len(raw) for raw, i in ranks.items()}
        self._model = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.cuts = cut_safe(pieces) and is_byte_level(bytes_path)
        self._piece = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode()
                       for i, p in enumerate(pieces)]
        self.piece_length = [len(p) for p in self._piece]

    def bytes_ids(self, units: list[str]) -> list[list[int]]:
        """Ids of A of a blank and each unit; units of known letters go to the merger as one text, cut up again by length."""
        out: list = [None] * len(units)
        known = [i for i, u in enumerate(units) if _KNOWN(u)] if self.cuts else []
        ids = self._merge("".join([" " + units[i] for i in known]))
        at = end = total = 0
        for i in known:
            total += len(units[i].encode()) + 1
            first = at
            while end < total:
                end += self.bytes_length[ids[at]]
                at += 1
            out[i] = ids[first:at]
            if end != total:  # a token went on past the unit: take the unit alone
                out[i], end = None, total
                break
        for i, got in enumerate(out):
            if got is None:
                out[i] = (self._merge if _KNOWN(units[i]) else self._encode)(" " + units[i])
        return out

    def _encode(self, text: str) -> list[int]:
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, units: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of A and of B of a blank and each unit; None where they do not join to its bytes."""
        for unit, a, b in zip(units, self.bytes_ids(units), self._model.encode(units, num_threads=1)):
            raw = b" " + unit.encode()
            if b"".join([self._token[i] for i in a]) == raw and b"".join([self._piece[i] for i in b]) == raw:
                yield a, b
            else:
                yield None


def groups(a: list[int], b: list[int]) -> list[tuple[int, int, int, int]]:
    """Leaf groups of two rising lists of token ends with the same last: first and end position in ``a``, then in ``b``."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        cut = None
        if a1 - a0 > 1 and b1 - b0 > 1:  # walk along the shorter list, bisect the longer
            if a1 - a0 <= b1 - b0:
                cut = _middle_cut(a, a0, a1 - 1, b, b0, b1 - 1)
            elif turned := _middle_cut(b, b0, b1 - 1, a, a0, a1 - 1):
                cut = turned[1], turned[0]
        if cut is None:
            out.append((a0, a1, b0, b1))
        else:
            i, j = cut
            todo.append((i + 1, a1, j + 1, b1))
            todo.append((a0, i + 1, b0, j + 1))
    return out


def _middle_cut(a: list[int], a0: int, last: int, b: list[int], b0: int, b1: int) -> tuple[int, int] | None:
    """Positions of the shared end nearest the middle of the interval, its own end left out."""
    up = bisect_left(a, (a[a0] + a[last]) >> 1, a0, last)
    down = up - 1
    while up < last or down >= a0:
        if up < last:
            j = bisect_left(b, a[up], b0, b1)
            if j < b1 and b[j] == a[up]:
                return up, j
            up += 1
        if down >= a0:
            j = bisect_left(b, a[down], b0, b1)
            if j < b1 and b[j] == a[down]:
                return down, j
            down -= 1
    return None


def links(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int) -> list[tuple[int, int]]:
    """Positions of the tokens of a group whose byte ranges overlap."""
    out, i, j = [], a0, b0
    while i < a1 and j < b1:
        out.append((i, j))
        x, y = a[i], b[j]
        i += x <= y
        j += y <= x
    return out


def align(a: list[int], ends_a: list[int], b: list[int], ends_b: list[int]) -> tuple[int, bytes, bytes]:
    """Numbers of tokens of A, of B and of groups in one number, the groups' ids as text, the links as 64-bit pairs of ids."""
    found, pairs = [], array("q")
    for a0, a1, b0, b1 in groups(ends_a, ends_b):
        if a1 - a0 == 1 and b1 - b0 == 1:
            found.append(f"{a[a0]}|{b[b0]}")
            pairs.append(a[a0] << _BITS | b[b0])
        else:
            found.append(f"{','.join(map(str, a[a0:a1]))}|{','.join(map(str, b[b0:b1]))}")
            pairs.extend([a[i] << _BITS | b[j] for i, j in links(ends_a, ends_b, a0, a1, b0, b1)])
    return len(a) << 2 * _COUNT | len(b) << _COUNT | len(found), ";".join(found).encode(), pairs.tobytes()


class Units:
    """Alignments of the units of texts; those of the first ``MEMO`` units are kept."""

    def __init__(self, vocabularies: Vocabularies):
        self._of = vocabularies
        self._memo: dict = {}

    def _cut(self, text: str | None) -> list[str]:
        if not text:
            return []
        units = _BLANKS.split(" " + text) if self._of.cuts else [" " + text]
        units[0] = units[0][1:]
        return units

    def _aligned(self, units: list[str]) -> Iterator[tuple | None]:
        of_a, of_b = self._of.bytes_length, self._of.piece_length
        for ids in self._of.encode(units):
            if ids is None:
                yield None
            else:
                a, b = ids
                yield align(a, list(accumulate([of_a[i] for i in a])), b, list(accumulate([of_b[i] for i in b])))

    def texts(self, texts: list[str | None]) -> Iterator[list | None]:
        """The alignments of the units of each text; None where it has no tokens.  Unknown units are encoded together."""
        memo, cut = self._memo, [self._cut(t) for t in texts]
        todo = sorted(set().union(*cut).difference(memo))
        new = {}
        for at in range(0, len(todo), _TOGETHER):
            some = todo[at:at + _TOGETHER]
            new.update(zip(some, self._aligned(some)))
        for units in cut:
            values = [memo[u] if u in memo else new[u] for u in units]
            yield None if not values or None in values else values
        for unit, value in new.items():
            if len(memo) >= MEMO:
                break
            if len(unit) <= _LONG_UNIT:
                memo[unit] = value


@lru_cache(maxsize=1)
def _units(bytes_path: str, pieces_path: str) -> Units:
    return Units(Vocabularies(bytes_path, pieces_path))


def tokens(docs: DataFrame, bytes_path: str, pieces_path: str) -> DataFrame:
    """rid, doc_id, the numbers of tokens, groups and links, the digest of the groups, and the distinct links with their counts."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _units(bytes_path, pieces_path)
        for batch in batches:
            counts: list[list] = [[], [], [], []]
            digests, keys, times = [], [], []
            for values in units.texts(batch.column("text").to_pylist()):
                if values is None:
                    row, digest, got, n = (0, 0, 0, 0), "", np.zeros(0, np.int64), np.zeros(0, np.int64)
                else:
                    numbers, spelled, linked = zip(*values)
                    all_links = np.frombuffer(b"".join(linked), np.int64)
                    got, n = np.unique(all_links, return_counts=True)
                    total = sum(numbers)
                    row = total >> 2 * _COUNT, total >> _COUNT & _ONES, total & _ONES, len(all_links)
                    digest = hashlib.sha256(b";".join(spelled)).hexdigest()
                for column, value in zip(counts, row):
                    column.append(value)
                digests.append(digest)
                keys.append(got)
                times.append(n.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]))),
                 pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*times, np.zeros(0, np.int32)])))],
                ["rid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links", "times"])

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text").mapInArrow(
        run, f"rid long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
             "links array<long>, times array<int>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """link, count, best: how many links hold each pair of ids, and whether no pair of the same B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch's own sums, so that what Spark sums on is far less than the links
        for batch in batches:
            got, at = np.unique(batch.column("links").flatten().to_numpy(), return_inverse=True)
            n = np.zeros(len(got), np.int64)
            np.add.at(n, at, batch.column("times").flatten().to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.int64()), pa.array(n)], ["link", "count"])

    counts = aligned.select("links", "times").mapInArrow(run, "link long, count long").groupBy("link").agg(F.sum("count").alias("count"))
    b = F.col("link").bitwiseAND(F.lit((1 << _BITS) - 1))
    # a B id meets at most as many ids as A has
    return counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(b)))


def _hot(pairs: DataFrame, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``hot`` most common links by id, with their counts and whether they are best."""
    rows = pairs.orderBy(F.col("count").desc(), "link").limit(hot).toArrow().sort_by("link")  # at most ``hot`` rows
    return tuple(rows[c].to_numpy() for c in ("link", "count", "best"))


def summed(aligned: DataFrame, pairs: DataFrame, hot: int = HOT) -> DataFrame:
    """rid, n_best, count_sum of every row of ``aligned``."""
    known, counts, best = _hot(pairs, hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("links")
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            link, n = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(known, link)
            at[at == len(known)] = 0
            found = known[at] == link if len(known) else np.zeros(len(link), bool)
            sums = np.zeros((2, len(sizes)), np.int64)
            np.add.at(sums[0], row[found], n[found] * best[at[found]])
            np.add.at(sums[1], row[found], n[found] * counts[at[found]])
            rest = np.flatnonzero(~found)
            ends = pa.array(np.searchsorted(row[rest], np.arange(len(sizes) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("rid"), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(ends, pa.array(link[rest])),
                 pa.ListArray.from_arrays(ends, pa.array(n[rest]))], ["rid", "n_best", "count_sum", "links", "times"])

    looked = stored(aligned.select("rid", "links", "times").mapInArrow(
        run, "rid long, n_best long, count_sum long, links array<long>, times array<long>"), "alignment-looked-up")
    rest = (looked.select("rid", F.explode(F.arrays_zip("links", "times")).alias("of"))
            .select("rid", F.col("of.links").alias("link"), F.col("of.times").alias("n")).join(pairs, "link")
            .select("rid", F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum")))
    return looked.select("rid", "n_best", "count_sum").unionByName(rest).groupBy("rid").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def compare(docs: DataFrame, bytes_path: str, pieces_path: str, hot: int = HOT) -> DataFrame:
    """How the two vocabularies' tokens of each document (doc_id, text) meet."""
    aligned = stored(tokens(need(docs, "doc_id", "text"), bytes_path, pieces_path), "alignment-links")
    pairs = stored(pair_counts(aligned), "alignment-pairs")
    return aligned.drop("links", "times").join(summed(aligned, pairs, hot), "rid").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
