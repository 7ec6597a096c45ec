"""Packing documents into fixed windows by a histogram and non-negative least squares.

Documents longer than a window give whole windows; what is left of each is its
tail.  Tail lengths are rounded up to bins.  All shallow combinations of bins
that fill a window are listed, their repeat counts solved against the histogram
by non-negative least squares and rounded to what the bins hold.  Which tails go
where follows from a tail's length and its rank among equal lengths alone: in a
bin the longest are used first.  So the driver sees one count per length, and
each task works out its pieces by arithmetic.

Tails that no combination uses are the residuals.  They are laid end to end and
cut to fill, first, the room that rounding up left in the combinations, then
fresh windows, and at last windows whose lengths are powers of two.  Padding is
left only where there are fewer residuals than room.

Edge cases: a null or empty text is its end token alone.  Repeated rows, equal
and null ids are packed each for itself.  An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtap.llm import byte_bpe
from railtap.llm.common import block_number, need, running_total, stored

WINDOW = 2048
END = 1


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """rid, doc_id, n and ids (little-endian words of 2 or 4 bytes) of each document, its end token included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, dtype = byte_bpe.id_units(path), np.dtype(byte_bpe.id_code(path)).newbyteorder("<")
        stop = np.array([end], dtype).tobytes()
        for b in batches:
            ids = [b"".join(units.values(t or "")) + stop for t in b.column("text").to_pylist()]
            n = pa.array([len(i) // dtype.itemsize for i in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), n, pa.array(ids, pa.binary())],
                                             ["rid", "doc_id", "n", "ids"])

    if not byte_bpe.is_byte_level(path):
        raise ValueError(f"{path}: packing takes byte-level BPE vocabularies")
    rows = need(docs, "doc_id", "text").withColumn("rid", F.monotonically_increasing_id())
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"rid long, doc_id {kind}, n long, ids binary")


def combinations(parts: int, depth: int) -> list[tuple[int, ...]]:
    """All falling tuples of at most ``depth`` positive numbers with sum ``parts``."""
    def more(left: int, most: int, depth: int) -> Iterator[tuple[int, ...]]:
        if left == 0:
            yield ()
        elif depth:
            for a in range(min(left, most), (left - 1) // depth, -1):
                for rest in more(left - a, a, depth - 1):
                    yield (a, *rest)
    return list(more(parts, parts, depth))


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """min |a x - b| with x >= 0, by the active-set method."""
    gram, target = a.T @ a, a.T @ b
    x, use = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    for _ in range(6 * a.shape[0]):
        slope = target - gram @ x
        slope[use] = -np.inf
        if slope.max() <= tolerance * max(1.0, np.abs(b).max()):
            break
        use[slope.argmax()] = True
        while True:
            on = np.flatnonzero(use)
            z = np.linalg.solve(gram[np.ix_(on, on)] + 1e-9 * np.eye(len(on)), target[on])
            if z.min() > 0:
                x[:] = 0
                x[on] = z
                break
            low = z <= 0
            step = np.min(x[on][low] / np.maximum(x[on][low] - z[low], 1e-300))
            x[on] += step * (z - x[on])
            use[on[x[on] <= 1e-12]] = False
            x[~use] = 0
            if not use.any():
                return x
    return x


@dataclass
class Layout:
    """Where a tail goes, by its length and its rank among tails of that length."""
    window: int
    bin_of: np.ndarray  # by length
    rank0: np.ndarray  # by length: first rank in the bin
    used: np.ndarray  # by length: tails in combinations
    stream0: np.ndarray  # by length: first position of its residuals on the line
    part: list[np.ndarray]  # by bin: rows (first rank, sequence of that rank, part)
    run0: np.ndarray  # first sequence of each run of equal combinations
    run_offsets: np.ndarray  # offsets of its parts
    room0: np.ndarray  # first position of a run's room on the line
    room_run: np.ndarray
    room: np.ndarray  # by run
    room_total: int
    line: int
    fresh: int  # first sequence after the combinations
    sequences: int

    def used_place(self, length: int, rank: int) -> tuple[int, int]:
        at = int(self.rank0[length]) + rank
        table = self.part[int(self.bin_of[length])]
        first, sequence, part = table[np.searchsorted(table[:, 0], at, "right") - 1]
        sequence = int(sequence + at - first)
        return sequence, int(self.run_offsets[np.searchsorted(self.run0, sequence, "right") - 1][part])

    def residual_places(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, length) of the stretches of a residual tail."""
        x = int(self.stream0[length]) + (rank - int(self.used[length])) * length
        end, w = x + length, self.window
        whole = self.room_total + (self.line - self.room_total) // w * w if self.line > self.room_total else self.room_total
        while x < end:
            if x < self.room_total:
                k = np.searchsorted(self.room0, x, "right") - 1
                run = self.room_run[k]
                room = int(self.room[run])
                q, off = divmod(x - int(self.room0[k]), room)
                sequence, size, base = int(self.run0[run]) + q, room, w - room
            elif x < whole:
                q, off = divmod(x - self.room_total, w)
                sequence, size, base = self.fresh + q, w, 0
            else:  # the last part window, as windows of falling powers of two
                left, at, sequence = self.line - whole, whole, self.fresh + (whole - self.room_total) // w
                while True:
                    size = 1 << (left.bit_length() - 1)
                    if x < at + size:
                        break
                    at, left, sequence = at + size, left - size, sequence + 1
                off, base = x - at, 0
            n = min(end - x, size - off)
            yield sequence, base + off, n
            x += n


def plan(histogram: dict[int, int], window: int = WINDOW, bin_width: int = 16, depth: int = 3) -> Layout:
    """Solve the repeat counts for tails with the given lengths (1 to window - 1) and lay out everything."""
    count = np.zeros(window, np.int64)
    for length, n in histogram.items():
        count[length] = n
    lengths = np.arange(window)
    bin_of = -(-lengths // bin_width)
    bins = window // bin_width
    have = np.bincount(bin_of, count, bins + 1).astype(np.int64)
    ways = [c for c in combinations(bins, depth) if all(have[b] for b in c)]
    repeats = np.zeros(len(ways), np.int64)
    if ways:
        a = np.zeros((bins + 1, len(ways)))
        for k, c in enumerate(ways):
            for b in c:
                a[b, k] += 1
        solved = nnls(a, have.astype(float))
    rank0 = np.zeros(window, np.int64)
    for b in range(bins + 1):
        inside = lengths[bin_of == b][::-1]
        rank0[inside] = np.cumsum(count[inside]) - count[inside]
    share = 1.0
    while True:
        left = have.copy()
        for k in np.argsort(-solved, kind="stable") if ways else []:
            need_of = {b: ways[k].count(b) for b in ways[k]}
            repeats[k] = max(0, min(int(round(share * solved[k])), *(int(left[b]) // m for b, m in need_of.items())))
            for b, m in need_of.items():
                left[b] -= m * repeats[k]
        used_bin = have - left
        used = np.clip(used_bin[bin_of] - rank0, 0, count)
        line = int(((count - used) * lengths).sum())
        room_total = window * int(repeats.sum()) - int((used * lengths).sum())
        if room_total <= line or not repeats.any():
            break
        share *= 0.97
    stream0 = np.cumsum((count - used) * lengths) - (count - used) * lengths

    part: list[list] = [[] for _ in range(bins + 1)]
    taken = np.zeros(bins + 1, np.int64)
    runs, sequence = [], 0
    for k in np.flatnonzero(repeats):
        n, cuts, sources = int(repeats[k]), {0}, []
        for p, b in enumerate(ways[k]):
            first = int(taken[b])
            taken[b] += n
            part[b].append((first, sequence, p))
            inside = lengths[(bin_of == b) & (count > 0)][::-1]
            cuts |= {int(r) - first for r in rank0[inside] if 0 < int(r) - first < n}
            sources.append((inside, first))
        for i in sorted(cuts):
            sizes = [int(inside[np.searchsorted(rank0[inside], first + i, "right") - 1]) for inside, first in sources]
            runs.append((sequence + i, np.cumsum([0, *sizes, *[0] * (depth - len(sizes))])[:depth], window - sum(sizes)))
        sequence += n
    run0 = np.array([r[0] for r in runs], np.int64)
    room = np.array([r[2] for r in runs], np.int64)
    each = np.diff(np.append(run0, sequence)) * room
    some = np.flatnonzero(each)
    extra = max(0, line - room_total)
    fresh_end = sequence + extra // window + bin(extra % window).count("1")
    return Layout(window, bin_of, rank0, used, stream0, [np.array(p, np.int64).reshape(-1, 3) for p in part], run0,
                  np.array([r[1] for r in runs], np.int64).reshape(-1, depth), (np.cumsum(each) - each)[some], some, room,
                  room_total, line, sequence, fresh_end)


def pieces(tokens: DataFrame, window: int = WINDOW, keep_ids: bool = False, **options) -> DataFrame:
    """Pack stored ``tokens`` (as :func:`tokenised` gives): one row per piece with its place."""
    narrow = need(tokens, "rid", "n").withColumn("tail", F.col("n") % window)
    # one count per tail length: at most ``window`` rows
    counted = {r["tail"]: r["count"] for r in narrow.groupBy("tail").count().collect()}
    documents = sum(counted.values())
    layout = plan({k: v for k, v in counted.items() if k}, window, **options)
    tails = sorted(counted)
    before = dict(zip(tails, np.cumsum([0, *(counted[t] for t in tails)]).tolist()))
    ranked = running_total(narrow.select("rid", "tail"), ["tail"], ["rid"], F.lit(1), "rank", block_number(documents))
    rows = tokens.join(ranked.select("rid", "rank"), "rid")
    kind = dict(tokens.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [[] for _ in range(8)]
            for row, (n, ids, rank) in enumerate(zip(b.column("n").to_pylist(), b.column("ids"), b.column("rank").to_pylist())):
                raw = ids.as_buffer()
                words = np.frombuffer(raw, f"<u{raw.size // n}")
                tail, full = n % window, n // window
                places = [(layout.sequences + before[tail] + rank + documents * k, 0, window) for k in range(full)]
                if tail and rank < layout.used[tail]:
                    places.append((*layout.used_place(tail, rank), tail))
                elif tail:
                    places += layout.residual_places(tail, rank)
                start = 0
                for sequence, offset, length in places:
                    own = words[start:start + length].astype("<u4").tobytes()
                    for column, value in zip(out, (row, start, length, zlib.crc32(own), n, sequence, offset, own if keep_ids else None)):
                        column.append(value)
                    start += length
            columns = [b.column("doc_id").take(pa.array(out[0], pa.int64())), *[pa.array(c, pa.int64()) for c in out[1:7]]]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                columns.append(pa.array(out[7], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = (f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
              + ", ids binary" * keep_ids)
    return rows.select("doc_id", "n", "ids", "rank").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, **options) -> DataFrame:
    """Tokenise ``docs`` and pack them; ``keep_ids`` adds each piece's ids (unsigned, 4 bytes, little-endian)."""
    return pieces(stored(tokenised(docs, path, end), "pack-ids"), window, **options)
