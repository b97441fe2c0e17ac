"""Best-fit packing with Martello-Toth dominance reduction.

Pieces of one length are alike, so the plan is made on the histogram of
lengths, which has at most capacity entries whatever the corpus. The reduction
goes through lengths from the largest: a sequence is fixed for good where one
set of pieces provably dominates every other that holds the length: it alone,
if nothing else fits; with a partner that fills the sequence; with the largest
partner that fits, if at most one more piece fits or no two that fit weigh more.
Each fixing shrinks the instance and may allow others; what is left is packed
best-fit, longest first, many alike at a time.

The plan comes back as runs of ranks within a length. Pieces get their rank by
(length, salt) groups whose sizes are summed first, so that a length that a
third of all pieces have is ranked by many tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catena.llm.common import saved, shuffle_partitions, trim_worker
from catena.llm.pieces import library_encoder

CAPACITY = 2048


def cut_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of n tokens: full ones, but the first may be shorter."""
    if n <= 0:
        return []
    head = (n - 1) % capacity + 1
    return [head] + [capacity] * ((n - head) // capacity)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32), and with ids the piece's ids: texts in tokens, end_id appended, cut to capacity.

    Null and empty texts make one piece of end_id alone. Repeated rows make
    pieces each; other columns are not read.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim_worker()
        encode = library_encoder(tokenizer, " ")
        tail = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            cols: list[list] = [[] for _ in range(5 + ids)]
            for doc, raw in zip(batch.column(0).to_pylist(), map(encode, (t.as_py() for t in batch.column(1)))):
                raw += tail
                start = 0
                for k, n in enumerate(cut_lengths(len(raw) // 4, capacity)):
                    part = raw[4 * start : 4 * (start + n)]
                    for c, v in zip(cols, (doc, k, start, n, zlib.crc32(part), np.frombuffer(part, "<i4"))):
                        c.append(v)
                    start += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(cols)])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


class Plan:
    """Sequences for a histogram of lengths: runs (length, rank, count, per sequence, sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        if any(not 0 < k <= capacity for k in counts):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        self.capacity = capacity
        self.left = {k: n for k, n in counts.items() if n > 0}
        self.sizes = sorted(self.left)
        #: (items, sequences): items is a tuple of (length, copies in a sequence).
        self.bins: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self._reduce()
        self.fixed = sum(n for _, n in self.bins)
        self._best_fit()
        self.sequences = sum(n for _, n in self.bins)

    def _take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
            del self.sizes[bisect_left(self.sizes, length)]

    def _fix(self, items: tuple[tuple[int, int], ...], n: int) -> None:
        self.bins.append((items, n))
        for length, copies in items:
            self._take(length, copies * n)

    def _partner(self, length: int, room: int) -> int | None:
        """The largest other piece of at most room."""
        k = bisect_right(self.sizes, room) - 1
        if k >= 0 and self.sizes[k] == length and self.left[length] < 2:
            k -= 1
        return self.sizes[k] if k >= 0 else None

    def _two_smallest(self, length: int) -> int:
        """The least weight of two pieces besides one of length."""
        got: list[int] = []
        for s in self.sizes[:3]:
            got += [s] * min(2, self.left[s] - (s == length))
        return sum(sorted(got)[:2]) if len(got) > 1 else self.capacity + 1

    def _best_pair(self, length: int, room: int) -> int:
        """The largest weight up to room of two pieces besides one of length; 0 if there is none."""
        best, a, b = 0, 0, bisect_right(self.sizes, room) - 1
        spare = lambda s: self.left[s] - (s == length)
        while a <= b:
            x, y = self.sizes[a], self.sizes[b]
            if x + y > room or spare(y) < 1:
                b -= 1
                continue
            if spare(x) > (a == b):
                best = max(best, x + y)
                if best == room:
                    break
            a += 1
        return best

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for length in self.sizes[::-1]:
                while length in self.left:
                    room = self.capacity - length
                    partner = self._partner(length, room)
                    if partner is None:
                        self._fix(((length, 1),), self.left[length] if self.sizes[0] > room else 1)
                        changed = True
                        continue
                    fills = partner == room
                    if not fills and self._two_smallest(length) <= room:
                        # At most two more fit, if three of the smallest don't; then a partner as heavy as any pair dominates.
                        three = 3 * self.sizes[0] > room
                        if not (three and self._best_pair(length, room) <= partner):
                            break
                    # Whether a set dominates hangs on which lengths have a piece or two to spare: all but the last few go at once.
                    n = self.left[length] // 2 if partner == length else min(self.left[length], self.left[partner])
                    n = n if fills else max(1, n - 2)
                    self._fix(((length, 2),) if partner == length else ((length, 1), (partner, 1)), n)
                    changed = True

    def _best_fit(self) -> None:
        rooms: list[int] = []
        open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}

        def put(room: int, items: tuple[tuple[int, int], ...], n: int) -> None:
            if room < self.sizes[0] or not room:
                self.bins.append((items, n))
                return
            if room not in open_:
                insort(rooms, room)
            open_.setdefault(room, []).append((items, n))

        while self.sizes:
            length = self.sizes[-1]
            left = self.left[length]
            smallest = self.sizes[0]
            while left:
                k = bisect_left(rooms, length)
                if k < len(rooms):
                    room = rooms[k]
                    items, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
                    # Each of these sequences takes all it can before the next: best fit does the same.
                    copies = room // length
                    full = min(n, left // copies)
                    if full:
                        put(room - copies * length, (*items, (length, copies)), full)
                        left -= full * copies
                        n -= full
                    if n and 0 < left < copies:
                        put(room - left * length, (*items, (length, left)), 1)
                        left, n = 0, n - 1
                    if n:
                        put(room, items, n)
                    continue
                copies = self.capacity // length
                full, rest = divmod(left, copies)
                if full:
                    put(self.capacity - copies * length, ((length, copies),), full)
                if rest:
                    put(self.capacity - rest * length, ((length, rest),), 1)
                left = 0
            del self.left[length]
            self.sizes.pop()
            if self.sizes and self.sizes[0] != smallest:
                raise AssertionError("the smallest length goes last")
        for room in rooms:
            self.bins += open_[room]

    def runs(self) -> np.ndarray:
        """Columns length, rank, count, per, sequence, offset; sorted by length and rank."""
        rank: dict[int, int] = {}
        out, sequence = [], 0
        for items, n in self.bins:
            offset = 0
            for length, copies in items:
                at = rank.get(length, 0)
                out.append((length, at, n * copies, copies, sequence, offset))
                rank[length] = at + n * copies
                offset += length * copies
            sequence += n
        return np.array(sorted(out), np.int64).reshape(-1, 6)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length", by: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces with sequence_id and offset: sequences hold at most capacity, without gaps.

    Lengths must be from 1 to capacity; another one, or a null, is an error.
    Pieces of one length are ordered by the columns in by; equal rows get one
    place each. Columns of pieces named sequence_id or offset are replaced. An
    empty table gives an empty one. pieces is read twice: save it if it is dear.
    """
    pieces = pieces.drop("sequence_id", "offset")
    salts = 8 * shuffle_partitions(pieces.sparkSession)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts))).withColumn("_n", F.coalesce(F.col(length_col).cast("long"), F.lit(-1)))
    # At most capacity rows: one for each length.
    counts = {r["_n"]: r["count"] for r in salted.groupBy("_n").count().collect()}
    runs = Plan(counts, capacity).runs()
    key = (runs[:, 0] << 44) + runs[:, 1]

    groups = salted.groupBy("_n", "_salt").count()
    before = Window.partitionBy("_n").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_n", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_n", "_salt").orderBy(*by)
    ranked = salted.join(groups, ["_n", "_salt"]).withColumn("_rank", F.col("_base") + F.row_number().over(own) - 1)
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("_n", "_rank"))
            run = runs[np.searchsorted(key, (n << 44) + rank, "right") - 1]
            q = rank - run[:, 1]
            sequence, slot = run[:, 4] + q // run[:, 3], q % run[:, 3]
            arrays = [batch.column(c) for c in names] + [pa.array(sequence), pa.array(run[:, 5] + slot * n)]
            yield pa.RecordBatch.from_arrays(arrays, [*names, "sequence_id", "offset"])

    out = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*names, "_n", "_rank").mapInArrow(place, out)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents cut to pieces and packed: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(saved(token_pieces(docs, tokenizer, capacity, end_id, id_col, text_col)), capacity)
