"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become token pieces of at most ``capacity`` ids.  What has to be
packed is a histogram: at most ``capacity`` different lengths with their
counts, whatever the size of the corpus.  The Martello-Toth reduction fixes
small sets of lengths that provably dominate every alternative (as often as
the counts allow), which shrinks the instance; best fit in decreasing order
packs the rest, a run of equal sequences at a time.  The result is a table of
slots; every piece looks its slot up by (length, rank within the length).

Defined cases: a null text is an empty document; every document ends with the
end id, so an empty one is a piece of length 1; an empty table gives no rows;
repeated rows are documents of their own; ties are ordered by (doc_id, piece,
checksum).  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_rank, written
from .text import buffers
from .tokens import WordEncoder

CAPACITY = 4096
END_ID = 1
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY,
                 end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every
    document's ids, cut after each ``capacity`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(tokenizer)
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in buffers(batch.column(1), 1 << 21):
                flat, counts = encoder.encode(data, offsets, end_id)
                yield _cut(ids.slice(first, end - first), flat, counts, capacity, with_ids)

    schema = _PIECES + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _cut(doc_ids: pa.Array, flat: np.ndarray, counts: np.ndarray, capacity: int, with_ids: bool) -> pa.RecordBatch:
    per_doc = -(-counts // capacity)
    doc = np.repeat(np.arange(len(counts)), per_doc)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    start = piece * capacity
    length = np.minimum(counts[doc] - start, capacity)
    at = (np.cumsum(counts) - counts)[doc] + start
    crc = [zlib.crc32(flat[a: a + n]) for a, n in zip(at.tolist(), length.tolist())]
    columns = [doc_ids.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
               pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    if with_ids:
        bounds = np.append(0, np.cumsum(length)).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32))))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


class Slots:
    """Placement of a histogram of lengths: rows (length, first rank, count,
    first sequence, offset).  Rank r of a length, first <= r < first + count,
    goes to sequence ``sequence + r - first`` at ``offset``."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = {n: c for n, c in sorted(counts.items()) if c > 0}
        self.used = dict.fromkeys(self.left, 0)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.fixed = 0
        while self._reduce():
            pass
        self._best_fit()

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int]) -> None:
        """Put the set into as many sequences as the counts allow."""
        times = min(self.left[n] // lengths.count(n) for n in set(lengths))
        offset = 0
        for n in lengths:
            self._place(n, times, self.sequences, offset)
            offset += n
        self.sequences += times
        self.fixed += times

    def _reduce(self) -> bool:
        """One pass over the lengths, largest first; true if a set was fixed."""
        fixed = self.fixed
        for length in sorted(self.left, reverse=True):
            while self.left.get(length) and (chosen := self._dominating(length)):
                self._fix(chosen)
        return self.fixed > fixed

    def _dominating(self, length: int) -> list[int] | None:
        """A set with ``length`` that dominates all others with it, or None.
        A set dominates another if the other's items can be grouped so that
        each group is no longer than a different item of the set."""
        room = self.capacity - length
        others = dict(self.left)
        others[length] -= 1
        keys = [n for n in sorted(others) if others[n]]
        fitting = keys[: bisect.bisect_right(keys, room)]
        if not fitting:
            return [length]
        largest = fitting[-1]
        smallest = _smallest(fitting, others, 3)
        if largest == room or sum(smallest[:2]) > room or len(smallest) < 2:
            return [length, largest]  # nothing longer than the largest partner fits beside it
        if len(smallest) == 3 and sum(smallest) <= room:
            return None  # three partners fit: no small set is known to dominate
        if _largest_pair(fitting, others, room) <= largest:
            return [length, largest]
        others[largest] -= 1
        second = [n for n in fitting if others[n] and n <= room - largest]
        if second:
            above = _smallest([n for n in fitting if n > second[-1]], _without(self.left, length), 2)
            if len(above) < 2 or sum(above) > room:
                return [length, largest, second[-1]]
        return None

    def _best_fit(self) -> None:
        """Longest first, each into the fullest sequences that still hold it.
        Runs of sequences with equal room are kept together."""
        runs: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def add(room: int, sequence: int, count: int) -> None:
            if room not in runs:
                runs[room] = []
                bisect.insort(rooms, room)
            runs[room].append((sequence, count))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect.bisect_left(rooms, length)
                if at == len(rooms):
                    each = min(self.capacity // length, self.left[length])
                    whole = self.left[length] // each
                    for k in range(each):
                        self._place(length, whole, self.sequences, k * length)
                    add(self.capacity - each * length, self.sequences, whole)
                    self.sequences += whole
                    continue
                room = rooms[at]
                sequence, count = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                take = min(count, self.left[length])
                self._place(length, take, sequence, self.capacity - room)
                add(room - length, sequence, take)
                if take < count:
                    add(room, sequence + take, count - take)

    def table(self) -> tuple[np.ndarray, ...]:
        """Columns (length, first, sequence, offset), ordered by length and
        first rank."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 5)
        return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 4]


def _without(counts: dict[int, int], length: int) -> dict[int, int]:
    return {n: c - (n == length) for n, c in counts.items()}


def _smallest(keys: list[int], counts: dict[int, int], most: int) -> list[int]:
    out: list[int] = []
    for n in keys:
        out += [n] * min(counts[n], most - len(out))
        if len(out) == most:
            break
    return out


def _largest_pair(keys: list[int], counts: dict[int, int], room: int) -> int:
    """Largest sum of two items that is at most ``room``; 0 if none."""
    best, low, high = 0, 0, len(keys) - 1
    while low <= high:
        total = keys[low] + keys[high]
        if total > room or (low == high and counts[keys[low]] < 2):
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of at most ``capacity``
    ids.  The histogram (at most ``capacity`` rows) is all that reaches the
    driver; the slots have a bound that depends on ``capacity`` alone, since
    each length opens at most one run of sequences and splits at most one."""
    pieces = written(pieces, "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    length, first, sequence, offset = Slots(counts, capacity).table()
    slot_key = (length << 44) | first
    ranked = salted_rank(pieces, ["length"], ["doc_id", "piece", "ids_crc32"],
                         F.xxhash64("doc_id", "piece", "ids_crc32"))
    kept = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() - 1
            at = np.searchsorted(slot_key, (batch.column("length").to_numpy() << 44) | rank, "right") - 1
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves from packed pieces with ``ids``:
    ``sequence_id, ids, doc_ids, starts`` (a group holds one sequence)."""
    item = F.struct("offset", "doc_id", "ids")
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
            .select("sequence_id", F.flatten(F.col("items.ids")).alias("ids"), F.col("items.doc_id").alias("doc_ids"),
                    F.col("items.offset").alias("starts")))


# --- query ---------------------------------------------------------------

def op7_packing(docs: DataFrame) -> DataFrame:
    return pack(token_pieces(docs))
