"""Removal of long repeated passages with suffix arrays built by two-stage
sorting.

A byte goes if a string of ``WINDOW`` bytes that covers it starts at another
place too, in the same or another document.  Strings are cut from whole
documents as UTF-8 bytes and never cross a document.

1. *Anchors.*  Of the hashes of the ``GRAM``-byte grams inside a window the
   smallest names the window; neighbouring windows mostly share it.  Equal
   windows have equal anchors at equal distances, so a window whose anchor
   hash occurs once in the corpus repeats nowhere.  This looks at every
   position and discards most of the text before anything is sorted.
2. *Snippets.*  The text around the windows of a shared anchor.  Equal
   snippets are counted first and travel once.
3. *Suffix arrays.*  The snippets of one anchor hash meet in one task, which
   sorts their suffixes in two stages: a suffix smaller than its successor is
   sorted directly, every other suffix is induced by scanning the buckets in
   order (a suffix precedes by its first byte and the place of its
   successor).  Neighbours in the array with a common prefix of ``WINDOW``
   bytes are repeats.
4. Anchors with more than ``HEAVY`` different snippets are split: windows of
   a narrower range share the bytes common to the range, so the hash of
   those bytes deals them out anew, and the same code solves the finer
   groups.  Where a group is still heavy, its windows are counted by their
   hashes: a task packs the distinct hashes of many snippets into one row per
   block of the hash range, the blocks add up, and every task gets one bit per
   hash back, so there is no row per window.

Defined cases: null or empty text has no bytes and loses none; texts shorter
than the window lose nothing; repeated rows are documents of their own, so
their windows repeat; an empty table gives no rows.  Extra columns are
ignored (``drop_repeats`` keeps them).
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, row_key, written
from .text import _powers, buffers, mix, prefix_hash, span_hash

WINDOW = 400
GRAM = 64
HEAVY = 512  # different snippets of an anchor that one task sorts together
RANGE = 32  # windows per range when a heavy anchor is split
BLOCK_HASHES = 2_000_000  # window hashes that one block adds up
PACK_BYTES = 4 << 20  # bytes of heavy snippets whose windows are counted together
BLOCK_BYTES = 1 << 19  # snippet bytes sorted as one text
SEGMENT = 1 << 21  # windows of a very long document scanned at a time
PLACE_BITS = 24  # low bits of an anchor's order that hold its place in the buffer

_MULT = np.uint64(0xD6E8FEB86659FD93)


# --- anchors --------------------------------------------------------------

def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values (two block-wise passes)."""
    count = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1: width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor offset from the first window,
    anchor hash, snippet hash) for each run of windows with one anchor."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    if len(data) < window:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(span_hash(prefix, at, at + gram))
    bits = np.uint64(PLACE_BITS)
    ordered = (grams >> bits << bits) | at.astype(np.uint64)  # leftmost of equal hashes wins
    least = (_sliding_least(ordered, window - gram + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    start = np.arange(len(least))
    valid = start + window <= offsets[doc + 1]
    start, least, doc = start[valid], least[valid], doc[valid]
    if not len(start):
        return empty
    new = np.ones(len(start), bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(start)))
    s = start[first]
    snippet = mix(span_hash(prefix, s, s + many + window - 1) * _MULT + many.astype(np.uint64))
    return doc[first], s - offsets[doc[first]], many, least[first] - s, grams[least[first]], snippet


def _segments(data: np.ndarray, offsets: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, bytes, offsets): a very long document comes in segments; each
    of its windows starts in exactly one."""
    if len(data) <= 2 * SEGMENT:
        yield 0, data, offsets
        return
    for low in range(0, len(data), SEGMENT):
        part = data[low: low + SEGMENT + window - 1]
        yield low, part, np.array([0, len(part)])


def _anchor_rows(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in buffers(batch.column("text")):
                for shift, part, part_offsets in _segments(data, offsets, window):
                    doc, start, many, off, h, snippet = anchors(part, part_offsets, window, gram)
                    row = pa.array(doc + lo)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("k1").take(row), batch.column("k2").take(row), pa.array(start + shift),
                         pa.array(many.astype(np.int32)), pa.array(off.astype(np.int32)),
                         pa.array(h.view(np.int64)), pa.array(snippet.view(np.int64))],
                        names=["k1", "k2", "start", "many", "off", "anchor", "snippet"])

    return run


# --- two-stage suffix sorting ---------------------------------------------

class SuffixArray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes at
    least; the end of the text is smaller than any byte."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, self.depth = text, depth
        self.prefix = prefix_hash(text)
        n = len(text)
        smaller = np.zeros(n, bool)  # than the successor
        if n > 1:
            differs = np.append(np.flatnonzero(text[1:] != text[:-1]), n - 1)
            run_end = differs[np.searchsorted(differs, np.arange(n))]
            inner = run_end < n - 1
            smaller[inner] = text[run_end[inner]] < text[run_end[inner] + 1]
        self.smaller = smaller
        self.order = self._induce(self._sort(np.flatnonzero(smaller)))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes, up to ``depth``."""
        n = len(self.text)
        power, _ = _powers(n + 1)
        reach = np.minimum(self.depth, n - np.maximum(a, b))
        low, high = np.zeros(len(a), np.int64), reach
        prefix, pa_, pb = self.prefix, self.prefix[a], self.prefix[b]
        wa, wb = power[a], power[b]
        while (open_ := low < high).any():
            middle = (low + high + 1) >> 1
            same = (prefix[a + middle] - pa_) * wb == (prefix[b + middle] - pb) * wa
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def _words(self, at: np.ndarray) -> np.ndarray:
        """The first 8 bytes of suffixes as big-endian numbers."""
        padded = np.append(self.text, np.zeros(8, np.uint8))
        out = np.zeros(len(at), np.uint64)
        for k in range(8):
            out = (out << np.uint64(8)) | padded[at + k]
        return out

    def _sort(self, at: np.ndarray) -> np.ndarray:
        """Direct sort: by 8 bytes, then ties are split around a pivot by the
        length of the common prefix with it, until none is left."""
        n = len(self.text)
        key = self._words(at)
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        group = np.cumsum(new) - 1
        open_ = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1) if len(at) else np.zeros(0, np.int64)
        while len(open_):
            own, tied = at[open_], group[open_]
            head = np.flatnonzero(np.append(True, tied[1:] != tied[:-1]))
            size = np.diff(np.append(head, len(tied)))
            pivot = np.repeat(own[head + size // 2], size)
            length = self.common(own, pivot)
            mine = np.where(own + length < n, self.text[np.minimum(own + length, n - 1)].astype(np.int64), -1)
            other = np.where(pivot + length < n, self.text[np.minimum(pivot + length, n - 1)].astype(np.int64), -1)
            side = np.sign(mine - other)
            equal = (length >= self.depth) | (own == pivot)
            rank = np.where(equal, 0, side * (self.depth + 1 - length))
            wide = 2 * self.depth + 4
            order = np.argsort(tied * wide + rank + self.depth + 2, kind="stable")
            at[open_] = own[order]
            rank, tied = rank[order], tied[order]
            new = np.ones(len(rank), bool)
            new[1:] = (tied[1:] != tied[:-1]) | (rank[1:] != rank[:-1])
            cut = np.flatnonzero(new)
            size = np.diff(np.append(cut, len(rank)))
            again = np.repeat((size > 1) & (rank[cut] != 0), size)
            group[open_] = open_[np.repeat(cut, size)]
            open_ = open_[again]
        return at

    def _induce(self, direct: np.ndarray) -> np.ndarray:
        """Scan the buckets (first bytes) in order.  In a bucket the induced
        suffixes come first, then the directly sorted ones; each suffix
        appends its predecessor to the predecessor's bucket, if that one is
        not smaller than it."""
        text, smaller = self.text, self.smaller
        n = len(text)
        bounds = np.searchsorted(text[direct], np.arange(257)) if len(direct) else np.zeros(257, np.int64)
        waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        if n:
            waiting[text[n - 1]].append(np.array([n - 1]))  # its successor is the empty suffix
        out = []
        for byte in range(256):
            induced = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, np.int64)
            found = [induced]
            while len(induced):  # runs of the bucket's own byte
                before = induced[induced > 0] - 1
                induced = before[(text[before] == byte) & ~smaller[before]]
                found.append(induced)
            bucket = np.concatenate([*found, direct[bounds[byte]: bounds[byte + 1]]])
            waiting[byte] = []
            out.append(bucket)
            before = bucket[bucket > 0] - 1
            first = text[before]
            before = before[first > byte]
            first = first[first > byte]
            order = np.argsort(first, kind="stable")
            before, first = before[order], first[order]
            cuts = np.flatnonzero(np.append(True, first[1:] != first[:-1])) if len(first) else []
            for a, b in zip(cuts, [*cuts[1:], len(first)]):
                waiting[first[a]].append(before[a:b])
        return np.concatenate(out)


def repeated_windows(snippets: list[bytes], times: list[int], window: int) -> list[np.ndarray]:
    """For each snippet, which of its windows start at more than one place
    (a snippet that occurs several times repeats all of its own)."""
    lengths = np.array([len(s) for s in snippets], np.int64)
    text = np.frombuffer(b"".join(snippets), np.uint8)
    ends = np.cumsum(lengths)
    array = SuffixArray(text, window).order
    owner = np.repeat(np.arange(len(snippets)), lengths)
    array = array[array + window <= ends[owner[array]]]  # suffixes that hold a whole window
    repeat = np.zeros(len(text), bool)
    if len(array) > 1:
        prefix = prefix_hash(text)
        whole = span_hash(prefix, array, array + window)
        pairs = np.flatnonzero(whole[1:] == whole[:-1])  # common prefix of neighbours >= window
        repeat[array[pairs]] = True
        repeat[array[pairs + 1]] = True
    repeat[np.repeat(np.array(times) > 1, lengths)] = True
    starts = ends - lengths
    return [repeat[a: b - window + 1] for a, b in zip(starts, ends)]


def _solve_groups(window: int):
    """Snippets sorted by group -> ranges of repeated windows.  Groups are
    joined to texts of about ``BLOCK_BYTES``; equal windows have one group."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        found = repeated_windows([r[-1] for r in rows], [r[-2] for r in rows], window)
        out: list[list] = [[], [], []]
        for row, repeat in zip(rows, found):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], repeat.view(np.int8), [0]])))
            if len(edge):
                out[0].append(row[0])
                out[1].append(edge[::2] + row[1])
                out[2].append(edge[1::2] + row[1])
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()),
                                           pa.array([x.tolist() for x in out[1]], pa.list_(pa.int32())),
                                           pa.array([x.tolist() for x in out[2]], pa.list_(pa.int32()))],
                                          names=["name", "lows", "highs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, last = [], 0, None
        for batch in batches:
            for group, name, skip, times, text in zip(*(c.to_pylist() for c in batch.columns)):
                if size > BLOCK_BYTES and group != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append((name, skip, times, text))
                size += len(text)
                last = group
        if rows:
            yield solve(rows)

    return run


def _cut_snippets(window: int):
    """Documents with the places of their representative snippets -> text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist()):
                for p in places:
                    out[0].append(p["anchor"])
                    out[1].append(p["name"])
                    out[2].append(p["off"])
                    out[3].append(p["times"])
                    out[4].append(text[p["start"]: p["start"] + p["many"] + window - 1])
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             names=["anchor", "name", "off", "times", "text"])

    return run


def _split(window: int, width: int):
    """Snippets of heavy anchors -> snippets of at most ``width`` windows,
    dealt out by anchor, range and the bytes that all windows of it share.
    Ranges are counted from the anchor, so equal windows fall together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            for anchor, name, off, skip, times, text in zip(*(c.to_pylist() for c in batch.columns)):
                many = len(text) - window + 1
                low = 0
                while low < many:
                    place = (off - low) // width  # distance of the window from its anchor
                    high = min(many, off - place * width + 1)
                    # From the start of the range's last window to the end of its
                    # first one: inside every window of the range.
                    core = text[off - place * width: off - (place + 1) * width + 1 + window]
                    key = hashlib.blake2b(core, digest_size=8, key=f"{anchor}/{place}/{width}".encode()).digest()
                    out[0].append(int.from_bytes(key, "little", signed=True))
                    out[1].append(name)
                    out[2].append(off - low)
                    out[3].append(skip + low)
                    out[4].append(times)
                    out[5].append(text[low: high + window - 1])
                    low = high
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)],
                                             names=["anchor", "name", "off", "skip", "times", "text"])

    return run


_PACKS = pa.schema([("pack", pa.int64()), ("names", pa.list_(pa.binary())), ("skips", pa.list_(pa.int32())),
                    ("many", pa.list_(pa.int32())), ("places", pa.binary()), ("hashes", pa.binary()), ("times", pa.binary())])
_SLICES = pa.schema([("block", pa.int64()), ("pack", pa.int64()), ("hashes", pa.binary()), ("times", pa.binary())])
_ANSWERS = pa.schema([("pack", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])


def _packed(window: int):
    """Snippets -> packs of some megabytes of them: the sorted distinct hashes
    of all their windows, how often each occurs (2 stands for more) and, per
    window in order, its hash's number."""

    def close(rows: list[tuple]) -> pa.RecordBatch:
        names, skips, times, texts = zip(*rows)
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        many = sizes - window + 1
        first = np.cumsum(sizes) - sizes
        at = np.arange(many.sum()) + np.repeat(first - (np.cumsum(many) - many), many)
        hashes = mix(span_hash(prefix_hash(data), at, at + window))
        found, number = np.unique(hashes, return_inverse=True)
        count = np.bincount(number, np.repeat(np.minimum(np.array(times, np.int64), 2), many), len(found))
        pack = int.from_bytes(os.urandom(8), "little", signed=True)
        values = (pack, names, skips, many.astype(np.int32), number.astype(np.uint32).tobytes(), found.tobytes(),
                  np.minimum(count, 2).astype(np.uint8).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _PACKS)], schema=_PACKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                rows.append(row)
                size += len(row[-1])
                if size >= PACK_BYTES:
                    yield close(rows)
                    rows, size = [], 0
        if rows:
            yield close(rows)

    return run


def _dealt(blocks: int):
    """Packs -> one row per pack and block of the hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, hashes, times in zip(*(c.to_pylist() for c in batch.columns)):
                block = ((np.frombuffer(hashes, np.uint64) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(block, np.arange(blocks + 1)).tolist()
                rows = [(b, pack, hashes[8 * a: 8 * z], times[a:z]) for b, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SLICES)], schema=_SLICES)

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices sorted by block -> per slice a bit for each of its hashes: it
    occurs more than once in all packs."""

    def answer(block: int, rows: list[tuple]) -> pa.RecordBatch:
        hashes = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows])
        found, number = np.unique(hashes, return_inverse=True)
        count = np.bincount(number, np.frombuffer(b"".join(r[2] for r in rows), np.uint8), len(found))
        several = (count > 1)[number]
        ends = np.cumsum([len(r[2]) for r in rows]).tolist()
        out = [(r[0], block, z - a, np.packbits(several[a:z]).tobytes()) for r, a, z in zip(rows, [0, *ends], ends)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ANSWERS)], schema=_ANSWERS)

    now, rows = None, []
    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if block != now and rows:
                yield answer(now, rows)
                rows = []
            now = block
            rows.append(tuple(row))
    if rows:
        yield answer(now, rows)


def _ranges_of_packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs with the answers of all blocks -> ranges of repeated windows."""
    for batch in batches:
        for names, skips, many, places, answers in zip(*(c.to_pylist() for c in batch.columns)):
            several = np.concatenate([np.unpackbits(np.frombuffer(a["bits"], np.uint8), count=a["size"]) for a in answers])
            repeat = several[np.frombuffer(places, np.uint32)]
            ends = np.cumsum(many).tolist()
            out: list[list] = [[], [], []]
            for name, skip, a, z in zip(names, skips, [0, *ends], ends):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], repeat[a:z].view(np.int8), [0]])))
                if len(edge):
                    out[0].append(name)
                    out[1].append((edge[::2] + skip).tolist())
                    out[2].append((edge[1::2] + skip).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.list_(pa.int32())), pa.array(out[2], pa.list_(pa.int32()))],
                                             names=["name", "lows", "highs"])


def counted_windows(snippets: DataFrame, window: int) -> DataFrame:
    """``name, lows, highs``: ranges of the windows of ``snippets`` (name,
    skip, times, text) that start at more than one place, told by the 64-bit
    hashes of the windows."""
    packs = written(snippets.select("name", "skip", "times", "text").mapInArrow(
        _packed(window), "pack long, names array<binary>, skips array<int>, many array<int>, places binary, hashes binary, times binary"), "suffix-packs")
    size = packs.agg(F.coalesce(F.sum(F.length("times")), F.lit(0))).first()[0]
    least = partitions(snippets.sparkSession)
    blocks = max(least, -(-size // BLOCK_HASHES))
    answers = (packs.select("pack", "hashes", "times").mapInArrow(_dealt(blocks), "block long, pack long, hashes binary, times binary")
               .repartition(min(blocks, 4 * least), "block").sortWithinPartitions("block")
               .mapInArrow(_answered, "pack long, block long, size long, bits binary"))
    back = answers.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("block", "size", "bits"))).alias("answers"))
    return (packs.select("pack", "names", "skips", "many", "places").join(back, "pack").drop("pack")
            .mapInArrow(_ranges_of_packs, "name binary, lows array<int>, highs array<int>"))


def _merged_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Touching and overlapping ranges of a snippet as one."""
    for batch in batches:
        lows, highs = [], []
        for low, high in zip(batch.column("lows").to_pylist(), batch.column("highs").to_pylist()):
            runs = _merge(zip(low, high))
            lows.append([r[0] for r in runs])
            highs.append([r[1] for r in runs])
        yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(lows, pa.list_(pa.int32())), pa.array(highs, pa.list_(pa.int32()))],
                                         names=["name", "lows", "highs"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, heavy: int = HEAVY) -> DataFrame:
    """``k1, k2, start, lows, highs``: per place of a snippet in the documents
    ``k1, k2, text`` (text as binary) the ranges of windows from ``start`` on
    that repeat, apart from each other.  A range of windows low to high removes
    the bytes from start + low to start + high + window - 1."""
    rows = docs.mapInArrow(_anchor_rows(window, gram),
                           "k1 long, k2 long, start long, many int, off int, anchor long, snippet long")
    rows = written(rows, "suffix-anchors")
    # Written on its own, so that the join below has plain shuffles on both
    # sides and the planner can split the rows of a very common anchor.
    shared = written(rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"),
                     "suffix-repeated")
    rows = written(rows.join(shared, "anchor"), "suffix-shared")
    same = ["anchor", "snippet", "many", "off"]
    distinct = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("times"),
                                       F.min(F.struct("k1", "k2", "start")).alias("at"))
    name = F.unhex(F.md5(F.concat_ws("/", *same))).alias("name")
    place = F.struct(F.col("at.start").alias("start"), "many", "off", "anchor", name, "times")
    places = distinct.groupBy(F.col("at.k1").alias("k1"), F.col("at.k2").alias("k2")).agg(F.collect_list(place).alias("places"))
    cut = (docs.join(places, ["k1", "k2"]).select("text", "places")
           .mapInArrow(_cut_snippets(window), "anchor long, name binary, off int, times long, text binary")
           .withColumn("skip", F.lit(0)).select("anchor", "name", "off", "skip", "times", "text"))
    snippets = written(cut, "suffix-snippets")
    solved = []
    for last in (False, True):
        large = (snippets.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
                 .filter(F.col("n") > heavy).select("anchor"))
        solved.append(snippets.join(large, "anchor", "left_anti").select("anchor", "name", "skip", "times", "text")
                      .repartition("anchor").sortWithinPartitions("anchor")
                      .mapInArrow(_solve_groups(window), "name binary, lows array<int>, highs array<int>"))
        if large.limit(1).count() == 0:
            break
        snippets = snippets.join(large, "anchor", "left_semi")
        if last:
            solved.append(counted_windows(snippets, window))
        else:
            snippets = written(snippets.mapInArrow(_split(window, RANGE), snippets.schema), "suffix-split")
    found = solved[0]
    for more in solved[1:]:
        found = found.unionByName(more)
    # A snippet solved in parts gets its ranges merged before they meet its
    # places, so the join has one row per place, however often it was split.
    parts = found.groupBy("name").agg(F.flatten(F.collect_list("lows")).alias("lows"), F.flatten(F.collect_list("highs")).alias("highs"))
    ranges = written(parts.mapInArrow(_merged_ranges, parts.schema), "suffix-found")
    return rows.select("k1", "k2", "start", name).join(ranges, "name").select("k1", "k2", "start", "lows", "highs")


def _merge(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def without_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW,
                    whole_characters: bool = False) -> DataFrame:
    """``row`` (the input row without ``text``) beside ``kept`` (binary: what
    is left), ``had_text, n_bytes, n_removed, n_spans``.  With
    ``whole_characters`` the rest of a character that lost a byte goes too, so
    that ``kept`` is valid UTF-8."""
    others = [c for c in docs.columns if c != text]
    keyed = docs.select(*row_key(*docs.columns), F.struct(F.lit(0).alias("__"), *others).alias("row"),
                        F.col(text).isNotNull().alias("had_text"),
                        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    ranges = repeated_ranges(keyed.select("k1", "k2", "text"), window)
    spans = ranges.groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "lows", "highs")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, removed, count, size = [], [], [], []
            for body, found in zip(batch.column("text"), batch.column("spans")):
                body = body.as_py()
                runs = _merge((p["start"] + low, p["start"] + high + window - 1)
                              for p in found.as_py() or [] for low, high in zip(p["lows"], p["highs"]))
                parts, at = [], 0
                for low, high in runs:
                    parts.append(body[at:low])
                    at = high
                left = b"".join([*parts, body[at:]]) if runs else body
                if whole_characters and runs:
                    left = left.decode("utf-8", "ignore").encode()
                kept.append(left)
                size.append(len(body))
                removed.append(len(body) - len(left))
                count.append(len(runs))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("had_text"), pa.array(kept, pa.binary()), pa.array(size, pa.int64()),
                 pa.array(removed, pa.int64()), pa.array(count, pa.int64())],
                names=["row", "had_text", "kept", "n_bytes", "n_removed", "n_spans"])

    joined = keyed.join(spans, ["k1", "k2"], "left").select("row", "had_text", "text", "spans")
    schema = joined.select("row", "had_text", F.col("text").alias("kept")).schema
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    return joined.mapInArrow(cut, schema)


# --- query ---------------------------------------------------------------

def op9_suffix_dedup(docs: DataFrame) -> DataFrame:
    slim = docs.select("doc_id", "text")
    out = without_repeats(slim)
    text = F.when(F.col("had_text"), F.make_valid_utf8(F.col("kept").cast("string")))  # a character cut in two reads U+FFFD
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))
