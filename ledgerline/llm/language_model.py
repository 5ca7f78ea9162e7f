"""Language-model scoring of whole documents.

*Counting.*  Documents are cut into chunks of some megabytes.  A chunk keeps
its distinct words' hashes, sorted, and every token as a number among them.
The hashes travel to blocks of the hash range, where the training counts of
all chunks are added and sent back in each chunk's order: every token of the
table is counted and looked up, a word once per chunk, so a very common word
is no hot key.  Tokens are known by a 64-bit hash; two words with one hash
would share a count (some 10^-7 in all for a million words).

*Events.*  The model tells apart the ``gru.HEAD`` most frequent words (the end
among them) and classes of the rarer ones by shape (length, letters beyond
ASCII, a mark at the end) and by the band of their count; a word of a class
has its share of the class's tokens, a word without count is an event of its
own, as in the base.  So that it knows what unseen words look like, training
sees each token with the count it has without that token (leave one out).

*Training.*  ``gru`` learns from every token of every training document:
``ROUNDS`` rounds in which trainers, one per ``TRAINER_TOKENS`` tokens up to
the session's partitions, start from the same parameters, learn on their share
of the documents (each belongs to one round) and are averaged.  A trainer
holds ``BUFFER_TOKENS`` tokens at a time.  Parameters have a fixed size (about
1 MB); only they and the counts of the head reach the driver.

Defined cases: a null text is empty and has one token, the end; a null doc_id
counts as the empty string in the split; repeated rows and ids are rows of
their own; without training rows every count is 0; an empty table gives no
rows; texts of any length are scored whole; extra columns are ignored.
Scores of given parameters agree but for the last digits.  Training in float32
carries such digits on, so parameters, and ``score`` with them, may differ
between runs (the order of chunks is not fixed); all else is exact.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import partitions, workers_import, written
from .text import BUFFER, buffers, words

CHUNK_BYTES = 8 << 20
BLOCK_ENTRIES = 2_000_000
ROUNDS = 3
TRAINER_TOKENS = 1_000_000
BUFFER_TOKENS = 2 << 20  # tokens that a trainer lays into lanes at a time
PARTS = 16  # pieces in which parameters are averaged
END_WORD = np.uint64(0x454E44)
LENGTHS = (4, 7, 11)  # shape: bytes of a word up to 3, 6, 10, more
MARKS = np.frombuffer(b",.;:!?)", np.uint8)
BANDS = np.array([1, 3, 16, 128])  # least count of a band; band 0 has no count
N_BANDS = len(BANDS) + 1
SHAPES = (len(LENGTHS) + 1) * 4
TAIL = SHAPES * N_BANDS


def _pack(a: np.ndarray) -> bytes:
    """Bytes of equal weight together, which compresses sorted and small
    numbers well."""
    return np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


# --- chunks ------------------------------------------------------------------

def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape) of the tokens of all documents, each with its end, and
    the tokens per document."""
    doc, start, end, h = words(data, offsets)
    n = np.bincount(doc, minlength=len(offsets) - 1) + 1
    beyond = np.zeros(len(data) + 1, np.int32)
    np.cumsum(data >= 128, out=beyond[1:])
    shape = (np.searchsorted(LENGTHS, end - start, "left") * 4 + (beyond[end] > beyond[start]) * 2
             + np.isin(data[end - 1], MARKS)).astype(np.uint8)
    at = np.arange(len(h)) + doc
    hashes = np.full(len(h) + len(n), END_WORD, np.uint64)
    shapes = np.zeros(len(hashes), np.uint8)
    hashes[at], shapes[at] = h, shape
    return hashes, shapes, n


_CHUNKS = pa.schema([("chunk", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                     ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary()), ("words", pa.binary()),
                     ("shapes", pa.binary()), ("counts", pa.binary()), ("entries", pa.int64())])


def chunks(documents: DataFrame, held_out: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Tokenised chunks, written once (their numbers are drawn at random)."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def close(ids, held, pieces) -> pa.RecordBatch:
        hashes, shapes, sizes = (np.concatenate(p) for p in zip(*pieces))
        found, first, tokens = np.unique(hashes, return_index=True, return_inverse=True)
        learned = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(tokens[learned], minlength=len(found)).astype(np.uint32)
        number = int.from_bytes(os.urandom(8), "little", signed=True)
        return _batch([(number, ids, held, sizes.astype(np.int32), _pack(tokens.astype(np.uint32)), _pack(found),
                        shapes[first].tobytes(), _pack(counts), len(found))], _CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, pieces, size = [], [], [], 0
        for batch in batches:
            all_ids, all_held = (batch.column(c).to_pylist() for c in ("doc_id", "held"))
            for first, end, data, offsets in buffers(batch.column("text"), min(BUFFER, chunk_bytes)):
                pieces.append(_tokens(data, offsets))
                ids += all_ids[first:end]
                held += all_held[first:end]
                size += len(data)
                if size >= chunk_bytes:
                    yield close(ids, held, pieces)
                    ids, held, pieces, size = [], [], [], 0
        if ids:
            yield close(ids, held, pieces)

    return written(rows.mapInArrow(run, "chunk long, ids array<long>, held array<boolean>, sizes array<int>, "
                                   "tokens binary, words binary, shapes binary, counts binary, entries long"), "lm-chunks")


# --- counts -------------------------------------------------------------------

def bands(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, counts, "right")


_TOP = pa.list_(pa.struct([("n", pa.int64()), ("word", pa.int64()), ("shape", pa.int64())]))
_COUNTS = pa.schema([("chunk", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("totals", pa.list_(pa.int64())),
                           ("top", _TOP)])


def counted(parts: DataFrame) -> DataFrame:
    """Two kinds of rows: per chunk and block the counts of its words, in
    order (``chunk`` not null); per block its totals (tokens, words, ends,
    then tokens by class with and without leave-one-out) and most frequent
    words."""
    spark = parts.sparkSession
    entries = parts.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    blocks = max(partitions(spark), -(-entries // BLOCK_ENTRIES))
    slices = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("words", pa.binary()), ("shapes", pa.binary()), ("counts", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, raw, shapes, counts in zip(*(batch.column(c).to_pylist() for c in ("chunk", "words", "shapes", "counts"))):
                found, counts = _unpack(raw, np.uint64), _unpack(counts, np.uint32)
                block = ((found >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)
                cuts = np.searchsorted(block, np.arange(blocks + 1))
                rows = [(b, chunk, _pack(found[a:z]), shapes[a:z], _pack(counts[a:z]))
                        for b, (a, z) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if z > a]
                if rows:
                    yield _batch(rows, slices)

    out = _COUNTS

    def add(block: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sizes = [len(r[2]) for r in rows]
        hashes = np.concatenate([_unpack(r[1], np.uint64) for r in rows])
        shapes = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        found, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        count = np.bincount(inverse, np.concatenate([_unpack(r[3], np.uint32) for r in rows]), len(found)).astype(np.int64)
        back = count[inverse]
        ends = np.cumsum(sizes).tolist()
        for row, a, z in zip(rows, [0, *ends], ends):
            yield _batch([(row[0], block, _pack(back[a:z]), None, None)], out)
        shape, rare = shapes[first].astype(np.int64), found != END_WORD
        with_ = np.bincount(shape * N_BANDS + bands(count), count * rare, TAIL)
        without = np.bincount(shape * N_BANDS + bands(count - 1), count * rare, TAIL)
        totals = [count.sum(), (count > 0).sum(), count[~rare].sum(), *with_, *without]
        best = np.flatnonzero(rare & (count > 0))
        best = best[np.argsort(-count[best], kind="stable")[: gru.HEAD - 1]]
        heads = [{"n": int(count[i]), "word": int(found[i].view(np.int64)), "shape": int(shape[i])} for i in best.tolist()]
        yield _batch([(None, block, None, [int(t) for t in totals], heads)], out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now and rows:
                    yield from add(now, rows)
                    rows = []
                now = block
                rows.append(tuple(row))
        if rows:
            yield from add(now, rows)

    sent = parts.select("chunk", "words", "shapes", "counts").mapInArrow(
        deal, "block long, chunk long, words binary, shapes binary, counts binary")
    grouped = sent.repartition(min(blocks, partitions(spark) * 4), "block").sortWithinPartitions("block")
    return written(grouped.mapInArrow(merge, "chunk long, block long, counts binary, totals array<long>, "
                                      "top array<struct<n:long,word:long,shape:long>>"), "lm-counts")


@dataclass
class Vocabulary:
    """What all tasks know of the counts; its size does not grow."""

    tokens: int  # N
    words: int  # V
    head: np.ndarray  # hashes of the frequent words by code (code 0 is the end)
    head_counts: np.ndarray
    mass: np.ndarray  # tokens of the rarer words by class
    unseen: np.ndarray  # the same with leave-one-out

    @classmethod
    def of(cls, counts: DataFrame) -> "Vocabulary":
        """Totals added and frequent words merged per partition, then once
        more: one row of fixed size arrives."""
        schema = pa.schema([("totals", pa.list_(pa.int64())), ("top", _COUNTS.field("top").type)])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals, top = None, []
            for batch in batches:
                for more, words_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    totals = np.array(more) if totals is None else totals + np.array(more)
                    top = sorted(top + words_, key=lambda t: (-t["n"], t["word"]))[: gru.HEAD - 1]
            if totals is not None:
                yield _batch([(totals, top)], schema)

        blocks = counts.filter("chunk IS NULL").select("totals", "top")
        row = blocks.mapInArrow(merge, blocks.schema).repartition(1).mapInArrow(merge, blocks.schema).first()
        totals, top = (np.array(row.totals, np.int64), row.top) if row else (np.zeros(3 + 2 * TAIL, np.int64), [])
        mass, unseen = totals[3: 3 + TAIL].copy(), totals[3 + TAIL:].copy()
        n = np.array([t.n for t in top], np.int64)
        shape = np.array([t["shape"] for t in top], np.int64)
        np.subtract.at(mass, shape * N_BANDS + bands(n), n)
        np.subtract.at(unseen, shape * N_BANDS + bands(n - 1), n)
        head = np.array([int(END_WORD), *[t.word for t in top]], np.int64).view(np.uint64)
        return cls(int(totals[0]), int(totals[1]), head, np.concatenate([totals[2:3], n]), mass, unseen)


# --- coded documents ---------------------------------------------------------

_CODED = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())),
                    ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("rare", pa.list_(pa.float64())),
                    ("codes", pa.binary()), ("falls", pa.binary()), ("learned", pa.int64())])


def coded(parts: DataFrame, counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The chunks with the model's code of every token and, per document, the
    number of known tokens and the sums of log10(count + 1) and of
    log10(share of the class).  ``falls`` has a bit per token: without itself
    its word falls to the band below, which is the code before its own.
    ``learned`` is the number of training tokens."""
    by_hash = np.argsort(vocabulary.head, kind="stable")
    head = vocabulary.head[by_hash]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, held, sizes, tokens, raw, shapes, back in zip(*(c.to_pylist() for c in batch.columns)):
                found, tokens = _unpack(raw, np.uint64), _unpack(tokens, np.uint32)
                count = np.concatenate([_unpack(b["counts"], np.int64) for b in back])
                at = np.minimum(np.searchsorted(head, found), len(head) - 1)
                frequent = head[at] == found
                shape = np.frombuffer(shapes, np.uint8).astype(np.int64)
                rare = shape * N_BANDS + bands(count)
                code = np.where(frequent, by_hash[at], gru.HEAD + rare).astype(np.uint16)
                fall = ~frequent & np.isin(count, BANDS)
                share = np.zeros(len(found))
                some = ~frequent & (count > 0)
                share[some] = np.log10(count[some] / vocabulary.mass[rare[some]])
                sizes = np.array(sizes, np.int64)
                first = np.cumsum(sizes) - sizes
                yield _batch([(ids, held, sizes, np.add.reduceat((count > 0)[tokens].astype(np.int64), first),
                               np.add.reduceat(np.log10(count + 1.0)[tokens], first), np.add.reduceat(share[tokens], first),
                               _pack(code[tokens]), np.packbits(fall[tokens]).tobytes(), sizes[~np.array(held, bool)].sum())], _CODED)

    back = counts.filter("chunk IS NOT NULL").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("block", "counts"))).alias("back"))
    joined = parts.join(back, "chunk").select("ids", "held", "sizes", "tokens", "words", "shapes", "back")
    return written(joined.mapInArrow(run, "ids array<long>, held array<boolean>, sizes array<int>, known array<long>, base array<double>, "
                                     "rare array<double>, codes binary, falls binary, learned long"), "lm-coded")


# --- model ---------------------------------------------------------------------

def averaged(trained: DataFrame, net: gru.Network) -> np.ndarray | None:
    """Mean of the trainers' parameters by their tokens.  Each of ``PARTS``
    pieces is averaged in a stream over its trainers."""
    schema = pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("values", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total, weight, done = None, None, 0, []
        for batch in batches:
            for part, tokens, raw in zip(*(c.to_pylist() for c in batch.columns)):
                values = np.frombuffer(raw, np.float32).astype(np.float64) * tokens
                if part != now:
                    if now is not None:
                        done.append((now, weight, (total / weight).astype(np.float32).tobytes()))
                    now, total, weight = part, values, tokens
                else:
                    total, weight = total + values, weight + tokens
        if now is not None:
            done.append((now, weight, (total / weight).astype(np.float32).tobytes()))
        if done:
            yield _batch(done, schema)

    rows = (trained.repartition(PARTS, "part").sortWithinPartitions("part")
            .mapInArrow(run, "part long, tokens long, values binary").collect())
    if not rows:
        return None
    flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(rows, key=lambda r: r.part)])
    return flat[: net.size]


def texts_of(held: list[bool], sizes: list[int], codes: bytes, falls: bytes, turn: int, rounds: int) -> list[np.ndarray]:
    """Codes of a chunk's training documents of one round, as training sees
    them: with the count that a word has without the token."""
    every = _unpack(codes, np.uint16)
    every = every - np.unpackbits(np.frombuffer(falls, np.uint8), count=len(every))
    ends = np.cumsum(sizes)
    return [every[ends[i] - sizes[i]: ends[i]] for i in range(turn, len(sizes), rounds) if not held[i]]


def fit(codes: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Parameters of the model, learned from all training documents."""
    spark = codes.sparkSession
    net = gru.Network(TAIL).start(vocabulary.head_counts, vocabulary.unseen)
    flat = net.flat()
    tokens = codes.agg(F.coalesce(F.sum("learned"), F.lit(0))).first()[0]
    if not tokens:
        return flat
    trainers = min(partitions(spark), -(-tokens // TRAINER_TOKENS))
    shares = codes.filter("learned > 0").select("held", "sizes", "codes", "falls").coalesce(trainers)
    pieces = pa.schema([("part", pa.int64()), ("tokens", pa.int64()), ("values", pa.binary())])
    for turn in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], flat=flat, turn=turn) -> Iterator[pa.RecordBatch]:
            trainer = gru.Trainer(gru.Network(TAIL).load(flat))
            texts, held_tokens = [], 0
            for batch in batches:
                for chunk in zip(*(c.to_pylist() for c in batch.columns)):
                    for text in texts_of(*chunk, turn, rounds):
                        texts.append(text)
                        held_tokens += len(text)
                        if held_tokens >= BUFFER_TOKENS:
                            trainer.learn(texts)
                            texts, held_tokens = [], 0
            trainer.learn(texts)
            if trainer.tokens:
                values = trainer.net.flat()
                step = -(-len(values) // PARTS)
                yield _batch([(p, trainer.tokens, values[p * step: (p + 1) * step].tobytes()) for p in range(PARTS)], pieces)

        mean = averaged(shares.mapInArrow(run, "part long, tokens long, values binary"), net)
        flat = flat if mean is None else mean
    return flat


def scored(codes: DataFrame, vocabulary: Vocabulary, flat: np.ndarray) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, base_score, score`` per document."""
    out = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("base_score", pa.float64()), ("score", pa.float64())])
    per_token = float(np.log10(vocabulary.tokens + vocabulary.words + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = gru.Network(TAIL).load(flat)
        for batch in batches:
            for ids, held, sizes, known, base, rare, raw in zip(*(c.to_pylist() for c in batch.columns)):
                sizes = np.array(sizes, np.int64)
                model = gru.score(net, _unpack(raw, np.uint16), sizes) / gru.LOG10 + np.array(rare)
                columns = [ids, held, sizes, known, np.array(base) - sizes * per_token, model]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return codes.select("ids", "held", "sizes", "known", "base", "rare", "codes").mapInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")


# --- query ---------------------------------------------------------------

FOLDS, FOLD = 7, 2


def op11_lm_score(documents: DataFrame) -> DataFrame:
    workers_import(documents.sparkSession)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == FOLD
    parts = chunks(documents, held)
    counts = counted(parts)
    vocabulary = Vocabulary.of(counts)
    codes = coded(parts, counts, vocabulary)
    result = scored(codes, vocabulary, fit(codes, vocabulary))
    return result.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
                         "base_score", "score")
