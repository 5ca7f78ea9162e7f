"""N-gram Jaccard join by a blocked sparse matrix product.

The incidence matrix has a row per distinct shingle set ("class": documents
with equal sets share it) and a column per 5-word shingle.  Its product with
its transpose holds the overlap of every two classes; two classes link when
``100 * overlap >= 75 * union``.  The product is never formed whole:

1. Columns are dealt to hash blocks.  A block drops its columns with a single
   class (they add to no overlap) and counts the others.
2. A class of n shingles needs an overlap of at least 0.75 n with a partner;
   one with fewer shared columns is discarded.  Of the m shared ones, ordered
   from the rarest on, any partner must share one of the first
   ``m - ceil(0.75 n) + 1`` ("prefix").
3. For every prefix column, all its classes are multiplied with one pivot.
   Links found this way join classes to components.
4. A column whose classes are not all in one component is open.  Its
   remaining products, between classes of different components, are taken
   pair by pair where the column is light and in row block x row block
   products where it is heavy; a block product returns a spanning forest of
   its links, so a group of near copies of any size adds rows in proportion
   to the group only.

Every pair of classes that could link meets in step 3 or 4 unless it is
already in one component, so no link between components is lost.  Shingles
are identified by 64-bit hashes, of which a block keeps 48 bits beside its
own number.

Defined cases: a null or blank text has the empty set and is linked with
nothing; a text with fewer than five words is one shingle of all its words;
equal sets link with each other; repeated rows are documents of their own; a
null id never becomes a component's label if another id is in it; an empty
table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, partitions, written
from .text import buffers, mix, words

SHINGLE = 5
PERCENT = 75
LIGHT = 32  # classes of a column up to which its open products are taken pair by pair
BLOCK_ENTRIES = 1 << 16  # matrix entries of one row block

_MUL = np.uint64(0x9E3779B97F4A7C15)
_FACT, _COLUMN, _ROW = 0, 1, 2


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of the distinct shingles of each document."""
    doc, _, _, h = words(data, offsets)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    n = len(h)
    whole = np.flatnonzero(doc[: max(0, n - SHINGLE + 1)] == doc[SHINGLE - 1:]) if n >= SHINGLE else np.zeros(0, np.int64)
    value = np.full(len(whole), SHINGLE, np.uint64)
    for k in range(SHINGLE):
        value = mix(value * _MUL + h[whole + k])
    docs = [doc[whole]]
    values = [value]
    first = np.cumsum(count) - count
    for size in range(1, SHINGLE):
        short = np.flatnonzero(count == size)
        value = np.full(len(short), size, np.uint64)
        for k in range(size):
            value = mix(value * _MUL + h[first[short] + k])
        docs.append(short)
        values.append(value)
    doc, value = np.concatenate(docs), np.concatenate(values)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _low48(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from48(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


# Rows that travel between the steps.  FACT: a document's id, class and set
# size.  COLUMN: a part of a column block (classes, their set sizes and entry
# counts, entries).  ROW: a part of a row block (the same plus frequencies).
_WIRE = "kind int, part int, block int, id long, class long, n long, classes binary, sizes binary, counts binary, entries binary, freqs binary"
_WIRE_NAMES = [c.split()[0] for c in _WIRE.split(", ")]
_ARROW = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("id", pa.int64()),
                    ("class", pa.int64()), ("n", pa.int64())] + [(n, pa.binary()) for n in _WIRE_NAMES[6:]])


def _wire(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def _to_columns(blocks: int):
    """Documents -> facts and parts of column blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, end, data, offsets in buffers(batch.column(1), 1 << 21):
                doc, value = shingle_sets(data, offsets)
                n = np.bincount(doc, minlength=end - first)
                has = np.flatnonzero(n)
                starts = (np.cumsum(n) - n)[has]
                name = np.zeros(end - first, np.uint64)
                if len(has):
                    name[has] = mix(np.add.reduceat(mix(value ^ _MUL), starts) + n[has].astype(np.uint64))
                name = name.view(np.int64)
                size = end - first
                part = (name.view(np.uint64) % np.uint64(blocks)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size, _FACT, np.int32)), pa.array(part), pa.array(np.zeros(size, np.int32)),
                     ids.slice(first, size), pa.array(name), pa.array(n.astype(np.int64)),
                     *[pa.nulls(size, pa.binary())] * 5], schema=_ARROW)
                block = ((value >> np.uint64(40)) % np.uint64(blocks)).astype(np.int32)
                order = np.argsort(block, kind="stable")
                block, doc, value = block[order], doc[order], value[order]
                cut = np.append(_runs(block), len(block))
                run_at = _runs(block, doc)
                run_len = np.diff(np.append(run_at, len(block)))
                run_cut = np.searchsorted(run_at, cut)
                rows = []
                for i in range(len(cut) - 1):
                    a, b = cut[i], cut[i + 1]
                    heads = run_at[run_cut[i]: run_cut[i + 1]]
                    rows.append({"kind": _COLUMN, "part": int(block[a]), "block": int(block[a]),
                                 "classes": name[doc[heads]].tobytes(), "sizes": n[doc[heads]].astype(np.uint32).tobytes(),
                                 "counts": run_len[run_cut[i]: run_cut[i + 1]].astype(np.uint32).tobytes(),
                                 "entries": _low48(value[a:b])})
                if rows:
                    yield _wire(rows)

    return run


def _blobs(rows: list[dict], name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(r[name] for r in rows), dtype)


def _shared_columns(parts: int):
    """Column blocks -> parts of row blocks with the shared columns only."""

    def solve(block: int, rows: list[dict]) -> pa.RecordBatch | None:
        times = _blobs(rows, "counts", np.uint32)
        name = np.repeat(_blobs(rows, "classes", np.int64), times)
        size = np.repeat(_blobs(rows, "sizes", np.uint32), times)
        value = _from48(b"".join(r["entries"] for r in rows))
        order = np.argsort(value, kind="stable")
        value = value[order]
        at = _runs(value)
        several = np.repeat(np.diff(np.append(at, len(value))) > 1, np.diff(np.append(at, len(value))))
        value, name, size = value[several], name[order][several], size[order][several]
        order = np.lexsort((name, value))
        value, name, size = value[order], name[order], size[order]
        at = _runs(value, name)  # equal sets give the same entry again
        value, name, size = value[at], name[at], size[at]
        at = _runs(value)
        freq = np.diff(np.append(at, len(value)))
        shared = np.repeat(freq > 1, freq)
        freq = np.repeat(freq, freq)[shared]
        value, name, size = value[shared], name[shared], size[shared]
        if not len(value):
            return None
        part = (name.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((name, part))
        value, name, size, freq, part = value[order], name[order], size[order], freq[order], part[order]
        cut = np.append(_runs(part), len(part))
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            heads = a + _runs(name[a:b])
            out.append({"kind": _ROW, "part": int(part[a]), "block": block, "classes": name[heads].tobytes(),
                        "sizes": size[heads].tobytes(), "counts": np.diff(np.append(heads, b)).astype(np.uint32).tobytes(),
                        "entries": _low48(value[a:b]), "freqs": np.minimum(freq[a:b], 65535).astype(np.uint16).tobytes()})
        return _wire(out)

    return _by_key("block", _COLUMN, solve)


def _by_key(key: str, kind: int, solve):
    """Run ``solve(key, rows)`` for each key of a partition sorted by (kind,
    key); rows of other kinds pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for i in _runs(kinds):
                piece = batch.slice(i)
                same = kinds[i:] == kinds[i]
                piece = piece.slice(0, len(same) if same.all() else int(np.argmin(same)))
                if kinds[i] != kind:
                    yield piece
                    continue
                for row in piece.to_pylist():
                    if row[key] != current and rows:
                        out = solve(current, rows)
                        rows = []
                        if out is not None:
                            yield out
                    current = row[key]
                    rows.append(row)
        if rows and (out := solve(current, rows)) is not None:
            yield out

    return run


def _matrix_rows(percent: int):
    """Parts of row blocks -> one row per class that can still have a partner:
    its shared columns from the rarest on, and the length of the prefix."""

    def solve(part: int, rows: list[dict]) -> pa.RecordBatch | None:
        times = _blobs(rows, "counts", np.uint32)
        name = np.repeat(_blobs(rows, "classes", np.int64), times)
        size = np.repeat(_blobs(rows, "sizes", np.uint32), times).astype(np.int64)
        value = np.concatenate([_from48(r["entries"]) | (np.uint64(r["block"]) << np.uint64(48)) for r in rows])
        freq = _blobs(rows, "freqs", np.uint16)
        order = np.lexsort((value, freq, name))
        name, size, value = name[order], size[order], value[order]
        at = np.append(_runs(name), len(name))
        shared = np.diff(at)
        n = size[at[:-1]]
        need = -(-percent * n // 100)
        alive = np.flatnonzero(shared >= need)
        if not len(alive):
            return None
        return _wire([{"kind": _ROW, "part": part, "block": int(shared[i] - need[i] + 1), "class": int(name[at[i]]),
                       "n": int(n[i]), "entries": value[at[i]: at[i + 1]].tobytes()} for i in alive])

    return _by_key("part", _ROW, solve)


def _overlap(a: bytes, b: np.ndarray) -> int:
    return len(np.intersect1d(np.frombuffer(a, np.uint64), b, assume_unique=True))


def _links(overlap: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * overlap >= percent * (n + m - overlap)


def _test_pairs(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that link.  Rows of ``a`` travel once to their
    pairs, then to the rows of ``b``."""
    left = rows.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("entries").alias("e_a"))
    right = rows.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("entries").alias("e_b"))
    fits = (F.col("n_a") * 100 >= F.col("n_b") * percent) & (F.col("n_b") * 100 >= F.col("n_a") * percent)
    sized = pairs.join(left.drop("e_a"), "a").join(right.drop("e_b"), "b").filter(fits).select("a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last, sets = None, None
            n_a, n_b = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            b, e_a, e_b = batch.column("b").to_numpy(), batch.column("e_a"), batch.column("e_b")
            for i in range(batch.num_rows):
                if b[i] != last:
                    last, sets = b[i], np.frombuffer(e_b[i].as_py(), np.uint64)
                keep[i] = _links(_overlap(e_a[i].as_py(), sets), n_a[i], n_b[i], percent)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return sized.join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def _block_links(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Spanning forest of the links between the two row blocks of a group
    (or inside its only block), started from the components already known."""
    group = group.sort_values("class")
    names, n = group["class"].to_numpy(), group["n"].to_numpy()
    values = [np.frombuffer(e, np.uint64) for e in group["entries"]]
    row = np.repeat(np.arange(len(values)), [len(v) for v in values])
    _, column = np.unique(np.concatenate(values), return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    overlap = np.zeros((len(values), len(values)), np.float32)
    columns = int(column[-1]) + 1
    for low in range(0, columns, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        dense = np.zeros((len(values), min(4096, columns - low)), np.float32)
        dense[row[a:b], column[a:b] - low] = 1
        overlap += dense @ dense.T
    label = pd.factorize(group["label"])[0]
    block = group["block"].to_numpy()
    both = group["first"].iloc[0] != group["second"].iloc[0]
    found = []
    for i in range(len(values)):
        linked = _links(overlap[i].astype(np.int64), n[i], n, percent) & (label != label[i])
        if both:
            linked &= block != block[i]
        while linked.any():
            j = int(np.argmax(linked))
            found.append((names[i], names[j]))
            label[label == label[j]] = label[i]
            linked &= label != label[i]
    return pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _heavy_links(heavy: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Links between components inside heavy columns, by block products."""

    def block_links(group: pd.DataFrame) -> pd.DataFrame:
        return _block_links(group, percent)

    member = heavy.groupBy("class").agg(F.min("pivot").alias("near"), F.first("label").alias("label"))
    member = member.join(rows.select("class", "n", "entries"), "class")
    blocks = (member.groupBy("near").agg((F.sum(F.length("entries")) / (8 * BLOCK_ENTRIES)).alias("size"))
              .select("near", F.greatest(F.lit(1), F.ceil("size")).alias("many")))
    placed = (member.join(blocks, "near")
              .withColumn("block", F.xxhash64("near", F.pmod(F.xxhash64("class"), F.col("many")))).drop("near", "many"))
    placed = written(placed, "ngram-blocks")
    used = heavy.join(placed.select("class", "block"), "class").groupBy("column", "block").agg(
        F.min("label").alias("low"), F.max("label").alias("high"))
    other = used.select("column", F.col("block").alias("second"), F.col("low").alias("low2"), F.col("high").alias("high2"))
    products = (used.withColumnRenamed("block", "first").join(other, "column")
                .filter(F.expr("first <= second AND least(low, low2) != greatest(high, high2)"))
                .select("first", "second").distinct())
    ends = products.select("first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    return ends.join(placed, "block").groupBy("first", "second").applyInPandas(block_links, "a long, b long")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """``id, class, n_shingles, component_id`` of every row of ``docs``
    (``id_col`` an integer, ``text``).  ``component_id`` is the smallest id
    that links reach; ``class`` names the row's shingle set (0: empty)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col("text").cast("binary"))
    wire = (source.mapInArrow(_to_columns(parts), _WIRE)
            .repartitionById(parts, "part").sortWithinPartitions("kind", "block")
            .mapInArrow(_shared_columns(parts), _WIRE)
            .repartitionById(parts, "part").sortWithinPartitions("kind", "part")
            .mapInArrow(_matrix_rows(percent), _WIRE)
            .select("kind", "id", "class", "n", F.col("block").alias("prefix"), "entries"))
    wire = written(wire, "ngram-matrix")
    facts = wire.filter(F.col("kind") == _FACT).select("id", "class", "n")
    rows = wire.filter(F.col("kind") == _ROW).select("class", "n", "prefix", "entries")

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.column("prefix").to_numpy()
            values = [np.frombuffer(e.as_py(), np.int64)[:p] for e, p in zip(batch.column("entries"), count)]
            if values:
                share = np.array([len(e) // 8 for e in batch.column("entries").to_pylist()]) / batch.column("n").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(values)), pa.array(np.repeat(batch.column("class").to_numpy(), count)),
                     pa.array(np.repeat(share, count))], names=["column", "class", "share"])

    # The pivot of a column is the class with the largest shared part: of a
    # text and its variants, that is the text.
    prefix = written(rows.mapInArrow(prefixes, "column long, class long, share double"), "ngram-prefix")
    pivots = (prefix.groupBy("column").agg(F.max_by("class", F.struct("share", "class")).alias("pivot"),
                                           F.count(F.lit(1)).alias("many")).filter("many > 1"))
    member = written(prefix.select("column", "class").join(pivots, "column"), "ngram-member")
    stars = (member.filter("class != pivot")
             .select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct())
    links = written(_test_pairs(stars, rows, percent), "ngram-links")
    labels = connected_components(links, "ngram-cc")
    labelled = (member.join(labels.withColumnRenamed("node", "class"), "class", "left")
                .withColumn("label", F.coalesce("label", "class")))
    state = labelled.groupBy("column").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    still = written(labelled.join(state.filter("low != high AND low IS NOT NULL").select("column"), "column"), "ngram-open")
    light = still.filter(F.col("many") <= LIGHT).filter("class != pivot").select("column", "class", "label")
    other = light.select("column", F.col("class").alias("b"), F.col("label").alias("label_b"))
    pairs = (light.withColumnRenamed("class", "a").join(other, "column")
             .filter("a < b AND label != label_b").select("a", "b").distinct())
    more = _test_pairs(pairs, rows, percent).unionByName(
        _heavy_links(still.filter(F.col("many") > LIGHT), rows, percent))
    final = connected_components(links.unionByName(written(more, "ngram-links2")), "ngram-cc2")
    named = (facts.filter("n > 0").groupBy("class").agg(F.min("id").alias("least"))
             .join(final.withColumnRenamed("node", "class"), "class", "left")
             .withColumn("label", F.coalesce("label", "class")))
    smallest = named.groupBy("label").agg(F.min("least").alias("component_id"))
    components = named.select("class", "label").join(smallest, "label").select("class", "component_id")
    return (facts.join(components, "class", "left")
            .select("id", "class", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")))


def keep_one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each group of linked
    documents the one with the smallest content key stays; documents with
    the empty set all stay.  Repeated rows of a group leave one row."""
    names = docs.columns
    keyed = docs.select(F.xxhash64(*names).alias("key"), F.struct("*").alias("row"))
    found = jaccard_components(docs.select(F.xxhash64(*names).alias("key"), "text"), "key", percent)
    found = written(found, "ngram-found")
    keep = (found.filter("n_shingles = 0 OR id = component_id")
            .groupBy(F.col("id").alias("key")).agg((F.max("n_shingles") > 0).alias("once")))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.lit(0)))
    return (keyed.join(keep, "key").withColumn("place", place)
            .filter("NOT once OR place = 1").select("row.*"))


# --- query ---------------------------------------------------------------

def op4_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
