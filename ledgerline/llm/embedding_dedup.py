"""Near-duplicate vectors by sorted projection passes.

Per pass every vector gets a key of concatenated random hashes (signs of
random projections).  Vectors of one label are ordered by the key, and each is
compared with the next ``window`` ones; pairs whose cosine reaches the
threshold are links.  The passes draw other projections; their links are
united.  The order is cut into ranges of the key, and each range also gets the
first ``window`` vectors that follow it, so neighbours never fall apart and a
hot label is spread over many tasks.

Places in the order are counted per 4,096th of the key space, so vectors that
agree in the first 12 bits of a pass are ranked in one task.

Neighbours of a pair at the threshold share about ``log2(n / window)`` leading
bits in a label of ``n`` vectors, so one pass finds it with a chance of about
``(window / n) ** rho``, where ``2 ** -rho`` is the chance that the two agree
in one bit.  Labels too large for ``passes`` passes get as many as leave a
pair at the threshold apart with a chance of at most ``1 - RECALL``.

A window is bounded, so inside a component with more members than a window
holds not every pair was compared.  The exact way for those: the members of
each such component are compared in row blocks, which completes the links
(every found component, whatever its size).

Equal vectors of a label count as one *group* in all of this: one of its rows
stands for it, so copies fill no window and no block, and a group's links weigh
as many rows as the other group has.  Groups are told apart by a 128-bit digest
of the components.  Every row then takes over its group's result.

Only rows with equal, non-null labels are compared.  Cosines are computed in
double precision from the stored values.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing and is its own component, and so is a vector of
another dimension than its neighbour's in the pair; a null label links with
nothing; repeated rows are vectors of their own (equal vectors have cosine 1);
a null id takes part but never names a component that has another id; an
empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, written

COSINE = 0.93
PASSES = 8  # at least
RECALL = 0.95  # chance that the passes find a lone pair at the threshold
WINDOW = 24
BITS = 60
RANGE = 512  # vectors of a key range
BLOCK = 256  # members of a row block when a large component is completed
COPIES = 4096  # rows of a group of equal vectors that take over its result in one task
SEED = 20240901


def _unit(vectors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, usable); all of one dimension."""
    matrix = np.stack(vectors).astype(np.float64)
    with np.errstate(invalid="ignore", over="ignore"):
        scale = np.abs(matrix).max(axis=1, keepdims=True)
        scaled = matrix / np.where((scale > 0) & np.isfinite(scale), scale, 1)
        norm = np.sqrt((scaled ** 2).sum(axis=1))
        return scaled / np.where(norm > 0, norm, 1)[:, None], norm > 0


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that can link, with ``dim``: ``key, label, vec (array<double>)``."""
    finite = F.expr("forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))")
    return (vectors.filter("vec IS NOT NULL AND size(vec) > 0 AND label IS NOT NULL")
            .filter(finite & F.expr("exists(vec, x -> x != 0)"))
            .withColumn("dim", F.size("vec")))


def _rho(cosine: float) -> float:
    """Bits of agreement that one bit of the code costs a pair at ``cosine``."""
    return float(-np.log2(1 - np.arccos(np.clip(cosine, 0.0, 1.0)) / np.pi))


def passes_needed(sizes: DataFrame, cosine: float, passes: int, window: int) -> DataFrame:
    """``sizes(label, dim, n)`` -> ``label, dim, passes`` of the labels that
    need more than ``passes``: at most one per ``enough`` vectors."""
    rho = _rho(cosine)
    enough = window * (1 - (1 - RECALL) ** (1 / passes)) ** (-1 / rho) if rho > 0 else float("inf")
    chance = F.pow(F.lit(float(window)) / F.col("n"), F.lit(rho))
    need = F.ceil(F.lit(float(np.log(1 - RECALL))) / F.log1p(-chance)).cast("int")
    return sizes.filter(F.col("n") > F.lit(max(enough, window))).select("label", "dim", F.greatest(need, F.lit(passes)).alias("passes"))


def _hashes(bits: int, seed: int):
    """key, label, dim, passes, vec -> one row per pass with the concatenated
    bits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                unit, _ = _unit(part["vec"].to_list())
                label, key, passes = part["label"].to_numpy(), part["key"].to_numpy(), part["passes"].to_numpy()
                for k in range(int(passes.max())):
                    if (k, dim) not in planes:
                        planes[k, dim] = np.random.default_rng([seed, int(dim), k]).standard_normal((int(dim), bits))
                    at = np.flatnonzero(passes > k)
                    yield pd.DataFrame({"pass": np.int32(k), "label": label[at], "dim": np.int32(dim),
                                        "code": (unit[at] @ planes[k, dim] > 0) @ weight, "key": key[at]})

    return run


def _window_links(cosine: float, window: int):
    """Group of one range: vectors in order of the code -> verified pairs."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["code", "key"])
        key, own = group["key"].to_numpy(), group["own"].to_numpy()
        unit, _ = _unit(group["vec"].to_list())
        found = []
        for step in range(1, min(window, len(group) - 1) + 1):
            near = np.einsum("ij,ij->i", unit[:-step], unit[step:]) >= cosine
            at = np.flatnonzero(near & own[:-step])
            found.append(np.stack([key[at], key[at + step]], axis=1))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)}).astype("int64")

    return run


def _block_counts(cosine: float):
    """Two blocks of a component's groups (or one with itself) -> for each
    group the number of rows that it links to between them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        unit, _ = _unit(group["vec"].to_list())
        key, block, rows = group["key"].to_numpy(), group["block"].to_numpy(), group["n"].to_numpy()
        first, second = group["first"].iloc[0], group["second"].iloc[0]
        a, b = np.flatnonzero(block == first), np.flatnonzero(block == second)
        linked = unit[a] @ unit[b].T >= cosine
        if first == second:
            np.fill_diagonal(linked, False)
            return pd.DataFrame({"key": key[a], "n": linked @ rows[a]})
        return pd.DataFrame({"key": np.concatenate([key[a], key[b]]),
                             "n": np.concatenate([linked @ rows[b], linked.T @ rows[a]])})

    return run


def window_links(usable_rows: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW,
                 bits: int = BITS, seed: int = SEED) -> DataFrame:
    """Verified pairs ``(a, b)`` of keys, each once.  ``passes`` is the least
    number of passes."""
    sizes = usable_rows.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    large = F.broadcast(passes_needed(sizes, cosine, passes, window))  # one row per some thousand vectors at most
    codes = usable_rows.join(large, ["label", "dim"], "left").select(
        "key", "label", "dim", F.coalesce("passes", F.lit(passes)).alias("passes"), "vec").mapInPandas(
        _hashes(bits, seed), f"pass int, label {usable_rows.schema['label'].dataType.simpleString()}, dim int, code long, key long")
    codes = written(codes, "vectors-codes")
    group = ["pass", "label", "dim"]
    # Ranges of about RANGE vectors: the codes are random bits, so their
    # leading bits deal a label out evenly unless vectors are equal or near;
    # ranks within the leading bits give exact places at any density.
    lead = F.shiftright("code", bits - 12)
    cells = codes.groupBy(*group, lead.alias("lead")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(*group).orderBy("lead").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.select(*group, "lead", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group, "lead").orderBy("code", "key")
    placed = (codes.withColumn("lead", lead).withColumn("place", F.row_number().over(inside))
              .join(before, [*group, "lead"])
              .withColumn("place", F.col("before") + F.col("place") - 1)
              .select(*group, "code", "key", "place"))
    home = F.floor(F.col("place") / RANGE)
    tail = F.floor((F.col("place") - window) / RANGE)  # also the end of the range before
    ranges = F.when((tail >= 0) & (tail < home), F.array(home, tail)).otherwise(F.array(home))
    dealt = (placed.withColumn("home", home).withColumn("range", F.explode(ranges))
             .withColumn("own", F.col("range") == F.col("home")).drop("home", "place"))
    with_vectors = dealt.join(usable_rows.select("key", "vec"), "key")
    return (with_vectors.groupBy(*group, "range").applyInPandas(_window_links(cosine, window), "a long, b long")
            .distinct())


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW) -> DataFrame:
    """``vec_id, embedding, label`` -> per row ``vec_id, n_links,
    component_id, kept``."""
    rows = vectors.select(F.monotonically_increasing_id().alias("key"), F.col("vec_id").cast("long").alias("vec_id"),
                          "label", F.col("embedding").cast("array<double>").alias("vec"))
    rows = written(rows, "vectors")
    good = usable(rows).withColumn("digest", F.unhex(F.md5(F.concat_ws(",", F.col("vec").cast("array<string>")).cast("binary"))))
    # Groups of equal vectors; the row with the least key stands for one.
    groups = written(good.groupBy("label", "dim", "digest").agg(
        F.min("key").alias("key"), F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")), "vectors-groups")
    lone = written(groups.select("key", "n").join(good.select("key", "label", "dim", "vec"), "key"), "vectors-lone")
    links = written(window_links(lone, cosine, passes, window), "vectors-links")
    labels = connected_components(links, "vectors-cc")
    members = labels.select(F.col("node").alias("key"), F.col("label").alias("component"))
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("many"))
    # Blocks of every component; pairs of blocks are dealt out as rows.
    blocks = (members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("key"), F.col("many")).cast("int")))
    pairs = (sizes.select("component", F.explode(F.sequence(F.lit(0), (F.col("many") - 1).cast("int"))).alias("first"), "many")
             .select("component", "first", F.explode(F.sequence("first", (F.col("many") - 1).cast("int"))).alias("second")))
    ends = pairs.select("component", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))
    counted = (blocks.select("component", "block", "key").join(lone.select("key", "n", "vec"), "key")
               .join(ends, ["component", "block"])
               .groupBy("component", "first", "second").applyInPandas(_block_counts(cosine), "key long, n long")
               .groupBy("key").agg(F.sum("n").alias("others")))
    least = members.join(groups.select("key", "least"), "key").groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(least, "component").join(counted, "key").select("key", "component_id", "others")
    found = (groups.join(linked, "key", "left").filter("n > 1 OR others IS NOT NULL")
             .select("label", "dim", "digest", "n", F.coalesce("component_id", "least").alias("component_id"),
                     (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    # Rows take over their group's result; large groups (at most one per
    # COPIES rows) are dealt over several tasks.
    parts = F.ceil(F.col("n") / COPIES).cast("int")
    on = ["label", "dim", "digest"]
    large = F.broadcast(groups.filter(F.col("n") > COPIES).select(*on, parts.alias("parts")))
    copies = found.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    taken = (good.select("key", *on).join(large, on, "left")
             .withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int"))
             .join(copies, [*on, "part"]).select("key", "component_id", "n_links"))
    component = F.coalesce("component_id", "vec_id")
    return (rows.join(taken, "key", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))


# --- query ---------------------------------------------------------------

def op8_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return near_duplicates(vectors)
