"""Skew-safe ordered computations per key.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task; a
key holding a third of the data would then be processed by one core.  These
helpers split each key by a *monotone bucket* (a slice of the event time):
the row-level window runs per ``(key, bucket)``, and the carry from earlier
buckets comes from one row per key and bucket.  Those rows are bounded by the
time a key spans (a slice of ten minutes: some 50,000 a year), not by its rows,
so their window over the key alone is small whatever the key holds.

A helper reads its input twice, once for the rows and once, with partial
aggregation in every task, for the carries.

The bucket must be a whole number that does not decrease in the ordering
(``slice_of(ts)`` with the order starting with ``ts``).  One bucket of the
hottest key must fit a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeutil import epoch_micros

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}
SLICE_MICROS = 600_000_000  # ten minutes


def slice_of(ts: Column | str) -> Column:
    """The ten-minute slice of a TIMESTAMP_NTZ: a whole number."""
    return F.floor(epoch_micros(ts) / F.lit(SLICE_MICROS))


def _join_carry(src: DataFrame, per_bucket: DataFrame, cols: list[str]) -> DataFrame:
    """Join the per-(key, bucket) carry back.  Key columns must be non-NULL
    (use a sentinel); a plain equi-join lets AQE broadcast the small carry
    table and keeps the big side's (key, bucket) partitioning."""
    return src.join(per_bucket, cols, "inner")


def running_many(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str],
                 specs: Sequence[tuple]) -> DataFrame:
    """Several running aggregates per ``keys`` in ``order`` in ONE pass.

    ``specs``: ``(name, value, agg, inclusive, descending)`` with ``agg`` in
    sum/max/min/last (``last``: the newest value that is not NULL);
    ``descending=True`` aggregates over the following rows.  All row-level
    windows share one exchange on (keys, bucket); the carries come from one
    aggregate, one window over its rows and one join.
    """
    keys = list(keys)
    src = df
    for i, (_, value, _, _, _) in enumerate(specs):
        src = src.withColumn(f"_v{i}", F.col(value) if isinstance(value, str) else value)
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])

    def total(i: int, agg: str, descending: bool) -> Column:
        if agg != "last":
            return _AGG[agg](f"_v{i}")
        newest = F.min_by if descending else F.max_by
        return newest(f"_v{i}", F.when(F.col(f"_v{i}").isNotNull(), place))

    def over(i: int, agg: str, column: str, window) -> Column:
        return (F.last(column, ignorenulls=True) if agg == "last" else _AGG[agg](column)).over(window)

    per_bucket = src.groupBy(*keys, bucket).agg(
        *[total(i, agg, descending).alias(f"_bt{i}") for i, (_, _, agg, _, descending) in enumerate(specs)])
    carries = []
    for i, (_, _, agg, _, descending) in enumerate(specs):
        b_order = F.col(bucket).desc() if descending else F.col(bucket)
        w_b = Window.partitionBy(*keys).orderBy(b_order).rowsBetween(Window.unboundedPreceding, -1)
        carries.append(over(i, agg, f"_bt{i}", w_b).alias(f"_b{i}"))
    per_bucket = per_bucket.select(*keys, bucket, *carries)
    rows = src
    for i, (_, _, agg, inclusive, descending) in enumerate(specs):
        ordering = edge_order_desc(order) if descending else list(order)
        w_in = (Window.partitionBy(*keys, bucket).orderBy(*ordering)
                .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
        rows = rows.withColumn(f"_w{i}", over(i, agg, f"_v{i}", w_in))
    out = _join_carry(rows, per_bucket, [*keys, bucket])
    for i, (name, _, agg, _, _) in enumerate(specs):
        before, within = F.col(f"_b{i}"), F.col(f"_w{i}")
        if agg == "sum":
            combined = F.coalesce(before, F.lit(0)) + F.coalesce(within, F.lit(0))
        elif agg == "last":
            combined = F.coalesce(within, before)
        else:
            combined = F.greatest(before, within) if agg == "max" else F.least(before, within)
        out = out.withColumn(name, combined).drop(f"_v{i}", f"_w{i}", f"_b{i}")
    return out


def running(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str],
            value: Column | str, name: str, agg: str = "sum", inclusive: bool = True,
            descending: bool = False) -> DataFrame:
    """Add ``name`` = running ``agg`` (sum/max/min/last) of ``value`` per ``keys``
    in ``order``; ``inclusive=False`` excludes the current row.
    ``descending=True`` runs from the end (an aggregate over the *following*
    rows).  Key columns must be non-NULL."""
    return running_many(df, keys, bucket, order, [(name, value, agg, inclusive, descending)])


def neighbour(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[Column | str],
              value: Column | str, name: str, direction: str = "prev") -> DataFrame:
    """Add ``name`` = ``value`` of the previous (``prev``) or next (``next``)
    row per ``keys`` in ``order``; NULL at the edge of the key."""
    value = F.col(value) if isinstance(value, str) else value
    keys = list(keys)
    order = list(order)
    src = df.withColumn("_v", value)
    w_in = Window.partitionBy(*keys, bucket).orderBy(*order)
    w_edge = w_in if direction == "prev" else Window.partitionBy(*keys, bucket).orderBy(*edge_order_desc(order))
    rows = (src.withColumn("_nb", (F.lag if direction == "prev" else F.lead)("_v").over(w_in))
            .withColumn("_edge", F.row_number().over(w_edge) == 1))  # first (prev) / last (next) of its bucket
    # Value at the far edge of each bucket: last row (for prev) / first row (for next).
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if direction == "prev" else F.min_by
    per_bucket = src.groupBy(*keys, bucket).agg(pick("_v", place).alias("_bv"))
    w_b = Window.partitionBy(*keys).orderBy(bucket)
    carry = F.lag("_bv").over(w_b) if direction == "prev" else F.lead("_bv").over(w_b)
    out = _join_carry(rows, per_bucket.select(*keys, bucket, carry.alias("_carry")), [*keys, bucket])
    out = out.withColumn(name, F.when(F.col("_edge"), F.col("_carry")).otherwise(F.col("_nb")))
    return out.drop("_v", "_nb", "_edge", "_carry")


def as_of(events: DataFrame, facts: DataFrame, keys: Sequence[str], value: str, name: str,
          ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """Add ``name`` = ``value`` of the newest row of ``facts`` of the same
    ``keys`` at or before each event (ties in ``ts`` go to the larger
    ``ident``); NULL without one.  Facts and events are one ordered stream per
    key with a running newest value, so a hot key is split like any other and
    no event is paired with more than one fact."""
    keys = list(keys)
    columns = events.columns
    stream = events.withColumn("_late", F.lit(1)).unionByName(
        facts.select(*keys, ts, ident, F.struct(F.col(value).alias("v")).alias("_fact"), F.lit(0).alias("_late")), allowMissingColumns=True)
    stream = stream.withColumn("_slice", slice_of(ts))
    found = running(stream, keys, "_slice", [ts, "_late", ident], "_fact", "_newest", agg="last")
    return found.filter("_late = 1").select(*columns, F.col("_newest.v").alias(name))


def edge_order_desc(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order]
