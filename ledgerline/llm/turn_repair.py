"""Repair of conversation structure by target alignment.

Every row of a conversation has a symbol: the initial of its role, whether its
text is truncated, or that it must go (blank, duplicate).  The cheapest edits
(Keep 0, Rerole to user/assistant 3, Delete 4, Insert 3, and 3 for each
truncated row that stays) that give role initials ``(s?(ua)+)?`` are found by
Wagner-Fischer alignment of the symbols with the grammar's string of each
feasible length.  Strings of all lengths share their suffix, so with columns
counted from the end one matrix per ending serves every length.  A greedy
repair gives the incumbent cost, which bounds the lengths and the band of
columns that can matter (Ukkonen).  The lengths of least cost are backtraced,
smallest edit first (D < I < K < R), and their audits compared.

*Long conversations.*  Rows are cut into slices of ``SLICE`` places.  A slice
is aligned for every grammar state before and after it; inserts stand before a
row, so an audit ends with the edit of the slice's last row and two audits of a
slice differ before either ends.  A chain over the slices of a conversation
(one short row of costs a slice) then picks one alignment per slice.

Defined cases: null roles and texts are one space (a blank text, a role that
fits nowhere), a null turn comes first and is one space in the damage's key; a
null conv_id is a conversation of its own; ties in turn are ordered by role and
text; an empty role has no initial; repeated rows are duplicates; an empty table
gives no rows; texts of any length; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, salted_rank, workers_import, written
from .sqltext import crc32

SLICE = 256  # places aligned together
TURNS_PER_BUCKET = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

# States of the grammar between two turns, and what closing costs there.
START, SYSTEM, USER, ASSISTANT = range(4)  # nothing yet; after s; a user turn is next; an assistant turn is next
CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (0, ""), ASSISTANT: (INSERT, "I")}
_FAR = 1 << 30


# --- alignment of one slice ------------------------------------------------

class _Matrix:
    """Wagner-Fischer costs of the rows ``i..`` of ``symbols`` against the
    last ``k`` turns of an alternating string that leaves the grammar in
    ``after``: ``rows[i][k - low[i]]``.  Costs are above the least that forced
    deletes and truncated rows cost anyway."""

    def __init__(self, symbols: str, after: int, limit: int):
        n = len(symbols)
        self.symbols, self.after = symbols, after
        free = np.array([c != "x" for c in symbols], np.int64)
        left = np.concatenate([np.cumsum(free[::-1])[::-1], [0]])  # rows that may stay, from i on
        self.low = np.maximum(left - limit, 0)
        high = left + limit // INSERT
        self.rows = [np.full(1, 0)] * (n + 1)
        self.rows[n] = np.where(np.arange(self.low[n], high[n] + 1) == 0, 0, _FAR)
        for i in range(n - 1, -1, -1):
            below, lo, hi = self.rows[i + 1], int(self.low[i]), int(high[i])
            ks = np.arange(lo, hi + 1)
            best = self._take(below, self.low[i + 1], ks) + self.delete(symbols[i])
            if symbols[i] != "x":
                put = np.where(self.next_is(ks, symbols[i].lower()), 0, REROLE)
                best = np.minimum(best, self._take(below, self.low[i + 1], ks - 1) + put)
            ramp = INSERT * ks
            self.rows[i] = np.minimum(np.minimum.accumulate(best - ramp) + ramp, _FAR)

    @staticmethod
    def _take(row: np.ndarray, low: int, ks: np.ndarray) -> np.ndarray:
        at = ks - low
        inside = (at >= 0) & (at < len(row))
        return np.where(inside, row[np.clip(at, 0, len(row) - 1)], _FAR)

    def turn(self, k: int) -> str:
        """Initial of the turn with ``k`` turns left, itself included."""
        return "a" if (k % 2 == 1) == (self.after == USER) else "u"

    def next_is(self, ks: np.ndarray, initial: str) -> np.ndarray:
        if initial not in "ua":
            return np.zeros(len(ks), bool)
        return ((ks % 2 == 1) == (self.after == USER)) == (initial == "a")

    @staticmethod
    def delete(symbol: str) -> int:
        """A truncated row that goes saves its 3."""
        return 0 if symbol == "x" else DELETE - TRUNCATED if symbol.isupper() else DELETE

    def cost(self, i: int, k: int) -> int:
        at = k - int(self.low[i])
        return int(self.rows[i][at]) if 0 <= at < len(self.rows[i]) else _FAR

    def cheapest(self, i: int, first: str, empty: bool) -> tuple[int, list[int]]:
        """Least cost from row ``i`` and the lengths that have it, of strings
        that begin with ``first`` (or are ``empty``)."""
        ks = np.arange(len(self.rows[i])) + self.low[i]
        fits = np.where(ks > 0, self.next_is(ks, first), empty)
        costs = np.where(fits, self.rows[i], _FAR)
        least = int(costs.min()) if len(costs) else _FAR
        return least, ks[costs == least].tolist() if least < _FAR else []

    def audit(self, i: int, k: int) -> str:
        """Least audit among the cheapest alignments from (i, k)."""
        out = []
        while i < len(self.symbols):
            c, here = self.symbols[i], self.cost(i, k)
            if self.cost(i + 1, k) + self.delete(c) == here:
                out.append("D")
                i += 1
            elif k and self.cost(i, k - 1) + INSERT == here:
                out.append("I")
                k -= 1
            else:
                out.append("K" if c.lower() == self.turn(k) else "R")
                i, k = i + 1, k - 1
        return "".join(out)


def _greedy(symbols: str, first: str) -> int:
    """Cost of a plain repair: every row that may stay stays, reroled if its
    turn is another's; one insert more lets it end at either turn."""
    cost, want = 0, first
    for c in symbols:
        if c != "x":
            cost += REROLE * (c.lower() != want)
            want = "a" if want == "u" else "u"
    return cost


@lru_cache(maxsize=8192)
def align(symbols: str) -> tuple[tuple[int, int, int, str], ...]:
    """(state before, state after, cost, audit) of the cheapest alignments of a
    slice, for all pairs of states that some alignment joins."""
    n = len(symbols)
    base = DELETE * symbols.count("x") + TRUNCATED * sum(c.isupper() for c in symbols)
    gone = np.concatenate([[0], np.cumsum([_Matrix.delete(c) for c in symbols])]).tolist()
    out: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, audit: str) -> None:
        made = (base + cost, audit)
        if (before, after) not in out or made < out[before, after]:
            out[before, after] = made

    for state in (START, SYSTEM):  # a string without a turn of this slice
        offer(state, state, gone[n], "D" * n)
    opens = [i for i, c in enumerate(symbols) if c in "sS"]  # a kept system turn opens the string: rows before it go
    for i in opens:
        offer(START, SYSTEM, gone[n] - _Matrix.delete(symbols[i]), "D" * i + "K" + "D" * (n - i - 1))
    limit = max(_greedy(symbols, "u"), _greedy(symbols, "a")) + REROLE + INSERT
    for after in (USER, ASSISTANT):
        matrix = _Matrix(symbols, after, limit)
        for before in (START, SYSTEM, USER, ASSISTANT):
            least, lengths = matrix.cheapest(0, "a" if before == ASSISTANT else "u", before == after)
            for k in lengths:
                offer(before, after, least, matrix.audit(0, k))
        for i in opens:
            least, lengths = matrix.cheapest(i + 1, "u", False)
            if lengths and ((START, after) not in out or base + gone[i] + least <= out[START, after][0]):
                for k in lengths:
                    offer(START, after, gone[i] + least, "D" * i + "K" + matrix.audit(i + 1, k))
    return tuple((b, a, cost, audit) for (b, a), (cost, audit) in sorted(out.items()))


def choose(slices: list[tuple[tuple[int, int, int, str], ...]]) -> tuple[int, list[int], str]:
    """(cost, index of the alignment taken in each slice, closing edits): the
    cheapest chain from START, of equal ones that with the least audit.  From
    one state before, two alignments of a slice have different audits, so the
    first difference decides."""
    ahead = {state: cost for state, (cost, _) in CLOSING.items()}
    picks = []
    for options in reversed(slices):
        best: dict[int, tuple] = {}
        for at, (before, after, cost, audit) in enumerate(options):
            if after in ahead:
                mine = (cost + ahead[after], audit, at)
                if before not in best or mine < best[before]:
                    best[before] = mine
        ahead = {state: b[0] for state, b in best.items()}
        picks.append({state: b[2] for state, b in best.items()})
    state, taken = START, []
    for options, pick in zip(slices, reversed(picks)):
        taken.append(pick[state])
        state = options[pick[state]][1]
    return ahead[START], taken, CLOSING[state][1]


# --- conversations ---------------------------------------------------------

def ordered(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` (role and text not null) with ``place``
    (from 1) by turn, null first."""
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 62)))
    ranked = salted_rank(rows, ["conv_id"], ["turn", "role", "text"], bucket, None)
    return ranked.withColumnRenamed("rank", "place")


def sliced(rows: DataFrame, size: int = SLICE) -> DataFrame:
    """Slices of placed rows: ``conv_id, slice, rows (place, turn, initial,
    fault), said (place, role, text), firsts`` (places of first occurrences).
    A first occurrence is a grouped minimum, so a text that one conversation
    repeats many times is no hot key."""
    stripped = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    last = F.substring(stripped, -1, 1)
    initial = F.substring("role", 1, 1)
    slice_ = F.floor((F.col("place") - 1) / size)
    rows = written(rows.select(
        "conv_id", "place", "turn", "role", "text",
        F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"),
        F.when(stripped == "", "blank").when(~last.isin(".", "!", "?"), "truncated").alias("fault")), "repair-rows")
    firsts = rows.groupBy("conv_id", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit("second"), "role", "text").alias("d2")).agg(
        F.min("place").alias("place"))
    both = rows.withColumn("first", F.lit(False)).unionByName(
        firsts.select("conv_id", "place", F.lit(True).alias("first")), allowMissingColumns=True)
    row = F.when(~F.col("first"), F.struct("place", "turn", "initial", "fault"))
    said = F.when(~F.col("first"), F.struct("place", "role", "text"))
    return written(both.groupBy("conv_id", slice_.alias("slice")).agg(
        F.array_sort(F.collect_list(row)).alias("rows"), F.array_sort(F.collect_list(said)).alias("said"),
        F.collect_list(F.when(F.col("first"), F.col("place"))).alias("firsts")), "repair-slices")


_OPTION = "struct<before:int,after:int,cost:long,audit:string>"
_COUNTS = ["blank", "duplicate", "truncated", "illegal", "turns"]


def alignments(slices: DataFrame) -> DataFrame:
    """Per slice its ``options`` and what its rows count: faults, illegal
    neighbours, distinct turns, with the first and last row for the border."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for rows, firsts in zip(batch["rows"], batch["firsts"]):
                seen, symbols = set(firsts), []
                count = dict.fromkeys(_COUNTS, 0)
                before = None
                for r in rows:
                    fault = "blank" if r["fault"] == "blank" else "duplicate" if r["place"] not in seen else r["fault"]
                    symbols.append("x" if fault in ("blank", "duplicate") else r["initial"].upper() if fault else r["initial"])
                    if fault:
                        count[fault] += 1
                    if before is not None:
                        count["illegal"] += before["initial"] + r["initial"] not in ("su", "ua", "au")
                    count["turns"] += r["turn"] is not None and (before is None or before["turn"] != r["turn"])
                    before = r
                numbers = [r["turn"] for r in rows if r["turn"] is not None]
                options = [dict(zip(("before", "after", "cost", "audit"), o)) for o in align("".join(symbols))]
                made.append((options, *count.values(), rows[0]["initial"], rows[-1]["initial"],
                             numbers[0] if numbers else None, numbers[-1] if numbers else None, rows[0]["turn"]))
            out = pd.DataFrame(made, columns=["options", *_COUNTS, "opens", "closes", "low", "high", "enters"], dtype=object)
            for name in ("low", "high", "enters"):
                out[name] = pd.array(out[name].tolist(), "Int64")
            out.insert(0, "slice", batch["slice"])
            out.insert(0, "conv_id", batch["conv_id"])
            yield out

    return slices.select("conv_id", "slice", "rows", "firsts").mapInPandas(
        run, f"conv_id string, slice long, options array<{_OPTION}>, {', '.join(f'{c} long' for c in _COUNTS)}, "
        "opens string, closes string, low long, high long, enters long")


def plans(aligned: DataFrame) -> DataFrame:
    """One row per conversation: counts, ``cost``, ``audit`` and ``picks`` (per
    slice the state before it and its edits; the last with the closing)."""
    names = [c for c in aligned.columns if c not in ("conv_id",)]
    grouped = aligned.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "slice", *[c for c in names if c not in ("slice", "options")], "options"))).alias("slices"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for conv, slices in zip(batch["conv_id"], batch["slices"]):
                options = [[(o["before"], o["after"], o["cost"], o["audit"]) for o in s["options"]] for s in slices]
                cost, taken, closing = choose(options)
                total = {c: sum(s[c] for s in slices) for c in _COUNTS}
                for a, b in zip(slices, slices[1:]):
                    total["illegal"] += a["closes"] + b["opens"] not in ("su", "ua", "au")
                    total["turns"] -= b["enters"] is not None and b["enters"] == a["high"]
                lows = [s["low"] for s in slices if s["low"] is not None]
                highs = [s["high"] for s in slices if s["high"] is not None]
                gaps = max(highs) - min(lows) + 1 - total["turns"] if lows else 0
                edits = [o[t] for o, t in zip(options, taken)]
                picks = [{"slice": int(s["slice"]), "before": e[0], "audit": e[3]} for s, e in zip(slices, edits)]
                picks[-1]["audit"] += closing
                made.append((conv, gaps, *[total[c] for c in _COUNTS[:4]], cost, "".join(p["audit"] for p in picks), picks))
            yield pd.DataFrame(made, columns=["conv_id", "gaps", *_COUNTS[:4], "cost", "audit", "picks"])

    return grouped.mapInPandas(run, "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, "
                               "cost long, audit string, picks array<struct<slice:long,before:int,audit:string>>")


def repaired_lines(before: int, audit: str, said: list[dict]) -> list[tuple[str, str]]:
    """The (role, text) turns that the edits of a slice leave."""
    out, state, rows = [], before, iter(said)
    for edit in audit:
        row = {"role": "", "text": ""} if edit == "I" else next(rows)
        if edit == "D":
            continue
        role = "assistant" if state == ASSISTANT else "user"
        if edit == "K":
            role = row["role"]
        out.append((role, row["text"]))
        state = SYSTEM if edit == "K" and state == START and role[:1] == "s" else USER if state == ASSISTANT else ASSISTANT
    return out


def repaired(slices: DataFrame, planned: DataFrame) -> DataFrame:
    """The turns after the edits: ``conv_id, slice, slices, turns (role,
    text)``, one row per slice."""
    pick = planned.select("conv_id", F.size("picks").alias("slices"), F.explode("picks").alias("pick")).select(
        F.col("conv_id").alias("of"), F.col("pick.slice").alias("at"), "slices", "pick.before", "pick.audit")
    joined = slices.select("conv_id", "slice", "said").join(
        pick, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("at"))).drop("of", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["conv_id", "slice", "slices"]].copy()
            out["turns"] = [[{"role": r, "text": t} for r, t in repaired_lines(b, a, s)]
                            for b, a, s in zip(batch["before"], batch["audit"], batch["said"])]
            yield out

    return joined.mapInPandas(run, "conv_id string, slice long, slices int, turns array<struct<role:string,text:string>>")


def repair(rows: DataFrame, size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """(plans, repaired slices) of ``conv_id, turn, role, text``.  Their
    conv_id is a string, which Python keeps exactly also beside nulls."""
    workers_import(rows.sparkSession)
    slices = sliced(ordered(rows.withColumn("conv_id", F.col("conv_id").cast("string"))), size)
    planned = written(plans(alignments(slices)), "repair-plans")
    return planned, repaired(slices, planned)


# --- query ---------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the contract's damage; what is null counts as one space."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("harm"))
    harm = F.col("harm")
    twice = F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.filter(harm != 0).select(
        "conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"), twice).drop("copy")


def line_digests(fixed: DataFrame) -> DataFrame:
    """``id, repaired_sha256``.  Conversations of one slice are hashed where
    they are; the slices of longer ones pass one after the other through the
    digest's state, as SHA-256 has it."""
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    fixed = written(fixed.select(F.col("conv_id").alias("id"), "slice", "slices", F.size("turns").alias("n"),
                                 F.array_join(line, "\n").alias("lines")), "repair-lines")
    short = fixed.filter("slices = 1").select("id", F.sha2("lines", 256).alias("repaired_sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, started, ids, digests = None, None, False, [], []
        for batch in batches:
            for i, n, lines in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "lines"))):
                if state is None or i != now:
                    if state is not None:
                        ids.append(now)
                        digests.append(state.hexdigest())
                    now, state, started = i, hashlib.sha256(), False
                if n:
                    state.update((("\n" if started else "") + lines).encode())
                    started = True
        if state is not None:
            ids.append(now)
            digests.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(digests, pa.string())], ["id", "repaired_sha256"])

    long_ = fixed.filter("slices > 1").repartition(partitions(fixed.sparkSession), "id").sortWithinPartitions("id", "slice")
    return short.unionByName(long_.mapInArrow(run, "id string, repaired_sha256 string"))


def op12_turn_repair(conversations: DataFrame) -> DataFrame:
    planned, fixed = repair(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = planned.drop("picks").withColumnRenamed("conv_id", "of")
    digests = line_digests(fixed)
    name = F.col("conv_id").cast("string")
    out = every.join(found, name.eqNullSafe(F.col("of")), "left").join(
        digests, name.eqNullSafe(F.col("id")), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


# States as in the module: 0 nothing yet, 1 after the system turn, 2 a user turn is next, 3 an assistant turn is next.
SQL = f"""
WITH RECURSIVE h AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS harm FROM conversations),
d AS (
  SELECT conv_id, turn, CASE harm WHEN 4 THEN 'user' ELSE role END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM h, (VALUES (0), (1)) AS copies(copy) WHERE harm <> 0 AND (harm = 3 OR copy = 0)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    CASE WHEN substr(role, 1, 1) IN ('s', 'u', 'a') THEN substr(role, 1, 1) ELSE 'o' END AS initial FROM d),
f AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY place) AS before FROM o),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(place) AS size
  FROM f GROUP BY conv_id),
inserts(state, done, paid, next) AS (
  SELECT * FROM (VALUES (0, '', 0, 0), (1, '', 0, 1), (2, '', 0, 2), (3, '', 0, 3), (0, 'I', 3, 3), (1, 'I', 3, 3), (2, 'I', 3, 3),
    (3, 'I', 3, 2), (0, 'II', 6, 2), (1, 'II', 6, 2), (2, 'II', 6, 2), (3, 'II', 6, 3)) v),
edits(state, edit, paid, initial, next) AS (
  SELECT * FROM (VALUES (0, 'D', 4, NULL, 0), (1, 'D', 4, NULL, 1), (2, 'D', 4, NULL, 2), (3, 'D', 4, NULL, 3), (0, 'K', 0, 's', 1),
    (0, 'K', 0, 'u', 3), (1, 'K', 0, 'u', 3), (2, 'K', 0, 'u', 3), (3, 'K', 0, 'a', 2), (0, 'R', 3, NULL, 3), (1, 'R', 3, NULL, 3),
    (2, 'R', 3, NULL, 3), (3, 'R', 3, NULL, 2)) v),
walk AS (
  SELECT conv_id, 0::BIGINT AS place, 0 AS state, '000000000' AS best FROM counts
  UNION ALL
  SELECT w.conv_id, f.place, e.next, min(printf('%09d', substr(w.best, 1, 9)::INT + i.paid + e.paid
      + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END) || substr(w.best, 10) || i.done || e.edit)
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1
  JOIN inserts i ON i.state = w.state
  JOIN edits e ON e.state = i.next AND (e.initial IS NULL OR e.initial = f.initial) AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, f.place, e.next),
fin AS (
  SELECT w.conv_id, min(printf('%09d', substr(best, 1, 9)::INT + CASE state WHEN 1 THEN 6 WHEN 3 THEN 3 ELSE 0 END) || substr(best, 10)
      || CASE state WHEN 1 THEN 'II' WHEN 3 THEN 'I' ELSE '' END) AS best
  FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.size = w.place GROUP BY w.conv_id),
plan AS (SELECT conv_id, substr(best, 1, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM fin),
steps AS (
  SELECT conv_id, pos, edit, odd, count(*) FILTER (edit <> 'I') OVER w AS place, count(*) FILTER (edit <> 'D') OVER w AS nth
  FROM (SELECT conv_id, pos, substr(audit, pos, 1) AS edit, length(replace(audit, 'D', '')) % 2 AS odd
        FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS pos FROM plan))
  WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
said AS (
  SELECT s.conv_id, string_agg(CASE s.edit WHEN 'K' THEN f.role ELSE CASE WHEN (s.nth + s.odd) % 2 = 1 THEN 'user' ELSE 'assistant' END END
      || ':' || CASE s.edit WHEN 'I' THEN '' ELSE f.text END, chr(10) ORDER BY s.pos) AS lines
  FROM steps s LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.place = s.place
  WHERE s.edit <> 'D' GROUP BY s.conv_id)
SELECT a.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate,
  coalesce(c.truncated, 0)::BIGINT AS truncated, coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(p.cost, 0)::BIGINT AS cost,
  coalesce(p.audit, '') AS audit, sha256(coalesce(l.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id::BIGINT AS conv_id FROM conversations) a
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN plan p ON p.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN said l ON l.conv_id IS NOT DISTINCT FROM a.conv_id
"""
