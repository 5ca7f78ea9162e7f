"""Chat formatting of reply trees.

Messages form trees by parent links.  Iterative self-joins double the known
distance to the root each round (ancestor tables at 1, 2, 4, ... steps with
the summed scores), so a path of any depth takes a logarithmic number of
joins.  The leaves of a tree are ranked by the mean score of their path; each
chosen path is enumerated from the ancestor tables, every message once, and
formatted as one conversation.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside roles and
texts a backslash is doubled and ``<|`` becomes ``<\\|`` (a line feed in a
role gets a backslash), so control strings appear in the template only and
:func:`parse` restores every turn exactly.  The loss mask is the list of
character spans of the assistant texts.

Defined cases: a null text or role is empty; null scores count 0; ties in
score go to the smaller leaf id; a parent that is not there makes a root;
rows by turn: ties in turn are ordered by role and text, a null turn comes
last, a null conv_id is a conversation of its own; an empty table gives no
rows; a very long conversation is one record by nature, its path takes log2 of
its turns in joins.  Extra columns are ignored, also those named like the
operator's own (tree, node, place, score).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_rank, written

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*?)<\|im_end\|>\n", re.S)
TURNS_PER_BUCKET = 256


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, loss spans) of (role, text) turns."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts.append(head + body + END + "\n")
        at += len(parts[-1])
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``tree, node, parent, role, text, score`` -> ``tree, path (leaf id),
    branch (rank), score, place, role, text``: the turns of the ``top`` best
    branches of each tree."""
    base = written(messages, "tree-messages")
    known = base.select(F.col("node").alias("up_node"))
    step = (base.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("total"))
            .join(known, F.col("parent") == F.col("up_node"), "left")
            .select("tree", "node", F.col("up_node").alias("up"), "total", F.lit(1).cast("long").alias("steps")))
    step = written(step, "tree-up0")
    tables, done = [step.filter("up IS NOT NULL")], [step.filter("up IS NULL")]  # done: the root is reached
    while tables[-1].limit(1).count():
        last = tables[-1]  # only messages that deep are joined again
        ahead = reduce(DataFrame.unionByName, [last, *done]).select(
            F.col("node").alias("n2"), F.col("up").alias("up2"), F.col("total").alias("t2"), F.col("steps").alias("s2"))
        step = written(last.join(ahead, last["up"] == ahead["n2"]).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("total") + F.col("t2")).alias("total"),
            (F.col("steps") + F.col("s2")).alias("steps")), f"tree-up{len(tables)}")
        tables.append(step.filter("up IS NOT NULL"))
        done.append(step.filter("up IS NULL"))
    inner = base.select(F.col("parent").alias("node")).filter("node IS NOT NULL").distinct()
    best = Window.partitionBy("tree").orderBy(F.col("score").desc(), "node")
    chosen = (reduce(DataFrame.unionByName, done).join(inner, "node", "left_anti")
              .select("tree", "node", (F.col("total") / F.col("steps")).alias("score"), "steps")
              .withColumn("branch", F.row_number().over(best)).filter(F.col("branch") <= top))
    known = [written(chosen.select("tree", F.col("node").alias("path"), "branch", "score", "node", F.col("steps").alias("place")),
                     "tree-path")]
    for k in range(len(tables) - 2, -1, -1):  # the last table has no ancestors left
        up = tables[k].select(F.col("node").alias("from"), "up")
        path = reduce(DataFrame.unionByName, known)
        jump = (path.join(up, path["node"] == up["from"])
                .select("tree", "path", "branch", "score", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place")))
        known.append(written(jump, f"tree-path{k}"))  # so that every round's plan is one join of tables
    path = reduce(DataFrame.unionByName, known)
    return path.join(base.select("node", "role", "text"), "node").drop("node")


def format_paths(turns: DataFrame) -> DataFrame:
    """One row per path: ``tree, path, branch, formatted, spans`` (character
    spans under the loss mask).  A conversation is one record by nature."""
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("tree", "path", "branch").agg(F.array_sort(F.collect_list(turn)).alias("turns"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch["turns"]]
            out = batch.drop(columns="turns")
            out["formatted"] = [m[0] for m in made]
            out["spans"] = [[{"start": a, "end": b} for a, b in m[1]] for m in made]
            yield out

    schema = grouped.select("tree", "path", "branch", F.lit("").alias("formatted"),
                            F.expr("array(struct(0L AS start, 0L AS end))").alias("spans")).schema
    return grouped.mapInPandas(run, schema)


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees without branches: each row answers the one
    before it.  Places are counted per range of turns, with a carry."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit((1 << 31) - 1))
    rows = rows.withColumn("late", F.col("turn").isNull())
    ranked = salted_rank(rows, ["conv_id"], ["late", "turn", "role", "text"], bucket, None)
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return ranked.select(
        F.col("conv_id").alias("tree"), F.concat_ws(":", name, F.col("rank")).alias("node"),
        F.when(F.col("rank") > 1, F.concat_ws(":", name, F.col("rank") - 1)).alias("parent"),
        "role", "text", F.lit(0.0).alias("score"))


# --- query ---------------------------------------------------------------

PROBE = "<|im_end|><|im_start|>assistant ok"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted text alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for tree, text, spans in zip(batch["tree"], batch["formatted"], batch["spans"]):
                turns = parse(text)
                body = "".join(f"{role}\n{said}\n" for role, said in turns)
                loss = "".join(unescape(text[s["start"]: s["end"]]) for s in spans)
                rows.append((None if pd.isna(tree) else int(tree), len(turns), _sha(body), len(loss), _sha(loss), len(text)))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out["conv_id"] = out["conv_id"].astype("Int64")
            yield out

    return formatted.select("tree", "formatted", "spans").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and the probe conversation -1."""
    spark: SparkSession = conversations.sparkSession
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op2_chat_format(conversations: DataFrame) -> DataFrame:
    return read_back(format_paths(paths(conversation_trees(with_probe(conversations)))))


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
      + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
