"""Edit-aware token counts.

Every document keeps a segment tree over its text: the leaves are stretches of
whole words (about ``LEAF`` bytes, each ending in white space but the last),
every node holds the characters, bytes and tokens below it.  An edit (position,
characters to delete, text to insert) descends by characters to the leaves it
touches, takes one leaf more where a word would run across the border, encodes
that stretch alone and updates the sums on the way up.  Characters are summed at
once, since the next edit descends by them; the stretches of the documents of a
batch are encoded together when their edits are done, then their tokens are
summed.  Token ids never cross white space, so the total equals a count of the
whole edited text.

Defined cases: a null text is empty and has no tokens; positions are characters
from 0 and are clamped to the text, deletions end at its end; a null insertion
inserts nothing, null positions and lengths count 0; edits of a document apply
in the order of ``seq`` (ties by position, length, insertion); documents without
edits keep their count; repeated rows are edited each; an empty table gives no
rows.  Extra columns travel along in ``row``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _SPACE, buffers, words
from .tokens import WordEncoder

LEAF = 256
COUNT_BYTES = 1 << 21  # bytes of changed leaves encoded together
HELD = 1 << 23  # characters of edited documents held until their tokens are counted
TOKENIZER = "word_bpe_49k.json"
_BLANK = " \t\n\x0b\x0c\r"
_EMPTY_TREE = "named_struct('chars', array(0), 'bytes', array(0), 'tokens', array(0))"


def _leaf_rows(encoder: WordEncoder, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Leaves of many documents: (leaves per document, bytes, characters,
    tokens of each leaf).  A leaf starts at the first word that starts in its
    stretch of ``LEAF`` bytes; a document's first leaf starts at its start."""
    doc, start, end, h = words(data, offsets, _SPACE, lower=False)
    distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    _, size = encoder.lookup(distinct, start[at], end[at], data)
    tokens = size.astype(np.int64)[inverse]
    stretch = (start - offsets[doc]) // LEAF
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (stretch[1:] != stretch[:-1])
    head = np.flatnonzero(new)
    owner, begin = doc[head], start[head].copy()
    first = np.ones(len(head), bool)
    first[1:] = owner[1:] != owner[:-1]
    begin[first] = offsets[owner[first]]
    leaf_tokens = np.add.reduceat(tokens, head) if len(head) else np.zeros(0, np.int64)
    # Documents without a word are one leaf.
    none = np.setdiff1d(np.arange(len(offsets) - 1), owner)
    owner, begin = np.concatenate([owner, none]), np.concatenate([begin, offsets[none]])
    leaf_tokens = np.concatenate([leaf_tokens, np.zeros(len(none), np.int64)])
    order = np.argsort(owner, kind="stable")
    owner, begin, leaf_tokens = owner[order], begin[order], leaf_tokens[order]
    leaf_bytes = np.diff(np.append(begin, len(data)))
    letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    leaf_chars = letters[begin + leaf_bytes] - letters[begin]
    return np.bincount(owner, minlength=len(offsets) - 1), leaf_bytes, leaf_chars, leaf_tokens


def _heaps(many: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Complete binary trees of sums (node 1 is the root; a document with m
    leaves has 2 * 2**ceil(log2 m) cells): (cell offsets, cells)."""
    size = 2 * (1 << np.ceil(np.log2(np.maximum(many, 1))).astype(np.int64))
    offsets = np.append(0, np.cumsum(size))
    out = np.zeros(offsets[-1], np.int64)
    inner = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
    out[np.repeat(offsets[:-1] + size // 2, many) + inner] = values
    width = size // 2
    while len(wide := np.flatnonzero(width > 1)):  # sum up one level of all trees
        half = width[wide] // 2
        row = np.repeat(wide, half)
        node = np.arange(len(row)) - np.repeat(np.cumsum(half) - half, half) + np.repeat(half, half)
        base = offsets[row]
        out[base + node] = out[base + 2 * node] + out[base + 2 * node + 1]
        width[wide] = half
    return offsets, out


def build(docs: DataFrame, text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``row`` (the input row) with its ``tree``."""
    source = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(tokenizer)
        for batch in batches:
            for first, end, data, offsets in buffers(batch.column("__text"), 1 << 21):
                many, *sums = _leaf_rows(encoder, data, offsets)
                columns = []
                for values in (sums[1], sums[0], sums[2]):
                    cells_at, cells = _heaps(many, values)
                    columns.append(pa.ListArray.from_arrays(pa.array(cells_at, pa.int32()), pa.array(cells, pa.int32())))
                tree = pa.StructArray.from_arrays(columns, names=["chars", "bytes", "tokens"])
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(first, end - first), tree], names=["row", "tree"])

    return source.mapInArrow(run, source.select("row", F.expr(_EMPTY_TREE).alias("tree")).schema)


class Document:
    """A text as leaves under a segment tree of (characters, tokens)."""

    def __init__(self, text: bytes, chars: list[int], lengths: list[int], tokens: list[int]):
        self.chars, self.tokens = list(chars), list(tokens)
        self.base = len(chars) // 2
        self.leaves: list[str | bytes] = []
        at = 0
        for n in lengths[self.base:]:
            self.leaves.append(text[at: at + n])
            at += n
        self.encoded = 0  # characters encoded again
        self.open: set[int] = set()  # leaves whose tokens are not counted yet

    def leaf(self, i: int) -> str:
        if isinstance(self.leaves[i], bytes):
            self.leaves[i] = self.leaves[i].decode("utf-8", "replace")
        return self.leaves[i]

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, place in it) of a character place; the end of the text is
        in the last leaf that has characters."""
        node = 1
        if place >= self.chars[1]:
            while node < self.base:
                node = 2 * node + (self.chars[2 * node + 1] > 0)
            return node - self.base, self.chars[node]
        while node < self.base:
            node *= 2
            if place >= self.chars[node]:
                place -= self.chars[node]
                node += 1
        return node - self.base, place

    def _next(self, i: int) -> int | None:
        """The next leaf that has characters."""
        node = i + self.base
        while node > 1 and not (node % 2 == 0 and self.chars[node + 1]):
            node //= 2
        if node <= 1:
            return None
        node += 1
        while node < self.base:
            node = 2 * node + (not self.chars[2 * node])
        return node - self.base

    def _set(self, i: int, text: str) -> None:
        self.leaves[i] = text
        self.open.add(i)
        self._add(self.chars, i, len(text))

    def _add(self, sums: list[int], i: int, value: int) -> None:
        """Leaf ``i`` has ``value`` now, and so have the sums above it."""
        node = i + self.base
        more = value - sums[node]
        while node and more:
            sums[node] += more
            node //= 2

    def edit(self, place: int, delete: int, insert: str) -> None:
        place = min(max(place, 0), self.chars[1])
        delete = min(max(delete, 0), self.chars[1] - place)
        low, low_at = self.find(place)
        high, high_at = self.find(place + delete)
        fresh = self.leaf(low)[:low_at] + insert + self.leaf(high)[high_at:]
        touched = [low]
        while touched[-1] != high:
            touched.append(self._next(touched[-1]))
        # A stretch that no longer ends in white space borders on a word.
        while not fresh.endswith(tuple(_BLANK)) and (more := self._next(touched[-1])) is not None:
            fresh += self.leaf(more)
            touched.append(more)
        for i in touched[1:]:
            self._set(i, "")
        self.encoded += len(fresh)
        self._set(low, fresh)

    def text(self) -> str:
        return "".join(self.leaf(i) for i in range(len(self.leaves)))


def settle(docs: list[Document], encoder: WordEncoder) -> None:
    """Count the tokens of the documents' changed leaves, all together."""
    places = [(doc, i) for doc in docs for i in sorted(doc.open)]
    texts = pa.array([doc.leaf(i).encode("utf-8", "replace") for doc, i in places], pa.binary())
    for first, end, data, offsets in buffers(texts, COUNT_BYTES):
        owner, start, stop, h = words(data, offsets, _SPACE, lower=False)
        distinct, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        _, size = encoder.lookup(distinct, start[at], stop[at], data)
        tokens = np.bincount(owner, size[inverse], end - first).astype(np.int64).tolist()
        for (doc, i), n in zip(places[first:end], tokens):
            doc._add(doc.tokens, i, n)
    for doc in docs:
        doc.open.clear()


def apply_edits(trees: DataFrame, edits: str = "edits", text: str = "text", with_text: bool = False,
                tokenizer: str = TOKENIZER) -> DataFrame:
    """``trees`` (``row, tree``) with an array column ``edits`` of (seq, place,
    delete, insert) -> ``row, tokens_before, tokens_after, n_edits,
    chars_after, chars_encoded`` (characters that the edits made it encode
    again), and ``edited`` if ``with_text``."""
    source = trees.select("row", F.col("row")[text].cast("binary").alias("__text"), "tree", F.col(edits).alias("edits"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.get(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            done: list[tuple] = []
            size = 0

            def close() -> None:
                settle([doc for _, _, doc in done], encoder)
                rows.extend((before, doc.tokens[1], n, doc.chars[1], doc.encoded, doc.text() if with_text else "") for before, n, doc in done)
                done.clear()

            for body, tree, todo in zip(batch.column("__text"), batch.column("tree"), batch.column("edits").to_pylist()):
                tree = tree.as_py()
                doc = Document(body.as_py() or b"", tree["chars"], tree["bytes"], tree["tokens"])
                before = doc.tokens[1]
                todo = sorted((e["seq"] or 0, e["place"] or 0, e["delete"] or 0, e["insert"] or "") for e in todo or [] if e)
                for _, place, delete, insert in todo:
                    doc.edit(place, delete, insert)
                done.append((before, len(todo), doc))
                size += doc.chars[1]
                if size >= HELD:
                    close()
                    size = 0
            close()
            columns = list(zip(*rows)) or [[]] * 6
            out = [batch.column("row")] + [pa.array(c, pa.int64()) for c in columns[:5]]
            if with_text:
                out.append(pa.array(columns[5], pa.string()))
            yield pa.RecordBatch.from_arrays(out, names=["row", *_COUNTS, *(["edited"] if with_text else [])])

    schema = source.select("row").schema
    for name in _COUNTS:
        schema = schema.add(name, "long")
    return source.mapInArrow(run, schema.add("edited", "string") if with_text else schema)


_COUNTS = ["tokens_before", "tokens_after", "n_edits", "chars_after", "chars_encoded"]


def with_edits(docs: DataFrame, key: str, edits: DataFrame) -> DataFrame:
    """``docs`` with the array ``edits`` of an edit log ``(key, seq, place,
    delete, insert)``; an edit log of one document is one record of it."""
    log = edits.groupBy(F.col(key).alias("__key")).agg(F.collect_list(F.struct("seq", "place", "delete", "insert")).alias("edits"))
    return docs.join(log, docs[key] == log["__key"], "left").drop("__key")


# --- query ---------------------------------------------------------------

def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document that follow from its id and length: a
    deletion, an insertion of a piece of its own, and a replacement."""
    length = F.coalesce(F.length("text"), F.lit(0))

    def draw(name: str, most) -> Column:
        return F.pmod(F.xxhash64(F.lit(name), "doc_id", length), most).cast("long")

    def piece(name: str) -> Column:
        return F.coalesce(F.substring(F.col("text"), draw(name, length + 1).cast("int") + 1, F.lit(24)), F.lit(""))

    def edit(seq: int, place, delete, insert) -> Column:
        return F.struct(F.lit(seq).alias("seq"), place.alias("place"), delete.alias("delete"), insert.alias("insert"))

    edits = F.array(edit(1, draw("p1", length + 1), draw("d1", F.lit(24)), F.lit("")),
                    edit(2, draw("p2", length + 1), F.lit(0).cast("long"), piece("i2")),
                    edit(3, draw("p3", length + 1), draw("d3", F.lit(8)), piece("i3")))
    return docs.select("doc_id", "text", edits.alias("edits"))


def op10_token_counts(docs: DataFrame) -> DataFrame:
    trees = build(sample_edits(docs)).select("row", "tree", F.col("row.edits").alias("edits"))
    return apply_edits(trees).select(F.col("row.doc_id").alias("doc_id"), *_COUNTS)
