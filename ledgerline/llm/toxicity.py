"""Toxic spans by a linear-chain conditional random field.

Tokens are runs of letters (bytes from 0x80 count as letters), digits and
apostrophes, A-Z lower-cased.  The labels mark documents, so tokens are
labelled first: a feature (a token, or its first 4 to 8 bytes, which catch
inflected forms) is a *mark* if the documents that hold it are toxic far more
often than chance allows (all such features are kept; the sample bounds their
number); the tokens of toxic documents that carry a mark are
labelled 1, all others 0.  A chain with two states is fitted to these
sequences (a weight for every mark, a bias, four transition weights; exact
gradients by forward-backward).  Inference runs over whole texts: tokens
without a mark share one emission, so a stretch of them is a matrix power and
forward-backward steps only from mark to mark.  The marginals of a document
give its score (largest marginal and expected toxic tokens through a logistic
curve fitted to the training documents) and its offending spans.

Training reads a bounded sample: at most ``TOXIC_DOCS`` and ``CLEAN_DOCS``
different texts, chosen by hash, never a row of the held-out fold.  Scoring
reads every text whole.  Labels, language, source and doc_id are no inputs of
a score.

Defined cases: a null or empty text has no tokens and gets the score of a text
without marks; null labels are no labels; a doc_id labelled several times is
toxic if any label says so; repeated rows are scored each; without labels, or
with labels of one kind only, the score is the smoothed share of toxic ones;
an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import _LOWER, buffers, mix, prefix_hash, span_hash, words

TOXIC_DOCS = 1000  # different toxic texts that training reads at most
CLEAN_DOCS = 2000  # different clean texts that training reads at most
FOLDS, HELD_OUT = 5, 0
PREFIXES = (4, 5, 6, 7, 8)  # bytes of a token that are features beside the whole token
PRIOR = (1.0, 9.0)  # pseudo-counts of toxic and clean documents
CHUNK = 128  # tokens of a training sequence

_GAP = np.ones(256, bool)
for _low, _high in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _GAP[_low:_high] = False
_GAP[39] = False


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


@dataclass
class Model:
    """Marks (sorted feature hashes) with their weights, the chain's other
    weights, and the score curve."""

    marks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -8.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)


# --- tokens and features --------------------------------------------------

def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, end, features): one column of feature hashes for the
    whole token and one per prefix length (0 where the token is shorter)."""
    doc, start, end, whole = words(data, offsets, _GAP)
    prefix = prefix_hash(_LOWER[data])
    columns = [whole]
    for size in PREFIXES:
        long_ = end - start >= size
        value = np.zeros(len(doc), np.uint64)
        value[long_] = mix(span_hash(prefix, start[long_], start[long_] + size) + np.uint64(1000 + size))
        columns.append(value)
    return doc, start, end, np.stack(columns, axis=1)


def _mark_of(features: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Index of the first feature of each token that is a mark, or -1."""
    out = np.full(len(features), -1, np.int64)
    if not len(marks):
        return out
    for k in range(features.shape[1]):
        open_ = np.flatnonzero(out < 0)
        value = features[open_, k]
        at = np.minimum(np.searchsorted(marks, value), len(marks) - 1)
        hit = marks[at] == value
        out[open_[hit]] = at[hit]
    return out


def _marked_tokens(data: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """(tokens per document; of the tokens with a mark: document, place in
    the document, start, end, mark).  Prefixes are hashed for all tokens, but
    nothing else is kept of tokens without a mark."""
    doc, start, end, whole = words(data, offsets, _GAP)
    count = np.bincount(doc, minlength=len(offsets) - 1)
    found = np.full(len(doc), -1, np.int64)
    if len(marks):
        prefix = prefix_hash(_LOWER[data])
        # A mark's lowest bits, as a table, sort out nearly all tokens.
        small = np.zeros(1 << 16, bool)
        small[(marks & np.uint64(0xFFFF)).astype(np.int64)] = True
        for size in (None, *PREFIXES):
            open_ = np.flatnonzero(found < 0) if size is None else np.flatnonzero((found < 0) & (end - start >= size))
            value = whole[open_] if size is None else mix(
                span_hash(prefix, start[open_], start[open_] + size) + np.uint64(1000 + size))
            near = small[(value & np.uint64(0xFFFF)).astype(np.int64)]
            open_, value = open_[near], value[near]
            at = np.minimum(np.searchsorted(marks, value), len(marks) - 1)
            hit = marks[at] == value
            found[open_[hit]] = at[hit]
    marked = np.flatnonzero(found >= 0)
    place = marked - (np.cumsum(count) - count)[doc[marked]]
    return count, doc[marked], place, start[marked], end[marked], found[marked]


# --- inference ------------------------------------------------------------

def _powers_of(matrix: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """``matrix ** exponent`` for each exponent, scaled to a largest entry of
    1 (the scale cancels in marginals)."""
    out = np.broadcast_to(np.eye(2), (len(exponents), 2, 2)).copy()
    step, left = matrix / matrix.max(), exponents.copy()
    while left.any():
        odd = (left & 1) == 1
        out[odd] = out[odd] @ step
        out[odd] /= out[odd].max(axis=(1, 2), keepdims=True)
        step = step @ step
        step = step / step.max()
        left >>= 1
    return out


def marginals(model: Model, count: np.ndarray, doc: np.ndarray, place: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Probability of state 1 at each token with a mark.  ``doc`` is sorted,
    ``place`` increases within a document."""
    if not len(doc):
        return np.zeros(0)
    move = np.exp(model.transitions)
    plain = np.array([1.0, np.exp(model.bias)])
    step = move * plain  # one token without a mark: states before -> after
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    many = np.diff(np.append(first, len(doc)))
    gap = place.copy()
    gap[1:] -= np.where(doc[1:] == doc[:-1], place[:-1] + 1, 0)
    between = _powers_of(step, gap)
    rest = count[doc] - 1 - place  # tokens after this one
    emit = np.stack([np.ones(len(doc)), np.exp(model.bias + model.weights[mark])], axis=1)
    order = np.argsort(-many, kind="stable")
    forward, backward = np.zeros((len(doc), 2)), np.zeros((len(doc), 2))
    sizes = many[order]
    for k in range(sizes[0]):  # k-th mark of each document
        live = order[: np.searchsorted(-sizes, -k, "left")]
        at = first[live] + k
        if k:
            state = np.einsum("ni,nij->nj", forward[at - 1], between[at]) @ move
        else:
            # The chain starts in a plain state before the first token.
            state = np.einsum("i,nij->nj", plain, between[at]) @ move
        state = state * emit[at]
        forward[at] = state / state.sum(axis=1, keepdims=True)
    tail = _powers_of(step, rest)
    for k in range(sizes[0] - 1, -1, -1):
        live = order[: np.searchsorted(-sizes, -k, "left")]
        at = first[live] + k
        last = many[live] == k + 1
        state = tail[at].sum(axis=2)
        if (~last).any():
            nxt = at[~last] + 1
            ahead = (backward[nxt] * emit[nxt]) @ move.T
            state[~last] = np.einsum("nij,nj->ni", between[nxt], ahead)
        backward[at] = state / state.sum(axis=1, keepdims=True)
    both = forward * backward
    return both[:, 1] / both.sum(axis=1)


def _document_features(documents: int, doc: np.ndarray, p: np.ndarray) -> np.ndarray:
    largest, expected = np.zeros(documents), np.zeros(documents)
    np.maximum.at(largest, doc, p)
    np.add.at(expected, doc, p)
    return np.stack([np.ones(documents), largest, np.log1p(expected)], axis=1)


def _curve(features: np.ndarray, weights: tuple[float, float, float]) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-(features @ np.array(weights))))


# --- training -------------------------------------------------------------

def _choose_marks(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray, clean_weight: float = 1.0,
                  use: np.ndarray | None = None) -> np.ndarray:
    """Features whose documents are toxic more often than chance allows.

    With ``k`` of ``n`` documents toxic and a share ``r`` of toxic documents in
    the sample, the chance of such a share is at most
    ``exp(-n * KL(k/n, r))``; it must stay below one in twice the number of
    features that are frequent enough to pass at all, and with clean documents
    at their weight in the corpus most of the documents must be toxic.

    ``doc`` is sorted."""
    rate = (toxic.sum() + PRIOR[0]) / (len(toxic) + sum(PRIOR))
    marks: list[np.ndarray] = []

    def gain_of(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
        share = np.clip(hits / np.maximum(n, 1), 1e-9, 1 - 1e-9)
        gain = n * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
        return np.where((share > rate) & (hits > 0.8 * (hits + clean_weight * (n - hits))), gain, 0.0)

    for k in range(features.shape[1]):
        value = features[:, k]
        at = np.flatnonzero(value if use is None else (value != 0) & use)
        at = at[np.argsort(value[at], kind="stable")]  # by feature, then document
        value, owner = value[at], doc[at]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[new], owner[new]
        head = np.flatnonzero(np.append(True, value[1:] != value[:-1])) if len(value) else np.zeros(0, np.int64)
        if not len(head):
            continue
        n = np.diff(np.append(head, len(value)))
        least = np.arange(1, int(n.max()) + 1)  # documents that a feature needs
        tested = np.maximum(1, len(n) - np.searchsorted(np.sort(n), least, "left"))
        able = np.flatnonzero(least * -np.log(rate) > np.log(2.0 * tested))
        if not len(able):
            continue
        gain = gain_of(np.add.reduceat(toxic[owner].astype(float), head), n)
        good = (n >= least[able[0]]) & (gain > np.log(2.0 * tested[able[0]]))
        marks.append(value[head][good])
    return np.sort(np.concatenate(marks)) if marks else np.zeros(0, np.uint64)


def _one_per_copy(whole: np.ndarray, doc: np.ndarray, documents: int, seeds: int = 3) -> np.ndarray:
    """Which sample documents to learn marks from: the first of each group of
    near copies (equal minimum of one of ``seeds`` hashes over runs of three
    tokens).  Words that only a copied text shares would look like marks."""
    keep = np.ones(documents, bool)
    whole_run = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
    if not len(whole_run):
        return keep
    owner = doc[whole_run]
    run = mix(mix(whole[whole_run] * np.uint64(3)) + mix(whole[whole_run + 1] * np.uint64(5)) + whole[whole_run + 2])
    head = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for seed in range(1, seeds + 1):
        least = np.minimum.reduceat(mix(run + np.uint64(seed)), head)
        first = np.unique(least, return_index=True)[1]
        later = np.ones(len(head), bool)
        later[first] = False
        keep[owner[head][later]] = False
    return keep


def _fit_chain(mark: np.ndarray, label: np.ndarray, marks: int, rounds: int = 90) -> tuple[np.ndarray, float, np.ndarray]:
    """Maximise the conditional likelihood of the labels of the training
    sequences ``(sequences, CHUNK)`` (mark -1: none, -2: padding) with a
    quadratic penalty, by Adam on exact gradients."""
    mark, label = np.ascontiguousarray(mark.T), np.ascontiguousarray(label.T)  # time first
    real = mark > -2
    weights, bias, move = np.zeros(marks + 1), -2.0, np.zeros((2, 2))
    slot = np.where(mark >= 0, mark, marks)  # the last weight stays 0
    pairs = real[1:]
    seen_move = np.zeros((2, 2))
    np.add.at(seen_move, (label[:-1][pairs], label[1:][pairs]), 1)
    seen_mark = np.bincount(slot[real & (label == 1)], minlength=marks + 1).astype(float)
    seen_bias = float(label[real].sum())
    total = float(real.sum())
    mean, square = np.zeros(marks + 6), np.zeros(marks + 6)
    steps, count = mark.shape
    for t in range(1, rounds + 1):
        emit = np.where(real, np.exp(np.clip(bias + weights[slot], -30, 30)), 1.0)  # of state 1; state 0 has 1
        (m00, m01), (m10, m11) = np.exp(np.clip(move, -30, 30))
        ahead0, ahead1 = np.empty(mark.shape), np.empty(mark.shape)
        a0, a1 = 1 / (1 + emit[0]), emit[0] / (1 + emit[0])
        ahead0[0], ahead1[0] = a0, a1
        for k in range(1, steps):
            n0, n1 = a0 * m00 + a1 * m10, (a0 * m01 + a1 * m11) * emit[k]
            scale = 1 / (n0 + n1)
            a0, a1 = np.where(real[k], n0 * scale, a0), np.where(real[k], n1 * scale, a1)
            ahead0[k], ahead1[k] = a0, a1
        p = np.empty(mark.shape)
        b0, b1 = np.full(count, 0.5), np.full(count, 0.5)
        grad_move = np.zeros((2, 2))
        for k in range(steps - 1, -1, -1):
            p[k] = ahead1[k] * b1 / (ahead0[k] * b0 + ahead1[k] * b1)
            if k:
                live = real[k]
                n0, n1 = b0, b1 * emit[k]
                x00, x01 = ahead0[k - 1] * m00 * n0, ahead0[k - 1] * m01 * n1
                x10, x11 = ahead1[k - 1] * m10 * n0, ahead1[k - 1] * m11 * n1
                share = live / (x00 + x01 + x10 + x11)
                grad_move += [[x00 @ share, x01 @ share], [x10 @ share, x11 @ share]]
                c0, c1 = m00 * n0 + m01 * n1, m10 * n0 + m11 * n1
                scale = 1 / (c0 + c1)
                b0, b1 = np.where(live, c0 * scale, b0), np.where(live, c1 * scale, b1)
        p *= real
        gradient = np.concatenate([
            (np.bincount(slot.ravel(), p.ravel(), marks + 1) - seen_mark)[:-1] + 0.05 * weights[:-1], [0.0],
            [p.sum() - seen_bias + 0.01 * bias], (grad_move - seen_move + 0.05 * move).ravel()]) / np.sqrt(total)
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        change = 0.15 * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.99 ** t)) + 1e-8)
        weights -= change[: marks + 1]
        weights[-1] = 0.0
        bias -= change[marks + 1]
        move -= change[marks + 2:].reshape(2, 2)
    return weights[:-1], float(bias), move


def _fit_curve(features: np.ndarray, toxic: np.ndarray, clean_weight: float) -> tuple[float, float, float]:
    """Logistic curve by Newton steps with a quadratic penalty; clean
    documents count at their weight in the corpus."""
    weight = np.where(toxic == 1, 1.0, clean_weight)
    w = np.zeros(3)
    penalty = np.diag([1e-3, 0.5, 0.5])
    for _ in range(30):
        p = _curve(features, tuple(w))
        gradient = features.T @ (weight * (p - toxic)) + penalty @ w
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + penalty
        w = w - np.linalg.solve(hessian, gradient)
    return tuple(w.tolist())


def fit(texts: list[bytes], toxic: np.ndarray, odds: float | None = None) -> Model:
    """Model of labelled texts (a bounded sample).  ``odds``: toxic per clean
    label in the corpus, if the sample holds them at another ratio."""
    clean = float((toxic == 0).sum())
    clean_weight = toxic.sum() / clean / odds if odds and clean and toxic.any() else 1.0
    rate = (toxic.sum() + PRIOR[0]) / (toxic.sum() + clean_weight * clean + sum(PRIOR))
    model = Model(curve=(float(np.log(rate / (1 - rate))), 0.0, 0.0))
    if not 0 < toxic.sum() < len(toxic):
        return model
    parts = []
    base = 0
    for first, end, data, offsets in buffers(pa.array(texts, pa.binary())):
        doc, _, _, features = tokens(data, offsets)
        parts.append((doc + base, features))
        base += end - first
    doc, features = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    del parts
    single = _one_per_copy(features[:, 0], doc, len(texts))[doc]
    model.marks = _choose_marks(features, doc, toxic, clean_weight, single)
    if not len(model.marks):
        return model
    mark = _mark_of(features, model.marks)
    del features
    label = ((mark >= 0) & (toxic[doc] == 1)).astype(np.int64)
    count = np.bincount(doc, minlength=len(texts))
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    piece = np.cumsum(place % CHUNK == 0) - 1
    shape = (int(piece[-1]) + 1, CHUNK)
    marks, labels = np.full(shape, -2), np.zeros(shape, np.int64)
    marks[piece, place % CHUNK], labels[piece, place % CHUNK] = mark, label
    # Pieces without a mark differ by length only; a bounded part of them
    # keeps the share of plain tokens, every piece with a mark stays.
    some = (marks >= 0).any(axis=1)
    plain = np.flatnonzero(~some)
    some[plain[:: max(1, len(plain) // max(2000, int(some.sum())))]] = True
    model.weights, model.bias, model.transitions = _fit_chain(marks[some], labels[some], len(model.marks))
    at = np.flatnonzero(mark >= 0)
    p = marginals(model, count, doc[at], place[at], mark[at])
    model.curve = _fit_curve(_document_features(len(texts), doc[at], p), toxic, clean_weight)
    return model


def train(docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> Model:
    """Model learned from the labelled rows outside the held-out fold.

    Ids are drawn by hash from the labels first (at most twice the bound of
    each kind, to leave room for copies), so only their texts are read; the
    fit itself runs in one task over that bounded sample."""
    known = (labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic"))
             .filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out(F.col("id")))
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    drawn = F.xxhash64("id")
    sample = (known.filter("toxic = 1").orderBy(drawn, "id").limit(2 * toxic_docs)
              .unionByName(known.filter("toxic = 0").orderBy(drawn, "id").limit(2 * clean_docs)))
    rows = (docs.select(F.col("doc_id").alias("id"), F.col("text"))
            .join(F.broadcast(sample), "id").filter("text IS NOT NULL")
            .groupBy(F.xxhash64("text").alias("copy"))
            .agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")))
    rows = (rows.filter("toxic = 1").orderBy("copy").limit(toxic_docs)
            .unionByName(rows.filter("toxic = 0").orderBy("copy").limit(clean_docs)))

    share = known.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).first()
    odds = share["toxic"] / (share["n"] - share["toxic"]) if share["toxic"] and share["toxic"] < share["n"] else None

    def fit_group(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["copy", "toxic"])
        model = fit([t.encode() for t in group["text"]], group["toxic"].to_numpy(), odds)
        return pd.DataFrame({"marks": [model.marks.tobytes()], "weights": [model.weights.tobytes()],
                             "rest": [np.concatenate([[model.bias], model.transitions.ravel(), model.curve]).tobytes()]})

    found = rows.withColumn("one", F.lit(True)).groupBy("one").applyInPandas(fit_group, "marks binary, weights binary, rest binary").collect()
    if not found:
        rate = PRIOR[0] / sum(PRIOR)
        return Model(curve=(float(np.log(rate / (1 - rate))), 0.0, 0.0))
    rest = np.frombuffer(found[0]["rest"])
    return Model(np.frombuffer(found[0]["marks"], np.uint64), np.frombuffer(found[0]["weights"]), float(rest[0]),
                 rest[1:5].reshape(2, 2), tuple(rest[5:8].tolist()))


# --- scoring --------------------------------------------------------------

def _score_rows(model: Model, keep: list[str], spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in buffers(batch.column("__text")):
                count, doc, place, start, stop, mark = _marked_tokens(data, offsets, model.marks)
                p = marginals(model, count, doc, place, mark)
                score = _curve(_document_features(end - first, doc, p), model.curve)
                columns = [batch.column(c).slice(first, end - first) for c in keep] + [pa.array(score)]
                if spans:
                    hit = np.flatnonzero(p >= 0.5)
                    lists: list[list] = [[] for _ in range(end - first)]
                    for i in hit.tolist():
                        low = int(offsets[doc[i]])
                        before = data[low: start[i]].tobytes().decode("utf-8", "replace")
                        own = data[start[i]: stop[i]].tobytes().decode("utf-8", "replace")
                        lists[doc[i]].append({"start": len(before), "end": len(before) + len(own), "p": float(p[i])})
                    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
                    columns.append(pa.array(lists, kind))
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "score"] + (["spans"] if spans else []))

    return run


def score(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """``row`` (the input row) with ``score`` and, if asked for, ``spans``
    (character offsets of the tokens that are toxic with at least one half)."""
    source = docs.select(F.struct("*").alias("row"), F.col(text).cast("binary").alias("__text"))
    found = [F.expr("array(named_struct('start', 0, 'end', 0, 'p', 0D))").alias("spans")] if spans else []
    schema = source.select("row", F.lit(0.0).alias("score"), *found).schema
    return source.mapInArrow(_score_rows(model, ["row"], spans), schema)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose score is below one half."""
    return score(docs, model).filter("score < 0.5").select("row.*")


# --- query ---------------------------------------------------------------

def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    slim = docs.select("doc_id", F.col("text").alias("text"))
    source = slim.select("doc_id", F.col("text").cast("binary").alias("__text"))
    scored = source.mapInArrow(_score_rows(model, ["doc_id"], False),
                               source.select("doc_id").schema.add("score", "double"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
