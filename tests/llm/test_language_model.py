"""Language-model scoring: counts against brute force, the network against a
plain loop, held-out quality."""
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ledgerline.llm import gru, language_model, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def _tokens(text):
    return WORD.findall((text or "").translate(UPPER)) + [None]


def _base(rows):
    """(doc_id, held out, tokens, known, N, base) of every row, sorted."""
    counts = Counter()
    for doc_id, text in rows:
        if zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 != 2:
            counts.update(_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        tokens = _tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((doc_id, zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2, len(tokens),
                    sum(counts[t] > 0 for t in tokens), n, base))
    return sorted(out, key=lambda r: (r[0] is not None, r))


def _check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in language_model.op11_lm_score(df).collect()), key=lambda r: (r[0] is not None, r))
    expected = _base(rows)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert [g[5] for g in got] == pytest.approx([e[5] for e in expected], rel=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    return got


def test_counts_and_base_equal_brute_force(documents):
    _check(documents)


def test_awkward_rows(awkward):
    _check(awkward)


def test_only_held_out_rows(spark, documents):
    held = documents.filter("crc32(CAST(doc_id AS STRING)) % 7 = 2").limit(20)
    got = _check(held)
    assert all(g[4] == 0 and g[5] == 0.0 for g in got)


def test_empty_table(nothing):
    assert language_model.op11_lm_score(nothing).count() == 0


def test_chunks_and_blocks_of_any_size(spark, documents, monkeypatch):
    """Small chunks and blocks count as large ones do."""
    from pyspark.sql import functions as F
    monkeypatch.setattr(language_model, "BLOCK_ENTRIES", 500)
    parts = language_model.chunks(documents, F.lit(False), chunk_bytes=20_000)
    counts = language_model.counted(parts)
    vocabulary = language_model.Vocabulary.of(counts)
    words = Counter(t for r in documents.select("text").collect() for t in _tokens(r.text))
    assert parts.count() > 5 and counts.filter("chunk IS NULL").count() > 20
    assert (vocabulary.tokens, vocabulary.words) == (sum(words.values()), len(words))
    ends = words.pop(None)
    top = sorted(words.values(), reverse=True)
    assert vocabulary.head_counts.tolist() == [ends, *top[: gru.HEAD - 1]]
    rest = sum(top[gru.HEAD - 1:])
    assert vocabulary.mass.sum() == rest and vocabulary.unseen.sum() == rest and vocabulary.mass.min() >= 0


def test_every_training_token_is_learned_from_once(spark, documents, monkeypatch):
    """The trainers' tokens over all rounds are the training tokens, whatever
    the chunks and buffers; none comes from a held-out document."""
    monkeypatch.setattr(language_model, "BUFFER_TOKENS", 3_000)
    learned, original = [], language_model.averaged

    def spy(trained, net):
        learned.append(trained.filter("part = 0").agg({"tokens": "sum"}).first()[0] or 0)
        return original(trained, net)

    monkeypatch.setattr(language_model, "averaged", spy)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    train_tokens = language_model.op11_lm_score(documents).first().train_tokens
    assert len(learned) == language_model.ROUNDS and min(learned) > 0
    assert sum(learned) == train_tokens == _base(rows)[0][4]


def test_learned_codes_leave_the_token_out(spark):
    """A word is learned in the band of its count without the token itself."""
    from pyspark.sql import functions as F
    texts = [f"w{i} " * times for i, times in enumerate([1, 2, 3, 4, 16, 17, 128, 129])]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    parts = language_model.chunks(frame, F.col("doc_id") == 1)
    counts = language_model.counted(parts)
    vocabulary = language_model.Vocabulary.of(counts)
    vocabulary.head, vocabulary.head_counts = vocabulary.head[:1], vocabulary.head_counts[:1]  # all words in classes
    vocabulary.mass[:] = 1
    row = language_model.coded(parts, counts, vocabulary).first()
    got = [t for turn in range(3) for t in language_model.texts_of(row.held, row.sizes, bytes(row.codes), bytes(row.falls), turn, 3)]
    bands = sorted((len(t) - 1, int(t[0] - gru.HEAD) % language_model.N_BANDS, int(t[-1])) for t in got)
    assert bands == [(n, int(language_model.bands(np.array(n - 1))), 0) for n in (1, 3, 4, 16, 17, 128, 129)]


# --- network -----------------------------------------------------------------

def _network(seed=3):
    net = gru.Network(language_model.TAIL)
    return net.load(np.random.default_rng(seed).normal(0, 0.4, net.size).astype(np.float32))


def _plain(net, codes):
    """Log probability of one text, token by token."""
    h, state, total, before = gru.HIDDEN, np.zeros(gru.HIDDEN), 0.0, 0
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    for code in codes:
        a, s = net.enter[before].astype(float), state @ net.recur.astype(float)
        reset, keep = sigmoid(a[:h] + s[:h]), sigmoid(a[h: 2 * h] + s[h: 2 * h])
        state = (1 - keep) * np.tanh(a[2 * h:] + reset * s[2 * h:]) + keep * state
        groups = state @ net.group + net.group_bias
        at = code // gru.WIDTH if code < gru.HEAD else code - gru.HEAD + gru.GROUPS
        total += groups[at] - np.log(np.exp(groups).sum())
        if code < gru.HEAD:
            inside = state @ net.word[at] + net.word_bias[at]
            total += inside[code % gru.WIDTH] - np.log(np.exp(inside).sum())
        before = code
    return total


def test_scores_equal_a_plain_loop_across_windows():
    rng, net = np.random.default_rng(5), _network()
    sizes = np.array([1, 3, 500, 64, 65, 2, 130] + [7] * 200)
    codes = rng.integers(0, gru.HEAD + language_model.TAIL, sizes.sum()).astype(np.uint16)
    got = gru.score(net, codes, sizes)
    first = np.cumsum(sizes) - sizes
    for i in [0, 1, 2, 3, 4, 5, 6, 7, 100, 206]:
        assert got[i] == pytest.approx(_plain(net, codes[first[i]: first[i] + sizes[i]].tolist()), rel=1e-4)
    assert len(gru.score(net, codes[:0], sizes[:0])) == 0


def test_first_token_probabilities_sum_to_one():
    n = gru.HEAD + language_model.TAIL
    assert np.exp(gru.score(_network(), np.arange(n).astype(np.uint16), np.ones(n, np.int64))).sum() == pytest.approx(1, abs=1e-3)


def test_training_learns_order_beyond_a_window():
    """Texts repeat a cycle of words that a model without state cannot tell."""
    cycle = np.array([5, 900, 5, 70, 5, gru.HEAD + 9, 0], np.uint16)
    sizes = np.full(300, 70)
    codes = np.concatenate([np.roll(np.tile(cycle, 10), i % 7) for i in range(300)])
    counts = np.bincount(codes, minlength=gru.HEAD + language_model.TAIL)
    net = gru.Network(language_model.TAIL).start(counts[: gru.HEAD], counts[gru.HEAD:])
    before = gru.score(net, codes, sizes).sum()
    for _ in range(2):
        gru.train(net, codes, sizes)
    assert gru.score(net, codes, sizes).sum() > 0.25 * before  # log probabilities are negative


def test_a_window_takes_one_softmax_for_all_groups(monkeypatch):
    """Each softmax runs over all words of a window at once, whatever the
    number of their groups (one call per group took a quarter of the time)."""
    calls = {"_soft": 0, "_picked": 0}

    def spied(name, original):
        def run(*args):
            calls[name] += 1
            return original(*args)
        return run

    for name in calls:
        monkeypatch.setattr(gru, name, spied(name, getattr(gru, name)))
    codes = np.tile(np.arange(0, gru.HEAD + language_model.TAIL, 7), 4).astype(np.uint16)  # all groups, and rarer classes
    sizes = np.full(40, len(codes) // 40)
    codes = codes[: sizes.sum()]
    gru.score(_network(), codes, sizes)
    assert calls["_picked"] == 2 * -(-int(sizes[0]) // gru.SCORE_WINDOW)
    _, tokens = gru.train(_network(), codes, sizes)
    longest = int(sizes[0]) * -(-len(sizes) // gru.TRAIN_LANES[0])
    assert tokens == len(codes) and calls["_soft"] == 2 * -(-longest // gru.TRAIN_WINDOW)


def test_slopes_equal_differences_of_a_plain_loop(monkeypatch):
    """The slopes of one window, lanes of unequal length among them, against
    the loss of a plain loop with a single weight moved."""
    rng, net, found = np.random.default_rng(7), _network(), {}
    sizes = np.array([9, 1, 14, 5, 3] + [6] * 30)
    codes = rng.integers(0, gru.HEAD + language_model.TAIL, sizes.sum()).astype(np.uint16)
    codes[rng.integers(0, len(codes), 60)] = rng.integers(0, 3 * gru.WIDTH, 60)  # some codes occur often
    first = np.cumsum(sizes) - sizes

    def keep(self, name, grad, rows=None):
        found[name] = (grad.copy(), rows)

    monkeypatch.setattr(gru.Trainer, "_step", keep)
    loss, tokens = gru.train(net, codes, sizes)
    texts = [codes[a: a + n].tolist() for a, n in zip(first, sizes)]

    def mean():
        return -sum(_plain(net, t) for t in texts) / len(codes)

    assert tokens == len(codes) and loss / tokens == pytest.approx(mean(), rel=1e-4)
    denter, rows = found["enter"]
    slopes = {"recur": found["recur"][0], "group": found["group_all"][0][: gru.HIDDEN], "group_bias": found["group_all"][0][gru.HIDDEN],
              "word": found["word_all"][0][:, : gru.HIDDEN], "word_bias": found["word_all"][0][:, gru.HIDDEN], "enter": np.zeros_like(net.enter)}
    slopes["enter"][rows] = denter
    for name, slope in slopes.items():
        values = getattr(net, name)
        largest = np.argsort(-np.abs(slope).ravel())[:200]
        for at in [np.unravel_index(i, slope.shape) for i in rng.choice(largest, 4, replace=False)]:
            kept = values[at]
            values[at] = kept + np.float32(0.01)
            more, up = mean(), float(values[at])
            values[at] = kept - np.float32(0.01)
            less, down = mean(), float(values[at])
            values[at] = kept
            assert slope[at] == pytest.approx((more - less) / (up - down), rel=0.02, abs=2e-6)


def test_sums_of_rows_by_code():
    rng = np.random.default_rng(11)
    for codes in (rng.integers(0, 40, 3000), (rng.pareto(0.6, 3000) * 3).astype(np.int64).clip(0, 2000), np.arange(5), np.zeros(30, np.int64)):
        values = rng.normal(size=(len(codes), 6)).astype(np.float32)
        expected = np.zeros((2001, 6))
        np.add.at(expected, codes, values)
        found, sums = gru._sums(codes.astype(np.uint16), values)
        assert sorted(found.tolist()) == sorted(set(codes.tolist()))
        assert np.abs(expected[found] - sums).max() < 1e-3


def test_held_out_documents_score_above_the_base(spark):
    rows = queries.QUERIES["op11_lm_score"](spark, "/root/testdata/sf0.01").filter("held_out").collect()
    better = sum(r.score > r.base_score for r in rows) / len(rows)
    gain = sum(r.score - r.base_score for r in rows) / sum(r.n_tokens for r in rows)
    assert len(rows) > 100 and better > 0.85 and gain > 0.15
