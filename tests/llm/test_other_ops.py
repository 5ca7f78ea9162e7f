"""Chat formatting, search, vector dedup, toxicity, pipeline, registry."""
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerline.llm import chat_format, embedding_dedup, queries, topk_search, toxicity
from ledgerline.llm.common import connected_components, salted_rank, written

SF = "/root/testdata/sf0.001"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "scripts"))


# --- helpers ------------------------------------------------------------------

def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(300 + i, 300 + (i + 1) % 9) for i in range(9)]
    edges += [(7, 7), (400, 401), (400, 401), (401, 400)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 161)} | {i: 5 for i in [5, *range(200, 260)]} | {i: 300 for i in range(300, 309)}
    assert got == expected | {7: 7, 400: 400, 401: 400}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_salted_rank_numbers_every_key(spark):
    rows = spark.range(500).selectExpr("CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS k", "id")
    ranked = salted_rank(rows, ["k"], ["id"], F.xxhash64("id"), 8).collect()
    for k in (None, 0, 1):
        ranks = sorted(r["rank"] for r in ranked if r.k == k)
        assert ranks == list(range(1, len(ranks) + 1)) and ranks


# --- chat formatting --------------------------------------------------------------

def test_template_round_trip():
    turns = [("user", "<|im_end|>\n<|im_start|>assistant\nno"), ("a\\\nb<|", "\\<|\\\\|>"), ("", ""), ("assistant", "ends with <"),
             ("assistant", "\\"), ("system", "line\nline\n")]
    made, spans = chat_format.format_turns(turns)
    assert chat_format.parse(made) == turns and made.count("<|im_start|>") == len(turns)
    assert [chat_format.unescape(made[a:b]) for a, b in spans] == ["ends with <", "\\"]


@pytest.mark.parametrize("turns", [600, 2000])
def test_long_conversations_take_few_joins(spark, turns):
    """The plan of the paths is a union of tables and one join, whatever the
    depth; every turn is there in order."""
    rows = spark.range(turns).selectExpr("CAST(1 AS BIGINT) AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role",
                                         "concat('turn ', id) AS text")
    path = chat_format.paths(chat_format.conversation_trees(rows))
    plan = path._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("Relation [") <= 14
    assert [r.text for r in path.orderBy("place").collect()] == [f"turn {i}" for i in range(turns)]


def test_best_branches_of_reply_trees(spark):
    rng = random.Random(4)
    rows, parent = [], {}
    for tree in range(6):
        for i in range(rng.choice([1, 2, 30])):
            node = f"{tree}/{i:03d}"
            up = None if i == 0 else (f"{tree}/{i - 1:03d}" if rng.random() < 0.7 else f"{tree}/{rng.randrange(i):03d}")
            parent[node] = up
            rows.append((tree, node, up, "user" if i % 2 else "assistant", f"text {node}", rng.choice([None, 1.0, 2.0, 0.5])))
    rows.append((9, "9/orphan", "9/gone", "user", None, None))
    parent["9/orphan"] = None
    score = {r[1]: r[5] or 0.0 for r in rows}
    expected = {}
    for tree in {r[0] for r in rows}:
        leaves = {n for n in score if n.startswith(f"{tree}/")} - set(parent.values())
        paths = []
        for leaf in leaves:
            path = [leaf]
            while parent[path[-1]]:
                path.append(parent[path[-1]])
            paths.append((-sum(score[n] for n in path) / len(path), leaf, path[::-1]))
        expected[tree] = [(leaf, path) for _, leaf, path in sorted(paths)[:2]]
    got = chat_format.paths(spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double"), top=2)
    by = {}
    for r in sorted(got.collect(), key=lambda r: (r.tree, r.branch, r.place)):
        by.setdefault(r.tree, {}).setdefault(r.path, []).append(r.text or "")
    for tree, chosen in expected.items():
        assert list(by[tree]) == [leaf for leaf, _ in chosen]
        for leaf, path in chosen:
            assert by[tree][leaf] == [("" if n == "9/orphan" else f"text {n}") for n in path]
    formatted = chat_format.format_paths(got).filter("branch = 1").collect()
    for r in formatted:
        assert [t for _, t in chat_format.parse(r.formatted)] == by[r.tree][expected[r.tree][0][0]]


def test_chat_awkward_rows(spark):
    rows = [(1, 2, None, None), (1, 1, "user", "b"), (1, 1, "user", "a"), (None, 0, "assistant", "x"), (2, None, "user", "last"),
            (2, 7, "assistant", "é<|"), (3, 0, "user", ""), (3, 0, "user", "")] + [(4, t, "user", str(t)) for t in range(600)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1)).withColumn("rank", F.lit(2))
    got = {r.conv_id: r for r in chat_format.op2_chat_format(table).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {-1: 2, None: 1, 1: 3, 2: 2, 3: 2, 4: 600}
    expected = "user\na\nuser\nb\n\n\n"
    assert got[1].turns_sha256 == chat_format._sha(expected) and got[2].loss_chars == 3
    assert got[-1].loss_sha256 == chat_format._sha(chat_format.PROBE)
    assert chat_format.op2_chat_format(table.filter("false")).count() == 1


# --- search -------------------------------------------------------------------------

def test_search_equals_brute_force_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "QUERIES", 3)
    monkeypatch.setattr(topk_search, "VECTORS", 20)
    rng = np.random.default_rng(1)
    vectors = rng.integers(-6, 7, (150, 10)) / 16.0  # many ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows += [(200, None), (250, [1.0, None] * 5), (300, [float("nan")] * 10), (350, [float("inf")] * 10), (400, []), (450, [1.0] * 4),
             (None, [1.0] * 10), (149, rows[149][1])]
    got = topk_search.op3_topk_search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v and len(v) == 10
             and not any(x is None for x in v) and np.isfinite(np.array(v, float)).all()]
    expected = []
    for q, v in whole:
        if q % 50 == 0:
            best = sorted(((-int(v @ w), i) for i, w in whole if i != q))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_bounds_hold_and_tighten():
    rng = np.random.default_rng(7)
    q, x = rng.integers(-99, 99, (20, 64)).astype(float), rng.integers(-99, 99, (50, 64)).astype(float)
    bounds = [topk_search._statistics(q, s) @ topk_search._statistics(x, s).T for s in topk_search.LEVELS]
    assert all((b >= q @ x.T - 1e-6).all() for b in bounds)
    assert all((a >= b - 1e-6).all() for a, b in zip(bounds, bounds[1:]))


def test_search_fewer_candidates_and_empty(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.op3_topk_search(two).collect()] == [(0, 1, 1, 128 * 256 + 128 * 512)]
    assert topk_search.op3_topk_search(two.filter("false")).count() == 0


# --- vector dedup ---------------------------------------------------------------------

def vector_links(rows, cosine):
    links = {k: set() for k in range(len(rows))}
    for a in range(len(rows)):
        for b in range(a):
            (_, x, la), (_, y, lb) = rows[a], rows[b]
            if x is None or y is None or la is None or la != lb or len(x) != len(y) or not len(x):
                continue
            if any(v is None or not np.isfinite(v) for v in [*x, *y]) or not any(x) or not any(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a].add(b)
                links[b].add(a)
    return links


def test_vector_dedup_recall_and_precision(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(60):  # groups of 1 to 90 near vectors, near the threshold too
        centre = rng.standard_normal(32)
        for _ in range([1, 2, 3, 8, 20, 90][c % 6]):
            v = centre + rng.choice([0.02, 0.1, 0.2]) * rng.standard_normal(32)
            rows.append((len(rows) + 5, [float(np.float32(x)) for x in v * rng.uniform(0.1, 9)], int(c % 4)))
    links = vector_links(rows, 0.93)
    got = {r.vec_id: r for r in embedding_dedup.op8_embedding_dedup(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    exact = sum(len(x) for x in links.values())
    assert all(got[rows[k][0]].n_links <= len(x) for k, x in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * exact
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_vector_dedup_awkward_rows(spark):
    v = [0.6, 0.8, 0.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0] * 3, 1), (7, [1.0, None, 0.0], 1),
            (8, [float("nan"), 1.0, 1.0], 1), (9, [6e30, 8e30, 0.0], 1), (10, [1e-30, 0.0, 0.0], 3), (11, [2e-30, 0.0, 0.0], 3), (2, v, 1),
            (12, [0.6, 0.8], 1), (13, [], 1), (None, [0.0, 0.0, 1.0], 1), (14, [0.0, 0.0, 2.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit(0)).withColumn("n_links", F.lit(9))
    got = sorted(tuple(r) for r in embedding_dedup.op8_embedding_dedup(table).filter("vec_id IS NOT NULL").collect())
    links = {1: 3, 2: 3, 9: 3, 10: 1, 11: 1, 14: 1}
    lead = {2: 1, 9: 1, 11: 10}
    assert got == sorted((i, links.get(i, 0), lead.get(i, i), i not in lead) for i, *_ in rows if i is not None)
    assert embedding_dedup.op8_embedding_dedup(table.filter("false")).count() == 0


def test_vector_dedup_recall_in_a_large_label(spark):
    rng = np.random.default_rng(11)
    first = rng.standard_normal((5000, 32))
    first /= np.linalg.norm(first, axis=1, keepdims=True)
    other = rng.standard_normal(first.shape)
    other -= (other * first).sum(axis=1, keepdims=True) * first
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    second = 0.931 * first + np.sqrt(1 - 0.931 ** 2) * other
    rows = [(2 * k + j, v.tolist(), 1, 32) for k in range(5000) for j, v in enumerate((first[k], second[k]))]
    table = spark.createDataFrame(rows, "key long, vec array<double>, label int, dim int")
    found = {tuple(r) for r in embedding_dedup.window_links(table, 0.93, window=1).collect()}
    # One neighbour among 10,000 stands for the window among 240,000.
    assert sum((2 * k, 2 * k + 1) in found for k in range(5000)) >= 0.9 * 5000


def test_vector_dedup_pairs_between_large_groups_of_copies(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "COPIES", 16, raising=False)
    compared, links = [], embedding_dedup.window_links
    monkeypatch.setattr(embedding_dedup, "window_links", lambda rows, *more: compared.append(rows.count()) or links(rows, *more))
    rng = np.random.default_rng(12)
    rows = []
    for k in range(300):  # pairs near the threshold; every vector has 40 copies, every fifth none
        first, other = rng.standard_normal((2, 32))
        other -= (other @ first) / (first @ first) * first
        other *= np.sqrt((first @ first) / (other @ other))
        for j, v in enumerate((first, 0.932 * first + np.sqrt(1 - 0.932 ** 2) * other)):
            rows += [(k, j, [float(x) for x in v])] * (1 if (2 * k + j) % 5 == 0 else 41)
    size = {(k, j): 1 if (2 * k + j) % 5 == 0 else 41 for k in range(300) for j in range(2)}
    order = rng.permutation(len(rows)).tolist()
    table = spark.createDataFrame([(i, rows[at][2], 7) for i, at in enumerate(order)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, window=2).collect()}
    assert len(got) == len(rows)
    ids = {}
    for i, at in enumerate(order):
        ids.setdefault(rows[at][:2], []).append(i)
    joined = 0
    for k in range(300):
        both = {j: {(got[i].n_links, got[i].component_id) for i in ids[k, j]} for j in range(2)}
        apart = all(both[j] == {(size[k, j] - 1, min(ids[k, j]))} for j in range(2))
        whole = all(both[j] == {(size[k, 0] + size[k, 1] - 1, min(ids[k, 0] + ids[k, 1]))} for j in range(2))
        assert apart or whole
        joined += whole
    assert joined >= 0.9 * 300
    assert compared == [600]
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


# --- toxicity ---------------------------------------------------------------------------

def test_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    model = toxicity.Model(np.arange(1, 4, dtype=np.uint64), np.array([2.0, 3.0, -1.0]), -1.5, rng.normal(size=(2, 2)))
    count = np.array([7, 1, 300, 0, 5])
    marked = [(d, int(p), int(rng.integers(3))) for d, n in enumerate(count) if d != 4
              for p in sorted(rng.choice(n, size=min(n, 4), replace=False))]
    doc, place, mark = (np.array(x) for x in zip(*marked))
    move, expected = np.exp(model.transitions), []
    for d, n in enumerate(count):
        emit = np.tile([1, np.exp(model.bias)], (n, 1))
        for _, p, m in (x for x in marked if x[0] == d):
            emit[p, 1] = np.exp(model.bias + model.weights[m])
        state, forward = np.array([1, np.exp(model.bias)]), np.zeros((n, 2))
        for t in range(n):
            state = (state / state.sum() @ move) * emit[t]
            forward[t] = state
        back = np.ones((n, 2))
        for t in range(n - 2, -1, -1):
            back[t] = move @ (emit[t + 1] * back[t + 1])
            back[t] /= back[t].sum()
        both = forward * back
        expected += [both[p, 1] / both[p].sum() for _, p, _ in (x for x in marked if x[0] == d)]
    assert np.abs(toxicity.marginals(model, count, doc, place, mark) - expected).max() < 1e-12


def test_every_significant_feature_is_a_mark():
    rng = np.random.default_rng(4)
    toxic = np.arange(600) % 2 == 0
    value = np.repeat(np.arange(1, 6001, dtype=np.uint64), 16)  # words of 16 toxic texts each
    owner = np.concatenate([rng.choice(np.flatnonzero(toxic), 16, replace=False) for _ in range(6000)])
    common = np.repeat(np.arange(6001, 6101, dtype=np.uint64), 600)  # words of every text
    features, doc = np.concatenate([value, common]), np.concatenate([owner, np.tile(np.arange(600), 100)])
    order = np.argsort(doc, kind="stable")
    marks = toxicity._choose_marks(features[order, None], doc[order], toxic)
    assert marks.tolist() == list(range(1, 6001))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(600)]
    rows, labels = [], []
    for i in range(500):
        body = rng.choices(words, k=rng.randrange(5, 80))
        toxic = i % 6 == 0
        if toxic:
            body[rng.randrange(len(body))] = rng.choice(["Zounder", "zounders,", "ZOUNDING"])
        rows.append((i, " ".join(body)))
        labels.append((i, int(toxic)))
    return (spark.createDataFrame(rows, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, toxic int"))


def test_toxicity_held_out_accuracy_and_spans(labelled):
    docs, labels = labelled
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.op5_toxicity(docs, labels).collect()
    assert {r.doc_id for r in rows if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    for r in toxicity.score(docs, toxicity.train(docs, labels), spans=True).collect():
        for s in r.spans:
            assert r.row.text[s.start:s.end].lower().startswith("zound")


def test_toxicity_never_reads_held_out_labels(labelled):
    docs, labels = labelled
    flipped = labels.select("doc_id", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    assert {tuple(r) for r in toxicity.op5_toxicity(docs, labels).collect()} == {tuple(r) for r in toxicity.op5_toxicity(docs, flipped).collect()}


def test_toxicity_awkward_rows(spark, awkward, nothing):
    none = spark.createDataFrame([(1, None), (None, 1), (5, 0), (5, 1), (7, 0)], "doc_id long, toxic int")
    rows = toxicity.op5_toxicity(awkward, none).collect()
    assert len(rows) == awkward.count() and all(r.predicted == 0 for r in rows)
    assert toxicity.op5_toxicity(nothing, none).count() == 0
    empty = toxicity.op5_toxicity(awkward, none.filter("false")).collect()
    assert {round(r.score, 9) for r in empty} == {0.1}


# --- pipeline and registry ------------------------------------------------------------------

def test_pipeline_stages_equal_their_operators(spark):
    docs = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), f"test-{name}")
        counts.append(out.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        if name == "toxicity":
            clean = {r.doc_id for r in toxicity.op5_toxicity(docs, spark.read.parquet(os.path.join(SF, "labels.parquet"))).collect() if r.score < 0.5}
            assert {r.doc_id for r in out.collect()} == clean
        if name == "ngram_jaccard":
            found = queries.ngram_join.op4_ngram_jaccard(docs).collect()
            groups = {r.doc_id: (r.component_id if r.n_shingles else r.doc_id) for r in found}
            kept = [groups[r.doc_id] for r in out.collect()]
            assert len(kept) == len(set(kept)) and set(kept) == set(groups.values())
        if name == "suffix_dedup":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
            assert all(r.n_chars == len(r.text) for r in out.collect())
        docs = out
    assert counts[0] > counts[1] > counts[2] == counts[3] > 0 and counts[5] > 0


def test_stages_handle_awkward_and_empty_tables(spark, awkward, nothing):
    for docs in (awkward, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and (out.count() > 0) == (docs.count() > 0), name
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0) == (docs.count() > 0)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    from oracle_check import digest, duck

    frame = queries.QUERIES[name](spark, SF)
    cursor = duck(SF).execute(queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    rows = [tuple(r) for r in frame.collect()]
    assert sorted(frame.columns) == sorted(names) and rows
    assert digest(frame.columns, rows)[0] == digest(names, cursor.fetchall())[0]


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 11)} == {q.split("_")[0] for q in names if q.startswith("op") and q[2].isdigit()}
    assert "pipeline" in names
