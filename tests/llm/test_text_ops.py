"""N-gram join, suffix dedup, packing, token counts, mixing, licence scan."""
import collections
import hashlib
import itertools
import random
import re
import textwrap
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import license_scan, mixing, ngram_join, packing, suffix_dedup, text, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- helpers ----------------------------------------------------------------

@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n,é ", max_size=12), min_size=1, max_size=6))
def test_words_equal_the_pattern(texts):
    data, offsets = text.byte_column(pa.array([t.encode() for t in texts], pa.binary()))
    doc, start, end, h = text.words(data[: offsets[-1]], offsets)
    got = [(int(d), data[a:b].tobytes().decode()) for d, a, b in zip(doc, start, end)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t)]
    name = {}
    for (_, w), x in zip(got, h.tolist()):
        assert name.setdefault(re.sub("[A-Z]", lambda m: m[0].lower(), w), x) == x
    assert len(set(name.values())) == len(name)


# --- n-gram Jaccard join ------------------------------------------------------

def shingles(body):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), body or ""))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def components(rows):
    """Brute force over distinct sets: doc_id -> (set size, smallest id)."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def check_components(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.op4_ngram_jaccard(docs).collect()}
    assert got == components(rows)


def test_ngram_join_equals_brute_force_on_the_table(spark, documents):
    check_components(spark, [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()])


def test_ngram_join_near_groups_beside_common_passages(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(400)]
    base, rows = rng.choices(vocab, k=90), []
    passage = rng.choices(vocab, k=40)
    for i in range(160):  # variants: some link to the base only, some to none
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4])):
            words[rng.randrange(90)] = rng.choice(vocab)
        rows.append((i, " ".join(words)))
    for i in range(160, 260):
        rows.append((i, " ".join(rng.choices(vocab, k=60) + passage)))
    rows += [(260, "one two three"), (261, "ONE two\nthree"), (262, "one two"), (263, ""), (264, None)]
    check_components(spark, rows)


def test_ngram_join_heavy_columns(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "LIGHT", 4)
    monkeypatch.setattr(ngram_join, "BLOCK_ENTRIES", 200)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    check_components(spark, rows)


def test_ngram_join_awkward_rows(spark, awkward, nothing):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.op4_ngram_jaccard(awkward).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 1, None), (5, 3, 5), (6, 3, 5), (8, 19996, 7)} <= got
    assert ngram_join.op4_ngram_jaccard(nothing).count() == 0
    kept = ngram_join.keep_one_per_group(awkward)
    assert kept.columns == awkward.columns and kept.count() == 7  # copies: 5, 5, 6 and 7, 8


# --- suffix dedup -------------------------------------------------------------

def removed(rows, window):
    count = collections.Counter(b[k:k + window] for _, b in rows for k in range(len(b) - window + 1))
    out = []
    for i, b in rows:
        hit = np.zeros(len(b), bool)
        for k in range(len(b) - window + 1):
            if count[b[k:k + window]] > 1:
                hit[k:k + window] = True
        spans = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        kept = np.frombuffer(b, np.uint8)[~hit].tobytes()
        out.append((i, len(b), int(hit.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@settings(max_examples=150, deadline=None)
@given(st.binary(min_size=1, max_size=80) | st.text(alphabet="ab", min_size=1, max_size=80).map(str.encode))
def test_two_stage_suffix_array_equals_sorting(body):
    array = suffix_dedup.SuffixArray(np.frombuffer(body, np.uint8), 100)
    assert array.order.tolist() == sorted(range(len(body)), key=lambda i: body[i:])
    at = array.order
    for a, b, n in zip(at[:-1], at[1:], array.common(at[:-1], at[1:])):
        x, y = body[a:], body[b:]
        assert n == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_suffix_dedup_equals_brute_force_on_the_table(spark, documents):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect()]
    assert collections.Counter(tuple(r)[:5] for r in suffix_dedup.op9_suffix_dedup(documents).collect()) == removed(rows, 400)


@pytest.mark.parametrize("heavy", [1024, 2])
def test_suffix_dedup_passages_copies_and_runs(spark, monkeypatch, heavy):
    original = suffix_dedup.repeated_ranges
    monkeypatch.setattr(suffix_dedup, "repeated_ranges", lambda d, w: original(d, w, heavy=heavy))
    rng = random.Random(heavy)
    letters = lambda n: "".join(rng.choices("abcdé ", k=n))
    passage = letters(500)
    rows = [(i, letters(rng.randrange(300)) + passage[rng.randrange(60):] + letters(rng.randrange(300))) for i in range(40)]
    copy = letters(900)
    rows += [(100, copy), (101, copy), (102, copy[:450] + "X" + copy[450:]), (103, "ab" * 700), (104, "z" * 401), (105, "z" * 400),
             (106, letters(399)), (107, ""), (108, None), (109, copy[200:620])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = removed([(i, (t or "").encode()) for i, t in rows], 400)
    assert collections.Counter(tuple(r)[:5] for r in suffix_dedup.op9_suffix_dedup(docs).collect()) == expected


def test_suffix_dedup_counts_windows_of_heavy_groups_without_a_row_each(spark, monkeypatch):
    """Windows of many different snippets are told by counts in a few packed
    rows, in any number of packs and blocks."""
    rng = random.Random(9)
    body = "".join(rng.choices("abc", k=300))
    texts = [body[rng.randrange(40):][: 60 + rng.randrange(60)].encode() for _ in range(300)]
    texts += ["".join(rng.choices("xyz", k=rng.randrange(50, 90))).encode() for _ in range(20)]
    times = [1 + (i % 50 == 0) for i in range(len(texts))]
    count = collections.Counter()
    for body_, n in zip(texts, times):
        for at in range(len(body_) - 49):
            count[body_[at: at + 50]] += n
    expected = {}
    for i, body_ in enumerate(texts):
        runs = suffix_dedup._merge((at + 7, at + 8) for at in range(len(body_) - 49) if count[body_[at: at + 50]] > 1)
        if runs:
            expected[i] = runs
    frame = spark.createDataFrame([(b"%d" % i, 7, n, bytearray(x)) for i, (x, n) in enumerate(zip(texts, times))],
                                  "name binary, skip int, times long, text binary").repartition(3)
    made, original = [], suffix_dedup.written
    monkeypatch.setattr(suffix_dedup, "written", lambda df, name: made.append(original(df, name)) or made[-1])
    for pack, block in ((1 << 22, 2_000_000), (4_000, 300)):
        monkeypatch.setattr(suffix_dedup, "PACK_BYTES", pack)
        monkeypatch.setattr(suffix_dedup, "BLOCK_HASHES", block)
        found = suffix_dedup.counted_windows(frame, 50).select(F.col("name").cast("string").alias("name"), "lows", "highs")
        got = {int(r["name"]): list(zip(r.lows, r.highs)) for r in found.collect()}
        assert got == expected
    assert made[0].count() <= 3 < made[1].count() < 30


def test_suffix_dedup_long_document_in_segments(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1500)
    body = "".join(rng.choices("abcdefgh ", k=9000))
    body = body + body[1200:2900] + "tail"
    data = np.frombuffer(body.encode(), np.uint8)
    windows = []
    for shift, part, offsets in suffix_dedup._segments(data, np.array([0, len(data)]), 400):
        for _, start, many, off, h, _ in zip(*suffix_dedup.anchors(part, offsets, 400, 64)):
            windows += range(start + shift, start + shift + many)
    assert windows == list(range(len(body) - 399))


def test_suffix_dedup_awkward_rows(awkward, nothing):
    rows = [(r.doc_id, (r.text or "").encode()) for r in awkward.collect()]
    assert collections.Counter(tuple(r)[:5] for r in suffix_dedup.op9_suffix_dedup(awkward).collect()) == removed(rows, 400)
    assert suffix_dedup.op9_suffix_dedup(nothing).count() == 0


# --- packing ------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(docs, rows, tokenizer):
    got = packing.op7_packing(docs).toPandas()
    expected = collections.Counter()
    for i, body in rows:
        ids = tokenizer.encode(body or "", add_special_tokens=False).ids + [1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p:p + 4096], "<u4")
            expected[(i, p // 4096, p, len(part), zlib.crc32(part.tobytes()))] += 1
    ids = [None if i != i else int(i) for i in got.doc_id.tolist()]
    assert collections.Counter(zip(ids, got.piece, got.start, got.length, got.ids_crc32)) == expected
    if len(got):
        ordered = got.sort_values(["sequence_id", "offset"])
        sums = ordered.groupby("sequence_id").length
        assert (sums.cumsum() - ordered.length == ordered.offset).all() and sums.sum().max() <= 4096
    return got


def test_packing_places_every_piece_once(documents, tokenizer):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    got = check_packing(documents, rows, tokenizer)
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 4096) + 1


def test_packing_awkward_rows(awkward, nothing, tokenizer):
    check_packing(awkward, [(r.doc_id, r.text) for r in awkward.collect()], tokenizer)
    assert packing.op7_packing(nothing).count() == 0


def test_packed_sequences_hold_the_ids(documents, tokenizer):
    packed = packing.pack(packing.token_pieces(documents.limit(30), capacity=512, with_ids=True), 512)
    texts = {r.doc_id: r.text for r in documents.collect()}
    for row in packing.packed_sequences(packed).collect():
        assert len(row.ids) <= 512
        for doc, a, b in zip(row.doc_ids, row.starts, [*row.starts[1:], len(row.ids)]):
            ids = tokenizer.encode(texts[doc], add_special_tokens=False).ids + [1]
            assert any(ids[p:p + 512] == row.ids[a:b] for p in range(0, len(ids), 512))


def best_packing(lengths, capacity):
    """Least number of bins, by exhaustive search."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity:
                place(k + 1, bins[:i] + [bins[i] + lengths[k]] + bins[i + 1:])
        place(k + 1, bins + [lengths[k]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_reduction_loses_no_optimum(lengths):
    """What the reduction fixed plus the optimum of the rest is the optimum."""
    lengths = sorted(lengths, reverse=True)
    slots = packing.Slots.__new__(packing.Slots)
    slots.capacity, slots.left = 20, dict(sorted(collections.Counter(lengths).items()))
    slots.used, slots.rows, slots.sequences, slots.fixed = dict.fromkeys(slots.left, 0), [], 0, 0
    while slots._reduce():
        pass
    rest = sorted([n for n, c in slots.left.items() for _ in range(c)], reverse=True)
    assert slots.fixed + best_packing(rest, 20) == best_packing(lengths, 20)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=30))
def test_slots_cover_every_rank_once(counts):
    slots = packing.Slots(counts, 64)
    taken, fill = collections.Counter(), collections.defaultdict(list)
    for length, first, count, sequence, offset in slots.rows:
        for k in range(count):
            taken[(length, first + k)] += 1
            fill[sequence + k].append((offset, length))
    assert taken == collections.Counter({(n, r): 1 for n, c in counts.items() for r in range(c)})
    for items in fill.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(fill) == slots.sequences


# --- token counts ---------------------------------------------------------------

def edited(body, edits):
    for e in sorted(edits, key=lambda e: e["seq"]):
        place = min(max(e["place"] or 0, 0), len(body))
        body = body[:place] + (e["insert"] or "") + body[place + max(e["delete"] or 0, 0):]
    return body


def check_counts(docs, tokenizer):
    trees = token_counts.build(docs).select("row", "tree", F.col("row.edits").alias("edits"))
    rows = token_counts.apply_edits(trees, with_text=True).collect()
    for r in rows:
        before = r.row.text or ""
        after = edited(before, [e.asDict() for e in r.row.edits or []])
        assert r.edited == after and r.chars_after == len(after)
        assert r.tokens_before == len(tokenizer.encode(before, add_special_tokens=False).ids)
        assert r.tokens_after == len(tokenizer.encode(after, add_special_tokens=False).ids)
    return rows


def test_token_counts_after_edits_equal_a_full_count(documents, tokenizer):
    rows = check_counts(token_counts.sample_edits(documents), tokenizer)
    assert sum(r.chars_encoded for r in rows) < sum(r.chars_after for r in rows) / 2


def test_token_counts_many_edits_at_borders(spark, tokenizer):
    rng = random.Random(11)
    pieces = ["word ", "x", " ", "\n", "it's", "don't stop", "é", "", "12", ", ", "漢字", "  "]
    rows = []
    for i in range(25):
        body = "".join(rng.choices(pieces + ["abc def "], k=rng.randrange(0, 400)))
        edits, size = [], len(body)
        for k in range(60):
            insert = "".join(rng.choices(pieces, k=rng.randrange(4)))
            edits.append((k, rng.randrange(-2, size + 9), rng.choice([0, 0, 1, 5, 400]), insert))
        rows.append((i, body, edits))
    docs = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<seq:int,place:long,delete:long,insert:string>>")
    check_counts(docs, tokenizer)


def test_token_counts_edit_log_and_awkward_rows(spark, awkward, nothing, tokenizer):
    log = spark.createDataFrame([(5, 1, 0, 6, "new "), (5, 2, None, None, None), (1, 1, 9, 9, "only this"), (99, 1, 0, 0, "x")],
                                "doc_id long, seq int, place long, delete long, insert string")
    docs = token_counts.with_edits(awkward, "doc_id", log)
    rows = check_counts(docs, tokenizer)
    assert len(rows) == awkward.count()
    assert token_counts.op10_token_counts(awkward).count() == awkward.count()
    assert token_counts.op10_token_counts(nothing).count() == 0


def test_edited_words_are_encoded_together(documents, monkeypatch):
    """The stretches of many documents go through the tokenizer in a few
    calls, not word by word, and sums are right after every group."""
    from ledgerline.llm import tokens
    encoder = tokens.WordEncoder(token_counts.TOKENIZER)
    texts = [r.text for r in documents.select("text").collect() if r.text][:60]
    calls, original = [], encoder._encode_all
    monkeypatch.setattr(encoder, "_encode_all", lambda words: calls.append(len(words)) or original(words))
    docs = []
    for text in texts:
        body = text.encode()
        cells = [token_counts._heaps(np.array([1]), np.array([n]))[1].tolist() for n in (len(text), len(body), 0)]
        doc = token_counts.Document(body, *cells)
        for k in range(3):
            doc.edit(7 * k, 3, "#x1 y'all,")
        docs.append(doc)
    token_counts.settle(docs, encoder)
    assert len(calls) <= 4  # letters and other words, once for a buffer or two
    for doc in docs:
        assert not doc.open
        assert doc.tokens[1] == len(encoder.tokenizer.encode(doc.text(), add_special_tokens=False).ids)


# --- mixing ---------------------------------------------------------------------

def water_fill(sizes, weights, share, cap):
    """Targets by the rule as it is told: share, cut, share the excess again."""
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sizes)}
    capped, left = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in capped]
        total = sum(weight[s] for s in open_)
        target = {s: left * weight[s] / total for s in open_}
        over = [s for s in open_ if target[s] > cap * sizes[s]]
        if not over:
            return {**capped, **target}
        for s in over:
            capped[s] = cap * sizes[s]
            left -= cap * sizes[s]


def test_mixing_targets_and_copies(documents):
    rows = mixing.op6_mixing(documents).join(documents.select("doc_id", "source", "text"), "doc_id").collect()
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in rows}
    sizes = collections.Counter()
    for r in rows:
        assert r.size == words[r.doc_id] and r.taken in (0, r.size, 2 * r.size)
        sizes[r.source] += r.size
    expected = water_fill(dict(sorted(sizes.items())), (3, 1, 2), 1.5, 2)
    taken, largest = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, r.target)
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s] + 1e-6
    again = {(r.doc_id, r.taken) for r in mixing.op6_mixing(documents.repartition(7)).collect()}
    assert again == {(r.doc_id, r.taken) for r in rows}


def test_mixing_awkward_rows(awkward, nothing):
    rows = mixing.op6_mixing(awkward).collect()
    assert len(rows) == awkward.count() and mixing.op6_mixing(nothing).count() == 0
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    size = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert size == sum(r.taken for r in rows)


# --- licence scan ---------------------------------------------------------------

def test_licence_rules_in_order(spark):
    apache = ("# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in "
              "compliance with the License.\n# You may obtain a copy of the License at\n#\n# Unless required by applicable law or "
              "agreed to in writing,  software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
              "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n# See the License for the specific language "
              "governing permissions and limitations under the License.\n")
    gpl = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied"
    rows = [(1, "Prose. Released under the MIT License. More prose."), (2, apache), (3, apache.replace("Unless", "Except") + "All rights reserved"),
            (4, "Licensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0."), (5, gpl), (6, None), (7, ""), (8, "the mit license")]
    got = {r.doc_id: (r.licences, r.n_matches, r.unmatched) for r in
           license_scan.op1_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ("MIT", 1, "") and got[2] == ("Apache-2.0", 1, "") and got[4] == ("CC-BY-NC-4.0", 2, "")
    assert got[3] == ("Apache-2.0,Proprietary", 2, "<APACHE2-USE><APACHE2-COPY><APACHE2-SEE>")
    assert got[5] == got[6] == got[7] == got[8] == ("", 0, "")


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED."""
APACHE = """Copyright 2020 Somebody

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2")


@pytest.mark.parametrize("width", [38, 72, 10_000])
@pytest.mark.parametrize("mark,end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("// ", "\r")])
def test_licence_notices_are_found_hard_wrapped(spark, width, mark, end):
    def wrapped(notice):
        lines = [line for part in notice.split("\n\n") for line in [*textwrap.wrap(part, width, break_long_words=False), ""]]
        return end.join(mark + line for line in lines)

    notices = {"MIT": MIT, "BSD-2-Clause": BSD, "Apache-2.0": APACHE, "GPL-3.0-or-later": GPL3, "GPL-2.0-or-later": GPL2}
    rows = [(k, wrapped(notice)) for k, notice in enumerate(notices.values())]
    rows += [(5, wrapped(MIT) + end + wrapped(GPL2)), (6, wrapped("Released under\n\nthe MIT License.")),
             (7, wrapped("Released. under the MIT License")), (8, f"a line{end}{mark}All rights reserved{end}{mark}another line")]
    got = {r.doc_id: (r.licences, r.n_matches, r.unmatched) for r in
           license_scan.op1_license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(5)] == [(name, 1, "") for name in notices]
    assert got[5] == ("GPL-2.0-or-later,MIT", 2, "") and got[6] == got[7] == ("", 0, "") and got[8] == ("Proprietary", 1, "")


def test_licence_sentences_hide_no_other():
    names = {s: name for name, sentences in license_scan.SENTENCES.items() for s in sentences}
    assert all(names[a] == names[b] for a in names for b in names if f" {a} " in f" {b} ")


def test_licence_scan_is_native_and_takes_awkward_rows(awkward, nothing):
    out = license_scan.op1_license_scan(awkward)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    assert out.count() == awkward.count() and license_scan.op1_license_scan(nothing).count() == 0


def test_mixing_is_native(documents):
    plan = mixing.op6_mixing(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_stage_cuts_passages_of_fifty_words(spark):
    """A passage of 52 words (below the operator's 400 bytes) goes wherever it
    stands; documents without it stay as they are."""
    from ledgerline.llm import stages

    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(n))
    passage = prose(52)
    assert 256 < len(passage) < 400
    rows = [(i, f"{prose(60)} {passage} {prose(30)}" if i % 5 == 0 else prose(100), "s", 1) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    got = {r.doc_id: r for r in stages.cut_repeats(spark, docs, "").collect()}
    for i, text, _, _ in rows:
        if i % 5:
            assert got[i].text == text and got[i].n_chars == 1
        else:
            assert passage[10:-10] not in got[i].text and got[i].n_chars == len(got[i].text) < len(text) - len(passage) + 3


def test_remembered_words_keep_their_ids_when_the_memory_is_small(documents, monkeypatch):
    """Ids equal the tokenizer's on whole texts, also while words are dropped
    from memory and met again."""
    from ledgerline.llm import tokens

    encoder = tokens.WordEncoder("word_bpe_49k.json")
    texts = [(r.text or "") for r in documents.select("text").limit(60).collect()] + ["", " \n", "İstanbul ŞŞ. <|im_end|> x,", "a. a, A. ,."]
    expected = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    for keep, cores in ((1_500_000, 250_000), (300, 50)):
        monkeypatch.setattr(tokens, "KEEP", keep)
        monkeypatch.setattr(tokens, "CORES", cores)
        encoder = tokens.WordEncoder("word_bpe_49k.json")
        for _ in range(2):
            for part in (texts[:20], texts[20:45], texts[45:]):
                raw = [t.encode() for t in part]
                flat, counts = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 1)
                got = np.split(flat, np.cumsum(counts)[:-1])
                assert [g.tolist() for g in got] == [expected[texts.index(t)] for t in part]
