"""Conversation structure repair and conversation prefix trie."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerline.llm import prefix_trie, queries, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, a long
    conversation, a common first turn, negative and far ids."""
    rng = random.Random(7)
    rows = []
    for conv in [*range(0, 40), 100, 101, 205, 2**60 + 3, -7]:
        for turn in range(rng.choice([1, 1, 2, 4, 7])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Hi.", "Why?", "no end", "", None, " \t\n", "ünï 漢字!", "Stop. \x0b"])
            rows.append((conv, turn if rng.random() < 0.9 else None, "user" if turn == 0 else role, "Hello." if turn == 0 else text))
    rows += [rows[3], rows[3], (5, 2, "user", "tie b"), (5, 2, "user", "tie a"), (None, 1, "user", "lost."), (None, None, None, None)]
    rows += [(77, t, ("user", "assistant")[t % 2] if t % 11 else "system", f"turn {t % 50}" + "." * (t % 7 > 0)) for t in range(90)]
    rows += [(78, t, ("user", "assistant")[t % 2], "x" * 30_000 if t == 3 else f"turn {t % 50}.") for t in range(60)]
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).selectExpr(
        "*", "1 AS place", "2 AS slice", "3 AS id", "4 AS size", "5 AS x1", "6 AS band", "7 AS depth", "8 AS fault", "9 AS harm", "10 AS of")


# --- repair -----------------------------------------------------------------

def _edits(symbols):
    """Least (cost, audit) by states of the grammar, three inserts anywhere."""
    def inserts(state, cost, audit):
        yield state, cost, audit
        for _ in range(3):
            state, cost, audit = 2 if state == 3 else 3, cost + 3, audit + "I"
            yield state, cost, audit

    best = {0: (0, "")}
    for x in symbols:
        new = {}

        def offer(state, cost, audit):
            if state not in new or (cost, audit) < new[state]:
                new[state] = (cost, audit)

        for now, (paid, done) in best.items():
            for state, cost, audit in inserts(now, paid, done):
                offer(state, cost + 4, audit + "D")
                if x == "x":
                    continue
                stay = 3 * x.isupper()
                want, then = ("a", 2) if state == 3 else ("u", 3)
                offer(then, cost + stay + 3, audit + "R")
                if x.lower() == want:
                    offer(then, cost + stay, audit + "K")
                if x.lower() == "s" and state == 0:
                    offer(1, cost + stay, audit + "K")
        best = new
    return min((cost, audit) for now, (paid, done) in best.items() for state, cost, audit in inserts(now, paid, done) if state in (0, 2))


def test_alignment_of_slices_equals_all_repairs():
    rng = random.Random(1)
    for n in [*range(1, 9)] * 60 + [30, 80] * 6:
        pool = rng.choice(["uaUAsx", "uuaas", "ua", "uaSsoOxUA", "x", "xs", "suax", "uaoO"])
        symbols = "".join(rng.choice(pool) for _ in range(n))
        size = rng.choice([1, 2, 3, 7, 256])
        options = [turn_repair.align(symbols[i: i + size]) for i in range(0, n, size)]
        cost, taken, closing = turn_repair.choose(options)
        audit = "".join(o[t][3] for o, t in zip(options, taken)) + closing
        assert (cost, audit) == _edits(symbols), symbols


def _repaired(rows):
    """conv_id -> the contract's columns, row by row."""
    convs, damaged = defaultdict(list), set()
    for conv, turn, role, text in rows:
        damaged.add(conv)
        role, text = " " if role is None else role, " " if text is None else text
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm == 1:
            text = ""
        if harm == 2:
            text = "".join(c for c in text if c not in ".!?")
        if harm == 4:
            role = "user"
        convs[conv] += [(turn, role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
    out = {}
    for conv in damaged:
        turns = sorted(convs[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, symbols, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                count[fault] += 1
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = _edits(symbols)
        size = sum(e != "D" for e in audit)
        target = ("s" if size % 2 else "") + "ua" * (size // 2)
        lines, row = [], iter(turns)
        for e in audit:
            _, role, text = (0, "", "") if e == "I" else next(row)
            if e != "D":
                role = role if e == "K" else {"u": "user", "a": "assistant"}[target[len(lines)]]
                lines.append(f"{role}:{text}")
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, sha)
    return out


def test_repair_equals_row_by_row(spark, odd, odd_rows):
    got = {r[0]: tuple(r[1:]) for r in turn_repair.op12_turn_repair(odd).collect()}
    assert got == _repaired(odd_rows)


def test_repair_over_slice_borders(spark, odd, odd_rows):
    """Slices of four rows give the same plans and texts as whole conversations."""
    rows = turn_repair.damaged(odd)
    planned, fixed = turn_repair.repair(rows, 4)
    expected = _repaired(odd_rows)
    got = {r.conv_id: tuple(r)[1:-1] for r in planned.collect()}
    digests = {r.id: r.repaired_sha256 for r in turn_repair.line_digests(fixed).collect()}
    assert len(got) == len(digests) and len(got) > 30
    for conv, values in got.items():
        assert (*values, digests[conv]) == expected[None if conv is None else int(conv)], conv


def test_repair_of_an_empty_table(odd):
    assert turn_repair.op12_turn_repair(odd.filter("false")).count() == 0


# --- prefix trie ---------------------------------------------------------------

def _sequences(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(turns)] for c, turns in convs.items()}


def _spliced(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def _trie(convs):
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    kids = defaultdict(set)
    for path in members:
        if path:
            kids[path[:-1]].add(path)
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, ids in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(ids) - 1) * len(path[-1][1]) if path else 0
    rows = set()
    for path, ids in members.items():
        ends = ",".join(str(c) for c in ids if len(convs[c]) == len(path))
        rows.add((ids[0], len(path), members[path[:-1]][0] if path else None, len(ids), len(kids[path]), leaves[path], saved[path],
                  hashlib.sha256(ends.encode()).hexdigest()))
    return rows


def test_trie_equals_dictionary(odd, odd_rows):
    got = [tuple(r) for r in prefix_trie.op13_prefix_trie(odd).collect()]
    expected = _trie(_spliced(_sequences(odd_rows)))
    assert len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("band, shard_rows", [(3, 10), (1, 1), (50, 1000)])
def test_trie_over_bands_and_shards(spark, odd_rows, band, shard_rows):
    convs = _sequences([r for r in odd_rows if r[0] != 78]) | {9000: [], 9001: []}
    convs |= {c: convs[77][: c % 90] for c in range(500, 540)}
    rows = spark.createDataFrame([(c, i + 1, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)],
                                 "conv_id long, place long, role string, text string")
    sizes = spark.createDataFrame([(c, len(t)) for c, t in convs.items()], "conv_id long, size long")
    nodes, parts = prefix_trie.trie(prefix_trie.closed(rows, sizes, band), shard_rows, band)
    ends = {(r.depth, r.x1, r.x2): r.ends_sha256 for r in prefix_trie.end_digests(parts).collect()}
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens,
            ends.get((r.depth, r.x1, r.x2), prefix_trie.NO_ENDS)) for r in nodes.collect()]
    expected = _trie(convs)
    assert len(got) == len(expected) and set(got) == expected


def test_trie_of_an_empty_table(odd):
    assert prefix_trie.op13_prefix_trie(odd.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["op12_turn_repair", "op13_prefix_trie"])
def test_queries_have_sql(name):
    assert name in queries.QUERIES and name in queries.ORACLE
