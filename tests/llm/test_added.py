"""Byte-level dedup, the filter audit and the conversation trie against plain versions, and on odd inputs."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LINES, ODD, docs

from tidelog.llm import audit, suffixes, turns
from tidelog.llm.exchange import unplanes

# 11: bytes


def plain_bytes(rows, length):
    first, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: float("inf") if rows[k][0] is None else rows[k][0])
    for k in order:
        key, data = float("inf") if rows[k][0] is None else rows[k][0], (rows[k][1] or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            if first.setdefault(data[p : p + length], key) < key:
                gone[p : p + length] = b"\1" * length
        out.append((rows[k][0], len(data), sum(gone), bytes(c for c, g in zip(data, gone, strict=True) if not g)))
    return sorted(out, key=str)


def found_bytes(df, **more):
    rows = suffixes.deduplicate(df, **more).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.length for s in r.removed), bytes(r.kept)) for r in rows), key=str)


@pytest.mark.parametrize("spread, weak", [(1024, False), (2, False), (1024, True)])
def test_bytes_of_repeated_strings_go(spark, monkeypatch, spread, weak):
    monkeypatch.setattr(suffixes, "SPREAD", spread)
    if weak:  # every hash collides: only the comparison of bytes tells strings apart
        monkeypatch.setattr(suffixes, "common", lambda prefixes, poly, x, y, width, length: np.full(len(x), length))
    draw = random.Random(3)
    source = "".join(draw.choice("abé") for _ in range(300))
    rows = [(draw.choice([i, i, 4, None]), "".join(draw.choice("xyz") * 3 + source[(a := draw.randrange(280)) : a + draw.randint(1, 30)] for _ in range(draw.randint(0, 6)))) for i in range(40)]
    assert found_bytes(docs(spark, rows), length=8, gram=3, slice_bytes=150) == plain_bytes(rows, 8)


def test_bytes_on_odd_rows(spark):
    assert found_bytes(docs(spark, ODD, True)) == plain_bytes(ODD, 50)
    assert suffixes.deduplicate(docs(spark, [])).count() == 0


def sent_to_buckets(monkeypatch):
    """Lists that get, from each call to come, the rows that slices send to buckets and the segments in them."""
    rows, segments = [], []
    meet = suffixes.meet

    def noted(df, key, then, work, *more):
        found = meet(df, key, then, work, *more)
        if work.__name__ == "send":
            sizes = [len(unplanes(r.b)) for r in found.select("b").collect()]
            rows.append(len(sizes))
            segments.append(sum(sizes))
        return found

    monkeypatch.setattr(suffixes, "meet", noted)
    return rows, segments


def test_rows_do_not_grow_as_slices_times_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET_ANCHORS", 64)
    monkeypatch.setattr(suffixes, "RUNS", 2, raising=False)
    monkeypatch.setattr(suffixes, "BUCKETS_BITS", 2, raising=False)
    sent, _ = sent_to_buckets(monkeypatch)
    draw = random.Random(13)
    source = "".join(draw.choice("abcdefé") for _ in range(4000))
    rows = [(draw.choice([i, i, 4, None]), "".join(draw.choice("xyz") + source[(a := draw.randrange(3900)) : a + draw.randint(1, 100)] for _ in range(8))) for i in range(160)]
    assert found_bytes(docs(spark, rows).coalesce(1), length=8, gram=3, slice_bytes=600) == plain_bytes(rows, 8)
    # A row for each slice and each bucket that it holds anchors of would be 14,736.
    assert sent[0] < 2000


@pytest.mark.parametrize("single", [1 << 17, 12, 1])
def test_segments_of_frequent_anchors_travel_in_pieces(spark, monkeypatch, single):
    monkeypatch.setattr(suffixes, "SPREAD", 1)
    monkeypatch.setattr(suffixes, "SINGLE", single, raising=False)
    _, segments = sent_to_buckets(monkeypatch)
    draw = random.Random(17)
    lines = ["".join(draw.choice("abcdé") for _ in range(draw.randint(20, 90))) for _ in range(4)]
    rows = [(draw.choice([i, i, 4, None]), "".join(draw.choice(["", "q"]) + draw.choice("xyzw") * draw.randint(0, 2) + draw.choice(lines)[draw.choice([0, 0, 3]) :] for _ in range(3))) for i in range(60)]
    assert found_bytes(docs(spark, rows), length=24, gram=4, slice_bytes=700) == plain_bytes(rows, 24)
    if single > 12:
        strings = sum(max(0, len(t.encode()) - 23) for _, t in rows)
        assert segments[0] < strings / 3


# 12: filters


def plain_audit(rows, labels):
    least = {}
    for i, _, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    flags = []
    for i, part, text in rows:
        t = text or ""
        words = t.encode().split()
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": t in least and (i is None or i > least[t]),
        }
        flags.append((part or "", {f for f in fails if fails[f]}, labels.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in flags}:
        mine = [(f, q) for p, f, q in flags if p == part]
        for order in itertools.permutations("ABCDE"):
            for k, x in enumerate(order):
                removed = [q for f, q in mine if x in f and not f & set(order[:k])]
                kept = sum(not f & set(order[: k + 1]) for f, _ in mine)
                again = sum(x in f and bool(f & set(order[:k])) for f, _ in mine)
                out[part, "".join(order), k + 1] = (kept, len(removed), again, sum(f == {x} for f, _ in mine), sum(q[0] for q in removed), sum(q[1] for q in removed))
    return out


def test_filters_interact_as_in_a_plain_audit(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["a", "B", "cc#", "DD", "é\x1f", "x\x0by"]) + str(draw.randint(0, 60)) for _ in range(draw.choice([0, 3, 99, 100, 150]))) for _ in range(20)]
    rows = [(draw.choice([i, i, 3, None]), draw.choice(["en", "", None]), draw.choice([*texts, None, LINES])) for i in range(60)]
    df = spark.createDataFrame([(i, t, p, "x") for i, p, t in rows], "doc_id long, text string, lang string, part string")
    marks = [(i, i % 2, i % 3 % 2) for i in range(0, 60, 2)]
    labels = spark.createDataFrame([*marks, (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): r for r in audit.interactions(audit.failures(df, "lang"), labels).collect()}
    want = plain_audit(rows, {i: (q, t) for i, q, t in marks})
    assert {k: (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) for k, r in got.items()} == want
    for (part, order, step), r in got.items():
        assert r.shapley == sum(w[1] for (p, o, k), w in want.items() if p == part and o[k - 1] == order[step - 1])
    assert audit.interactions(audit.failures(df.where("false"), "lang"), labels).count() == 0


# 13: conversations


def plain_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    convs = {c: [x[3] for x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(convs.get(c - int(np.fmod(c, 5)), [])[:h] + own[h:])
    nodes = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    out = []
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        ends = sorted(c for c in members if built[c] == prefix)
        out.append((
            min(members), len(prefix), min(nodes[prefix[:-1]]) if prefix else None, len(members), sum(len(p) == len(prefix) + 1 for p in below),
            sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes) for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, piece", [(8, 4096), (2, 3)])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block, piece):
    monkeypatch.setattr(turns, "JOINED_IDS", 2)
    draw = random.Random(block)
    rows = [(draw.choice([*range(-12, 24), 5, 5, None]), draw.choice([0, 1, 2, 3, None]), draw.choice(["u", None]), draw.choice(["a", "é", None, "bb"])) for _ in range(160)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, depth string")
    got = turns.prefix_trie(*turns.rebuilt(df), block=block, piece=piece)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)


def test_no_conversations_no_root(spark):
    df = spark.createDataFrame([(None, 1, "u", "a")], "conv_id long, turn long, role string, text string")
    assert turns.prefix_trie(*turns.rebuilt(df)).where(F.lit(True)).count() == 0
