"""Nearest neighbours, Lloyd clustering and conversation repair against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import dialogue, lloyd, neighbours, queries

from ..oracle import differences

VECTORS = "vec_id long, embedding array<float>, side string, x string, v string, cluster string, lane string"
NAN, INF = float("nan"), float("inf")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "clash", "clash", "clash", "clash", "clash") for i, v in rows], VECTORS)


def near_by_force(rows, k, every):
    """{query id: [(distance, id)]} over all pairs; rows as (id, vector) without repeats."""
    rows = [(i, v) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, a in rows:
        if i % every == 0:
            own = []
            for j, b in rows:
                if len(a) == len(b) and (i, a) != (j, b):
                    own.append((math.sqrt(sum((np.float64(np.float32(x)) - np.float64(np.float32(y))) ** 2 for x, y in zip(a, b))), j))
            out[i] = sorted(own)[:k]
    return out


def found(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return dict(out)


def test_neighbours_as_by_all_pairs(spark, sf):
    assert differences(queries.op11_neighbours(spark, sf), queries.oracle_sql()["op11_neighbours"], sf) == ""


def test_neighbours_with_crowds_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    grid = [[float(x) for x in v] for v in rng.integers(-2, 3, (300, 3))]  # many ties and equal vectors
    rows = list(enumerate(grid)) + [(1000 + i, [1.0, 1.0, 1.0]) for i in range(200)]  # one vector with a third of the rows
    rows += [(2000, None), (2010, []), (2020, [0.0, 0.0, 0.0]), (2030, [NAN, 1.0, 1.0]), (2040, [INF, 1.0, 1.0]), (2050, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(3000, [1.0, 2.0]), (3001, [1e-30, 2.0]), (3002, [1e30, 2.0]), (3010, [5.0]), (3020, [1e-40, -0.0])]
    want = {q: pairs for q, pairs in near_by_force(rows, 10, 10).items() if pairs}
    df = vectors(spark, rows + rows[:50]).repartition(5)  # repeated rows count once
    assert found(neighbours.nearest_neighbours(df, F.col("vec_id") % 10 == 0)) == want
    monkeypatch.setattr(neighbours, "GROUP_VALUES", 40)  # many groups of queries, small blocks and tiles
    groups = neighbours.nearest_neighbours(df, F.col("vec_id") % 10 == 0)
    assert groups.count() == sum(map(len, want.values()))
    assert found(groups) == want


def test_blocks_and_tiles_of_any_size():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:150] = x[0]
    ids = np.arange(400)
    for size in (7, 64, 400):
        best = neighbours.Best(neighbours.Vectors(ids[::20], x[::20]), 6)
        for at in range(0, 400, size):
            best.meet(neighbours.Vectors(ids[at : at + size], x[at : at + size], 6))
        for q, _, near, scores in best.lists():
            d = neighbours.distances(np.repeat(x[q : q + 1], 400, axis=0), x)
            assert list(zip(scores, near)) == sorted((d[j], j) for j in range(400) if j != q)[:5]


def test_neighbours_of_few_rows(spark):
    assert neighbours.nearest_neighbours(vectors(spark, []), F.col("vec_id") % 10 == 0).collect() == []
    assert neighbours.nearest_neighbours(vectors(spark, [(0, [1.0])]), F.col("vec_id") % 10 == 0).collect() == []
    assert found(neighbours.nearest_neighbours(vectors(spark, [(0, [1.0]), (7, [3.0])]), F.col("vec_id") % 10 == 0)) == {0: [(2.0, 7)]}


def lloyd_by_force(rows, k, rounds):
    """{row number: (cluster, distance)}, centroids; rows as (id, integers)."""
    key = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [list(v) for _, v in sorted((key(i), v) for i, v in rows)[:k]]
    for last in [False] * rounds + [True]:
        near = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in rows]
        if last:
            return [(j, d) for d, j in near], centroids
        for j in range(len(centroids)):
            own = [v for (_, v), (_, at) in zip(rows, near) if at == j]
            if own:
                centroids[j] = [sum(c) // len(own) for c in zip(*own)]


def test_lloyd_as_by_sql(spark, sf):
    assert differences(queries.op12_lloyd(spark, sf), queries.oracle_sql()["op12_lloyd"], sf) == ""


def test_lloyd_with_crowds_large_numbers_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.integers(-40, 40, 2)]) for i in range(150)] + [(500 + i, [3.0, -7.5]) for i in range(90)]
    rows += [(7, [1.0, 1.0]), (7, [1.0, 1.0]), (None, [2.0, 2.0]), (900, [3e7, -3e7]), (901, [-2.5e8, 1.0])]
    odd = [(1, None), (2, []), (3, [1.0]), (4, [NAN, 1.0]), (5, [INF, 1.0]), (6, [None, 1.0]), (8, [1e20, 1.0])]
    whole = [(i, [math.floor(64 * float(np.float32(c))) for c in v]) for i, v in rows]
    near, centroids = lloyd_by_force(whole, 16, 3)
    got = lloyd.cluster(vectors(spark, rows + odd).repartition(3), dims=2).collect()
    inertia = defaultdict(int)
    for j, d in near:
        inertia[j] += d
    want = sorted((-1 if i is None else i, j, d, inertia[j], sum(inertia.values()), tuple(centroids[j])) for (i, _), (j, d) in zip(whole, near))
    assert sorted((-1 if r["vec_id"] is None else r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], tuple(r["centroid"])) for r in got) == want


def test_lloyd_of_few_rows_and_of_longs(spark):
    assert lloyd.cluster(vectors(spark, []), dims=2).collect() == []
    few = lloyd.cluster(vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0])]), dims=2).collect()
    assert sorted((r["vec_id"], r["distance"]) for r in few) == [(1, 0), (2, 0)]
    far = lloyd.cluster(vectors(spark, [(i, [c, 0.0]) for i, c in enumerate([0.0, 4e15, 4.1e15])]), k=1, rounds=1, dims=2).collect()
    assert all(r["inertia"] is None for r in far)  # more than a long holds


def repair_by_force(rows):
    """(cost, audit) of rows (initial, fault) by all least pairs, from the end."""
    move = {("0", "s"): "1", ("0", "u"): "2", ("1", "u"): "2", ("3", "u"): "2", ("2", "a"): "3"}

    @cache
    def best(i, q, inserts):
        out = [(0, "")] if i == len(rows) and q in "03" else []
        if inserts < 3:
            out += [(5 + c, "I" + a) for r in "ua" if (q, r) in move for c, a in [best(i, move[q, r], inserts + 1)]]
        if i < len(rows):
            initial, fault = rows[i]
            out += [(2 + c, "D" + a) for c, a in [best(i + 1, q, 0)]]
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                if (q, initial) in move:
                    out += [(more + c, "K" + a) for c, a in [best(i + 1, move[q, initial], 0)]]
                out += [(more + 1 + c, "R" + a) for r in "ua" if (q, r) in move for c, a in [best(i + 1, move[q, r], 0)]]
        return min(out, default=(10**9, ""))

    for i in reversed(range(len(rows))):  # from the end, so that no recursion is deep
        for q in "0123":
            best(i, q, 0)
    return best(0, "0", 0)


def test_cheapest_audits_by_force():
    rng = np.random.default_rng(6)
    repairs = dialogue.Repairs()
    kinds = "suaoSUAOx"
    for _ in range(3000):
        row = "".join(rng.choice(list(kinds), rng.integers(0, 12)))
        faults = [("?", "blank") if k == "x" else (k.lower(), "truncated" if k.isupper() else "") for k in row]
        assert repairs.audit(row) == repair_by_force(faults), row
    assert len(repairs.vectors) < 200  # the automaton is finite and small
    cost, audit = repairs.audit("sua" * 100_000)
    assert len(audit) == 300_000 and cost > 0


def conversations_by_force(rows):
    """{conv: all columns} from (conv, turn, role, text) by the contract."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c == conv:
                said = lambda x: " " if x is None else str(x)
                lot = zlib.crc32(f"{said(c)}:{said(turn)}".encode()) % 20
                role, text = said(role), said(text)
                text = "" if lot == 1 else text.translate({ord(x): None for x in ".!?"}) if lot == 2 else text
                own += [(turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in own:
            solid = text.strip(" \t\n\x0b\f\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = repair_by_force([(role[:1], f) for (_, role, _), f in zip(own, faults)])
        turns = {t for t, _, _ in own if t is not None}
        lines, left, length = [], iter(own), len(audit) - audit.count("D")
        place = -(length % 2)
        for letter in audit:
            _, role, text = next(left) if letter != "I" else (None, "", "")
            if letter != "D":
                lines.append(f"{role if letter == 'K' else ('user', 'assistant')[place % 2]}:{text}")
                place += 1
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines)
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string, kind string, digest string, head string, copy string"


def chats(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)


def check_conversations(df, rows):
    want = conversations_by_force(rows)
    hurt = dialogue.damaged(df)
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in dialogue.repaired_digests(hurt).collect()} == {c: w[:-1] for c, w in want.items()}
    lines = defaultdict(list)
    for r in sorted(dialogue.repaired_rows(hurt).collect(), key=lambda r: r["place"]):
        lines[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    assert {c: lines.get(c, []) for c in want} == {c: w[-1] for c, w in want.items()}


def test_conversations_by_force(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    check_conversations(df, [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
    assert {r["conv_id"] for r in queries.op13_dialogue(spark, sf).collect()} == {r[0] for r in df.select("conv_id").distinct().collect()}


def test_odd_conversations(spark):
    rng = np.random.default_rng(8)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "Used"], ["Hello.", "Well", "Well?", "", " \t", None, "é 漢字!", "a:b.", "x" * 5000 + "."]
    pick = lambda xs: xs[rng.integers(len(xs))]
    rows = [(int(c) if c else None, pick([None, 1, 2, 3, 5, 8, 13, 21, -4]), pick(roles), pick(texts)) for c in rng.integers(0, 60, 500)]
    rows += [(70, t, "user" if t % 2 else "assistant", f"Line {t}.") for t in range(800)]  # one conversation with most rows
    rows += [(i, t, "user", "Same.") for i in (80, 81) for t in range(20)]
    check_conversations(chats(spark, rows).repartition(4), rows)


def test_empty_conversations(spark):
    assert dialogue.repaired_digests(dialogue.damaged(chats(spark, []))).collect() == []
    gone = next(t for t in range(1000) if zlib.crc32(f"1:{t}".encode()) % 20 == 0)
    (row,) = dialogue.repaired_digests(dialogue.damaged(chats(spark, [(1, gone, "user", "Hi.")]))).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dialogue.repaired_rows(dialogue.damaged(chats(spark, [(1, gone, "user", "Hi.")]))).collect() == []


@pytest.mark.parametrize("size", [1, 50])
def test_batches_are_bounded(size):
    import pyarrow as pa

    rows = [("x" * 10, i) for i in range(100)]
    got = list(dialogue.batches_of(iter(rows), pa.schema([("t", pa.string()), ("i", pa.int64())]), most=30, size=size))
    assert [r["i"] for b in got for r in b.to_pylist()] == list(range(100)) and max(b.num_rows for b in got) <= 30
