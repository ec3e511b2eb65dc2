import math
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from loomlog.llm import negatives

DDL = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT"
SF = "/root/testdata/sf0.01"


def brute(rows, every=100):
    """Every anchor against every row, in plain Python."""
    known = []
    for vec_id, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            known.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    out = []
    for a_id, a_label, a in known:
        if a_id is None or a_id % every:
            continue
        scored = sorted(
            ((-sum(x * y for x, y in zip(a, v, strict=False)), i is None, i or 0, label) for i, label, v in known),
        )
        positives = [(s, no, i) for s, no, i, label in scored if label == a_label and (no or i != a_id)][:5]
        for p, p_none, p_id in positives:
            rank = 0
            for s, none, i, label in scored:
                if label != a_label and -30 * p <= -100 * s <= -90 * p and rank < 10:
                    rank += 1
                    out.append((a_id, None if p_none else p_id, rank, None if none else i, -p, -s))
    return out


def same(got, expected):
    def key(r):
        return tuple((x is None, x or 0) for x in r)

    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_oracle_on_the_whole_table(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = con.execute(entry.oracle_sql()["op13_hard_negatives"]).fetchall()
    got = entry.queries()["op13_hard_negatives"](spark, SF)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert len(expected) > 100
    same(got.collect(), expected)


@pytest.mark.parametrize("seed", [1, 2])
def test_small_blocks_teams_and_parcels_equal_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(negatives, "TEAM", 3)
    monkeypatch.setattr(negatives, "ZONES", 4)
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(3)] for _ in range(6)]
    rows = []
    for i in range(300):
        centre = rng.choice(centres)
        rows.append((i, [c + rng.gauss(0, 0.05) for c in centre], rng.randrange(4)))
    frame = spark.createDataFrame(rows, DDL)
    same(negatives.mine(frame, "vec_id % 20 = 0", block=8).collect(), brute(rows, 20))


def test_clustered_rows_leave_blocks_unread(spark):
    rng, rows = random.Random(4), []
    for c in range(16):
        centre = [4.0 if c >> k & 1 else -4.0 for k in range(4)]
        rows += [(100 * c + i, [x + rng.gauss(0, 0.02) for x in centre], rng.randrange(3)) for i in range(64)]
    frame = spark.createDataFrame(rows, DDL)
    blocks, width = negatives.write_blocks(negatives.usable(frame), 64)
    teams = negatives._teams(blocks, negatives.F.expr("vec_id % 100 = 0"), width)
    windows = teams.select("team", negatives.F.posexplode("ids").alias("member", "id")).selectExpr("team", "member", "0 AS window", "4000000L AS floor", "9000000L AS top")
    asking = negatives._asking(teams, windows)
    pairs = sum(len(r.members) for r in negatives._wanted(asking, blocks, True).collect())
    assert pairs < 16 * blocks.count() / 3
    same(negatives.mine(frame, block=64).collect(), brute(rows))


def test_hilbert_keys_visit_neighbours():
    side = 8
    points = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = [k.tobytes() for k in negatives.hilbert_keys(points, 3)]
    assert len(set(keys)) == len(points)
    path = points[sorted(range(len(points)), key=lambda i: keys[i])]
    assert (abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_products_are_exact():
    rng = np.random.default_rng(1)
    a, v = rng.integers(-300, 300, (20, 7)), rng.integers(-300, 300, (50, 7))
    least, most = negatives.bounds(a, v.min(axis=0)[None], v.max(axis=0)[None])
    scores = negatives.products(a, v)
    assert (scores >= least).all() and (scores <= most).all() and (scores == a @ v.T).all()
    big = np.full((1, 8), negatives.LIMIT, np.int64) - np.arange(8)
    assert int(negatives.products(big, big)[0, 0]) == sum((negatives.LIMIT - k) ** 2 for k in range(8))


def test_odd_rows(spark):
    vector = [0.5, 0.25, -0.25]
    rows = [(100, vector, 1), (100, vector, 1), (None, vector, 1), (None, [0.4, 0.2, 0.1], 2), (1, vector, 2), (2, [0.4, 0.2, -0.2], 2)]
    rows += [(3, None, 1), (4, [0.1, None, 0.2], 2), (5, [float("nan"), 0.0, 0.0], 2), (6, [float("inf"), 0.0, 0.0], 2), (7, vector, None)]
    rows += [(8, [0.45, 0.2], 3), (9, [], 3), (10, [3e38, -3e38, 0.0], 4), (200, [0.4, 0.3, -0.2, 0.1], 1), (300, [], 9), (11, [0.3, 0.3, 0.3], 2), (11, [0.3, 0.3, 0.3], 2)]
    clamped = [(i, None if v is None else [None if x is None else max(min(x, 2.0**18), -(2.0**18)) if math.isfinite(x) else x for x in v], k) for i, v, k in rows]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], DDL + ", team INT, ids STRING")
    same(negatives.mine(frame).collect(), brute(clamped))
    assert negatives.mine(spark.createDataFrame([], DDL)).count() == 0
    assert negatives.mine(spark.createDataFrame([(1, [1.0], 1)], DDL)).count() == 0


def test_many_equal_rows(spark):
    rng = random.Random(5)
    rows = [(i, [0.5, 0.5, 0.1], i % 3) for i in range(200)] + [(200 + i, [rng.random() for _ in range(3)], i % 3) for i in range(150)]
    same(negatives.mine(spark.createDataFrame(rows, DDL), block=16).collect(), brute(rows))
