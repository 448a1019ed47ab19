import datetime
import random
import zlib

import numpy as np

from lodestar.llm import features
from lodestar.llm.queries import ORACLES, QUERIES
from tests.compare import from_duckdb, from_spark

START = datetime.datetime(2024, 1, 1)
CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string, shard int, what string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int, k long, days int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz, e long, client string"


def us(x):
    return None if x is None else int((x - datetime.datetime(1970, 1, 1)) / datetime.timedelta(microseconds=1))


def cents(x):
    return 0 if x is None or not np.isfinite(x) else int(np.floor(100 * x + 0.5))


def brute(clicks, sales, lines, windows=(2, 14)):
    day, wait = 86_400_000_000, 240 * 60_000_000
    clicks = set(clicks)
    out = []
    for sale_id, client, _, _, sold, *_ in sales:
        if client is None or sold is None:
            continue
        t = us(sold) + zlib.crc32(b"" if sale_id is None else str(sale_id).encode()) % 259_200 * 1_000_000
        mine = [(s, us(s[4])) for s in sales if s[1] == client and s[4] is not None]
        label = any(t < e <= t + 7 * day for _, e in mine)
        for d in windows:
            inside = lambda e, at: e is not None and at is not None and t - d * day < e <= t and at + wait <= t
            c = [x for x in clicks if x[3] == client and inside(us(x[1]), us(x[2]))]
            s = [x for x, e in mine if inside(e, us(x[5]))]
            ls = [x for y in s for x in lines if x[0] is not None and x[0] == y[0] and x[8] is not None and us(x[8]) <= t]
            last = max(c, key=lambda x: (x[1], x[0] is not None, x[0] or 0))[0] if c else None
            out.append((sale_id, d, t, label, len(c), sum(x[4] == "purchase" for x in c), sum(cents(x[5]) for x in c), last, len(s), sum(cents(x[3]) for x in s), len(ls), len({x[2] for x in ls if x[2] is not None}), sum(cents(x[5]) for x in ls)))
    return sorted(out, key=repr)


def shop(seed, n=150, clients=4):
    r = random.Random(seed)
    at = lambda days: START + datetime.timedelta(microseconds=int(r.random() * days * 86_400_000_000))
    late = lambda x: None if r.random() < 0.03 else x + datetime.timedelta(hours=r.choice([0, 0, 1, 50, 400]) * r.random())
    client = lambda: r.choice([*range(clients), 0, 0, None])
    money = lambda: r.choice([None, float("nan"), float("inf"), -1.005, 2.675, round(r.random() * 100, 2)])
    clicks = []
    for k in range(3 * n):
        ts = at(40).replace(microsecond=0)
        clicks.append((r.choice([k, k // 2]), None if r.random() < 0.03 else ts, late(ts), client(), r.choice(["purchase", "view", None]), money(), r.choice([None, "{}"]), 1, "x"))
    clicks += r.choices(clicks, k=n)
    sales = []
    for k in range(n):
        sold = at(40)
        sales.append((k, client(), "done", money(), None if r.random() < 0.03 else sold, late(sold), 1, 5, 6))
    lines = []
    for k in range(4 * n):
        sold = sales[k % n][4] or START
        lines.append((r.choice([k % n, k % n, k % n, None, n + 7]), 1, r.choice([None, *range(6)]), 1, 1, money(), 0.1, "kept", None if r.random() < 0.05 else sold.replace(hour=0, minute=0, second=0, microsecond=0) + datetime.timedelta(days=r.randrange(0, 12)), 1, "x"))
    lines += r.choices(lines, k=20)
    return clicks, sales, lines


def tables(spark, clicks, sales, lines):
    return spark.createDataFrame(clicks, CLICKS), spark.createDataFrame(sales, SALES), spark.createDataFrame(lines, LINES)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_fenwick_equals_plain_sums():
    rng = np.random.default_rng(1)
    for n, asks in ((0, 5), (1, 3), (300, 200), (40, 0)):
        tree, a, e, tie = (rng.integers(0, top, n) for top in (5, 30, 30, 3))
        values = rng.integers(0, 100, (n, 2))
        ask, t, low = (rng.integers(0, top, asks) for top in (6, 32, 32))
        sums, best = features.fenwick(tree, a, e, tie, values, ask, t, low)
        for i in range(asks):
            hit = np.flatnonzero((tree == ask[i]) & (a <= t[i]) & (e > low[i]))
            assert (sums[i] == values[hit].sum(0)).all()
            assert (best[i] == -1) == (not len(hit))
            if len(hit):
                assert (e[best[i]], tie[best[i]]) == max(zip(e[hit], tie[hit], strict=True)) and best[i] in hit


def test_pieces_cover_each_moment_of_an_item_once(spark):
    r, day = random.Random(2), features.DAY
    rows = [(r.randrange(3), r.randrange(4), (e := r.randrange(40 * day)) + r.randrange(4 * day), e) for _ in range(200)]
    items = spark.createDataFrame([(*x, None, None) for x in rows], "client long, item long, a long, e long, width long, last long")
    got = features.pieces(items, (2, 14)).collect()
    for _ in range(300):
        t, c, d = r.randrange(50 * day), r.randrange(3), r.choice([2, 14])
        alive = {i for g, i, a, e in rows if g == c and a <= t < e + d * day}
        assert sum(p.client == c and p.days == d and p.a <= t < p.e + d * day for p in got) == len(alive)


def test_features_equal_brute_force_whole_and_cut(spark):
    for seed, rows in ((1, 20_000), (2, 25), (3, 60)):
        given = shop(seed)
        assert got(features.features(*tables(spark, *given), large=rows, rows_a_shard=rows)) == brute(*given)


def test_one_client_one_item_many_shards(spark):
    clicks, sales, lines = shop(7, n=120, clients=1)
    lines = [(*x[:2], 3, *x[3:]) for x in lines]
    assert got(features.features(*tables(spark, clicks, sales, lines), large=10, rows_a_shard=10)) == brute(clicks, sales, lines)


def test_awkward_tables(spark):
    at = lambda days: START + datetime.timedelta(days=days)
    sales = [(None, 1, "x", 1.0, at(1), at(1), 1, 1, 1), (5, 1, "x", 1.0, at(1), at(1), 1, 1, 1), (5, 1, "x", 1.0, at(1), at(1), 1, 1, 1), (6, None, "x", 1.0, at(1), at(1), 1, 1, 1), (7, 2, None, None, None, at(1), 1, 1, 1), (8, 3, "x", 2.0, at(1), None, 1, 1, 1)]
    clicks = [(None, at(1), at(1), 1, None, None, None, 1, "x"), (9, at(1), at(1), 1, None, None, None, 1, "x"), (None, at(1.1), at(1.1), 3, None, None, None, 1, "x")]
    lines = [(5, 1, 1, 1, 1, 1.0, 0.1, "x", at(1), 1, "x")]
    assert got(features.features(*tables(spark, clicks, sales, lines))) == brute(clicks, sales, lines)
    assert got(features.features(*tables(spark, clicks, [], lines))) == []
    assert got(features.features(*tables(spark, [], sales, []))) == brute([], sales, [])


def test_query_equals_sql(spark, sf_dir):
    assert from_spark(QUERIES["op12_point_in_time_features"](spark, sf_dir)) == from_duckdb(ORACLES["op12_point_in_time_features"], sf_dir)
