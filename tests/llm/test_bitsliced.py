import numpy as np
import pytest

from lodestar.llm import bitsliced
from lodestar.llm.queries import ORACLES, QUERIES
from tests.compare import from_duckdb, from_spark


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, [1], 2) for i, v in rows], "vec_id long, embedding array<float>, label int, codes array<int>, block int")


def brute(rows, every, k):
    seen = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v):
            seen.setdefault(i, set()).add(tuple(int(np.floor(256 * float(np.float32(x)))) for x in v))
    out = []
    for q in sorted(seen):
        if q % every == 0:
            best = {j: max(sum(a * b for a, b in zip(x, y, strict=True)) for x in seen[q] for y in seen[j] if len(x) == len(y)) for j in seen if j != q and any(len(x) == len(y) for x in seen[q] for y in seen[j])}
            out += [(q, r + 1, j, best[j]) for r, j in enumerate(sorted(best, key=lambda j: (-best[j], j))[:k])]
    return out


def got(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


def test_slices_add_up_to_the_product():
    rng = np.random.default_rng(3)
    for rows, dims, spread in ((1, 1, 5), (70, 7, 300), (640, 5, 4), (100, 3, 0), (65, 64, 200)):
        codes = rng.integers(-spread, spread + 1, (rows, dims))
        lows, bits, slices = bitsliced.sliced(codes)
        for _ in range(4):
            q = rng.integers(-spread - 9, spread + 9, dims)
            base, total = bitsliced.scores(q, lows, bits, slices)
            made = np.full(rows, base)
            for w, s in enumerate(total):
                if s is not None:
                    made += np.unpackbits(s.view(np.uint8), bitorder="little")[:rows].astype(int) << w
            assert (made == codes @ q).all()


def test_best_rows_of_slices():
    rng = np.random.default_rng(5)
    for _ in range(30):
        values = rng.integers(0, 9, 100)
        total = [np.packbits(np.pad(values >> b & 1, (0, 28)).astype(np.uint8), bitorder="little").view(np.uint64) for b in range(4)]
        rows = np.packbits(np.pad(np.arange(100) % 3 > 0, (0, 28)).astype(np.uint8), bitorder="little").view(np.uint64)
        sure, edge = map(bitsliced.places, bitsliced.best(total, rows, 7))
        of = sorted((v for i, v in enumerate(values) if i % 3), reverse=True)
        assert len(sure) <= 7 and len(set(values[edge])) <= 1 and len(sure) + len(edge) >= 7
        assert sorted([*values[sure], *values[edge][: 7 - len(sure)]], reverse=True) == of[:7]


def test_top_products_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(0, 0.2, 8)) for i in rng.permutation(900)]
    rows += [(i, [0.25] * 8) for i in range(1000, 1200)]  # many equal scores
    assert got(bitsliced.top_products(table(spark, rows))) == brute(rows, 50, 5)
    small = bitsliced.build(table(spark, rows), rows_a_block=64)
    assert small.count() > 10
    assert got(bitsliced.search(small, bitsliced.quantised(table(spark, rows).where("vec_id % 50 = 0")), 5, queries_a_block=3)) == brute(rows, 50, 5)


def test_awkward_vectors(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (50, None), (100, [None, 1.0]), (150, [float("nan"), 1]), (200, []), (250, [float("inf"), 1]), (None, [1, 1]), (300, [0, 0]), (1, [0.5, -3]), (2, [0.5, -3]), (3, [-2.0, 7]), (3, [-2.0, 7]), (3, [9.0, 1]), (4, [1, 1, 1]), (350, [1, 2, 3]), (400, [-1, -0.001])]
    assert got(bitsliced.top_products(table(spark, rows))) == brute(rows, 50, 5)
    few = [(0, [1.0]), *[(7, [float(k)]) for k in range(40)], (8, [0.5])]  # one vec_id fills the top of a block
    assert got(bitsliced.top_products(table(spark, few))) == brute(few, 50, 5)


def test_empty_table_and_large_components(spark):
    assert got(bitsliced.top_products(table(spark, []))) == []
    with pytest.raises(Exception, match="must stay below"):
        bitsliced.top_products(table(spark, [(0, [1e9]), (1, [1.0])])).collect()


def test_query_equals_sql(spark, sf_dir):
    assert from_spark(QUERIES["op13_top_products"](spark, sf_dir)) == from_duckdb(ORACLES["op13_top_products"], sf_dir)
