"""Exact top-k by inner product over a bit-sliced index.

A component x becomes the integer floor(scale * x). The index holds, for each block of rows and each component, one bitmap a
bit: the component above the block's least value, from the least bit up. A query's score is a sum of those slices, each under the
bits of the query's own component: slices of equal weight are added three at a time by bitmap arithmetic (a full adder: sum
and carry), until the score itself lies in slices. The k best rows are then read from the most significant slice downward,
and those on the boundary, which all have one score, go by vec_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, tidy, written

INDEX = "dims int, block int, vec_ids binary, values binary, lows binary, bits binary, slices binary"
RESULT = "query_id long, vec_id long, score long"
MOST = 1 << 23  #: of a component's size: scores of up to 2^16 components then fit into 63 bits


def quantised(rows: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, dims, codes) of the rows that take part, each once: codes are floor(scale * x) of every component."""
    given = only(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    taken = given.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & (F.size("embedding") > 0))
    return taken.select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda x: F.floor(x * scale)).alias("codes")).distinct()


def checked(codes: np.ndarray) -> np.ndarray:
    """codes, unless one is so large that a score could leave 63 bits."""
    if codes.size and max(-int(codes.min()), int(codes.max())) >= MOST:
        raise ValueError(f"components must stay below {MOST} when scaled")
    return codes


def sliced(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least value, number of bits of each component, slices) of codes (rows, dims); a slice is a bitmap of words of 64 rows,
    those of a component in order from its least bit."""
    lows = codes.min(0)
    above = (codes - lows).astype(np.uint64)
    bits = np.array([int(x).bit_length() for x in above.max(0)], np.int64)
    words = -(-len(codes) // 64)
    out = np.zeros((int(bits.sum()), words * 8), np.uint8)
    at = 0
    for d, n in enumerate(bits.tolist()):
        for b in range(n):
            packed = np.packbits((above[:, d] >> np.uint64(b)).astype(np.uint8) & 1, bitorder="little")
            out[at, : len(packed)] = packed
            at += 1
    return lows, bits, out.view(np.uint64)


def added(columns: dict[int, np.ndarray]) -> list[np.ndarray]:
    """The slices of the sum, from the least, of slices by weight (weight: (n, words))."""
    out, weight = [], min(columns, default=0)
    out += [None] * weight
    while columns:
        s = columns.pop(weight, None)
        if s is None:
            out.append(None)
            weight += 1
            continue
        carries = []
        while len(s) > 1:
            n = len(s) // 3
            if n:
                a, b, c = s[:n], s[n : 2 * n], s[2 * n : 3 * n]
                x = a ^ b
                carries.append((a & b) | (x & c))
                s = np.concatenate([x ^ c, s[3 * n :]])
            else:  # two are left
                carries.append((s[0] & s[1])[None])
                s = (s[0] ^ s[1])[None]
        out.append(s[0])
        if carries:
            up = [*carries, columns[weight + 1]] if weight + 1 in columns else carries
            columns[weight + 1] = np.concatenate(up)
        weight += 1
    return out


def scores(q: np.ndarray, lows: np.ndarray, bits: np.ndarray, slices: np.ndarray) -> tuple[int, list[np.ndarray]]:
    """(a constant, slices) that add up to the inner product of q with each row: a negative component takes the slices'
    complement, and the constant makes up for it."""
    first = np.concatenate([[0], np.cumsum(bits)])
    base = int(q.astype(object) @ lows.astype(object))
    plain: dict[int, list[int]] = {}
    turned: dict[int, list[int]] = {}
    for d in np.flatnonzero(q).tolist():
        x, n = int(q[d]), int(bits[d])
        to = plain if x > 0 else turned
        base -= ((1 << n) - 1) * max(0, -x)
        for w in range(abs(x).bit_length()):
            if abs(x) >> w & 1:
                for b in range(n):
                    to.setdefault(w + b, []).append(int(first[d]) + b)
    columns = {}
    for w in plain.keys() | turned.keys():
        columns[w] = np.concatenate([slices[plain.get(w, [])], ~slices[turned.get(w, [])]])
    return base, added(columns)


def places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def count(bitmap: np.ndarray) -> int:
    return int(np.bitwise_count(bitmap).sum())


def best(total: list[np.ndarray], rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(bitmap of the rows that are surely among the k largest of `rows`, bitmap of those at the boundary, equal to each
    other): from the most significant slice downward."""
    sure, open_ = np.zeros_like(rows), rows
    for s in reversed(total):
        if s is None:
            continue
        high = open_ & s
        n = count(sure) + count(high)
        if n > k:
            open_ = high
        else:
            sure, open_ = sure | high, open_ & ~s
            if n == k:
                return sure, np.zeros_like(rows)
    return sure, open_


def search_block(ids: np.ndarray, q: np.ndarray, vec_ids: np.ndarray, values: np.ndarray, lows: np.ndarray, bits: np.ndarray, slices: np.ndarray, k: int):
    """(place of a query, vec_ids, scores) of the k best other ids of a block, for each query in turn; vec_ids are in order. A vec_id with several
    vectors counts once, by its best."""
    every = np.packbits(np.ones(len(vec_ids), np.uint8), bitorder="little")
    full = np.zeros(slices.shape[1] * 8, np.uint8)
    full[: len(every)] = every
    full = full.view(np.uint64)
    repeated = len(np.unique(vec_ids)) < len(vec_ids)
    for i, x in enumerate(q):
        _, total = scores(x, lows, bits, slices)
        rows, a, b = full, *np.searchsorted(vec_ids, [ids[i], ids[i] + 1])
        if b > a:
            own = np.zeros(len(full) * 64, np.uint8)
            own[a:b] = 1
            rows = full & ~np.packbits(own, bitorder="little").view(np.uint64)
        want, n = k, count(rows)
        while True:
            sure, edge = best(total, rows, want)
            at = places(sure)
            at = np.concatenate([at, places(edge)[: max(0, want - len(at))]])
            if not repeated or want >= n or len(np.unique(vec_ids[at])) >= k:
                break
            want *= 2  # some of them share a vec_id
        yield i, vec_ids[at], values[at] @ x


def build(rows: DataFrame, scale: int = 256, rows_a_block: int = 1 << 15) -> DataFrame:
    """The index, a written table: a row a block of about rows_a_block vectors of one length, dealt by a hash of the row."""
    spark = rows.sparkSession
    codes = written(quantised(rows, scale), "codes")
    few = spark.sparkContext.defaultParallelism
    blocks = written(codes.groupBy("dims").agg(F.count(F.lit(1)).alias("n")).select("dims", F.greatest(F.ceil(F.col("n") / rows_a_block), F.least(F.lit(few), F.ceil(F.col("n") / 2048))).cast("int").alias("blocks")), "blocks")
    dealt = codes.join(blocks, "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", "codes"), F.col("blocks")).cast("int"))
    packed = dealt.groupBy("dims", "block").agg(F.array_sort(F.collect_list(F.struct("vec_id", "codes"))).alias("r"))

    def run(batches):
        for batch in batches:
            for dims, block, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                vec_ids = r.values.field(0).to_numpy()
                values = checked(r.values.field(1).flatten().to_numpy().reshape(-1, dims))
                lows, bits, slices = sliced(values)
                yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([block], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in (vec_ids, values.astype(np.int32), lows, bits, slices)]], ["dims", "block", "vec_ids", "values", "lows", "bits", "slices"])

    return written(packed.mapInArrow(tidy(run), INDEX), "bit-slices")


def search(index: DataFrame, queries: DataFrame, k: int = 5, queries_a_block: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each of queries (vec_id, dims, codes) over the index.

    Blocks of queries meet blocks of the index in a join on length and block; each meeting returns k rows a query.
    """
    asked = queries.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / queries_a_block).cast("int").alias("parts"))
    parts = queries.join(asked, "dims").withColumn("part", F.pmod(F.xxhash64("vec_id", "codes"), F.col("parts")).cast("int"))
    parts = parts.groupBy("dims", "part").agg(F.collect_list(F.struct("vec_id", "codes")).alias("q"))
    blocks = index.select("dims", "block")

    def run(batches):
        for batch in batches:
            for dims, asked_, *stored in zip(*[batch.column(k) for k in range(len(batch.schema))], strict=True):
                ids, q = asked_.values.field(0).to_numpy(), checked(asked_.values.field(1).flatten().to_numpy().reshape(-1, dims.as_py()))
                kinds = (np.int64, np.int32, np.int64, np.int64, np.uint64)
                vec_ids, values, lows, bits, slices = [np.frombuffer(x.as_buffer(), t) for x, t in zip(stored, kinds, strict=True)]
                words = -(-len(vec_ids) // 64)
                got = list(search_block(ids, q, vec_ids, values.reshape(len(vec_ids), -1).astype(np.int64), lows, bits, slices.reshape(-1, words), k))
                query = np.repeat(ids, [len(found) for _, found, _ in got])
                yield pa.RecordBatch.from_arrays([pa.array(query), *[pa.array(np.concatenate([x[n] for x in got])) for n in (1, 2)]], ["query_id", "vec_id", "score"])

    met = parts.join(blocks, "dims").join(index, ["dims", "block"]).select("dims", "q", "vec_ids", "values", "lows", "bits", "slices").mapInArrow(tidy(run), RESULT)
    best_ = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best_.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_products(rows: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k rows of rows (vec_id, embedding) with the largest integer inner product (all, if fewer) for each row whose vec_id
    `every` divides; ties to the smaller vec_id.

    A query's own vec_id is no candidate. Vectors of unlike lengths have no product: each length is searched by itself. Null,
    empty and non-finite vectors, those with a null component and null vec_ids take no part; zero vectors do. Repeated rows
    count once; a vec_id with several vectors counts once, as query and as candidate, by its best product; other columns are
    ignored; an empty table gives no rows. A component of 2^23 or more when scaled is an error, as scores must fit into 63 bits.
    """
    return search(build(rows, scale), quantised(rows.where(F.col("vec_id") % every == 0), scale), k)


SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT * FROM v WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(max(list_inner_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[]))) AS BIGINT) AS score
      FROM q JOIN v ON len(q.c) = len(v.c) AND q.vec_id <> v.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
