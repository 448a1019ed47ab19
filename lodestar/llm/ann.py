"""Approximate nearest neighbours by additive quantisation.

A vector, less the mean and divided by the largest deviation of a sample, is the sum of one word of each of several
full-dimensional codebooks; each codebook is learnt on what the ones before it leave, and a vector's words are found by beam
search. Stored beside the words is the norm of their sum, so |q - x|^2 is a constant less twice a sum of table entries plus
that norm. Norms, tables and their sums are in double precision, as neighbours may lie much nearer to each other than to the
mean. The nearest by them are ranked anew on the original vectors, in double precision too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, tidy, written

RESULT = "query_id long, rank int, vec_id long, score double"


def kmeans(x: np.ndarray, k: int, rounds: int, rng) -> np.ndarray:
    """k centres of x; an empty centre takes the vector farthest from its own."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        d = (centres * centres).sum(1)[None, :] - 2 * x @ centres.T
        near = d.argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = total / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            far = np.argsort(-(d[np.arange(len(x)), near] + (x * x).sum(1)), kind="stable")
            empty = np.flatnonzero(n == 0)
            centres[empty] = x[far[np.arange(len(empty)) % len(far)]]
    return centres


class Codebooks:
    """Codebooks (books, words, dimensions), and the mean and scale by which a vector comes before them."""

    def __init__(self, sample: np.ndarray, books: int = 32, words: int = 256, rounds: int = 5, seed: int = 7):
        with np.errstate(over="ignore"):
            self.mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
            self.mean = np.where(np.isfinite(self.mean), self.mean, 0.0)
            largest = float(np.abs(sample - self.mean).max()) if len(sample) else 0.0
        self.scale = largest if 0 < largest < np.inf else 1.0
        self.words = train(self.placed(sample), books, words, rounds, seed)

    def placed(self, x: np.ndarray) -> np.ndarray:
        """x about the mean, in units of the scale; what lies beyond single precision goes to its end."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.nan_to_num(np.clip((x - self.mean) / self.scale, -1e15, 1e15))


def train(sample: np.ndarray, books: int, words: int, rounds: int, seed: int) -> np.ndarray:
    """(books, words, dimensions) codebooks, each on the residuals of those before it."""
    rng, rest, out = np.random.default_rng(seed), sample.astype(np.float32), []
    for _ in range(books):
        c = kmeans(rest, words, rounds, rng).astype(np.float32)
        rest = rest - c[((c * c).sum(1)[None, :] - 2 * rest @ c.T).argmin(1)]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: Codebooks, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(words of each vector, squared norm of their sum) by beam search over the codebooks in order."""
    n, dims = x.shape
    rest, codes = books.placed(x).astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8)
    for c in books.words:
        width = rest.shape[1]
        error = (rest * rest).sum(2)[:, :, None] + (c * c).sum(1)[None, None, :] - 2 * (rest.reshape(-1, dims) @ c.T).reshape(n, width, -1)
        flat = error.reshape(n, -1)
        k = min(beam, flat.shape[1])
        best = np.argpartition(flat, k - 1, axis=1)[:, :k]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(flat, best, 1), axis=1, kind="stable"), 1)
        parent, word = best // len(c), best % len(c)
        rest = np.take_along_axis(rest, parent[:, :, None], 1) - c[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.uint8)], 2)
    made = np.zeros((n, dims))
    for m, c in enumerate(books.words):
        made += c[codes[:, 0, m]]
    return codes[:, 0], (made * made).sum(1)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) of the rows that take part: no null, zero, or non-finite vector, and a vec_id."""
    given = only(rows, "vec_id", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return given.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(fine & F.exists("embedding", lambda x: x != 0))


def _matrices(column: pa.Array):
    """(length, places, matrix) of the vectors of a list column, by their lengths."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    for d in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == d)
        yield d, at, flat[first[at][:, None] + np.arange(d)]


def build(rows: DataFrame, sample: int = 8192, books: int = 32, words: int = 256, beam: int = 4) -> tuple[DataFrame, dict[int, Codebooks]]:
    """The index (vec_id, embedding, dims, code, norm) of every usable row, as a written table, and codebooks by length.

    sample: vectors of a length at most (about) that its codebooks are learnt on, taken by a hash of vec_id. The driver
    holds one sample and one set of codebooks a length.
    """
    fine = usable(rows).withColumn("dims", F.size("embedding"))
    learnt: dict[int, Codebooks] = {}
    for r in fine.groupBy("dims").agg(F.approx_count_distinct("vec_id").alias("n")).orderBy("dims").collect():
        of, low = fine.where(F.col("dims") == r["dims"]).select("vec_id", "embedding"), int(1_000_000 * min(1.0, sample / max(r["n"], 1)))
        taken = of.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < low).dropDuplicates(["vec_id"]).toArrow().sort_by("vec_id")
        if not taken.num_rows:
            taken = of.orderBy(F.xxhash64("vec_id"), "vec_id").limit(words).toArrow()
        learnt[r["dims"]] = Codebooks(np.array(taken["embedding"].to_pylist(), np.float64).reshape(-1, r["dims"]), books, words)
    codebooks = rows.sparkSession.sparkContext.broadcast(learnt)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                codes, norms = [b""] * len(part), np.zeros(len(part))
                for d, places, x in _matrices(part.column(1)):
                    code, norms[places] = encode(x, codebooks.value[d], beam)
                    for k, c in zip(places.tolist(), code, strict=True):
                        codes[k] = c.tobytes()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(codes, pa.binary()), pa.array(norms)], ["vec_id", "embedding", "dims", "code", "norm"])

    return written(fine.mapInArrow(run, "vec_id long, embedding array<double>, dims int, code binary, norm double"), "ann-index"), learnt


def best_by_tables(q: np.ndarray, books: Codebooks, vec: np.ndarray, code: np.ndarray, norm: np.ndarray, most: int):
    """(query, place) of the `most` rows nearest to each query by table scores, with the scores; ties to the smaller vec_id.
    vec is in order."""
    words = books.words.astype(np.float64)
    for a in range(0, len(q), 32):
        tables = words @ (-2 * books.placed(q[a : a + 32]).T)  # by book a row a word, a column a query
        sums = np.repeat(norm[:, None], tables.shape[2], axis=1)
        for m in range(len(tables)):
            sums += tables[m][code[:, m]]
        score = np.ascontiguousarray(sums.T)
        last = np.partition(score, most - 1, axis=1)[:, most - 1] if most < len(vec) else np.full(len(score), np.inf)
        for i, s in enumerate(score):
            below = np.flatnonzero(s < last[i])
            near = np.concatenate([below, np.flatnonzero(s == last[i])[: max(0, most - len(below))]])
            yield a + i, near, s[near]


def _spread(most: int, least_blocks: int) -> F.Column:
    """The number of blocks of about `most` rows for n rows; up to least_blocks smaller ones where there are few."""
    n = F.col("n")
    return F.greatest(F.ceil(n / most), F.least(F.lit(least_blocks), F.ceil(n / 1024))).cast("int")


def candidates(index: DataFrame, codebooks: dict[int, Codebooks], queries: DataFrame, most: int, rows_a_block: int = 1 << 16, queries_a_block: int = 1024) -> DataFrame:
    """query_id, vec_id: the `most` rows of the whole index that are nearest by table scores to each query, itself left out.

    Blocks of codes meet blocks of queries of the same length in a join: a block of codes stays in its task, and a block of
    queries goes once to each. A task keeps `most` a query and block before any shuffle.
    """
    spark = index.sparkSession
    shared = spark.sparkContext.broadcast(codebooks)
    few = spark.sparkContext.defaultParallelism
    codes = index.groupBy("dims", "vec_id", "code").agg(F.first("norm").alias("norm"))  # repeated rows go before the blocks
    counts = index.groupBy("dims").agg(F.count(F.lit(1)).alias("n"))
    blocks = written(counts.select("dims", _spread(rows_a_block, few).alias("blocks")), "blocks")  # a row a length
    codes = codes.join(F.broadcast(blocks), "dims").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.col("blocks")).cast("int"))
    codes = codes.groupBy("dims", "block").agg(F.collect_list(F.struct("vec_id", "code", "norm")).alias("c"))
    asked = queries.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / queries_a_block).cast("int").alias("parts"))
    parts = queries.join(F.broadcast(asked), "dims").withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(13)), F.col("parts")).cast("int"))
    parts = parts.groupBy("dims", "part").agg(F.collect_list(F.struct("vec_id", "embedding")).alias("q"))
    parts = parts.join(F.broadcast(blocks), "dims").select("dims", "q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(batches):
        for batch in batches:
            for dims, asked_, rows in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                ids, q = asked_.values.field(0).to_numpy(), np.array(asked_.values.field(1).to_pylist(), np.float64)
                vec = rows.values.field(0).to_numpy()
                order = np.argsort(vec, kind="stable")
                code = np.frombuffer(b"".join(rows.values.field(1).to_pylist()), np.uint8).reshape(len(vec), -1)[order]
                norm, vec = rows.values.field(2).to_numpy()[order], vec[order]
                for k, near, score in best_by_tables(q, shared.value[dims], vec, code, norm, min(len(vec), most + 1)):
                    other = vec[near] != ids[k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(int(other.sum()), ids[k])), pa.array(vec[near][other]), pa.array(score[other])], ["query_id", "vec_id", "near"])

    met = parts.join(codes, ["dims", "block"]).select("dims", "q", "c").mapInArrow(tidy(run), "query_id long, vec_id long, near double")
    by = Window.partitionBy("query_id").orderBy("near", "vec_id")
    return met.withColumn("_r", F.row_number().over(by)).where(F.col("_r") <= most).select("query_id", "vec_id").distinct()


def search(index: DataFrame, codebooks: dict[int, Codebooks], queries: DataFrame, k: int = 10, most: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The k nearest of each query (vec_id, embedding, dims) among all other rows of the index: of the `most` nearest by
    table scores over the whole index, ranked anew on the original vectors. That is `most` exact distances a query, however
    large the index."""
    queries = queries.select("vec_id", "embedding", "dims").distinct()
    found = written(candidates(index, codebooks, queries, max(most, k)), "candidates")
    wanted = found.select("vec_id").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted  # else the join shuffles
    vectors = index.join(wanted, "vec_id", "left_semi").select("vec_id", F.col("embedding").alias("x"), "dims").distinct()

    def run(batches):
        for batch in batches:
            score = np.zeros(len(batch))
            for (_, at, q), (_, _, x) in zip(_matrices(batch.column(2)), _matrices(batch.column(3)), strict=True):
                score[at] = np.sqrt(((x - q) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], ["query_id", "vec_id", "score"])

    asked = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "dims")
    pairs = found.join(vectors, "vec_id").join(asked, ["query_id", "dims"]).select("query_id", "vec_id", "q", "x")
    scored = pairs.mapInArrow(tidy(run), "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """The k nearest (all, if fewer) of each row of rows (vec_id, embedding) whose vec_id `every` divides, nearest first.

    Nearness is the Euclidean distance, ties to the smaller vec_id; a query's own vec_id is no candidate. Vectors of unlike
    lengths have no distance: each length is searched by itself. Null, empty, zero and non-finite vectors and null vec_ids
    take no part; repeated rows count once; of several vectors of one vec_id the nearest pair counts; other columns are
    ignored; an empty table gives no rows.
    """
    index, codebooks = build(rows)
    return search(index, codebooks, index.where(F.col("vec_id") % every == 0), k)
