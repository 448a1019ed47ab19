"""A keyed vector store: upsert, lookups, cosine search, means, redundancy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric
from lodestar.plans.tables import folder_of, in_folders, written


def upsert(store: DataFrame, new: DataFrame, key: str = "item_id") -> DataFrame:
    """store without the keys of new, and new; of repeated new keys one row."""
    return store.join(new.select(key), key, "left_anti").select(store.columns).unionByName(new.dropDuplicates([key]).select(store.columns))


def with_prefix(store: DataFrame, paper_id: str) -> DataFrame:
    """A paper's items, by its own column rather than a prefix that other ids could share."""
    return store.where(F.col("paper_id") == paper_id)


def record_items(records: DataFrame) -> DataFrame:
    """(item_id, paper_id, text) of a record's claims, methods and techniques, numbered from 1."""
    rows = []
    for kind, column, value in (
        ("claim", "claims", F.col("x.statement")),
        ("method", "methods", F.trim(F.concat_ws(" ", "x.name", "x.description"))),
        ("technique", "techniques", F.trim(F.concat_ws(" ", "x.name", "x.description"))),
    ):
        each = records.select("paper_id", F.posexplode(column).alias("p", "x"))
        rows.append(each.select(F.concat_ws("_", "paper_id", F.lit(kind), (F.col("p") + 1).cast("string")).alias("item_id"), "paper_id", value.alias("text")))
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def unit(vec: Column) -> Column:
    """vec at length 1; one without a length stays."""
    size = F.sqrt(numeric.dot(vec, vec))
    return F.when(size > 0, F.transform(vec, lambda x: x / size)).otherwise(vec)


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def best_of_block(ids: np.ndarray, q: np.ndarray, items: np.ndarray, x: np.ndarray, k: int):
    """(places of queries, places of items, scores): the k best of a block for each query, ties to the smaller item; a query
    isn't its own neighbour."""
    s = np.round(q @ x.T, 12)
    s[ids[:, None] == items[None, :]] = -np.inf
    r = min(k, len(items))
    # all that reach the r-th best score, so that ties are settled by id afterwards
    least = -np.partition(-s, r - 1, axis=1)[:, r - 1]
    a, c = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    o = np.lexsort((np.argsort(np.argsort(items, kind="stable"), kind="stable")[c], -s[a, c], a))
    a, c = a[o], c[o]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < r
    return a[keep], c[keep], s[a[keep], c[keep]]


def reach(q: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The largest cosine that a query can have with an item of each block: its angle to the pivot less the block's radius."""
    angle = np.arccos(np.clip(q @ pivots.T, -1, 1)) - radius[None, :]
    return np.cos(np.maximum(angle, 0))


class Search:
    """Blocks of items and of queries that meet in joins; kinds: the types of item and query ids."""

    def __init__(self, store: DataFrame, queries: DataFrame, k: int):
        self.spark, self.k = store.sparkSession, k
        self.item_kind, self.query_kind = dict(store.dtypes)["item_id"], dict(queries.dtypes)["query_id"]
        self.found = f"query_id {self.query_kind}, item_id {self.item_kind}, score double"

    def cells(self, rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        """rows (id, vec) with cell, the nearest pivot."""
        shared, kind = self.spark.sparkContext.broadcast(pivots), dict(rows.dtypes)["id"]

        def run(batches):
            for b in batches:
                if len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((_matrix(b.column(1)) @ shared.value.T).argmax(1))], ["id", "vec", "cell"])

        return rows.mapInArrow(run, f"id {kind}, vec array<double>, cell long")

    def blocks(self, rows: DataFrame, most: int) -> DataFrame:
        """(cell, part, rows): a cell's rows, dealt by a hash to parts of about `most`."""
        n = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_n"))
        dealt = rows.join(n, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_n")).cast("int"))
        return dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("id", "vec"))).alias("rows"))

    def scored(self, met: DataFrame) -> DataFrame:
        """The k best of each query in each meeting (asked, rows)."""
        k = self.k

        def run(batches):
            for b in batches:
                for asked, rows in zip(b.column(0), b.column(1), strict=True):
                    q, x = asked.values, rows.values
                    ids, items = q.field(0), x.field(0)
                    a, c, s = best_of_block(np.array(ids.to_pylist(), object), _matrix(q.field(1)), np.array(items.to_pylist(), object), _matrix(x.field(1)), k)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), items.take(pa.array(c)), pa.array(s)], ["query_id", "item_id", "score"])

        return met.select("asked", F.col("rows")).mapInArrow(run, self.found)

    def read(self, met: DataFrame, path: str, most: int = 4096) -> DataFrame:
        """The k best of each query among some open blocks at a time (folder, open, asked), which tasks read from the folders at
        path: no block is shuffled for the queries that it meets."""
        k = self.k
        kind = pa.int64() if self.item_kind == "bigint" else pa.int32() if self.item_kind == "int" else pa.string()

        def run(batches):
            now, held = None, {}
            for b in batches:
                for folder, open_, asked in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                    if folder != now:
                        now, held = folder, {}
                        for t in folder_of(path, "folder", folder):
                            for name, rows in zip(t["block"].to_pylist(), t["rows"], strict=True):
                                held[name] = np.array(rows.values.field(0).to_pylist(), object), _matrix(rows.values.field(1))
                    ids, queries = asked.values.field(0), _matrix(asked.values.field(1))
                    names, wanted = np.array(ids.to_pylist(), object), sorted(open_)
                    while wanted:
                        n = int(max(1, np.searchsorted(np.cumsum([len(held[w][0]) for w in wanted]), most, "right")))
                        some, wanted = [held[w] for w in wanted[:n]], wanted[n:]
                        items = np.concatenate([s[0] for s in some])
                        a, c, score = best_of_block(names, queries, items, np.concatenate([s[1] for s in some]), k)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), pa.array(items[c].tolist(), kind), pa.array(score)], ["query_id", "item_id", "score"])

        return met.select("folder", "open", "asked").mapInArrow(run, self.found)

    def ranked(self, found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)


def topk(store: DataFrame, queries: DataFrame, k: int, block: int = 8192, asked: int = 512, pivots: int = 256, small: int = 65_536) -> DataFrame:
    """(query_id, item_id, score, rank): the k items of store (item_id, vec) nearest by cosine to each query (query_id, vec).

    Exact. Items lie in blocks of about `block` around pivots, each with its own mean as pivot and the largest angle to it as
    radius. Queries first meet the blocks of their nearest pivot; the k-th best score found there lets them skip every block
    whose pivot and radius allow less. Blocks meet in joins, and each meeting returns k items a query. A store of up to `small`
    items is met whole. Ties (scores equal to 12 digits) go to the smaller item_id; a query isn't its own neighbour; a null
    vector takes no part; pivots: so many items, by a hash of their ids.
    """
    run = Search(store, queries, k)
    items = store.where("vec is not null and item_id is not null").select(F.col("item_id").alias("id"), unit(F.col("vec").cast("array<double>")).alias("vec"))
    probes = queries.where("vec is not null and query_id is not null").select(F.col("query_id").alias("id"), unit(F.col("vec").cast("array<double>")).alias("vec"))
    total = items.count()
    if total <= small:
        one = F.pmod(F.xxhash64("id"), F.lit(1)).alias("cell")  # one cell, but no constant, on which a join would be a product
        met = run.blocks(probes.select("id", "vec", one), asked).select("cell", F.col("rows").alias("asked")).join(run.blocks(items.select("id", "vec", one), block).select("cell", "rows"), "cell")
        return run.ranked(run.scored(met))
    chosen = items.orderBy(F.xxhash64("id"), "id").limit(min(pivots, max(1, total // block))).select("vec").toArrow()
    centres = _matrix(chosen["vec"].combine_chunks())
    blocks = written(run.blocks(run.cells(items, centres), block).select(F.concat_ws("-", "cell", "part").alias("block"), "cell", "rows"), "item-blocks")
    parts = written(run.blocks(run.cells(probes, centres), asked).select(F.concat_ws("-", "cell", "part").alias("ask"), "cell", F.col("rows").alias("asked")), "query-blocks")
    near = written(run.ranked(run.scored(parts.join(blocks, "cell"))).drop("rank"), "near")
    least = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
    bounds = parts.select("ask", "cell", F.explode("asked").alias("x")).select("ask", "cell", "x.id", "x.vec").join(least, "id", "left").groupBy("ask", "cell").agg(F.collect_list(F.struct("vec", F.coalesce("least", F.lit(-2.0)).alias("least"))).alias("q"))

    def heads(batches):
        for b in batches:
            for name, cell, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                x = _matrix(rows.values.field(1))
                p = x.mean(0)
                size = np.sqrt(p @ p)
                p = p / size if size > 0 else p
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([cell]), pa.array([p.tolist()]), pa.array([float(np.arccos(np.clip(x @ p, -1, 1)).max())])], ["block", "cell", "pivot", "radius"])

    many = max(1, total // block // 1024)  # groups of pivots
    groups = F.pmod(F.xxhash64("block"), F.lit(many)).cast("int")
    pivots_ = written(blocks.mapInArrow(heads, "block string, cell long, pivot array<double>, radius double").groupBy(groups.alias("g")).agg(F.collect_list(F.struct("block", "cell", "pivot", "radius")).alias("heads")), "pivots")
    far = bounds.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(many - 1)))).join(pivots_, "g")

    def open_(batches):
        for b in batches:
            for ask, cell, q, given in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                h = given.values
                reached = reach(_matrix(q.values.field(0)), _matrix(h.field(2)), h.field(3).to_numpy())
                meets = (reached >= q.values.field(1).to_numpy()[:, None] - 1e-9).any(0) & (h.field(1).to_numpy() != cell)
                names = h.field(0).filter(pa.array(meets))
                yield pa.RecordBatch.from_arrays([pa.array([ask] * len(names), pa.string()), names], ["ask", "block"])

    left = far.select("ask", "cell", "q", "heads").mapInArrow(open_, "ask string, block string")
    folders = max(1, total * centres.shape[1] >> 20)
    folder = F.pmod(F.xxhash64("block"), F.lit(folders)).cast("int").alias("folder")
    path = in_folders(blocks.select(folder, "block", "rows"), "folder", folders, "block-folders")
    met = written(left, "open-blocks").groupBy("ask", folder).agg(F.collect_list("block").alias("open")).join(parts.select("ask", "asked"), "ask")
    return run.ranked(near.unionByName(run.read(met, path)))


def norm_topk(store: DataFrame, k: int, prefix: str | None = None) -> DataFrame:
    """The k longest vectors of a store; prefix: of items whose id begins so."""
    if prefix is not None:
        store = store.where(F.startswith(F.col("item_id").cast("string"), F.lit(prefix)))
    return store.withColumn("norm", F.sqrt(numeric.dot(F.col("vec"), F.col("vec")))).orderBy(F.desc("norm"), "item_id").limit(k)


def item_order(item_id: Column) -> Column:
    """The place of an item among a paper's: claims before methods before techniques, each by its number."""
    kind = F.when(F.rlike(item_id, F.lit("_claim_[0-9]+$")), 0).when(F.rlike(item_id, F.lit("_method_[0-9]+$")), 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.regexp_extract(item_id, "_([0-9]+)$", 1).try_cast("long").alias("number"), item_id.alias("item_id"))


def means(store: DataFrame, group: str, most: int | None = None, order: Column | str | None = None) -> DataFrame:
    """(group, pos, mean): by group the mean vector, of its first `most` items where given; a partial sum leaves each task.

    Items go by item_order where their ids are texts, else by item_id.
    """
    if most:
        by = order if order is not None else item_order(F.col("item_id")) if dict(store.dtypes)["item_id"] == "string" else "item_id"
        store = store.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(by))).where(F.col("_r") <= most)
    return store.select(group, F.posexplode("vec").alias("pos", "x")).groupBy(group, "pos").agg(F.avg("x").alias("mean"))


def redundancy(items: DataFrame, group: str, order: str = "item_id") -> DataFrame:
    """Adds score: the largest cosine with an earlier item of the same group, 0 for the first.

    Groups are papers' items, whose number the item budget bounds.
    """
    a, b = items.alias("a"), items.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col("vec").alias("_v")).alias("b")
    met = a.join(b, (F.col(f"a.{group}") == F.col("_g")) & (F.col("_o") < F.col(f"a.{order}")), "left")
    best = met.groupBy(f"a.{group}", f"a.{order}").agg(F.max(F.when(F.col("_o").isNotNull(), numeric.cosine(F.col("a.vec"), F.col("_v")))).alias("score"))
    return best.select(group, order, F.coalesce("score", F.lit(0.0)).alias("score"))
