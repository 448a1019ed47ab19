"""Pairs of sets with codes in common, counted a pair of blocks at a time.

Sets are dealt to blocks of about equal numbers of postings, which are written once to the folder that all executors share. What
Spark deals out is the list of pairs of blocks; a task reads the blocks of its pairs from there, a few at once. So nothing is
shuffled for a pair of blocks, and what a task holds is bounded by the size of a block, whatever the number of sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.tables import folder_of, in_folders, written

CELLS = 1 << 15  # pairs counted at once, so few that they stay in a core's cache
VECTOR = "_vector"  # a column of sets from which pairs get a similarity
MOST = 400_000  # postings of a block; a task holds a few blocks, so that this bounds its memory whatever the number of sets
SQUARE, MANY = 2, 64  # blocks that meet as many others at a time, read once, in a task; twice as many where blocks are many
WIDE = 256  # from so many blocks on, four times as many
KINDS = 1 << 22  # numbers that a task keeps at most while it counts pairs by kind
ARROW = {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}  # columns of marks


def seed_of(tags: DataFrame, seeds: int = 8) -> int:
    """A seed under which the hashes of all tags (tag) differ, so that a hash says the same as its tag."""
    tags = written(tags.select("tag").distinct(), "tags")
    for seed in range(seeds):
        if tags.groupBy(F.xxhash64("tag", F.lit(seed)).alias("c")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            return seed
    raise RuntimeError("hashes of tags meet under every seed")


class Side:
    """A block's sets as arrays: at has each posting's place among the block's distinct codes (tags), owners has the sets by
    tag, those of a tag from its start on."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows[c].combine_chunks()
        self.rows, codes = rows.drop_columns(["codes"]), column("codes")
        self.lengths = codes.value_lengths().to_numpy(zero_copy_only=False)
        self.ids, self.domains = column("paper_id"), column("domain")
        values = codes.flatten().to_numpy(zero_copy_only=False)
        order = np.argsort(values)
        ordered = values[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        self.start = np.append(np.flatnonzero(new), len(ordered))
        self.tags = ordered[new]
        self.at, self.owner = np.empty(len(values), np.int32), np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        self.at[order] = np.cumsum(new, dtype=np.int32) - 1
        self.owners = self.owner[order]


def ranks(values: pa.Array) -> np.ndarray:
    """Numbers in the order of values, equal for equal ones."""
    if pa.types.is_integer(values.type):
        return values.to_numpy(zero_copy_only=False)
    return np.unique(np.array(values.to_pylist(), object), return_inverse=True)[1]


def found(left: Side, right: Side, itself: bool, least: int, high: np.ndarray, crossing: bool, heads: bool, alike: bool = False):
    """(x, y, shared, strong) by some sets of the left block at a time: places of sets on the left and, after all of those, on
    the right, and the order of both ids. crossing: only pairs of two domains; alike: only those of one.

    heads: codes go from the rarest on; the last least - 1 of a left set are counted only where one before them is shared,
    without which no pair has `least`.
    """
    n, m = len(left.ids), len(right.ids)
    rank, domain = ranks(pa.concat_arrays([left.ids, right.ids])), ranks(pa.concat_arrays([left.domains, right.domains])) if crossing or alike else None
    place = np.minimum(np.searchsorted(right.tags, left.tags), len(right.tags) - 1)
    place[right.tags[place] != left.tags] = -1
    here = place[left.at]
    met = np.flatnonzero(here >= 0)
    here, row = here[met], left.owner[met]
    size, start = np.diff(right.start)[here], right.start[here]
    marked = np.isin(right.tags, high)[here] if len(high) else None
    if heads:
        ends = np.cumsum(left.lengths)
        tail = met >= ends[row] - (least - 1)
    first = np.searchsorted(row, np.arange(n + 1))
    work = np.concatenate([[0], np.cumsum(size)])
    shift, owners, steps = start - work[:-1], right.owners, np.arange(CELLS)
    at = 0
    while at < n:
        to = max(at + 1, min(at + max(1, CELLS // m), int(np.searchsorted(work[first[1:]], work[first[at]] + 2 * CELLS, "right"))))
        span = slice(first[at], first[to])

        def counted(some, at=at, to=to):
            s = size[some]
            k = int(s.sum())
            from_ = shift[some] + work[some.start] if isinstance(some, slice) else start[some] - (np.cumsum(s) - s)
            cell = np.repeat(from_, s)
            cell += steps[:k] if k <= len(steps) else np.arange(k)
            cell = owners[cell].astype(np.int64)
            cell += np.repeat((row[some] - at) * m, s)
            return np.bincount(cell, minlength=(to - at) * m)

        if heads:
            span = np.arange(span.start, span.stop)
            shared = counted(span[~tail[span]])
            open_ = np.flatnonzero(shared.reshape(-1, m).any(1))
            rest = span[tail[span] & np.isin(row[span] - at, open_)]
            if len(rest):
                shared = np.where(shared > 0, shared + counted(rest), 0)
        else:
            shared = counted(span)
        cells = np.flatnonzero(shared >= least)
        x = cells // m
        y = cells - x * m + n
        x += at
        keep = rank[x] < rank[y] if itself else rank[x] != rank[y]
        if domain is not None:
            keep &= (domain[x] != domain[y]) == crossing
        if not keep.all():
            cells, x, y = cells[keep], x[keep], y[keep]
        if len(cells):
            some = (span if heads else np.arange(span.start, span.stop))[marked[span]] if marked is not None else ()
            strong = counted(some)[cells] > 0 if len(some) else np.zeros(len(cells), bool)
            yield x, y, shared[cells], strong, rank
        at = to


def vectors_of(side: Side, width: int) -> np.ndarray:
    """A row a set of its vector, zeros where it has none or is shorter than width."""
    given = side.rows[VECTOR].combine_chunks()
    lengths = given.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((len(given), width))
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(given)), lengths), place] = given.flatten().fill_null(0.0).to_numpy(zero_copy_only=False)
    return out


class Cosines:
    """The cosines of pairs of places in two sides, 0 where a vector has no length."""

    def __init__(self, left: Side, right: Side):
        width = max([0, *[pc.max(s.rows[VECTOR].combine_chunks().value_lengths()).as_py() or 0 for s in (left, right)]])
        self.n, (self.x, self.y) = len(left.ids), (vectors_of(s, width) for s in (left, right))
        self.sizes = [np.sqrt((v * v).sum(1)) for v in (self.x, self.y)]

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        first, y = int(x[0]), y - self.n
        dots = (self.x[first : int(x[-1]) + 1] @ self.y.T)[x - first, y]
        size = self.sizes[0][x] * self.sizes[1][y]
        return np.divide(dots, size, out=np.zeros(len(x)), where=size > 0)


class Marks:
    """What is known of some pairs of two blocks: rows (a, b, and more columns) by places in the blocks."""

    def __init__(self, left: Side, right: Side, itself: bool, rows: pa.Table):
        rows = rows.combine_chunks()
        self.n, self.m, self.rows = len(left.ids), len(right.ids), rows.drop_columns(["a", "b"])
        found_ = [self._places(rows, "a", "b", left, right)]
        if not itself:
            found_.append(self._places(rows, "b", "a", left, right))
        row, x, y = (np.concatenate(z) for z in zip(*found_, strict=True))
        order = np.argsort(x * self.m + y)
        self.keys, self.row = (x * self.m + y)[order], row[order]

    @staticmethod
    def _places(rows: pa.Table, one: str, other: str, left: Side, right: Side):
        """(row, x, y): places of `one` on the left and of `other` on the right, for each row that has both; an id may have
        several places."""
        at, out = np.arange(len(rows)), []
        for side, c in ((left, one), (right, other)):
            known = side.ids.dictionary_encode()
            code = known.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            begin = np.searchsorted(code[order], np.arange(len(known.dictionary) + 1))
            here = pc.fill_null(pc.index_in(rows[c].combine_chunks(), value_set=known.dictionary), -1).to_numpy(zero_copy_only=False)[at]
            kept = np.flatnonzero(here >= 0)
            at, here, out = at[kept], here[kept], [o[kept] for o in out]
            times = np.diff(begin)[here]
            nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, out = np.repeat(at, times), [np.repeat(o, times) for o in out]
            out.append(order[np.repeat(begin[here], times) + nth])
        return at, *out

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of found() the row that is known of it, or -1."""
        first = int(x[0]) * self.m
        low, high = np.searchsorted(self.keys, [first, (int(x[-1]) + 1) * self.m])
        if low == high:
            return np.full(len(x), -1)
        table = np.full((int(x[-1]) + 1) * self.m - first, -1, np.int32)
        table[self.keys[low:high] - first] = self.row[low:high]
        return table[x * self.m + (y - self.n) - first]


class Forest:
    """Which of n places are connected: root has one place for all that are."""

    def __init__(self, n: int):
        self.root, self.links = np.arange(n), np.zeros(n, np.int64)

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        self.links += np.bincount(x, minlength=len(self.links))
        x, y = self.root[x], self.root[y]
        while (some := x != y).any():
            low, high = np.minimum(x[some], y[some]), np.maximum(x[some], y[some])
            np.minimum.at(self.root, high, low)
            while (further := self.root[self.root] != self.root).any():
                self.root[further] = self.root[self.root[further]]
            x, y = self.root[low], self.root[high]

    def stars(self):
        """Places but roots, their roots, and at one place of each root the number of links added there."""
        leaves = np.flatnonzero(self.root != np.arange(len(self.root)))
        roots, once = np.unique(self.root[leaves], return_index=True)
        links = np.zeros(len(leaves), np.int64)
        links[once] = np.bincount(self.root, self.links, len(self.root)).astype(np.int64)[roots]
        return leaves, self.root[leaves], links


class Blocks:
    """sets (paper_id, domain, tags, and more columns) dealt to blocks of about so many postings, those of a group apart.

    marks (a, b, and more columns; a < b): what is known of some pairs, dealt to the pairs of blocks of their papers, so that
    pairs get these columns, of several rows the largest values, without a join.

    asking: a boolean column of sets; then only pairs with an asking set are counted, and blocks without one don't meet.
    """

    def __init__(self, sets: DataFrame, scope: str, high: list[str], postings: int | None, seed: int | None = None, marks: DataFrame | None = None, asking: str | None = None):
        spark = sets.sparkSession
        if seed is None:
            seed = seed_of(sets.select(F.explode("tags").alias("tag")))
        apart = marks is None and (scope == "within" or (scope == "cross" and len(sets.select("domain").distinct().take(65)) < 65))  # many domains lie in blocks together
        self.crossing, self.alike, self.apart, self.scope = scope == "cross" and not apart, scope == "within" and not apart, apart, scope
        self.kinds = dict(sets.dtypes)
        self.vectors = VECTOR in sets.columns
        self.more = [c for c in sets.columns if c not in ("paper_id", "domain", "tags", VECTOR, asking)]
        asks = F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))
        if marks is not None and asking is not None:
            raise ValueError("marks are dealt to blocks of all sets")
        sets = sets.withColumn("_g", F.concat(F.when(asks, "+").otherwise("-"), F.col("domain").cast("string") if apart else F.lit("")))
        total = sets.agg(F.sum(F.size("tags"))).first()[0] or 0
        postings = postings or min(MOST, max(50_000, total // 24))
        folders = max(1, -(-total // postings))
        self.square = SQUARE if folders <= MANY else 2 * SQUARE if folders <= WIDE else 4 * SQUARE
        self.counts = written(sets.groupBy("_g").agg(F.ceil(F.sum(F.size("tags")) / postings).cast("int").alias("_n")).withColumn("_s", F.pmod(F.xxhash64("_g"), F.lit(folders)).cast("int")), "block-counts")
        codes = F.transform("tags", lambda t: F.xxhash64(t, F.lit(seed))).alias("codes")
        dealt = sets.join(self.counts, "_g").withColumn("_b", F.pmod(F.xxhash64("paper_id"), F.col("_n")).cast("int"))
        rows = dealt.select(((F.col("_s") + F.col("_b")) % folders).alias("_folder"), "_g", "_b", "paper_id", "domain", codes, *self.more, *[VECTOR] * self.vectors)
        self.path, self.folders = in_folders(rows, "_folder", folders, "blocks"), folders
        wanted = spark.range(1).select(F.array(*[F.xxhash64(F.lit(t), F.lit(seed)) for t in high]).alias("c")).first().c
        self.high = np.array(sorted(wanted), np.int64)
        self.marks, self.marked = [], None
        if marks is not None:
            self._mark(marks)
        self._squares: DataFrame | None = None

    def _mark(self, marks: DataFrame) -> None:
        self.marks = [(c, k) for c, k in marks.dtypes if c not in ("a", "b")]
        self.mark_folders = min(self.folders * (self.folders + 1) // 2, 20_000)
        of = lambda c: F.pmod(F.xxhash64(F.col(c).cast(self.kinds["paper_id"])), F.lit(self.folders)).cast("int")  # noqa: E731  as _b, where no group lies apart
        dealt = marks.withColumns({"_x": of("a"), "_y": of("b")}).select(F.least("_x", "_y").alias("_i"), F.greatest("_x", "_y").alias("_j"), "a", "b", *[c for c, _ in self.marks])
        cell = F.floor(F.col("_j") * (F.col("_j") + 1) / 2).cast("int") + F.col("_i")
        tasks = min(self.mark_folders, 16 * marks.sparkSession.sparkContext.defaultParallelism)
        there = dealt.withColumn("_cell", cell % self.mark_folders).repartition(tasks, "_cell")  # what is grouped and written lies there already
        once = there.groupBy("_cell", "_i", "_j", "a", "b").agg(*[F.max(c).alias(c) for c, _ in self.marks])
        self.marked = in_folders(once, "_cell", None, "marks")

    def mark_kinds(self, most: int) -> int:
        """How many different values marks have, counted up to most + 1."""
        if self.marked is None:
            return 0
        told = self.counts.sparkSession.read.schema(", ".join(f"{c} {k}" for c, k in self.marks)).parquet(self.marked)
        return len(told.select(*[c for c, _ in self.marks]).distinct().take(most + 1))

    def squares(self) -> DataFrame:
        """Pairs of groups' squares of blocks, dealt out evenly."""
        if self._squares is None:
            last = F.floor((F.col("_n") - 1) / self.square).cast("int")
            each = self.counts.select("_g", "_n", "_s", F.explode(F.sequence(F.lit(0), last)).alias("_i"), last.alias("_l"), F.substr("_g", F.lit(2)).alias("_of"), F.col("_g").startswith("+").alias("_asks"))
            asking = each.where("_asks")
            if self.scope == "cross" and self.apart:
                asking, each = (x.withColumn("_z", F.pmod(F.xxhash64("_g"), F.lit(1))) for x in (asking, each))  # no constant, on which a join would be a product
                on, meet = "_z", F.when(F.col("_asked"), F.col("_of") < F.col("_with")).otherwise(F.col("_of") != F.col("_with"))
            else:
                on, meet = "_of", ~F.col("_asked")
            other = each.select(F.col("_g").alias("_h"), F.col("_n").alias("_m"), F.col("_s").alias("_t"), F.col("_i").alias("_j"), F.col("_asks").alias("_asked"), F.col("_of").alias("_with"), on)
            met = asking.join(other, on).where(meet).select("_g", "_n", "_s", "_i", "_h", "_m", "_t", "_j")
            if not (self.scope == "cross" and self.apart):
                met = met.unionByName(asking.select("_g", "_n", "_s", "_i", F.col("_g").alias("_h"), F.col("_n").alias("_m"), F.col("_s").alias("_t"), F.explode(F.sequence("_i", "_l")).alias("_j")))
            met = written(met.select("_g", "_n", "_s", "_i", "_h", "_m", "_t", "_j"), "squares")
            self._squares = met.repartition(max(1, min(met.count(), 16 * met.sparkSession.sparkContext.defaultParallelism)))
        return self._squares

    def _run(self, task, schema: str) -> DataFrame:
        """task() gives, for a task, what a pair of blocks yields and what its end yields."""
        path, folders, square, marked, mark_folders = self.path, self.folders, self.square, self.marked, getattr(self, "mark_folders", 0)

        def side(g, b: int, k: int) -> Side | None:
            parts = [t.filter(pc.and_(pc.equal(t["_g"], g), pc.equal(t["_b"], b))) for t in folder_of(path, "_folder", k)]
            return Side(pa.concat_tables(parts).combine_chunks()) if sum(map(len, parts)) else None

        def known(left: Side, right: Side, i: int, j: int) -> Marks | None:
            if marked is None:
                return None
            parts = [t.filter(pc.and_(pc.equal(t["_i"], i), pc.equal(t["_j"], j))).drop_columns(["_i", "_j"]) for t in folder_of(marked, "_cell", (j * (j + 1) // 2 + i) % mark_folders)]
            return Marks(left, right, i == j, pa.concat_tables(parts)) if sum(map(len, parts)) else None

        def run(batches):
            work, end = task()
            held: dict = {}  # the blocks on the right of a square; one on the left at a time
            for batch in batches:
                for r in batch.to_pylist():
                    rights = [(r["_h"], o) for o in range(r["_j"] * square, min(r["_m"], (r["_j"] + 1) * square))]
                    held = {k: held[k] for k in rights if k in held}
                    for b in range(r["_i"] * square, min(r["_n"], (r["_i"] + 1) * square)):
                        me, left = (r["_g"], b), None
                        for k in rights:
                            if k[0] == r["_g"] and k[1] < b:
                                continue
                            if k not in held:
                                held[k] = side(*k, (r["_t"] + k[1]) % folders)
                            if left is None and (left := held[me] if me in held else side(*me, (r["_s"] + b) % folders)) is None:
                                break
                            if held[k] is not None:
                                yield from work(left, held[k], k == me, known(left, held[k], b, k[1]))
            yield from end()

        return self.squares().mapInArrow(run, schema)

    def pairs(self, least: int, heads: bool = False) -> DataFrame:
        """(a, b, domain_a, domain_b, shared, strong, each more column of both papers, similarity where sets have vectors, and the
        columns of marks): a row a pair."""
        high, crossing, alike, more, vectors = self.high, self.crossing, self.alike, self.more, self.vectors
        pieces, marks = ["domain", *more], [c for c, _ in self.marks]
        names = ["a", "b", *[f"{c}_{end}" for c in pieces for end in "ab"], "shared", "strong", *["similarity"] * vectors, *marks]
        kinds = [self.kinds["paper_id"]] * 2 + [self.kinds[c] for c in pieces for _ in "ab"] + ["long", "boolean", *["double"] * vectors, *[k for _, k in self.marks]]
        schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True))
        types = {c: ARROW[k] for c, k in self.marks}

        def work(left, right, itself, known):
            column = lambda c: pa.concat_arrays([left.rows[c].combine_chunks(), right.rows[c].combine_chunks()])
            ids, sides, cosines = column("paper_id"), [column(c) for c in pieces], Cosines(left, right) if vectors else None
            for x, y, shared, strong, rank in found(left, right, itself, least, high, crossing, heads, alike):
                turned = rank[x] > rank[y]
                at = [pa.array(np.where(turned, y, x)), pa.array(np.where(turned, x, y))]
                told = []
                if marks and known is None:
                    told = [pa.nulls(len(x), types[c]) for c in marks]
                elif marks:
                    row = known.of(x, y)
                    told = [known.rows[c].combine_chunks().take(pa.array(row, mask=row < 0)) for c in marks]
                yield pa.RecordBatch.from_arrays([*[ids.take(k) for k in at], *[s.take(k) for s in sides for k in at], pa.array(shared.astype(np.int64)), pa.array(strong), *([pa.array(cosines.of(x, y))] if vectors else []), *told], names)

        return self._run(lambda: (work, lambda: ()), schema)

    def tally(self, first: tuple[str, int], second: tuple[str, int], most: int, similar: float | None = None) -> DataFrame:
        """(first, second, shared, strong, crossing, similar, the columns of marks, n): how many pairs of a kind there are. Tasks
        count, so that no pair is a row.

        first and second: a column of sets and the number of its values, from 0 on; of a pair, the first paper's value of the one
        and the second's of the other count. shared: up to most. similar: whether the cosine of both vectors is so high at least (or no number, which Spark takes for the highest).
        """
        high, crossing, alike, vectors, marks = self.high, self.crossing, self.alike, self.vectors and similar is not None, [c for c, _ in self.marks]
        (one, n_one), (two, n_two) = first, second
        shape = (n_one, n_two, most, 2, 2, 2)
        size = int(np.prod(shape))
        if size > KINDS:
            raise ValueError(f"more than {KINDS} kinds of pairs")
        schema = "first int, second int, shared int, strong boolean, crossing boolean, similar boolean, n long" + "".join(f", {c} {k}" for c, k in self.marks)
        names, types = ["first", "second", "shared", "strong", "crossing", "similar", "n", *marks], [ARROW[k] for _, k in self.marks]

        def task():
            counts: dict = {}  # by the values of marks

            def work(left, right, itself, known):
                column = lambda c: pa.concat_arrays([left.rows[c].combine_chunks(), right.rows[c].combine_chunks()])
                values = lambda c: column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                firsts, seconds, domain = values(one) * n_two, values(two), ranks(column("domain"))
                cosines = Cosines(left, right) if vectors else None
                told = [tuple(r.values()) for r in known.rows.to_pylist()] if known and len(known.rows) < 64 else None
                if known and told is None:
                    kinds_ = known.rows.append_column("_r", pa.array(np.arange(len(known.rows)))).group_by(marks).aggregate([("_r", "list")])
                    told, code = [tuple(r[c] for c in marks) for r in kinds_.select(marks).to_pylist()], np.empty(len(known.rows), np.int64)
                    for k, rows in enumerate(kinds_["_r_list"].to_pylist()):
                        code[rows] = k
                elif known:
                    code = np.arange(len(told))
                every = [tuple([None] * len(marks)), *(told or [])]
                here, open_, held = np.zeros(size * len(every), np.int64), [], 0
                for x, y, shared, strong, rank in found(left, right, itself, 1, high, crossing, False, alike):
                    turned = rank[x] > rank[y]
                    kind = np.where(turned, firsts[y] + seconds[x], firsts[x] + seconds[y]) * most + (np.minimum(shared, most) - 1)
                    kind = ((kind * 2 + strong) * 2 + (domain[x] != domain[y])) * 2 + (~(cosines.of(x, y) < similar) if vectors else 0)
                    if known:
                        row = known.of(x, y)
                        kind += np.where(row < 0, 0, code[row] + 1) * size
                    open_.append(kind)
                    held += len(kind)
                    if held >= len(here):
                        here += np.bincount(np.concatenate(open_), minlength=len(here))
                        open_, held = [], 0
                if open_:
                    here += np.bincount(np.concatenate(open_), minlength=len(here))
                for k, values_ in enumerate(every):
                    part = here[k * size : (k + 1) * size]
                    if values_ in counts:
                        counts[values_] += part
                    elif part.any():
                        counts[values_] = part.copy()
                yield from ()

            def end():
                for told, n in counts.items():
                    at = np.flatnonzero(n)
                    a, b, shared, strong, crossing_, similar_ = np.unravel_index(at, shape)
                    ints, flags = [pa.array(z.astype(np.int32)) for z in (a, b, shared + 1)], [pa.array(z == 1) for z in (strong, crossing_, similar_)]
                    yield pa.RecordBatch.from_arrays([*ints, *flags, pa.array(n[at]), *[pa.array([v] * len(at), t) for v, t in zip(told, types, strict=True)]], names)

            return work, end

        return self._run(task, schema)

    def stars(self, least: int, heads: bool = False) -> DataFrame:
        """(a, b, links): for each pair of blocks, a spanning forest of its pairs, and how many pairs each tree stands for, at one
        edge of it. What is connected by pairs is connected by these, and links of a component add up to its pairs."""
        high, crossing, alike, kind = self.high, self.crossing, self.alike, self.kinds["paper_id"]

        def work(left, right, itself, known):
            n = len(left.ids)
            forest = Forest(n if itself else n + len(right.ids))
            for x, y, *_ in found(left, right, itself, least, high[:0], crossing, heads, alike):
                forest.add(x, y - n if itself else y)
            u, v, links = forest.stars()
            ids = left.ids if itself else pa.concat_arrays([left.ids, right.ids])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(u)), ids.take(pa.array(v)), pa.array(links)], ["a", "b", "links"])

        return self._run(lambda: (work, lambda: ()), f"a {kind}, b {kind}, links long")
