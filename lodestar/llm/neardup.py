"""Near-duplicates by MinHash signatures, an inverted join on their coordinates, and exact confirmation on full sets.

1. Each document becomes its set of word shingles (64-bit hashes), a hash of the whole set, and a signature of COORDINATES
   minima. Documents of one set form a class, a node from here on.
2. Two sets at the threshold agree in at least `matches` coordinates, but for one pair in a billion, so they share one of
   any COORDINATES - matches + 1 of them. Each node is posted under its rarest coordinate-value pairs only (the prefix).
   The long lists beyond the prefix are skipped and never merged: what they would add to a pair's count of collisions is
   read off the two signatures where the pair meets in a short list.
3. First the node of each list goes to its smallest partner with `matches` collisions, and these stars are confirmed on
   full sets, so that a group of copies becomes one component at the price of one set a node. Then only pairs of nodes in
   different components are left: each is confirmed in one list, that of the first coordinate both are posted under.
   Lists and stars over a block's size are dealt as pairs of blocks. No pair table is ever made.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.graph import components

from .common import dropped, only, tidy, written
from .tokens import slices

COORDINATES = 32
BLOCK = 1024  # documents of a block
BLOCK_BYTES = 4 << 20  # of full sets in a block
_rng = np.random.default_rng(20240101)
_XOR = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of `size` words; of all its words where it has fewer; else none.

    Words are what ASCII white space parts, A-Z in lower case.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[coded.indices.to_numpy()]
    real = np.array([w != "" for w in words], bool)[coded.indices.to_numpy()] if words else np.zeros(0, bool)
    ends = np.cumsum(np.concatenate([[0], real]))[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])]
    hashes = hashes[real]
    grams = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        grams[: len(hashes) - k] += hashes[k:] * _PLACE[k] if k < len(hashes) else 0
        grams = _mixed(grams) if k < size - 1 else grams
    grams = _mixed(grams)
    out = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(s: np.ndarray) -> np.ndarray:
    return (((s[None, :] ^ _XOR[:, None]) * _MUL[:, None]) >> np.uint64(32)).min(1).astype("<u4")


def least_matches(num: int, den: int, lost: float = 1e-9) -> int:
    """The most coordinates that two sets at num / den fail to agree in with a probability of `lost` at most."""
    t, below = num / den, 0.0
    for k in range(COORDINATES):
        below += math.comb(COORDINATES, k) * t**k * (1 - t) ** (COORDINATES - k)
        if below > lost:
            return max(1, k)
    return COORDINATES


def _forest(n: int, pairs) -> list[tuple[int, int]]:
    """(root, member) for the members of each tree that pairs join; the root is the smallest place."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(find(x), x) for x in range(n) if find(x) != x]


def partners(sig: np.ndarray, matches: int) -> list[tuple[int, int]]:
    """For each place whose signature agrees with another's in `matches` coordinates: it, and the first such other."""
    out = []
    for at in range(0, len(sig), 64):
        n = (sig[at : at + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.uint8)
        n[np.arange(len(n)), np.arange(at, at + len(n))] = 0
        some = n >= matches
        rows = np.flatnonzero(some.any(1))
        out += zip((rows + at).tolist(), some[rows].argmax(1).tolist(), strict=True)
    return out


def unsettled(sig: np.ndarray, posted: np.ndarray, component: np.ndarray, block: np.ndarray, coordinate: int, matches: int) -> np.ndarray:
    """The places with a partner of another component that this coordinate's list is to confirm: the first coordinate that
    both agree in and are posted under (a bit each in `posted`). Where two blocks meet, partners are of different blocks."""
    cross = bool((block != block[0]).any())
    bits = (posted[:, None] >> np.arange(COORDINATES, dtype=np.int64)) & 1 == 1
    found = np.zeros(len(sig), bool)
    for at in range(0, len(sig), 64):
        same = sig[at : at + 64, None, :] == sig[None, :, :]
        other = component[at : at + 64, None] != component[None, :]
        if cross:
            other &= block[at : at + 64, None] != block[None, :]
        a, b = np.nonzero((same.sum(2, dtype=np.uint8) >= matches) & other)
        home = (same[a, b] & bits[a + at] & bits[b]).argmax(1) == coordinate
        found[a[home] + at] = True
        found[b[home]] = True
    return np.flatnonzero(found)


def linked_to(root: np.ndarray, s: np.ndarray, num: int, den: int) -> bool:
    if den * min(len(root), len(s)) < num * max(len(root), len(s)):
        return False
    at = np.minimum(np.searchsorted(root, s), len(root) - 1)
    both = int((root[at] == s).sum())
    return den * both >= num * (len(root) + len(s) - both)


def confirmed(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of all links den * |A & B| >= num * |A | B| among the sets, by counts over shared shingles."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    every = np.concatenate([sets[k] for k in order]) if n else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(n), size[order])
    values, at, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count[at] > 1
    columns = np.cumsum(count > 1) - 1
    col, row = columns[at[shared]], owner[shared]
    width = int((count > 1).sum())
    if not width:
        return []
    sorted_size, pairs = size[order], []
    start = np.searchsorted(row, np.arange(n + 1))
    # rows of one block against all, `wide` columns of the shared shingles at a time
    step, wide = 256, 2048
    by_col = np.argsort(col, kind="stable")
    col_c, row_c = col[by_col], row[by_col]
    cuts = np.searchsorted(col_c, np.arange(0, width + wide, wide))
    for a in range(0, n, step):
        b = min(a + step, n)
        if start[b] == start[a]:
            continue
        # only rows no smaller than the block's and small enough to reach the threshold
        top = int(np.searchsorted(sorted_size, sorted_size[b - 1] * den / num, "right"))
        inter = np.zeros((b - a, top - a), np.float32)
        for x, y in zip(cuts, cuts[1:]):
            r, c = row_c[x:y], col_c[x:y]
            keep = (r >= a) & (r < top)
            r, c = r[keep] - a, c[keep]
            if not len(r) or r.min() >= b - a:
                continue
            used, c = np.unique(c, return_inverse=True)
            m = np.zeros((top - a, len(used)), np.float32)
            m[r, c] = 1
            inter += m[: b - a] @ m.T
        i, j = np.nonzero(inter)
        ok = i < j
        i, j = i[ok], j[ok]
        both = inter[i, j].astype(np.int64)
        link = den * both >= num * (sorted_size[i + a] + sorted_size[j + a] - both)
        pairs += zip(order[i[link] + a].tolist(), order[j[link] + a].tolist(), strict=True)
        pairs = [(x, y) for x, y in _forest(n, pairs)]
    return _forest(n, pairs)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, set_key (a hash of the whole set) and sig (bytes) of every document."""

    def run(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                sets = shingle_sets(part.column(1), size)
                key = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                sig = [signature(s).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, sets), pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(tidy(run), "doc_id long, n_shingles long, set_key binary, sig binary")


def classes_of(signed: DataFrame) -> DataFrame:
    """node (any unique number, fixed once written), rep (the smallest doc_id), set_key, n_shingles, sig of each set."""
    by_set = signed.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return by_set.withColumn("node", F.monotonically_increasing_id())


def _posted(classes: DataFrame, matches: int) -> DataFrame:
    """node, key, posted: each class under its rarest coordinate-value pairs that any other class has too; posted: a bit
    for each coordinate that it is under."""
    spark = classes.sparkSession

    def post(batches):
        place = np.arange(COORDINATES, dtype=np.int64) << 32
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, COORDINATES)
                key = (sig.astype(np.int64) | place).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(batch.column(0).to_numpy(), COORDINATES))], ["key", "node"])

    postings = written(classes.select("node", "sig").mapInArrow(tidy(post), "key long, node long"), "postings")
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    prefix = COORDINATES - matches + 1
    held = postings.join(lists, "key").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("at"))
    # those without another member come first in the prefix, and post nothing
    first = held.select("node", F.expr(f"slice(at, 1, greatest(0, {prefix} - ({COORDINATES} - size(at))))").alias("at"))
    marked = first.withColumn("posted", F.expr("aggregate(at, 0L, (bits, x) -> bits | shiftleft(1L, cast(shiftright(x.key, 32) as int)))"))
    chosen = written(marked.select("node", "posted", F.explode("at.key").alias("key")), "prefix")
    dropped(spark, postings)
    return chosen


def _listed(posted: DataFrame, *more) -> DataFrame:
    """Rows of lists (node, key, n_shingles and others) that hold two components or more, with _n, the number of the list's
    blocks, and _b, the row's own; more: other columns of the list."""
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum(8 * F.col("n_shingles")).alias("bytes"), F.min("component").alias("_a"), F.max("component").alias("_z"), *more)
    sizes = sizes.where("_a <> _z").withColumn("_n", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int"))
    return posted.join(sizes.drop("_a", "_z", "members", "bytes"), "key").withColumn("_b", F.pmod(F.xxhash64("node", F.lit(7)), F.col("_n")).cast("int"))


def _met(rows: DataFrame) -> DataFrame:
    """Deals rows of _listed to all pairs (_i, _j) of blocks that their own block is in."""
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, F.col("_b")).alias("i"), F.greatest(k, F.col("_b")).alias("j"))))
    return rows.select("*", pair.alias("_p")).select("*", F.col("_p.i").alias("_i"), F.col("_p.j").alias("_j")).drop("_p")


def stars(chosen: DataFrame, classes: DataFrame, matches: int) -> DataFrame:
    """(u, v), u > v: each node with a partner of `matches` collisions in its block of a list, and the smallest there. The
    list's smallest node stands in all its blocks, so that blocks of copies find the same centre."""

    def run(batches):
        for batch in batches:
            edges = set()
            for nodes, sigs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes, first = np.unique(nodes, return_index=True)
                sig = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES)[first]
                edges.update((int(nodes[max(p)]), int(nodes[min(p)])) for p in partners(sig, matches))
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])

    least = F.min(F.struct("node", "sig")).alias("least")
    rows = _listed(chosen.select("node", "key").join(classes.select("node", "sig", "n_shingles", F.col("node").alias("component")), "node"), least)
    each = F.when(F.col("_n") > 1, F.array(F.struct("node", "sig"), "least")).otherwise(F.array(F.struct("node", "sig")))
    # the smallest node comes once with each row and goes again before the lists are made
    lists = rows.select("key", "_b", F.explode(each).alias("m")).groupBy("key", "_b").agg(F.collect_set("m").alias("m")).where("size(m) > 1")
    return written(lists.select(F.col("m.node").alias("nodes"), F.col("m.sig").alias("sigs")).mapInArrow(tidy(run), "u long, v long").distinct(), "stars")


def full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, size: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """node, set (bytes) of nodes, made anew from the text of the class's smallest doc_id; of several texts of that id, the
    one with the class's own set."""

    def sets(batches):
        for batch in batches:
            for at, n in slices(batch.column(1)):
                part = batch.slice(at, n)
                made = [(node, s.tobytes()) for node, s, key in zip(part.column(0).to_pylist(), shingle_sets(part.column(1), size), part.column(2).to_pylist(), strict=True) if xxhash.xxh3_128_digest(s.tobytes()) == key]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["node", "set"])

    wanted = written(nodes.join(classes.select("node", F.col("rep").alias("doc_id"), "set_key"), "node"), "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= broadcast_rows else wanted  # else the join shuffles
    made = docs.join(chosen, "doc_id").select("node", "text", "set_key").mapInArrow(tidy(sets), "node long, set binary")
    out = written(made.dropDuplicates(["node"]), "sets")
    dropped(docs.sparkSession, wanted)
    return out


def confirmed_stars(edges: DataFrame, sets: DataFrame, num: int, den: int, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The (u, v) of edges whose full sets are linked. The members of one v meet its set in blocks of a bounded size; only
    the v of more than one block are looked up, so that a v of very many members isn't dealt by itself."""

    def run(batches):
        for batch in batches:
            kept = []
            for v, nodes, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                members = {n: np.frombuffer(x.as_buffer(), np.uint64) for n, x in zip(nodes, raw, strict=True)}
                kept += [(n, v) for n, s in members.items() if n != v and linked_to(members[v], s, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in kept], pa.int64()) for k in (0, 1)], ["u", "v"])

    size = sets.select(F.col("node").alias("u"), F.octet_length("set").alias("bytes"))
    centres = edges.join(size, "u").groupBy("v").agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    centres = written(centres, "centres")
    many = centres.where("blocks > 1")
    many = F.broadcast(many) if many.count() <= broadcast_rows else many  # else the join shuffles
    block = F.pmod(F.xxhash64("u"), F.coalesce("blocks", F.lit(1))).cast("int")
    members = edges.join(many, "v", "left").select("v", block.alias("block"), F.col("u").alias("node"))
    own = centres.select("v", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("v").alias("node"))
    grouped = members.unionByName(own).join(sets, "node").groupBy("v", "block").agg(F.collect_list(F.struct("node", "set")).alias("m")).where("size(m) > 1")
    return grouped.select("v", F.col("m.node").alias("nodes"), F.col("m.set").alias("sets")).mapInArrow(tidy(run), "u long, v long")


def confirmed_lists(chosen: DataFrame, classes: DataFrame, sets: DataFrame, found: DataFrame, matches: int, num: int, den: int) -> DataFrame:
    """(u, v): links that join components of found (node, component): a spanning forest of them in each list."""
    spark = classes.sparkSession

    def run(batches):
        names = ["key", "_i", "_j", "node"]
        for batch in batches:
            rows = []
            for key, i, j, nodes, sigs, bits, comps, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sig = np.frombuffer(b"".join(sigs), "<u4").reshape(-1, COORDINATES)
                comps = np.array(comps)
                if (comps != comps[0]).any():
                    rows += [(key, i, j, nodes[k]) for k in unsettled(sig, np.array(bits, np.int64), comps, np.array(blocks), key >> 32, matches).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names)

    def confirm(batches):
        for batch in batches:
            edges = []
            for nodes, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members = [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]
                edges += [(nodes[b], nodes[a]) for a, b in confirmed(members, num, den)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["u", "v"])

    labelled = classes.select("node", "sig", "n_shingles").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = _met(_listed(chosen.join(labelled, "node")))
    lists = rows.groupBy("key", "_i", "_j").agg(F.collect_list(F.struct("node", "sig", "posted", "component", "_b")).alias("m")).where("size(m) > 1")
    open_ = lists.select("key", "_i", "_j", *[F.col(f"m.{c}").alias(c) for c in ("node", "sig", "posted", "component", "_b")]).mapInArrow(tidy(run), "key long, _i int, _j int, node long")
    open_ = written(open_, "open")
    grouped = open_.join(sets, "node").groupBy("key", "_i", "_j").agg(F.collect_list(F.struct("node", "set")).alias("m")).where("size(m) > 1")
    out = written(grouped.select(F.col("m.node").alias("nodes"), F.col("m.set").alias("sets")).mapInArrow(tidy(confirm), "u long, v long"), "links")
    dropped(spark, open_)
    return out


def linked(docs: DataFrame, classes: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """(u, v): confirmed links among classes with the same components as all of them."""
    spark, matches = docs.sparkSession, least_matches(num, den)
    chosen = _posted(classes, matches)
    edges = stars(chosen, classes, matches)
    sets = full_sets(docs, classes, edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), size)
    first = written(confirmed_stars(edges, sets, num, den), "links")
    found = written(components(first), "groups")
    rest = confirmed_lists(chosen, classes, sets, found, matches, num, den)
    out = written(first.unionByName(rest), "links")
    for t in (chosen, edges, sets, first, found, rest):
        dropped(spark, t)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (doc_id, text).

    Sets are linked where den * |A & B| >= num * |A | B|; component_id is the smallest doc_id reachable, its own included.
    A text without words has an empty set and is linked with nothing. Repeated rows stay, and rows of one doc_id with unlike
    texts are linked each by its own text. A null doc_id is linked with nothing and kept, its component null. Texts may be
    of any length. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    given = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = written(_signed(given, size), "signed")
    classes = written(classes_of(signed), "classes")
    edges = linked(given, classes, size, num, den)
    found = written(components(edges), "components")
    dropped(spark, edges)
    named = found.join(classes.select("node", "rep", "set_key"), "node")
    smallest = named.groupBy("component").agg(F.min("rep").alias("_c"))
    of_class = written(classes.select("set_key", "rep").join(named.join(smallest, "component").select("set_key", "_c"), "set_key", "left").select("set_key", F.coalesce("_c", "rep").alias("_c")), "classes")
    for t in (classes, found):
        dropped(spark, t)
    rows = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = rows.join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("_c", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def distinct_documents(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs that stand for their component: the one with its smallest doc_id; repeated rows of it go too.

    Rows with a null doc_id and texts without words stay. Of unlike texts of one doc_id any one that stands stays. An empty
    table gives no rows.
    """
    found = written(near_duplicates(docs, size, num, den), "duplicates")
    gone = found.where("not kept").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    left = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return left
    return left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))


#: near_duplicates(documents, 3, 85, 100) in DuckDB's SQL; distinct ids are assumed.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w
), r AS (SELECT g, min(doc_id) AS rep, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS x FROM r),
p AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(node, other) AS (SELECT rep, rep FROM r UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id, coalesce(c.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN r ON r.g = s.g LEFT JOIN c ON c.node = r.rep
"""
