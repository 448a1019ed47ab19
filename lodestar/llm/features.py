"""Features of sales as they were known at a time, by a sweep over availability with Fenwick trees.

What happened to a client (clicks, sales, their lines) has a time of event and a time from which it is known. A sale asks, at
its time t, for what happened in the d days up to t and was known by then. A shard takes its clients' rows in order of
availability into a Fenwick tree over the ranks of event time; a question is a prefix of ranks (latest first), which the tree
answers with sums and with the latest event. Distinct items are a second such tree, over the union of the intervals in which
an item counts, each from its first to its last activity.

A client of few rows is a shard. One of many rows is cut by time, as short as its busiest hour asks for: what is inserted in an
earlier shard and ends within a later one is carried there as a row, and what lasts beyond it as a sum; those sums are prefix
sums over shards, taken in blocks.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, only, tidy, written

DAY = 86_400_000_000
HOUR = DAY // 24
#: What a shard's row is.
EVENT, SALE, PROBE, MARK, CARRIED, ITEM, ITEM_CARRIED, SUM, LATEST, NEXT = range(10)
#: Where an event comes from; an item is an interval in which an item counts.
CLICK, SOLD, LINES, ITEMS = range(4)
NO_ID = -(2**63) + 1  #: stands for an id that is null
COLUMNS = "client shard what source days a e k n m cents".split()
STATE = "client long, shard int, what int, source int, days int, a long, e long, k long, n long, m long, cents long"
RESULT = "sale_id long, d int, t_us long, label boolean, n_clicks long, n_purchases long, click_cents long, last_click_id long, n_sales long, sale_cents long, n_lines long, n_items long, line_cents long"


def micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970; a time without a zone is taken as UTC, whatever the session's zone."""
    kind = dict(df.dtypes)[name]
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)") if kind == "timestamp_ntz" else F.unix_micros(F.col(f"`{name}`"))


def cents(x: Column) -> Column:
    """floor(100 x + 0.5); 0 for a null and for what is no finite number."""
    x = x.cast("double")
    return F.when(F.abs(x) < float("inf"), F.floor(100 * x + 0.5)).otherwise(0)


# One shard, or several at once: arrays.


def ranked(tree: np.ndarray, key: np.ndarray, tie: np.ndarray, ask_tree: np.ndarray, ask_key: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): rows in order of (tree, key, tie), and for each question the number of rows of smaller trees, or of its
    tree with a smaller (inclusive: or equal) key."""
    n = len(tree)
    order = np.lexsort((tie, key, tree))
    flag = np.concatenate([np.zeros(n, np.int8), np.full(len(ask_tree), 1 if inclusive else -1, np.int8)])
    every = np.lexsort((flag, np.concatenate([key, ask_key]), np.concatenate([tree, ask_tree])))
    before = np.cumsum(every < n)
    place = np.empty(len(every), np.int64)
    place[every] = before
    return order, place[n:]


def fenwick(tree: np.ndarray, a: np.ndarray, e: np.ndarray, tie: np.ndarray, values: np.ndarray, ask_tree: np.ndarray, t: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each question (tree, t, low) the sums of values over its tree's rows with a <= t and e > low, and the row of them
    with the largest (e, tie), or -1.

    Rows are inserted in order of a into Fenwick trees over ranks of e, the latest first, so that e > low is a prefix. A level's
    nodes are kept side by side, each as the running sums (and least rank) of its insertions in their order; a question reads,
    at every level of its prefix's length, one node as of the insertions before it.
    """
    n = len(tree)
    sums, best = np.zeros((len(ask_tree), values.shape[1]), np.int64), np.full(len(ask_tree), n, np.int64)
    if not n or not len(ask_tree):
        return sums, np.full(len(ask_tree), -1)
    by_a, asked = ranked(tree, a, tie, ask_tree, t, inclusive=True)
    by_e, prefix = ranked(tree, -e, -tie, ask_tree, -low, inclusive=False)
    rank = np.empty(n, np.int64)
    rank[by_e] = np.arange(n)
    trees = tree[by_e]
    start, ask_start, end = np.searchsorted(trees, trees, "left"), np.searchsorted(trees, ask_tree, "left"), np.searchsorted(trees, trees, "right")
    r, first, size = rank[by_a], start[rank[by_a]], (end - start)[rank[by_a]]  # in order of insertion
    v = values[by_a]
    prefix = prefix - ask_start
    level = 0
    while (prefix >> level).any():
        here = np.flatnonzero(prefix >> level & 1)
        node = r - first >> level
        into = np.flatnonzero((node & 1 == 0) & (node + 1 << level <= size))  # nodes that some prefix can read
        key = first[into] + node[into]
        by_node = np.argsort(key, kind="stable")
        into, key = into[by_node], key[by_node]
        of = ask_start[here] + (prefix[here] >> level) - 1
        at = key * (n + 1) + into
        to = np.searchsorted(at, of * (n + 1) + asked[here])
        from_ = np.searchsorted(at, of * (n + 1))
        total = np.zeros((len(into) + 1, v.shape[1]), np.int64)
        np.cumsum(v[into], axis=0, out=total[1:])
        sums[here] += total[to] - total[from_]
        least = np.minimum.accumulate(r[into] - (key << 32)) + (key << 32) if len(into) else np.zeros(0, np.int64)
        some = to > from_
        best[here[some]] = np.minimum(best[here[some]], least[to[some] - 1])
        level += 1
    return sums, np.where(best < n, by_e[np.minimum(best, n - 1)], -1)


def shard_features(rows: dict[str, np.ndarray], windows: tuple[int, ...], label_days: int) -> Iterator[list[np.ndarray]]:
    """The result's columns, by window, of whole shards; rows hold STATE, ordered by client and shard."""
    fresh = np.concatenate([[True], (np.diff(rows["client"]) != 0) | (np.diff(rows["shard"]) != 0)])
    tree = np.cumsum(fresh) - 1
    what, k = rows["what"], rows["k"]
    of = lambda *kinds: np.flatnonzero(np.isin(what, kinds))
    probe, mark = of(SALE, PROBE), of(SALE, MARK)
    if not len(probe):
        return
    t, ask = rows["a"][probe], tree[probe]

    # label: the next sale after t
    order, place = ranked(tree[mark], rows["e"][mark], k[mark], ask, t, inclusive=True)
    sold, sold_tree = rows["e"][mark][order], tree[mark][order]
    never = np.iinfo(np.int64).max
    after = np.full(len(probe), never)
    found = np.flatnonzero(place < len(order))
    found = found[sold_tree[place[found]] == ask[found]]
    after[found] = sold[place[found]]
    by_tree = np.full(tree[-1] + 1, never)
    by_tree[tree[of(NEXT)]] = rows["e"][of(NEXT)]
    after = np.minimum(after, by_tree[ask])
    label = (after != never) & (after - label_days * DAY <= t)

    latest = of(LATEST)
    before_e, before_k = np.full(tree[-1] + 1, np.iinfo(np.int64).min), np.zeros(tree[-1] + 1, np.int64)
    before_e[tree[latest]], before_k[tree[latest]] = rows["e"][latest], k[latest]
    for d in windows:
        low = t - d * DAY
        into = np.flatnonzero((what == EVENT) | ((what == CARRIED) & (rows["days"] == d)))
        source = rows["source"][into]
        values = np.zeros((len(into), 7), np.int64)
        for s, places in ((CLICK, (0, 1, 2)), (SOLD, (3, None, 4)), (LINES, (5, None, 6))):
            for name, c in zip(("n", "m", "cents"), places, strict=True):
                if c is not None:
                    values[:, c] = np.where(source == s, rows[name][into], 0)
        sums, _ = fenwick(tree[into], rows["a"][into], rows["e"][into], k[into], values, ask, t, low)
        click = into[source == CLICK]
        _, best = fenwick(tree[click], rows["a"][click], rows["e"][click], k[click], np.zeros((len(click), 0), np.int64), ask, t, low)
        into = np.flatnonzero(((what == ITEM) | (what == ITEM_CARRIED)) & (rows["days"] == d))
        items = fenwick(tree[into], rows["a"][into], rows["e"][into], k[into], np.ones((len(into), 1), np.int64), ask, t, low)[0][:, 0]

        lasting = np.zeros((tree[-1] + 1, 8), np.int64)
        sum_ = np.flatnonzero((what == SUM) & (rows["days"] == d))
        for s, places in ((CLICK, (0, 1, 2)), (SOLD, (3, None, 4)), (LINES, (5, None, 6)), (ITEMS, (7, None, None))):
            one = sum_[rows["source"][sum_] == s]
            for name, c in zip(("n", "m", "cents"), places, strict=True):
                if c is not None:
                    lasting[tree[one], c] += rows[name][one]
        sums, items = sums + lasting[ask, :7], items + lasting[ask, 7]
        # the latest click: here, or the latest of the shards before
        e = np.where(best >= 0, rows["e"][click][best] if len(click) else 0, np.iinfo(np.int64).min)
        id_ = np.where(best >= 0, k[click][best] if len(click) else 0, 0)
        old_e, old_id = before_e[ask], before_k[ask]
        older = (old_e > low) & ((old_e > e) | ((old_e == e) & (old_id > id_)))
        e, id_ = np.where(older, old_e, e), np.where(older, old_id, id_)
        yield [np.ma.array(k[probe], mask=k[probe] == NO_ID), np.full(len(probe), d, np.int32), t, label, sums[:, 0], sums[:, 1], sums[:, 2], np.ma.array(id_, mask=(e <= low) | (id_ == NO_ID)), sums[:, 3], sums[:, 4], sums[:, 5], items, sums[:, 6]]


def swept(state: DataFrame, windows: tuple[int, ...], label_days: int, rows_at_once: int = 100_000) -> DataFrame:
    """RESULT of shards' rows (STATE): a partition is read in order of shards, and whole shards are swept together."""
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(given):
        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: table[c].to_numpy() for c in COLUMNS}
            for columns in shard_features(rows, windows, label_days):
                yield pa.RecordBatch.from_arrays([pa.array(x.filled(0), mask=x.mask) if isinstance(x, np.ma.MaskedArray) else pa.array(x) for x in columns], names)

        held: list[pa.RecordBatch] = []
        n = 0
        for batch in given:
            held.append(batch)
            n += len(batch)
            if n < rows_at_once:
                continue
            every = pa.Table.from_batches(held)
            client, shard = every["client"].to_numpy(), every["shard"].to_numpy()
            cut = np.flatnonzero((client[1:] != client[:-1]) | (shard[1:] != shard[:-1]))
            if len(cut):  # the last shard may go on
                yield from out(every.slice(0, int(cut[-1]) + 1))
                every = every.slice(int(cut[-1]) + 1)
            held, n = every.to_batches(), len(every)
        if n:
            yield from out(pa.Table.from_batches(held))

    dealt = state.repartition("client", "shard").sortWithinPartitions("client", "shard").select(*COLUMNS)
    return dealt.mapInArrow(tidy(run), RESULT)


# The rows of shards: DataFrames.


def events_of(clicks: DataFrame, sales: DataFrame, lines: DataFrame, late: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, items, probes), each written.

    events (client, source, a, e, n, m, cents, k): what is known from a on and happened at e, rows with equal times put together;
    items (client, item, a, e): of an item's lines known from a on the latest e; probes (client, sale_id, t, e).
    """
    wait = late * 60_000_000
    clicks = clicks.select(*[F.col(f"`{c}`") for c in ("click_id", "ts", "arrived_at", "client_id", "kind", "value", "props")]).distinct()  # equal rows once
    e, at = micros(clicks, "ts"), micros(clicks, "arrived_at") + wait
    one = F.lit(1).cast("long")
    clicked = clicks.select(F.col("client_id").cast("long").alias("client"), F.lit(CLICK).alias("source"), F.greatest(e, at).alias("a"), e.alias("e"), at.alias("_at"), one.alias("n"), F.coalesce((F.col("kind") == "purchase").cast("long"), F.lit(0)).alias("m"), cents(F.col("value")).alias("cents"), F.col("click_id").cast("long").alias("k"))
    sales = only(sales, "sale_id", "client_id", "sold_at", "arrived_at", "total")
    moved = F.pmod(F.crc32(F.coalesce(F.col("sale_id").cast("string"), F.lit(""))), F.lit(259_200)) * 1_000_000
    sold = sales.select(F.coalesce(F.col("sale_id").cast("long"), F.lit(NO_ID)).alias("sale_id"), F.col("client_id").cast("long").alias("client"), micros(sales, "sold_at").alias("e"), (micros(sales, "arrived_at") + wait).alias("_at"), moved.alias("_moved"), cents(F.col("total")).alias("cents"))
    sold = written(sold.where("client is not null and e is not null"), "sales")
    sales_in = sold.select("client", F.lit(SOLD).alias("source"), F.greatest("e", "_at").alias("a"), "e", "_at", one.alias("n"), F.lit(0).cast("long").alias("m"), "cents", F.lit(None).cast("long").alias("k"))
    lines = only(lines, "sale_id", "item_id", "amount", "shipped_at")
    parts = lines.select(F.col("sale_id").cast("long").alias("sale_id"), F.col("item_id").cast("long").alias("item"), cents(F.col("amount")).alias("cents"), micros(lines, "shipped_at").alias("_shipped")).where("sale_id is not null and _shipped is not null")
    # lines of a sale that are alike but for their amount meet it as one row, so that a sale of very many lines is small
    parts = parts.groupBy("sale_id", "item", "_shipped").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    met = written(sold.where("_at is not null").select("sale_id", "client", "e", "_at").join(parts, "sale_id").select("client", "item", F.greatest("e", "_at", "_shipped").alias("a"), "e", "n", "cents"), "lines")
    lines_in = met.select("client", F.lit(LINES).alias("source"), "a", "e", F.lit(0).cast("long").alias("_at"), "n", F.lit(0).cast("long").alias("m"), "cents", F.lit(None).cast("long").alias("k"))
    every = clicked.unionByName(sales_in).unionByName(lines_in).where("client is not null and e is not null and _at is not null")
    events = every.groupBy("client", "source", "a", "e").agg(F.sum("n").alias("n"), F.sum("m").alias("m"), F.sum("cents").alias("cents"), F.coalesce(F.max("k"), F.lit(NO_ID)).alias("k"))
    items = met.where("item is not null").groupBy("client", "item", "a").agg(F.max("e").alias("e"))
    return written(events, "events"), written(items, "items"), sold.select("client", "sale_id", (F.col("e") + F.col("_moved")).alias("t"), "e")


def state_rows(df: DataFrame, kind: int | None, **columns) -> DataFrame:
    """df as STATE: given columns (names or columns), kind as what unless that is given, zeros elsewhere."""
    given = {"client": "client", "shard": "shard", "what": F.lit(kind)} | columns
    kinds = dict(x.split() for x in STATE.split(", "))
    return df.select(*[(F.col(given[c]) if isinstance(given.get(c), str) else given.get(c, F.lit(0))).cast(kinds[c]).alias(c) for c in COLUMNS])


def before(sums: DataFrame, keys: list[str], columns: dict[str, str], block: int = 1024, later: bool = False) -> DataFrame:
    """sums (keys, shard, columns) with what the shards of its keys before it (later: after it) come to, by block of shards
    and then within it: columns names the aggregate of each, sum or max or min."""
    blocked = sums.withColumn("_block", F.floor(F.col("shard") / block))
    order = (lambda c: F.col(c).desc()) if later else F.col
    within = Window.partitionBy(*keys, "_block").orderBy(order("shard")).rowsBetween(Window.unboundedPreceding, -1)
    of = {"sum": F.sum, "max": F.max, "min": F.min}
    whole = blocked.groupBy(*keys, "_block").agg(*[of[f](c).alias(c) for c, f in columns.items()])
    over = Window.partitionBy(*keys).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*keys, "_block", *[of[f](c).over(over).alias(f"_w_{c}") for c, f in columns.items()])
    both = {"sum": lambda x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)), "max": F.greatest, "min": F.least}
    inner = blocked.select(*keys, "shard", "_block", *[of[f](c).over(within).alias(f"_i_{c}") for c, f in columns.items()])
    joined = inner.join(whole, [*keys, "_block"])
    return joined.select(*keys, "shard", *[both[f](F.col(f"_i_{c}"), F.col(f"_w_{c}")).alias(c) for c, f in columns.items()])


def pieces(items: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(client, days, a, e, width, last): the union of the intervals, from first to last activity, in which an item of items
    (client, item, a, e, width, last) counts, as pieces [a, e + days) that don't overlap.

    Of an item's rows in order of a only those matter whose e is later than all before: first within an hour of a, then over
    the hours.
    """
    hourly = items.withColumn("_h", F.floor(F.col("a") / HOUR))
    within = Window.partitionBy("client", "item", "_h").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    kept = hourly.withColumn("_p", F.max("e").over(within)).where(F.col("_p").isNull() | (F.col("e") > F.col("_p")))
    over = Window.partitionBy("client", "item").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    hours = hourly.groupBy("client", "item", "_h").agg(F.max("e").alias("_m")).withColumn("_q", F.max("_m").over(over)).drop("_m")
    kept = kept.join(hours, ["client", "item", "_h"]).withColumn("_p", F.greatest("_p", "_q")).where(F.col("_p").isNull() | (F.col("e") > F.col("_p")))
    kept = written(kept.select("client", "a", "e", "_p", "width", "last"), "item-rows")
    by_window = [kept.select("client", F.lit(d).alias("days"), F.greatest(F.col("a"), F.col("_p") + d * DAY).alias("a"), "e", "width", "last").where(F.col("a") < F.col("e") + d * DAY) for d in windows]
    return functools.reduce(DataFrame.unionByName, by_window)


def cut(times: DataFrame, large: int, rows_a_shard: int) -> DataFrame:
    """(client, width, first, last) of clients with over `large` of times (client, time): how long their shards are, whole
    hours, so that the busiest hour's pace puts rows_a_shard into one, and the first and last of them. An hour isn't cut."""
    hours = times.groupBy("client", F.floor(F.col("time") / HOUR).alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    width = F.greatest(F.lit(1), F.floor(rows_a_shard / F.max("n"))) * HOUR
    spans = hours.groupBy("client").agg(F.sum("n").alias("n"), width.alias("width"), F.min("_h").alias("_f"), F.max("_h").alias("_l")).where(F.col("n") > large)
    return spans.select("client", "width", F.floor(F.col("_f") * HOUR / F.col("width")).alias("first"), F.floor(F.col("_l") * HOUR / F.col("width")).alias("last"))


def item_rows(pieces_: DataFrame) -> DataFrame:
    zero = lambda *names: [F.lit(0).cast("long").alias(c) for c in names]
    return pieces_.select(F.lit(ITEM).alias("what"), "client", F.lit(ITEMS).alias("source"), F.col("days").alias("_of"), "a", "e", F.lit(1).cast("long").alias("n"), *zero("k", "m", "cents"), "width", "last")


def cut_state(events: DataFrame, pieces_: DataFrame, probes: DataFrame, clients: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """STATE of clients that are cut by time; the rows of the first three have their client's width and last shard."""
    inserted = events.select(F.lit(EVENT).alias("what"), "client", "source", F.lit(0).alias("_of"), "a", "e", "k", "n", "m", "cents", "width", "last").unionByName(item_rows(pieces_))
    shard = lambda time: F.floor(time / F.col("width")).cast("int")
    start = written(inserted.withColumn("shard", shard(F.col("a"))), "inserted")
    # a row for each window in which an event is known before it is too old, with the shard in which it ends
    by_window = [start.withColumns({"days": F.lit(d), "_end": F.col("e") + d * DAY}).where(F.col("_of").isin(0, d) & (F.col("a") < F.col("_end"))) for d in windows]
    each = functools.reduce(DataFrame.unionByName, by_window).withColumn("_end", shard(F.col("_end"))).drop("_of")
    carried = each.where((F.col("_end") > F.col("shard")) & (F.col("_end") <= F.col("last"))).withColumn("shard", F.col("_end"))
    # sums of what is known before a shard and lasts beyond it: inserted before, less what ends before or in it
    by = ["client", "days", "source", "shard"]
    sums = [F.sum(c).alias(c) for c in ("n", "m", "cents")]
    signed = lambda df, sign: df.select(*by, *[(F.col(c) * sign).alias(c) for c in ("n", "m", "cents")])
    change = signed(each, 1).unionByName(signed(each.withColumn("shard", F.col("_end")).where(F.col("shard") <= F.col("last")), -1)).groupBy(*by).agg(*sums)
    shards = clients.select("client", F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("shard"))
    grid = shards.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(d).alias("days"), F.lit(s).alias("source")) for d in windows for s in (CLICK, SOLD, LINES, ITEMS)]))).select("client", "shard", "_k.days", "_k.source")
    full = grid.join(change, by, "left").fillna(0, ["n", "m", "cents"])
    known = before(full, ["client", "days", "source"], {"n": "sum", "m": "sum", "cents": "sum"})
    lasting = known.unionByName(signed(carried, -1).groupBy(*by).agg(*sums).select(*known.columns)).groupBy(*by).agg(*sums)
    latest = start.where(f"what = {EVENT} and source = {CLICK}").groupBy("client", "shard").agg(F.max(F.struct("e", "k")).alias("x"))
    latest = before(shards.join(latest, ["client", "shard"], "left"), ["client"], {"x": "max"}).where("x is not null").select("client", "shard", "x.e", "x.k")
    marks = probes.select("client", shard(F.col("e")).alias("shard"), "e")
    next_ = before(shards.join(marks.groupBy("client", "shard").agg(F.min("e").alias("e")), ["client", "shard"], "left"), ["client"], {"e": "min"}, later=True).where("e is not null")
    values = {c: c for c in ("source", "a", "e", "k", "n", "m", "cents")}
    rows = [
        state_rows(start, None, **values | {"what": "what", "days": "_of"}),
        state_rows(carried, None, **values | {"what": F.when(F.col("what") == ITEM, ITEM_CARRIED).otherwise(CARRIED), "days": "days"}),
        state_rows(probes.withColumn("shard", shard(F.col("t"))), PROBE, a="t", k="sale_id"),
        state_rows(marks, MARK, e="e"),
        state_rows(lasting, SUM, source="source", days="days", n="n", m="m", cents="cents"),
        state_rows(latest, LATEST, e="e", k="k"),
        state_rows(next_, NEXT, e="e"),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def features(clicks: DataFrame, sales: DataFrame, lines: DataFrame, windows: tuple[int, ...] = (2, 14), label_days: int = 7, late: int = 240, large: int = 20_000, rows_a_shard: int = 5_000) -> DataFrame:
    """By sale of sales with a client_id and a sold_at, and by window of d days, what was known of its client at the sale's time.

    t: sold_at and crc32(sale_id) modulo 259,200 seconds. label: a sale of the client in the label_days after t. Counted are
    the client's clicks and sales of the d days up to t that arrived `late` minutes before t or earlier, and those sales' lines
    shipped by t. Clicks that are equal in all columns count once; equal sales and lines each time. Null times are never
    reached; null, infinite and NaN amounts are 0; null clients have no sales; lines without a sale are left out, and items
    without an id aren't counted as items; several clicks at the last time: the largest click_id, a null one last; a sale
    repeated has its row each time; other columns are ignored; empty tables give no rows, or zeros.

    large: a client of more rows is cut by time, into shards of about rows_a_shard rows besides what is carried into them; an
    hour isn't cut.
    """
    batches(sales.sparkSession, 16_384)  # rows are short
    events, items, probes = events_of(clicks, sales, lines, late)
    at = lambda df, time: df.select("client", F.col(time).alias("time"))
    clients = written(cut(at(events, "a").unionByName(at(probes, "t")).unionByName(at(probes, "e")), large, rows_a_shard), "cut-clients")
    placed = lambda df, name: written(df.join(clients.drop("first"), "client", "left"), name)
    events, probes, found = placed(events, "placed-events"), placed(probes, "placed-sales"), written(pieces(placed(items, "placed-items"), windows), "pieces")
    whole = lambda df: df.where("width is null").withColumn("shard", F.lit(0))
    rest = lambda df: df.where("width is not null")
    values = {c: c for c in ("source", "a", "e", "k", "n", "m", "cents")}
    rows = state_rows(whole(events), EVENT, **values).unionByName(state_rows(whole(item_rows(found)), None, **values | {"what": "what", "days": "_of"})).unionByName(state_rows(whole(probes), SALE, a="t", e="e", k="sale_id"))
    return swept(rows.unionByName(cut_state(rest(events), rest(found), rest(probes), clients, windows)), windows, label_days)


SQL = """
WITH s AS (SELECT row_number() OVER () AS id, sale_id, client_id, epoch_us(sold_at) AS e, epoch_us(arrived_at) + 14400000000 AS known,
             coalesce(CAST(floor(100 * total + 0.5) AS BIGINT), 0) AS cents, CAST(sale_id AS VARCHAR) AS text FROM sales),
h AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], range(0, 8 * length(text))), lambda acc, i:
             xor((CASE WHEN i % 8 = 0 THEN xor(acc, CAST(ord(substr(text, i // 8 + 1, 1)) AS BIGINT)) ELSE acc END) >> 1,
                 3988292384 * ((CASE WHEN i % 8 = 0 THEN xor(acc, CAST(ord(substr(text, i // 8 + 1, 1)) AS BIGINT)) ELSE acc END) & 1))), 4294967295) AS crc FROM s),
w AS (SELECT id, sale_id, client_id, e + (crc % 259200) * 1000000 AS t, d, e + (crc % 259200) * 1000000 - d * 86400000000 AS low
      FROM h, (VALUES (2), (14)) AS days(d) WHERE client_id IS NOT NULL AND e IS NOT NULL),
c AS (SELECT click_id, client_id, kind, epoch_us(ts) AS e, epoch_us(arrived_at) + 14400000000 AS known, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
      FROM (SELECT DISTINCT * FROM clicks)),
l AS (SELECT s.client_id, s.e, greatest(s.known, epoch_us(shipped_at)) AS known, item_id, coalesce(CAST(floor(100 * amount + 0.5) AS BIGINT), 0) AS cents
      FROM sale_lines JOIN s USING (sale_id) WHERE s.known IS NOT NULL AND shipped_at IS NOT NULL),
wc AS (SELECT id, d, count(*) AS n_clicks, count(*) FILTER (kind = 'purchase') AS n_purchases, sum(c.cents) AS click_cents, max({'e': c.e, 'k': c.click_id}).k AS last_click_id
       FROM w JOIN c ON c.client_id = w.client_id AND c.e > low AND c.e <= t AND c.known <= t GROUP BY ALL),
ws AS (SELECT w.id, d, count(*) AS n_sales, sum(s.cents) AS sale_cents FROM w JOIN s ON s.client_id = w.client_id AND s.e > low AND s.e <= t AND s.known <= t GROUP BY ALL),
wl AS (SELECT id, d, count(*) AS n_lines, count(DISTINCT item_id) AS n_items, sum(l.cents) AS line_cents
       FROM w JOIN l ON l.client_id = w.client_id AND l.e > low AND l.e <= t AND l.known <= t GROUP BY ALL),
y AS (SELECT DISTINCT w.id FROM w JOIN s ON s.client_id = w.client_id AND s.e > t AND s.e <= t + 604800000000)
SELECT sale_id, d, t AS t_us, y.id IS NOT NULL AS label, coalesce(n_clicks, 0) AS n_clicks, coalesce(n_purchases, 0) AS n_purchases,
  CAST(coalesce(click_cents, 0) AS BIGINT) AS click_cents, last_click_id, coalesce(n_sales, 0) AS n_sales, CAST(coalesce(sale_cents, 0) AS BIGINT) AS sale_cents,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_items, 0) AS n_items, CAST(coalesce(line_cents, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN wc USING (id, d) LEFT JOIN ws USING (id, d) LEFT JOIN wl USING (id, d) LEFT JOIN y USING (id)
"""
