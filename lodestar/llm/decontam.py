"""Benchmark decontamination by templates, in DataFrame operations alone.

Numbers, units and names in a text become typed placeholders, so that a question with other parameters has the same
template. Windows of template tokens are hashed and joined; where enough of an item's windows occur in a document, the
values in the slots must agree: within one alignment an item's value always stands for the same value of the document.

Each text has three forms. In the first only names in running text are placeholders, in the second every run of
capitalised words is, so that a changed name may begin a sentence. The third keeps all values; it is for items that hold
too few literals for a template. An item shorter than a window is one window as a whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, written

# Placeholders (texts hold no other digits by then), patterns, units. Groups repeat possessively, which Java
# does in a loop; otherwise it recurses, and long runs of numbers or names overflow the stack.
NUMBER, NAME, UNIT = "0", "1", "2"
NUMBERS = r"[0-9]+(?:[.,:/-][0-9]+)*+"
NAMES = r"([\p{Ll},;:] )(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*+)"
CAPITALS = r"(^|[^\p{L}])(\p{Lu}\p{L}*(?: \p{Lu}\p{L}*)*+)"
UNITS = r" 0 +(mm|cm|km|m|mg|kg|g|ml|l|lb|lbs|oz|ft|in|mi|mph|km/h|s|sec|min|h|hours?|minutes?|seconds?|days?|weeks?|months?|years?|meters?|metres?|miles?|inches|feet|pounds?|dollars?|euros?|cents?|percent|degrees?)(?:[^\p{L}]|$)"
TOKENS = r"[\p{L}0-9]+"
WORDS = rf"{NUMBERS}|\p{{L}}+"
RUNNING, EVERYWHERE, EXACT = 0, 1, 2  # the forms: names in running text, names everywhere, no placeholders
FORM = ["item_id", "form", "width"]
WINDOW = 8  # tokens; with the doubling below a power of two
LITERALS = 4  # tokens of an item's window that are no placeholders, at least


def _template(text, names: str) -> F.Column:
    """text with its numbers, units and names as placeholders, in lower case."""
    numbers = F.when(text.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(text, NUMBERS, " 0 "), UNITS, " 0 2 ")).otherwise(text)
    return F.lower(F.regexp_replace(numbers, names, "$11"))


def _names(form: int) -> str:
    return CAPITALS if form == EVERYWHERE else NAMES


def _tokens(text, form: int) -> F.Column:
    if form == EXACT:
        return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))
    return F.regexp_extract_all(_template(text, _names(form)), F.lit(TOKENS), F.lit(0))


def _windows(tokens, form: int, wide: int) -> F.Column:
    """Hashes of all windows of `wide` tokens, those of WINDOW by doubling. Each step names the one before it once, through
    a lambda, so that the expression stays linear however the optimizer puts it together. Forms have unlike hashes."""
    if wide < WINDOW:
        each = lambda t: F.transform(t, lambda _, i: F.xxhash64(F.lit(form), F.slice(t, i + 1, wide)))
        return F.get(F.transform(F.array(tokens), lambda t: F.slice(each(t), 1, F.greatest(F.size(t) - wide + 1, F.lit(0)))), 0)

    def doubled(width):
        def step(x):
            n = F.greatest(F.size(x) - width, F.lit(0))
            return F.zip_with(F.slice(x, 1, n), F.slice(x, width + 1, n), lambda a, b: F.xxhash64(a, b))

        return step

    h, width = F.transform(tokens, lambda t: F.xxhash64(F.lit(form), t)), 1
    while width < WINDOW:
        h, width = F.get(F.transform(F.array(h), doubled(width)), 0), 2 * width
    return h


def _values(text, form: int) -> list[F.Column]:
    """The values behind the placeholders 0, 1 and 2, each in order."""
    spaced = F.regexp_replace(text, NUMBERS, " 0 ")
    return [
        F.regexp_extract_all(text, F.lit(NUMBERS), F.lit(0)),
        F.regexp_extract_all(F.regexp_replace(spaced, UNITS, " 0 2 "), F.lit(_names(form)), F.lit(2)),
        F.regexp_extract_all(spaced, F.lit(UNITS), F.lit(1)),
    ]


def _slots(rows: DataFrame, key: str, form: int) -> DataFrame:
    """(key, form, at, value): the value behind each placeholder in rows (key, text), by the place of its token."""
    if form == EXACT:
        return rows.select(key, F.lit(form).alias("form"), F.lit(0).alias("at"), F.lit("").alias("value")).where("false")
    rows = rows.select(key, _tokens(F.col("text"), form).alias("_t"), *[v.alias(f"_v{k}") for k, v in enumerate(_values(F.col("text"), form))])
    of = lambda k: F.filter(F.transform("_t", lambda t, i: F.when(t == str(k), i)), lambda i: i.isNotNull())
    pairs = F.concat(*[F.zip_with(of(k), f"_v{k}", lambda i, x: F.struct(i.alias("at"), x.alias("value"))) for k in range(3)])
    return rows.select(key, F.lit(form).alias("form"), F.inline(pairs)).where("at is not null")


def _longest(numbers) -> F.Column:
    """How many of an array's distinct numbers follow one another, at most."""
    start = F.struct(F.lit(-1).alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s, x):
        run = F.when(x == s["last"] + 1, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(numbers), start, step, lambda s: s["best"])


def _item_windows(items: DataFrame) -> DataFrame:
    """form, width, item_id, ipos, nth and h of the windows that count, numbered from 1 in their order."""
    every = reduce(DataFrame.union, [items.select("item_id", "text", F.lit(form).alias("form"), _tokens(F.col("text"), form).alias("t")) for form in (RUNNING, EVERYWHERE, EXACT)])
    every = written(every.where(F.size("t") > 0).withColumn("width", F.least(F.size("t"), F.lit(WINDOW))), "items")
    shapes = every.select("form", "width").distinct().collect()  # three forms of at most WINDOW widths
    if not shapes:
        return every.select(*FORM, F.lit(0).alias("ipos"), F.lit(0).alias("nth"), F.lit(0).cast("long").alias("h"))
    literal = F.filter(F.slice(F.col("t"), F.col("ipos") + 1, F.col("width")), lambda x: ~x.isin(NUMBER, NAME, UNIT))
    cut = reduce(DataFrame.union, [every.where((F.col("form") == form) & (F.col("width") == width)).select("*", F.posexplode(_windows(F.col("t"), form, width)).alias("ipos", "h")) for form, width in shapes])
    rich = cut.where((F.col("form") != EXACT) & (F.size(literal) >= LITERALS))
    exact = cut.where(F.col("form") == EXACT).join(rich.where(F.col("form") == RUNNING).select("item_id", "text"), ["item_id", "text"], "left_anti")
    nth = F.dense_rank().over(Window.partitionBy(*FORM).orderBy("ipos"))
    return rich.select(*FORM, "ipos", "h").union(exact.select(*FORM, "ipos", "h")).distinct().select(*FORM, "ipos", nth.alias("nth"), "h")


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    """df for a broadcast if it has `rows` rows at most; beyond that for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, broadcast_rows: int = 1_000_000, passage: int = 50) -> DataFrame:
    """doc_id, item_id, covered, windows and slots of pairs of docs (doc_id, text) and benchmark (item_id, text).

    A pair is returned where, in alignments whose slots are consistent, `share` or more of the item's windows occur in the
    document, or so many windows in a row as `passage` tokens have; figures are of the first form that finds it. Windows of
    fewer than LITERALS literal tokens don't count. Items without one that does are matched by their exact words and
    numbers instead, however short they are. Null or empty texts and null ids match nothing. Repeated rows give one pair;
    rows of one id count as one text. Of forms that find a pair with like figures the one listed first counts. A text's
    length costs time in proportion, and no row holds more than one text. Other columns are ignored; an empty table on
    either side gives no rows.
    """
    items = only(benchmark, "item_id", "text").where("item_id is not null and text is not null").distinct()
    windows = written(_item_windows(items), "windows")
    shapes = [tuple(r) for r in windows.select("form", "width").distinct().collect()] or [(RUNNING, WINDOW)]
    given = only(docs, "doc_id", "text").where("doc_id is not null and text is not null")
    every = reduce(DataFrame.union, [given.select("doc_id", F.posexplode(_windows(_tokens(F.col("text"), form), form, width)).alias("dpos", "h")) for form, width in shapes])
    hits = written(every.join(_bounded(windows, broadcast_rows), "h").select("doc_id", *FORM, "dpos", "ipos", "nth").distinct(), "hits")
    sizes = windows.groupBy(*FORM).agg(F.count_distinct("ipos").alias("windows"))
    long = F.lit(passage + 1) - F.col("width")
    enough = lambda df, run: df.where((F.col("covered") >= share * F.col("windows")) | (F.col(run) >= long))
    maybe = enough(hits.groupBy("doc_id", *FORM).agg(F.count_distinct("ipos").alias("covered")).join(sizes, FORM), "covered")
    maybe = written(maybe.select("doc_id", *FORM), "maybe")
    # values in the slots of the pairs that are left, a row each, so that a long text costs no more than its length
    forms = sorted({form for form, _ in shapes})

    def slots(rows, key, name):
        ids = lambda form: maybe.where(F.col("form") == form).select(key).distinct()
        of = lambda form: _slots(rows.join(_bounded(ids(form), broadcast_rows), key).select(key, "text"), key, form)
        return reduce(DataFrame.union, map(of, forms)).withColumnRenamed("value", name)

    alignment = ["doc_id", *FORM, "shift"]
    held = hits.join(maybe, ["doc_id", *FORM]).withColumn("shift", F.col("dpos") - F.col("ipos"))
    runs = written(held.groupBy(*alignment).agg(F.collect_set("ipos").alias("at"), _longest(F.collect_set("nth")).alias("run")), "runs")
    places = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(p, p + F.col("width") - 1))))
    of_items = _bounded(written(slots(items, "item_id", "iv"), "item-slots").withColumnRenamed("at", "p"), broadcast_rows)
    spots = runs.select(*alignment, F.explode(places).alias("p")).join(of_items, ["item_id", "form", "p"])
    bound = spots.withColumn("at", F.col("p") + F.col("shift")).join(slots(given, "doc_id", "dv"), ["doc_id", "form", "at"], "left")
    same = F.size(F.collect_set("iv")) == F.size(F.collect_set(F.struct("iv", "dv")))
    checked = bound.groupBy(*alignment).agg(F.count_distinct("p").alias("slots"), same.alias("same"))
    kept = runs.join(checked, alignment, "left").where(F.coalesce("same", F.lit(True))).select("doc_id", *FORM, "run", F.coalesce("slots", F.lit(0)).alias("slots"), F.explode("at").alias("ipos"))
    found = kept.groupBy("doc_id", *FORM).agg(F.count_distinct("ipos").alias("covered"), F.max("slots").alias("slots"), F.max("run").alias("run"))
    first = F.min(F.struct("form", "width", "covered", "windows", "slots")).alias("x")
    return enough(found.join(sizes, FORM), "run").groupBy("doc_id", "item_id").agg(first).select("doc_id", "item_id", "x.covered", "x.windows", "x.slots")


def clean_documents(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The rows of docs without benchmark items, with all their columns; null ids and texts stay."""
    gone = written(contaminated(docs, benchmark, share, broadcast_rows).select("doc_id").distinct(), "contaminated")
    return docs.join(_bounded(gone, broadcast_rows), "doc_id", "left_anti").select(docs.columns)


#: The first form of items of WINDOW tokens or more in DuckDB's SQL, over documents and benchmark.
SQL = rf"""
WITH
texts AS (
  SELECT 0 AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION SELECT 1, item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), spaced AS (
  SELECT kind, id, text, regexp_replace(text, '{NUMBERS}', ' 0 ', 'g') AS s FROM texts
), united AS (
  SELECT kind, id, text, s, regexp_replace(s, '{UNITS}', ' 0 2 ', 'g') AS u FROM spaced
), tokens AS (
  SELECT kind, id, regexp_extract_all(lower(regexp_replace(u, '{NAMES}', '\11', 'g')), '{TOKENS}') AS t,
    regexp_extract_all(text, '{NUMBERS}') AS v0, regexp_extract_all(u, '{NAMES}', 2) AS v1, regexp_extract_all(s, '{UNITS}', 1) AS v2 FROM united
), placed AS (
  SELECT kind, id, t, v0, v1, v2, unnest(range(0, len(t))) AS pos FROM tokens
), valued AS (
  SELECT kind, id, pos, CASE t[pos + 1]
    WHEN '0' THEN v0[len(list_filter(t[1:pos + 1], lambda x: x = '0'))]
    WHEN '1' THEN v1[len(list_filter(t[1:pos + 1], lambda x: x = '1'))]
    WHEN '2' THEN v2[len(list_filter(t[1:pos + 1], lambda x: x = '2'))] END AS v
  FROM placed WHERE t[pos + 1] IN ('0', '1', '2')
), windowed AS (
  SELECT kind, id, pos, t[pos + 1:pos + {WINDOW}] AS w FROM placed WHERE pos + {WINDOW} <= len(t)
), items AS (
  SELECT id AS item_id, pos AS ipos, w FROM windowed WHERE kind = 1 AND len(list_filter(w, lambda x: x NOT IN ('0', '1', '2'))) >= {LITERALS}
), sizes AS (SELECT item_id, count(DISTINCT ipos) AS windows FROM items GROUP BY item_id),
hits AS (
  SELECT d.id AS doc_id, item_id, d.pos - ipos AS shift, ipos FROM windowed d JOIN items USING (w) WHERE d.kind = 0
), spots AS (
  SELECT DISTINCT doc_id, item_id, shift, ipos + k AS p FROM hits, range(0, {WINDOW}) AS r(k)
), bound AS (
  SELECT DISTINCT s.doc_id, s.item_id, s.shift, i.v AS iv, d.v AS dv FROM spots s
  JOIN valued i ON i.kind = 1 AND i.id = s.item_id AND i.pos = s.p
  LEFT JOIN valued d ON d.kind = 0 AND d.id = s.doc_id AND d.pos = s.p + s.shift
), slots AS (
  SELECT s.doc_id, s.item_id, s.shift, count(*) AS n FROM spots s JOIN valued i ON i.kind = 1 AND i.id = s.item_id AND i.pos = s.p GROUP BY ALL
), bad AS (
  SELECT doc_id, item_id, shift FROM bound GROUP BY ALL HAVING count(*) > count(DISTINCT iv)
)
SELECT h.doc_id, h.item_id, count(DISTINCT h.ipos) AS covered, any_value(windows) AS windows, CAST(max(coalesce(n, 0)) AS BIGINT) AS slots
FROM hits h JOIN sizes USING (item_id) LEFT JOIN slots USING (doc_id, item_id, shift) ANTI JOIN bad USING (doc_id, item_id, shift)
GROUP BY h.doc_id, h.item_id HAVING count(DISTINCT h.ipos) >= 0.6 * any_value(windows)
""".replace("*+", "*")
