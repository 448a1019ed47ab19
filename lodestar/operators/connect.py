"""Pairs of papers that share tags: an inverted-index join in blocks, pruning with reasons, scores, report and log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import numeric
from lodestar.operators.graph import components
from lodestar.operators.pair_blocks import VECTOR, Blocks, seed_of
from lodestar.plans.tables import written

# Tags that say nothing, and tags that suffice alone.
GENERIC_TAGS = ["fallback", "ingested", "automated", "pdf", "paper"]
HIGH_SIGNAL_TAGS = ["adaptive_computation", "knowledge_distillation", "latent_dynamics", "latent_moe", "looped_transformer", "mamba_transformer", "mixture_of_experts", "state_space_models", "world_model"]
REASONS = ["skipped_analyzed", "skipped_similarity", "missing_records", "no_connection", "validation_failed", "speculative_filtered", "below_confidence", "kept"]


def meaningful(tags: Column, generic=GENERIC_TAGS) -> Column:
    """Distinct tags, trimmed and in lower case, without empty and generic ones."""
    clean = F.transform(F.filter(tags, lambda t: t.isNotNull()), lambda t: F.lower(F.trim(t)))
    return F.array_except(F.array_distinct(clean), F.array(*map(F.lit, ["", *generic])))


def tag_rows(papers: DataFrame) -> DataFrame:
    """(paper_id, domain, tag) of papers (paper_id, domain, tags); only exhausted ones, where there is a status."""
    if "status" in papers.columns:
        papers = papers.where("status = 'exhausted'")
    return papers.select("paper_id", "domain", F.explode(meaningful(F.col("tags"))).alias("tag"))


def dealt(rows: DataFrame, key: list[str], block: int) -> DataFrame:
    """Distinct rows of the tags that two papers or more have, each under the pairs of blocks (_i, _j) that its block _b is in.

    A tag of up to `block` papers is one block. The papers of a more frequent one are dealt to blocks by a hash, and two
    blocks meet at a time, so no task holds a whole tag.
    """
    rows = rows.distinct()
    blocks = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_n"), F.count(F.lit(1)).alias("_papers")).where("_papers > 1").drop("_papers")
    named = rows.columns
    rows = rows.join(blocks, key).withColumn("_b", F.pmod(F.xxhash64("paper_id"), F.col("_n")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda k: F.struct(F.least(k, F.col("_b")).alias("_i"), F.greatest(k, F.col("_b")).alias("_j")))
    return rows.select(*named, "_b", F.inline(pair))


def met_in_blocks(rows: DataFrame, scope: str, block: int, bound=None) -> DataFrame:
    """(tag, a, b, domain_a, domain_b): a row for each tag that two papers share, a < b, by an equi-join on tag and pair of blocks.

    rows may have more columns; bound, if given, is a condition on their two sides, as functions of their names.
    """
    more = [c for c in rows.columns if c not in ("paper_id", "domain", "tag")]
    every = dealt(rows, ["domain", "tag"] if scope == "within" else ["tag"], block)
    side = lambda x, *names: every.select(F.col("paper_id").alias(x), F.col("domain").alias(f"domain_{x}"), F.col("tag").alias(names[0]), F.col("_b").alias(f"_b{x}"), F.col("_i").alias(names[1]), F.col("_j").alias(names[2]), *[F.col(c).alias(f"{c}_{x}") for c in more])
    on = (F.col("tag") == F.col("_tag")) & (F.col("_i") == F.col("_k")) & (F.col("_j") == F.col("_l")) & (F.col("a") < F.col("b"))
    on &= (F.col("_i") == F.col("_j")) | (F.col("_ba") != F.col("_bb"))  # two papers of one block meet where it meets itself
    if scope != "all":
        same = F.col("domain_a") == F.col("domain_b")
        on &= same if scope == "within" else ~same
    if bound is not None:
        on &= bound(lambda c: F.col(f"{c}_a"), lambda c: F.col(f"{c}_b"))
    return side("a", "tag", "_i", "_j").join(side("b", "_tag", "_k", "_l"), on).select("tag", "a", "b", "domain_a", "domain_b")


def in_order(sets: DataFrame, scope: str) -> DataFrame:
    """sets with their tags from the rarest to the most frequent, ties by name: one order for all sets that can meet."""
    by = ["domain", "tag"] if scope == "within" else ["tag"]
    each = sets.select("paper_id", "domain", F.explode("tags").alias("tag"))
    n = each.groupBy(*by).agg(F.count(F.lit(1)).alias("_f"))
    ordered = each.join(n, by).groupBy("paper_id", "domain").agg(F.array_sort(F.collect_list(F.struct("_f", "tag"))).alias("_t"))
    return ordered.select("paper_id", "domain", F.transform("_t", lambda x: x["tag"]).alias("tags"))


def prefixes(sets: DataFrame, least: int) -> DataFrame:
    """Rows of the tags under which a set must be looked for: all but its least - 1 most frequent ones, with the number of tags
    from each on (rest). Two sets with `least` tags in common share one of these, and of the first such at least so many follow."""
    fit = sets.where(F.size("tags") >= least)
    head = F.slice("tags", 1, F.size("tags") - (least - 1))
    return fit.select("paper_id", "domain", F.size("tags").alias("_n"), F.posexplode(head).alias("_p", "tag")).select("paper_id", "domain", "tag", (F.col("_n") - F.col("_p")).alias("rest"))


def by_prefix(sets: DataFrame, scope: str, least: int, block: int) -> DataFrame:
    """Pairs with `least` shared tags or more, by an index of prefixes; what meets there is compared on its whole sets. Where
    prefixes too share many tags, they meet by pairs of blocks."""
    sets = written(in_order(sets, scope), "ordered-sets")
    if dense(sets.select("domain", F.slice("tags", 1, F.greatest(F.lit(0), F.size("tags") - (least - 1))).alias("tags")), scope):
        return by_blocks(sets, scope, least, heads=True)
    met = met_in_blocks(prefixes(sets, least), scope, block, lambda x, y: F.least(x("rest"), y("rest")) >= least)
    pairs_ = met.select("a", "b", "domain_a", "domain_b").distinct()
    for end in ("a", "b"):
        pairs_ = pairs_.join(sets.select(F.col("paper_id").alias(end), F.col("domain").alias(f"domain_{end}"), F.col("tags").alias(f"_t{end}")), [end, f"domain_{end}"])
    both = pairs_.withColumn("_t", F.array_intersect("_ta", "_tb"))
    return both.select("a", "b", "domain_a", "domain_b", F.size("_t").cast("long").alias("shared"), F.arrays_overlap("_t", F.array(*map(F.lit, HIGH_SIGNAL_TAGS))).alias("strong")).where(F.col("shared") >= least)


def by_blocks(sets: DataFrame, scope: str, least: int, postings: int | None = None, heads: bool = False) -> DataFrame:
    """Pairs with `least` shared tags or more, counted by pairs of blocks of about so many postings (pair_blocks): a pair is a row
    once, and no row a tag. heads: tags go from the rarest on, and a pair is counted on where it shares one of its prefix."""
    return Blocks(sets, scope, HIGH_SIGNAL_TAGS, postings).pairs(least, heads)


def dense(sets: DataFrame, scope: str, postings: int = 400_000) -> bool:
    """Whether papers share so many tags that reading every pair of blocks is less than a row for each shared tag."""
    by = ["domain", "tag"] if scope == "within" else ["tag"]
    n = sets.select("domain", F.explode("tags").alias("tag")).groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = n.agg(F.sum("n").alias("rows"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("matches")).first()
    return r["rows"] is not None and r["matches"] > 2 * r["rows"] * max(1.0, r["rows"] / postings)


def dense_asked(sets: DataFrame, postings: int = 400_000) -> bool:
    """The same where only pairs with a set that asks (_asks) are looked for: blocks of these meet all blocks."""
    n = sets.select("_asks", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count_if("_asks").cast("double").alias("m"))
    r = n.agg(F.sum("n").alias("rows"), F.sum("m").alias("asking"), F.sum(F.col("m") * (F.col("n") - (F.col("m") + 1) / 2)).alias("matches")).first()
    return r["rows"] is not None and r["matches"] > 2 * r["rows"] * max(1.0, r["asking"] / postings)


def tag_sets(rows: DataFrame) -> DataFrame:
    """(paper_id, domain, tags) of rows (paper_id, domain, tag), as a written table."""
    return written(rows.where("paper_id is not null and domain is not null and tag is not null").groupBy("paper_id", "domain").agg(F.collect_set("tag").alias("tags")), "tag-sets")


def linked(rows: DataFrame, scope: str = "within", least: int = 1, postings: int | None = None) -> DataFrame:
    """(a, b, links): edges that connect what pairs() with `least` shared tags or more connect, and no more; the links of a
    component's edges add up to the number of its pairs. Far fewer rows than pairs, where papers share many tags."""
    sets = tag_sets(rows)
    if dense(sets, scope):
        return Blocks(sets, scope, HIGH_SIGNAL_TAGS, postings).stars(least)
    return pairs(sets.select("paper_id", "domain", F.explode("tags").alias("tag")), scope, least=least).select("a", "b", F.lit(1).cast("long").alias("links"))


def connected(rows: DataFrame, scope: str = "within", least: int = 1, postings: int | None = None, large: int = 20_000_000, hubs: int = 200_000) -> DataFrame:
    """(a, b): edges that connect what pairs() with `least` shared tags or more connect, and no more. Of more than `large` postings
    only pairs are counted that can tell something: those of the papers with the most tags (of about `hubs` postings), and then
    those of papers that these haven't brought into the largest component. What both join is all that pairs would.
    """
    sets = tag_sets(rows)
    if not dense(sets, scope):
        return pairs(sets.select("paper_id", "domain", F.explode("tags").alias("tag")), scope, least=least, how="prefix" if least > 1 else "tags").select("a", "b")
    sets, by = sets.where(F.size("tags") >= least), ["domain"] if scope == "within" else []
    if (sets.agg(F.sum(F.size("tags"))).first()[0] or 0) <= large:
        return Blocks(sets, scope, [], postings).stars(least).select("a", "b")
    seed = seed_of(sets.select(F.explode("tags").alias("tag")))
    sizes = sets.groupBy(*by, F.size("tags").alias("_size")).agg(F.sum(F.size("tags")).alias("_held"))
    held = F.sum("_held").over(Window.partitionBy(*by).orderBy(F.desc("_size")))
    enough = sizes.withColumn("_held", held).withColumn("_fit", F.col("_held") <= hubs)
    # the sizes that fit; where papers of the largest size alone don't, an even share of these
    bound = enough.groupBy(*by).agg(F.coalesce(F.min(F.when(F.col("_fit"), F.col("_size"))), F.max("_size")).alias("_from"), F.greatest(F.lit(1), F.ceil(F.min("_held") / hubs)).alias("_share"))
    first = with_bound(sets, bound, by).select("paper_id", "domain", "tags", ((F.size("tags") >= F.col("_from")) & (F.pmod(F.xxhash64("paper_id"), F.col("_share")) == 0)).alias("_asks"))
    some = written(Blocks(first, scope, [], postings, seed, asking="_asks").stars(least).select("a", "b"), "hub-edges")
    labels = written(components(some.select(F.col("a").alias("u"), F.col("b").alias("v"))), "hub-labels")
    at = sets.select("paper_id", "domain").join(labels.withColumnRenamed("node", "paper_id"), "paper_id")
    most = at.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max_by("component", "n").alias("_most"))
    inside = with_bound(at, most, by).where("component = _most").select("paper_id", "domain", F.lit(True).alias("_in"))
    rest = sets.join(inside, ["paper_id", "domain"], "left").select("paper_id", "domain", "tags", F.col("_in").isNull().alias("_asks"))
    return some.unionByName(Blocks(rest, scope, [], postings, seed, asking="_asks").stars(least).select("a", "b"))


def with_bound(sets: DataFrame, bound: DataFrame, by: list[str]) -> DataFrame:
    """sets with the columns of bound, a row for each value of by, or one row."""
    if by:
        return sets.join(bound, by)
    r = bound.first()
    return sets.withColumns({c: F.lit(None if r is None else r[c]) for c in bound.columns})


def pairs(rows: DataFrame, scope: str = "within", domains: tuple | None = None, paper=None, least: int = 1, with_tags: bool = False, block: int = 10_000, how: str | None = None, more: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(a, b, domain_a, domain_b, shared, strong): a < b with `least` tags in common or more; strong: whether a high-signal
    tag is among them.

    scope: 'within' a domain, 'cross' two given domains (or any two), 'all'. paper: only pairs with this paper. with_tags
    adds the sorted tags. Every tag counts, however frequent. Repeated rows count once.

    more (paper_id, ...): columns of papers, which each pair gets of both as x_a and x_b. vectors (paper_id, vec): adds similarity,
    the cosine of both papers' vectors, 0 where one has none. Papers that meet by blocks bring these along; others are joined
    with them as pairs.

    how: 'blocks' counts pairs of blocks of papers, for papers that share many tags; 'prefix' joins on the rarest tags of each
    paper, for `least` of two or more; 'tags' joins on all. Unless given, blocks where the tags' frequencies say that it is less
    work, else a join.
    """
    high = F.col("tag").isin(*HIGH_SIGNAL_TAGS).alias("_high")  # told once a row, not once a pair
    if paper is None:
        rows = of_domains(rows, scope, domains)
    if paper is None and not with_tags and how != "tags":
        sets = tag_sets(rows)
        if least > 1:  # a paper with fewer tags is in no pair
            sets = sets.where(F.size("tags") >= least)
        if how == "blocks" or (how is None and dense(sets, scope)):
            return by_blocks(with_columns(sets, more, vectors), scope, least)
        if least > 1:
            return with_both(by_prefix(sets, scope, least, block), more, vectors)
        rows = sets.select("paper_id", "domain", F.explode("tags").alias("tag"))
    if paper is not None:
        rows = rows.distinct()
        one = rows.where(F.col("paper_id") == paper).select(F.col("paper_id").alias("p"), F.col("domain").alias("dp"), "tag", high)
        other = rows.where(F.col("paper_id") != paper).select(F.col("paper_id").alias("q"), F.col("domain").alias("dq"), "tag")
        first = F.col("p") < F.col("q")
        ends = [F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.when(first, F.col("dp")).otherwise(F.col("dq")).alias("domain_a"), F.when(first, F.col("dq")).otherwise(F.col("dp")).alias("domain_b")]
        joined = one.join(other, "tag").select("tag", "_high", *ends)
    else:
        joined = met_in_blocks(rows, scope, block).select("tag", high, "a", "b", "domain_a", "domain_b")
    out = [F.count(F.lit(1)).alias("shared"), F.max("_high").alias("strong")]
    if with_tags:
        out.append(F.array_sort(F.collect_list("tag")).alias("tags"))
    if scope == "within" and paper is None:  # one domain is enough then
        found = joined.groupBy("a", "b", "domain_a").agg(*out).select("a", "b", "domain_a", F.col("domain_a").alias("domain_b"), *[F.col(c) for c in ("shared", "strong", "tags")[: len(out)]])
    else:
        found = joined.groupBy("a", "b", "domain_a", "domain_b").agg(*out)
    return with_both(found.where(F.col("shared") >= least) if least > 1 else found, more, vectors)


def of_domains(rows: DataFrame, scope: str, domains: tuple | None) -> DataFrame:
    return rows.where(F.col("domain").isin(*domains)) if scope == "cross" and domains else rows


def with_columns(sets: DataFrame, more: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """sets with the columns of more (paper_id, ...), and their vectors."""
    if more is not None:
        sets = sets.join(more, "paper_id", "left")
    if vectors is not None:
        sets = sets.join(vectors.select("paper_id", F.col("vec").cast("array<double>").alias(VECTOR)), "paper_id", "left")
    return sets


def tally(rows: DataFrame, scope: str, first, n_first: int, second, n_second: int, most: int = 2, how: str | None = None) -> DataFrame:
    """(first, second, shared, strong, crossing, n): how many of the pairs that pairs() gives there are of a kind, for results that
    don't need each by itself. Where papers share many tags, tasks count them and no pair is a row.

    first and second: of a column of ids, what counts of a pair's first and second paper, an integer from 0 to below n_first or
    n_second. shared: up to most. crossing: whether the papers are of two domains.
    """
    kinds = ["first", "second", "shared", "strong", "crossing"]
    sets = tag_sets(rows)
    if how == "blocks" or (how is None and dense(sets, scope)):
        given = sets.withColumns({"_first": first(F.col("paper_id")).cast("int"), "_second": second(F.col("paper_id")).cast("int")})
        counted = Blocks(given, scope, HIGH_SIGNAL_TAGS, None).tally(("_first", n_first), ("_second", n_second), most)
    else:
        met = pairs(sets.select("paper_id", "domain", F.explode("tags").alias("tag")), scope, how="tags")
        counted = met.select(first(F.col("a")).cast("int").alias("first"), second(F.col("b")).cast("int").alias("second"), F.least("shared", F.lit(most)).cast("int").alias("shared"), "strong", (F.col("domain_a") != F.col("domain_b")).alias("crossing"), F.lit(1).cast("long").alias("n"))
    return counted.groupBy(*kinds).agg(F.sum("n").alias("n"))


def with_both(pairs_: DataFrame, more: DataFrame | None, vectors: DataFrame | None) -> DataFrame:
    """pairs (a, b, ...) with the columns of more (paper_id, ...) of both papers, and the similarity of their vectors."""
    for end in "ab":
        if more is not None:
            pairs_ = pairs_.join(more.select(F.col("paper_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in more.columns if c != "paper_id"]), end, "left")
        if vectors is not None:
            pairs_ = pairs_.join(vectors.select(F.col("paper_id").alias(end), F.col("vec").alias(f"_v{end}")), end, "left")
    if vectors is None:
        return pairs_
    return pairs_.withColumn("similarity", F.coalesce(numeric.cosine(F.col("_va"), F.col("_vb")), F.lit(0.0))).drop("_va", "_vb")


def worth(similarity: Column, strong: Column, shared: Column, threshold: float, enough: int = 2) -> Column:
    """Whether a pair is analysed: similar enough, or a high-signal tag, or tags enough."""
    return (similarity >= threshold) | strong | (shared >= enough)


def latest(events: DataFrame, key, order) -> DataFrame:
    """The last event of each key."""
    keys = [key] if isinstance(key, str) else list(key)
    return events.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in events.columns if c not in keys]), F.struct(*order)).alias("_e")).select(*keys, "_e.*")


def already(logged: Column, depth_a: Column, depth_b: Column, old_a: Column, old_b: Column, upgrades: bool) -> Column:
    """Whether a logged pair is skipped: always, or with upgrades unless a depth has grown (an unknown old one is 0)."""
    if not upgrades:
        return logged
    return logged & (F.coalesce(depth_a, F.lit(0)) <= F.coalesce(old_a, F.lit(0))) & (F.coalesce(depth_b, F.lit(0)) <= F.coalesce(old_b, F.lit(0)))


def opened(events: DataFrame) -> DataFrame:
    """The batch form of streaming.jobs.opened_pairs: by pair in order of seq, the first event and each that is deeper than all
    before it."""
    before = Window.partitionBy("pair").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    depth = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    rows = events.select("pair", "seq", depth("depth_a").alias("depth_a"), depth("depth_b").alias("depth_b"))
    rows = rows.withColumns({"_a": F.max("depth_a").over(before), "_b": F.max("depth_b").over(before)})
    first = F.col("_a").isNull()
    return rows.where(first | (F.col("depth_a") > F.col("_a")) | (F.col("depth_b") > F.col("_b"))).select("pair", "seq", "depth_a", "depth_b", F.when(first, "initial").otherwise("depth_upgrade").alias("reason"))


def judged(candidates: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Adds confidence_raw, confidence, novelty, connection_type and score; without answers (a, b, ...) the fixed fallback."""
    crossing = F.col("domain_a") != F.col("domain_b")
    if answers is not None:
        candidates = candidates.join(answers.select("a", "b", "connection_type", F.col("confidence").alias("_c"), F.col("novelty").alias("_n")), ["a", "b"], "left")
        raw = numeric.confidence(F.col("_c"), "connect", 3)
        novelty = F.when(F.col("_n").isin("obvious", "non-obvious", "speculative"), F.col("_n")).otherwise("non-obvious")
    else:
        candidates = candidates.withColumn("connection_type", F.lit("complementary_techniques"))
        raw, novelty = F.lit(3), F.lit("non-obvious")
    out = candidates.withColumn("confidence_raw", raw).withColumn("novelty", novelty).withColumn("confidence", numeric.penalised(F.col("confidence_raw"), crossing))
    return out.withColumn("score", numeric.score(F.col("confidence"), F.col("novelty"))).drop("_c", "_n")


def with_reason(candidates: DataFrame, least: int = 3, **flags: Column) -> DataFrame:
    """Adds reason: the first that holds, in REASONS' order; flags by reason name, those absent never hold."""
    flags = {
        "speculative_filtered": (F.col("novelty") == "speculative") & (F.col("confidence") < 4),
        "below_confidence": F.col("confidence") < least,
    } | flags
    out = F.lit("kept")
    for reason in reversed(REASONS[:-1]):
        if reason in flags:
            out = F.when(F.coalesce(flags[reason], F.lit(False)), reason).otherwise(out)
    return candidates.withColumn("reason", out)


def report(labelled: DataFrame, n: str | None = None) -> DataFrame:
    """One row: how many candidates, and how many for each reason. n: a column that says for how many a row stands."""
    if n is not None:
        of = lambda where: F.coalesce(F.sum(F.when(where, F.col(n))), F.lit(0)).cast("long")
        return labelled.agg(of(F.lit(True)).alias("candidates"), *[of(F.col("reason") == r).alias(r) for r in REASONS])
    return labelled.agg(F.count(F.lit(1)).alias("candidates"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])


def counts(connections: DataFrame, n: str | None = None) -> DataFrame:
    """(confidence, novelty, n) of connections. n: a column that says for how many a row stands."""
    return connections.groupBy("confidence", "novelty").agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))


def top(connections: DataFrame, n: int = 5) -> DataFrame:
    return connections.orderBy(F.desc("score"), F.desc("shared"), "a", "b").limit(n)


def top_pairs(rows: DataFrame, judge, ceiling: float, n: int = 5, scope: str = "all", postings: int = 500_000) -> DataFrame:
    """top() of judge(pairs of rows (paper_id, domain, tag)), by rounds: the papers with the most tags first.

    judge: takes pairs and gives those that count, each by itself, with a score; no score is above `ceiling`. A round reads the
    pairs with `least` tags in common or more, which only papers with so many tags have. Once n of them have a score of
    `ceiling`, all pairs that share less come after these; until then a round has about 4 times the postings of the one
    before, and the last reads all pairs.
    """
    sets = tag_sets(rows)
    sizes = sets.groupBy(F.size("tags").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()  # about the root of twice the postings at most
    held, steps = 0, []
    for r in sizes:
        held += r["size"] * r["n"]
        if held > postings and r["size"] > 1:
            steps.append(r["size"])
            postings = 4 * held
    each = lambda least: sets.where(F.size("tags") >= least).select("paper_id", "domain", F.explode("tags").alias("tag"))
    for least in steps:
        found = written(top(judge(pairs(each(least), scope, least=least)), n), "top-pairs")
        r = found.agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).first()
        if r["n"] == n and r["score"] >= ceiling:
            return top(found, n)
    return top(judge(pairs(each(1), scope)), n)


def visible(a: Column, b: Column, cites_a: Column, cites_b: Column) -> Column:
    """Whether either names the other among what it cites."""
    return F.coalesce(F.array_contains(cites_a, b), F.lit(False)) | F.coalesce(F.array_contains(cites_b, a), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("::", F.least(a, b), F.greatest(a, b))


def of_keys(log: DataFrame, kind: str) -> DataFrame:
    """log (pair, ...) with the ids (a, b) of type kind whose texts pair_key() puts together so, a < b, in place of pair. Of texts
    that hold the separator themselves there may be several such ids, a row each."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        cut = log.withColumns({"_x": F.substring_index("pair", "::", 1), "_y": F.substring_index("pair", "::", -1)})
    else:
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("pair") - 1)), lambda k: F.substr("pair", k, F.lit(2)) == "::")
        cut = log.withColumn("_k", F.explode(at)).withColumns({"_x": F.substr("pair", F.lit(1), F.col("_k") - 1), "_y": F.substr("pair", F.col("_k") + 2)}).drop("_k")
    cut = cut.withColumns({"_p": F.col("_x").try_cast(kind), "_q": F.col("_y").try_cast(kind)})
    same = (F.col("_p").cast("string") == F.col("_x")) & (F.col("_q").cast("string") == F.col("_y")) & (F.col("pair") == pair_key(F.col("_x"), F.col("_y")))
    return cut.where(same & (F.col("_p") != F.col("_q"))).select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), *[c for c in log.columns if c != "pair"])


def hidden(connections: DataFrame) -> DataFrame:
    """One row: how many connections (visible), and how many of them extraction alone doesn't show."""
    seen = F.count_if(F.col("visible"))
    return connections.agg(F.count(F.lit(1)).alias("connections"), seen.alias("visible"), F.greatest(F.lit(0), F.count(F.lit(1)) - seen).alias("hidden"))
