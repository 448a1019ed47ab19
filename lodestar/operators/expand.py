"""Bounded expansion of papers: alias normalisation, the redundancy fold, stop rules."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.config import Settings
from lodestar.functions import numeric

# The names under which each bucket's text may come, and defaults.
TEXT_ALIASES = {
    "derivations": ["statement", "content", "item", "description", "derivation", "claim"],
    "exercises": ["problem", "item", "content", "question", "prompt"],
    "missing_angles": ["angle", "item", "content", "description", "gap"],
    "open_questions": ["question", "item", "content", "prompt"],
    "unstated_assumptions": ["assumption", "item", "content", "description"],
    "experiments": ["hypothesis", "content", "item", "title", "claim"],
    "necessary_connections": ["work", "title", "item", "content", "name"],
}
DEFAULT_DETAIL = {
    "derivations": ("follows_from", "claim_1"), "exercises": ("solution", "To be validated."), "missing_angles": ("where_it_lands", "Pending domain-specific synthesis."),
    "open_questions": ("how_to_close", "Pending."), "unstated_assumptions": ("impacts_claim", "claim_1"), "experiments": ("design", "Design not specified."),
    "necessary_connections": ("why_necessary", "Needs explicit rationale."),
}
BUCKETS = list(TEXT_ALIASES)


def first_text(payload: Column, names) -> Column:
    """The first name of a VARIANT whose value is a non-blank scalar, trimmed; lists and objects are passed over."""
    out = []
    for n in names:
        v = F.try_variant_get(payload, f"$.{n}", "string")
        out.append(F.when(~F.rlike(F.ltrim(v), F.lit(r"^[\[{]")), F.nullif(F.trim(v), F.lit(""))))
    return F.coalesce(*out)


def truth(payload: Column, name: str) -> Column:
    """Whether a field of a VARIANT counts as true: texts, lists and objects that aren't empty, numbers other than 0, true; null
    where it is null or absent."""
    value, kind = F.try_variant_get(payload, f"$.{name}", "string"), F.schema_of_variant(F.try_variant_get(payload, f"$.{name}", "variant"))
    number = F.coalesce(value.try_cast("double") != 0, F.lit(True))
    return F.when(value.isNull(), F.lit(None)).when(kind == "STRING", value != "").when(kind == "BOOLEAN", value == "true").when(F.rlike(kind, F.lit("^(OBJECT|ARRAY)")), ~value.isin("{}", "[]")).otherwise(number)


def normalised(items: DataFrame) -> DataFrame:
    """items (bucket, payload as JSON text) with text, detail, confidence, closable and source_claim.

    A payload is parsed once, as VARIANT, and its fields are read from that; one that is no JSON has none of them.
    """
    p, b = F.col("_payload"), F.col("bucket")
    text, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, names in TEXT_ALIASES.items():
        key, default = DEFAULT_DETAIL[k]
        text = F.when(b == k, first_text(p, names)).otherwise(text)
        detail = F.when(b == k, F.coalesce(first_text(p, [key]), F.lit(default))).otherwise(detail)
    conf = F.lower(first_text(p, ["confidence"]))
    closable = F.coalesce(*[truth(p, n) for n in ("closable", "can_close", "answerable")], F.lit(False))
    return items.withColumn("_payload", F.try_parse_json("payload")).select(
        *[F.col(f"`{c}`") for c in items.columns],
        text.alias("text"),
        detail.alias("detail"),
        F.when(b == "derivations", F.when(conf.isin("derived", "likely", "speculative"), conf).otherwise("likely")).otherwise(conf).alias("confidence"),
        F.when(b == "open_questions", closable).alias("closable"),
        F.coalesce(first_text(p, ["source_claim"]), F.lit("claim_1")).alias("source_claim"),
    )


def item_key(text: Column) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(100_000_000))


def budget(pages: Column, depth: Column, settings: Settings = Settings()) -> Column:
    return numeric.item_budget(pages, depth, settings.multipliers)


def stops(items: DataFrame, cap: Column, settings: Settings = Settings()) -> DataFrame:
    """By paper: the batch at which expansion stops, and why, from items (paper_id, seq, batch, redundant, speculative).

    Rules are looked at after each batch, in order: hard_cap, redundancy, speculative_ceiling; without any, completed.
    """
    frame = Window.partitionBy("paper_id").orderBy("seq").rowsBetween(1 - settings.window, 0)
    running = Window.partitionBy("paper_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    last = Window.partitionBy("paper_id", "batch").orderBy(F.desc("seq"))
    flagged = items.select(
        "paper_id", "seq", "batch",
        F.sum(F.col("redundant").cast("int")).over(frame).alias("_r"), F.sum(F.col("speculative").cast("int")).over(frame).alias("_s"), F.count(F.lit(1)).over(frame).alias("_n"),
        F.sum((~F.col("redundant")).cast("int")).over(running).alias("_k"), cap.alias("_cap"),
    )
    ends = flagged.withColumn("_e", F.row_number().over(last)).where("_e = 1")
    full = F.col("_n") >= settings.window
    why = F.when(F.col("_k") >= F.col("_cap"), "hard_cap").when(full & (F.col("_r") >= settings.redundancy_stop), "redundancy")
    why = why.when((F.col("_n") >= settings.speculative_stop) & (F.col("_s") == settings.speculative_stop), "speculative_ceiling")
    ended = ends.withColumn("criterion", why)
    first = ended.where("criterion is not null").groupBy("paper_id").agg(F.min_by(F.struct("batch", "criterion"), "batch").alias("x"))
    every = ended.groupBy("paper_id").agg(F.max("batch").alias("_last"))
    return every.join(first, "paper_id", "left").select("paper_id", F.coalesce("x.batch", "_last").alias("batch"), F.coalesce("x.criterion", F.lit("completed")).alias("criterion"))


class Accepted:
    """The unit vectors that a group has accepted so far, as one matrix that grows by doubling."""

    def __init__(self):
        self.rows, self.n = np.zeros((0, 0)), 0

    def add(self, x: np.ndarray) -> None:
        if not self.n:
            self.rows = np.zeros((max(64, len(x)), x.shape[1]))
        while self.n + len(x) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[self.n : self.n + len(x)] = x
        self.n += len(x)

    def fold(self, x: np.ndarray, threshold: float) -> np.ndarray:
        """Scores of the unit vectors x, in order: the largest product with one accepted before it, 0 without any; those
        below the threshold are accepted. One product against what is accepted, and a triangular pass within x."""
        best = (x @ self.rows[: self.n].T).max(1) if self.n else np.full(len(x), -np.inf)
        inner = x @ x.T
        taken = np.zeros(len(x), bool)
        for i in range(len(x)):
            if not np.isfinite(best[i]):
                best[i] = 0.0
            if best[i] < threshold:
                taken[i] = True
                np.maximum(best[i + 1 :], inner[i, i + 1 :], out=best[i + 1 :])
        self.add(x[taken])
        return best


def units(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1; zeros stay, and stand for nulls."""
    rows = [v for v in vectors.to_pylist() if v is not None] if vectors.null_count else None
    if rows is None:
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    else:
        x = np.zeros((len(vectors), len(rows[0]) if rows else 0))
        x[np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))] = rows
    size = np.sqrt((x * x).sum(1))
    return x / np.where(size > 0, size, 1)[:, None]


def fold(candidates: DataFrame, threshold: float = 0.85, known: DataFrame | None = None, block: int = 256) -> DataFrame:
    """(paper_id, seq, score, redundant) of candidates (paper_id, seq, vec): each against those accepted before it, and
    against known ones (paper_id, seq, vec), which are accepted beforehand and not returned.

    Acceptance depends on earlier acceptance, so a paper's items go through one task in order, in blocks; it holds the accepted
    vectors, whose number the item budget bounds, and one block. Ids keep their types; a null vector is like no other.
    """
    kinds = dict(candidates.dtypes)
    rows = candidates.select("paper_id", "seq", "vec", F.lit(1).alias("_new"))
    if known is not None:
        rows = rows.unionByName(known.select("paper_id", "seq", "vec", F.lit(0).alias("_new")))
    dealt = rows.repartition("paper_id").sortWithinPartitions("paper_id", "_new", "seq")

    def run(batches):
        paper, accepted = None, Accepted()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            cuts = [0, *[k for k in range(1, len(ids)) if ids[k] != ids[k - 1]], len(ids)]
            for low, high in itertools.pairwise(cuts):
                if ids[low] != paper:
                    paper, accepted = ids[low], Accepted()
                for at in range(low, high, block):
                    part = batch.slice(at, min(block, high - at))
                    new, x = part.column(3).to_numpy() == 1, units(part.column(2))
                    accepted.add(x[~new])
                    scores = accepted.fold(x[new], threshold)
                    part = part.filter(pa.array(new))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores), pa.array(scores >= threshold)], ["paper_id", "seq", "score", "redundant"])

    return dealt.mapInArrow(run, f"paper_id {kinds['paper_id']}, seq {kinds['seq']}, score double, redundant boolean")


def eligible(registry: DataFrame, depth: int, domain: str | None = None, target: str | None = None, everything: bool = False, reprocess: bool = False, count: int | None = None) -> DataFrame:
    """Papers to expand: a target before everything before a domain; those done at the depth or deeper go unless reprocessed.

    count: so many of each domain, in order of registry_pos.
    """
    if target is not None:
        registry = registry.where(F.col("paper_id") == target)
    elif not everything and domain is not None:
        registry = registry.where(F.col("domain") == domain)
    if not reprocess:
        registry = registry.where(~((F.col("status") == "exhausted") & (F.coalesce("exhausted_at_depth", F.lit(0)) >= depth)))
    if count is not None:
        registry = registry.withColumn("_r", F.row_number().over(Window.partitionBy("domain").orderBy("registry_pos"))).where(F.col("_r") <= count).drop("_r")
    return registry


def verdict(kept: Column, cap: Column, flags: Column, settings: Settings = Settings()) -> Column:
    """The rule that ends a paper after a batch, or null: flags are the (redundant, speculative) of its last items, as many as
    a window holds at most; kept: how many items weren't redundant so far."""
    n = lambda name: F.size(F.filter(flags, lambda x: x[name]))
    out = F.when(kept >= cap, "hard_cap").when((F.size(flags) >= settings.window) & (n("redundant") >= settings.redundancy_stop), "redundancy")
    return out.when((F.size(flags) >= settings.speculative_stop) & (n("speculative") == settings.speculative_stop), "speculative_ceiling")


def deeper(depth: Column, recorded: Column) -> Column:
    return (depth < 5) & (F.coalesce(recorded, F.lit(0)) <= depth)
