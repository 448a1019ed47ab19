"""Domain classification by weighted cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import numeric, text

# Cues and weights by domain.
RULES = {
    "physics": [("entanglement", 0.95), ("quantum", 0.95), ("qecc", 0.95), ("tqft", 0.85), ("hep th", 0.6), ("particle", 0.55), ("gravity", 0.5), ("entropy", 0.45), ("thermodynamic", 0.45), ("epr", 0.55), ("field theory", 0.65), ("department of physics", 0.75), ("free energy principle", 0.25), ("locc", 0.5), ("communication protocol", 0.35), ("quantization", 0.4), ("scattering", 0.3)],
    "ML": [("neural network", 0.95), ("neural", 0.85), ("transformer", 0.9), ("machine learning", 0.9), ("deep learning", 0.85), ("meta-learning", 1.0), ("metalearning", 1.0), ("meta learning", 1.0), ("metacognition", 0.7), ("world model", 0.95), ("world models", 0.95), ("looped transformer", 0.95), ("loopwm", 0.95), ("adaptive computation", 0.65), ("latent dynamics", 0.65), ("embedding", 0.65), ("reinforcement", 0.75), ("dataset", 0.5), ("training", 0.45), ("inference", 0.45), ("optimization", 0.45), ("model", 0.2)],
    "mathematics": [("nash equilibria", 1.0), ("undecidability", 0.95), ("theorem", 0.6), ("topology", 0.65), ("proof", 0.6), ("algebra", 0.45), ("manifold", 0.65), ("probability", 0.45), ("statistics", 0.4), ("department of mathematics", 0.95), ("equilibrium", 0.25), ("graph", 0.25), ("lemma", 0.45), ("corollary", 0.45), ("stochastic", 0.35)],
    "neuroscience": [("neuron", 0.9), ("synapse", 0.75), ("brain", 0.65), ("cortex", 0.6), ("cognitive", 0.45), ("cognitive science", 0.7), ("dissociation", 0.95), ("depersonalization", 0.95), ("depersonalisation", 0.95), ("psychology", 0.45), ("psychiatry", 0.75), ("fmri", 0.85), ("eeg", 0.8), ("behavior", 0.35), ("perception", 0.35), ("attention", 0.35), ("department of neuroscience", 0.9), ("free energy principle", 0.45), ("predictive coding", 0.6), ("active inference", 0.5)],
    "philosophy": [("phenomen", 0.9), ("epistemology", 0.85), ("metaphysics", 0.75), ("consciousness", 0.8), ("mind", 0.45), ("ethics", 0.6), ("ontology", 0.7), ("qualia", 0.9), ("intentional", 0.6), ("phenomenology", 0.9), ("human-like", 0.9), ("objects and processes", 0.8), ("thoughts and thinkers", 0.95), ("philosophy department", 0.95), ("complementarity", 0.6), ("thoughts", 0.35)],
}


def rule_rows(spark: SparkSession, rules: dict | None = None) -> DataFrame:
    """(domain, domain_pos, pos, cue, token, weight); cues that normalise to one token keep a row each."""
    rows = [(d, k, p, cue, w) for k, (d, cues) in enumerate((RULES if rules is None else rules).items()) for p, (cue, w) in enumerate(cues)]
    made = spark.createDataFrame(rows, "domain string, domain_pos int, pos int, cue string, weight double")
    return made.withColumn("token", text.normalized(F.col("cue")))


def _scored(body: Column, rules: DataFrame, most: int = 20_000) -> Column:
    """Domains with a hit in a text, best first: structs of minus the score, domain_pos, domain, cues (the first four).

    The rules become a constant of the plan, so no join and no shuffle is needed; a table of over `most` rules is refused.
    """
    known = rules.select("domain", "domain_pos", "pos", "cue", "token", "weight").limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"over {most} rules")
    domains = sorted({(r["domain_pos"], r["domain"]) for r in known})
    rule = lambda r: F.struct(F.lit(r["domain_pos"]).alias("d"), F.lit(r["pos"]).alias("pos"), F.lit(r["cue"]).alias("cue"), F.lit(f" {r['token']} ").alias("token"), F.lit(float(r["weight"])).alias("weight"))
    every = F.array(*[rule(r) for r in sorted(known, key=lambda r: (r["domain_pos"], r["pos"]))])
    if not known:
        return F.array().cast("array<struct<less:double,domain_pos:int,domain:string,cues:string>>")

    def of(found):
        def one(d):
            mine = F.filter(found, lambda r: r["d"] == d["domain_pos"])
            score = F.aggregate(mine, F.lit(0.0), lambda x, r: x + r["weight"])
            cues = F.array_join(F.transform(F.slice(F.array_sort(F.transform(mine, lambda r: F.struct(r["pos"].alias("pos"), r["cue"].alias("cue")))), 1, 4), lambda r: r["cue"]), ", ")
            return F.struct((-score).alias("less"), d["domain_pos"].alias("domain_pos"), d["domain"].alias("domain"), cues.alias("cues"))

        named = F.array(*[F.struct(F.lit(p).alias("domain_pos"), F.lit(d).alias("domain")) for p, d in domains])
        return F.array_sort(F.transform(F.filter(named, lambda d: F.exists(found, lambda r: r["d"] == d["domain_pos"])), one))

    # each step names the one before it once, through a lambda, so that a text is normalised and searched once
    hits = F.transform(F.array(F.concat(F.lit(" "), text.normalized(body), F.lit(" "))), lambda p: F.filter(every, lambda r: F.contains(p, r["token"])))
    return F.get(F.transform(hits, of), 0)


def scores(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, domain, domain_pos, score, cues) of docs (doc_id, text); cues: the first four names."""
    rows = docs.select("doc_id", F.explode(_scored(F.col("text"), rules)).alias("x"))
    return rows.select("doc_id", "x.domain", "x.domain_pos", (-F.col("x.less")).alias("score"), "x.cues")


def classified(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """(doc_id, domain, confidence, score, margin, cues) of every row of docs (doc_id, text), in one projection; those under
    0.60 are unclassified. A null or empty text has no hits; repeated rows stay; an empty table gives no rows."""
    rows = docs.select("doc_id", _scored(F.col("text"), rules).alias("_x"))
    rows = rows.select("doc_id", F.get("_x", 0).alias("a"), F.get("_x", 1).alias("b")).select("doc_id", F.col("a.domain").alias("domain"), F.col("a.cues").alias("cues"), (-F.col("a.less")).alias("score"), (-F.col("b.less")).alias("_s"))
    return rows.select(
        "doc_id",
        F.when(F.col("score") >= 0.60, F.col("domain")).otherwise("unclassified").alias("domain"),
        numeric.domain_confidence(F.col("score"), F.col("_s")).alias("confidence"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        (F.coalesce("score", F.lit(0.0)) - F.coalesce("_s", F.lit(0.0))).alias("margin"),
        F.coalesce("cues", F.lit("")).alias("cues"),
    )


def merged(model_domain: Column, model_conf: Column, rule_domain: Column, rule_conf: Column) -> tuple[Column, Column]:
    """(domain, confidence) of a model's answer and the rules' together."""
    none = F.lit("unclassified")
    rules = (model_domain == none) & (rule_domain != none) & (rule_conf >= 0.55)
    model = (model_conf >= 0.75) | (rule_domain == none)
    over = (model_domain == none) | (rule_conf >= 0.65) | (rule_conf > model_conf + 0.15)
    take_rules = F.when(rules, True).when(model, False).otherwise(over)
    return F.when(take_rules, rule_domain).otherwise(model_domain), F.when(take_rules, F.greatest(rule_conf, model_conf)).otherwise(model_conf)


def final_domain(given: Column, found: Column, known) -> Column:
    """A caller's domain before the found one; labels outside the known ones are unclassified."""
    d = F.coalesce(F.nullif(F.trim(given), F.lit("")), found)
    return F.when(d.isin(*known), d).otherwise("unclassified")
