"""Nested contracts: validation in two modes, and migrations.

A contract is {field: {type, required, default, enum, pattern, minimum, maximum, min_items, max_items, format, fields}};
it is walked once on the driver into one expression that lists each row's errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import numeric

TRUE, FALSE = ("true", "1", "yes", "y"), ("false", "0", "no", "n")
PHASES = {"within_domain": "within", "cross_domain": "cross"}


def _error(bad: Column, path: Column, message: str) -> Column:
    return F.array(F.when(F.coalesce(bad, F.lit(False)), F.concat(path, F.lit(f": {message}"))))


def _value_errors(x: Column, rule: dict, path: Column, mode: str) -> list[Column]:
    kind, s = rule.get("type", "string"), x.cast("string")
    out: list[Column] = []
    if kind in ("integer", "number"):
        number = s.try_cast("double") if mode == "pipeline" else x.try_cast("double")
        out.append(_error(x.isNotNull() & number.isNull(), path, f"expected {kind}"))
        if kind == "integer":
            out.append(_error(number != F.floor(number), path, "expected integer"))
        for key, bad in (("minimum", lambda n, v: n < v), ("maximum", lambda n, v: n > v)):
            if key in rule:
                out.append(_error(bad(number, rule[key]), path, f"{key} {rule[key]}"))
    elif kind == "boolean":
        out.append(_error(~F.lower(s).isin(*TRUE, *FALSE), path, "expected boolean"))
    elif kind == "string":
        if "pattern" in rule:
            out.append(_error(~F.rlike(s, F.lit(f"^(?:{rule['pattern']})$")), path, "pattern"))
        if rule.get("format"):
            shaped = F.rlike(s, F.lit(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"))
            out.append(_error(s.isNotNull() & ~(shaped & F.try_to_timestamp(s).isNotNull()), path, "expected ISO 8601"))
    elif kind.startswith("list"):
        for key, bad in (("min_items", lambda n, v: n < v), ("max_items", lambda n, v: n > v)):
            if key in rule:
                out.append(_error(bad(F.size(x), rule[key]), path, f"{key} {rule[key]}"))
        if kind == "list[object]":
            inner = lambda e, i: F.flatten(F.array(*_field_errors(e, rule.get("fields", {}), F.concat(path, F.lit("/"), i.cast("string")), mode)))
            out.append(F.coalesce(F.flatten(F.transform(x, inner)), F.array().cast("array<string>")))
    elif kind == "object":
        out += _field_errors(x, rule.get("fields", {}), path, mode)
    if "enum" in rule and kind != "list[string]":
        out.append(_error(~s.isin(*map(str, rule["enum"])), path, "not in enum"))
    return out


def _field_errors(row: Column, contract: dict, path: Column, mode: str) -> list[Column]:
    out: list[Column] = []
    for name, rule in contract.items():
        here, x = F.concat(path, F.lit(f"/{name}")), row[name]
        if rule.get("required") and (mode == "strict" or "default" not in rule):
            out.append(_error(x.isNull(), here, "missing"))
        out += _value_errors(x, rule, here, mode)
    return out


def errors(rows: DataFrame, contract: dict, mode: str = "pipeline", header_only: list[str] | None = None) -> Column:
    """The errors of a row, as texts with slash paths.

    'pipeline' lets a missing field with a default pass and reads numbers in texts; 'strict' does neither. header_only
    names the fields that are looked at, for parity with contracts whose lists were never visited.
    """
    used = {k: v for k, v in contract.items() if header_only is None or k in header_only}
    parts = _field_errors(F.struct(*[F.col(c) for c in rows.columns]), used, F.lit(""), mode)
    return F.filter(F.flatten(F.array(*parts)), lambda e: e.isNotNull()) if parts else F.array().cast("array<string>")


def fixed(rows: DataFrame, contract: dict) -> DataFrame:
    """rows with defaults for missing fields and scalars coerced; what can't be coerced stays for errors() to name."""
    out = rows
    for name, rule in contract.items():
        if name not in rows.columns:
            out = out.withColumn(name, F.lit(rule.get("default")))
            continue
        kind, s = rule.get("type"), F.col(name).cast("string")
        if kind == "integer" and dict(rows.dtypes)[name] == "string":
            out = out.withColumn(name, F.coalesce(F.floor(s.try_cast("double")).cast("string"), F.col(name)))
        if kind == "boolean" and dict(rows.dtypes)[name] == "string":
            out = out.withColumn(name, F.when(F.lower(s).isin(*TRUE), "true").when(F.lower(s).isin(*FALSE), "false").otherwise(F.col(name)))
        if rule.get("default") is not None:
            out = out.withColumn(name, F.coalesce(name, F.lit(rule["default"]).cast(dict(rows.dtypes)[name])))
    return out


def contract_of(path: Column) -> Column:
    """The contract that a file's place implies."""
    p = F.lower(path)
    return F.when(F.contains(p, F.lit("/exhaust/")), "expansion").when(F.contains(p, F.lit("/library/")), "library").when(F.rlike(p, F.lit("/(within|cross)_domain/")), "connection").when(F.contains(p, F.lit("/hypotheses/")), "hypothesis")


def migrated_connections(rows: DataFrame) -> DataFrame:
    """Connections of version 1: ids under their new names, scope from the folder, labels as numbers, defaults."""
    have = set(rows.columns)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in have], F.lit(None).cast("string"))
    folder = F.when(F.contains("path", F.lit("/within_domain/")), "within").when(F.contains("path", F.lit("/cross_domain/")), "cross") if "path" in have else F.lit(None).cast("string")
    kind = pick("connection_type")
    return rows.select(
        F.lit(1).alias("schema_version"),
        F.coalesce(pick("pair_scope"), folder).alias("pair_scope"),
        pick("paper_a_id", "paper_a").alias("paper_a_id"),
        pick("paper_b_id", "paper_b").alias("paper_b_id"),
        F.when(kind == "shared_approach", "methodological_overlap").otherwise(kind).alias("connection_type"),
        numeric.confidence(pick("confidence"), "migrate", 3).alias("confidence"),
        F.coalesce(pick("novelty"), F.lit("non-obvious")).alias("novelty"),
        F.coalesce(pick("status"), F.lit("pending_review")).alias("status"),
    )


def migrated_library(rows: DataFrame) -> DataFrame:
    """schema_version 1, and years that are texts as numbers."""
    return rows.withColumn("schema_version", F.lit(1)).withColumn("year", F.coalesce(F.col("year").cast("string").try_cast("int"), F.lit(0)))


def migrated_expansions(rows: DataFrame) -> DataFrame:
    """schema_version 2, depth from 1 to 5, an unknown criterion as completed, source_claim from follows_from."""
    known = ("redundancy", "speculative_ceiling", "hard_cap", "completed")
    return (
        rows.withColumn("schema_version", F.lit(2))
        .withColumn("depth", F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(F.col("depth").cast("string").try_cast("int"), F.lit(1)))))
        .withColumn("criterion", F.when(F.col("criterion").isin(*known), F.col("criterion")).otherwise("completed"))
        .withColumn("source_claim", F.coalesce(F.nullif(F.trim("source_claim"), F.lit("")), F.nullif(F.trim("follows_from"), F.lit("")), F.lit("claim_1")))
    )


def migrated_gaps(gaps: Column) -> Column:
    """Gaps with their scores as numbers and ranks by place where they have none."""
    return F.transform(
        gaps,
        lambda g, i: F.struct(g["description"].alias("description"), numeric.confidence(g["confidence"], "migrate", 3).alias("confidence"), numeric.confidence(g["feasibility"], "migrate", 3).alias("feasibility"), F.coalesce(g["rank"], i + 1).alias("rank")),
    )


def versions(target: int | None = None, **each: int | None) -> dict[str, int]:
    """The version to migrate each kind to: the known ones, then one for all, then those named."""
    known = {"library": 1, "expansion": 2, "connection": 1, "hypothesis": 1}
    unknown = set(each) - set(known)
    if unknown:
        raise ValueError(f"no such kind: {sorted(unknown)}")
    return {k: each[k] if each.get(k) is not None else target if target is not None else v for k, v in known.items()}


def _truth(x: Column) -> Column:
    """yes/y/true/1 and no/n/false/0 as booleans; else null."""
    return F.when(x.isin("yes", "y", "true", "1"), True).when(x.isin("no", "n", "false", "0"), False)


def migrated_hypotheses(rows: DataFrame, version: int = 1) -> DataFrame:
    """Hypotheses under their new names: cluster_id from id, paper_ids from papers or paper_id and distinct, a known status,
    novelty and gaps with their defaults. Scalars may be texts; columns that are absent count as null."""
    have = dict(rows.dtypes)
    col = lambda n, t: F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    s, many = lambda n: col(n, "string"), lambda n: col(n, "array<string>")
    papers = F.coalesce(many("paper_ids"), many("papers"), F.when(s("paper_id").isNotNull(), F.array(s("paper_id"))), F.array().cast("array<string>"))
    status = F.replace(F.lower(F.trim(s("status"))), F.lit(" "), F.lit("_"))
    novelty = s("novelty")
    inner = {f.name for f in rows.schema["gaps"].dataType.elementType.fields} if "gaps" in have else set()
    of = lambda g, n, t="string": g[n].cast(t) if n in inner else F.lit(None).cast(t)
    kind = rows.schema["gaps"].dataType.elementType if "gaps" in have else None
    single = lambda g: F.when(of(g, "supporting_paper").isNotNull(), F.array(of(g, "supporting_paper"))) if "supporting_paper" in inner and kind["supporting_paper"].dataType.typeName() == "string" else of(g, "supporting_paper", "array<string>")
    gap = lambda g, i: F.struct(
        F.coalesce(of(g, "gap_type"), F.lit("unexplored_question")).alias("gap_type"), of(g, "description").alias("description"),
        numeric.confidence(of(g, "confidence"), "migrate", 3).alias("confidence"), numeric.confidence(of(g, "feasibility"), "migrate", 3).alias("feasibility"),
        F.coalesce(_truth(of(g, "novelty")), F.lit(True)).alias("novelty"),
        F.coalesce(of(g, "supporting_papers", "array<string>"), single(g), F.array().cast("array<string>")).alias("supporting_papers"), F.coalesce(of(g, "rank", "int"), i + 1).alias("rank"),
    )
    return rows.select(
        F.lit(version).alias("schema_version"), F.coalesce(F.nullif(s("cluster_id"), F.lit("")), s("id")).alias("cluster_id"),
        F.array_distinct(F.filter(papers, lambda p: p.isNotNull())).alias("paper_ids"), s("summary").alias("summary"),
        F.when(status.isin("pending_review", "investigate", "accepted", "rejected"), status).otherwise("pending_review").alias("status"),
        F.coalesce(_truth(novelty), F.when(novelty.isNull(), True).otherwise(novelty != "")).alias("novelty"),
        *([F.transform("gaps", gap).alias("gaps")] if kind else []),
    )


def migration_report(before: DataFrame, after: DataFrame, key: str, dry_run: bool = True) -> DataFrame:
    """(key, action, notes): what a migration does to each row, by comparing rows; notes name the columns that differ."""
    shared = [c for c in after.columns if c != key]
    as_text = lambda df, p: df.select(key, *[(F.to_json(F.struct(F.col(c).alias("x"))) if c in df.columns else F.lit(None).cast("string")).alias(f"{p}{c}") for c in shared])
    both = as_text(before, "_b_").join(as_text(after, "_a_"), key)
    differ = F.filter(F.array(*[F.when(~F.col(f"_b_{c}").eqNullSafe(F.col(f"_a_{c}")), F.lit(c)) for c in shared]), lambda x: x.isNotNull())
    return both.select(key, F.when(F.size(differ) == 0, "unchanged").otherwise("would_update" if dry_run else "updated").alias("action"), differ.alias("notes"))


def migration_totals(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("processed"), F.count_if(F.col("action") != "unchanged").alias("changed"))


def validation_totals(checked: DataFrame) -> DataFrame:
    """One row of rows (errors): how many were looked at, and how many failed."""
    return checked.agg(F.count(F.lit(1)).alias("validated"), F.count_if(F.size("errors") > 0).alias("failed"))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose rows differ, by comparing the rows rather than by flags."""
    b = before.select(key, F.to_json(F.struct(*sorted(before.columns))).alias("_b"))
    a = after.select(key, F.to_json(F.struct(*sorted(after.columns))).alias("_a"))
    return b.join(a, key).where("_a <> _b").select(key)
