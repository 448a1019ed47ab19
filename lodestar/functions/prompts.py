"""Text blocks made from records: prompts, summaries, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields of each bucket that its summary line shows, in order.
PROMPT_FIELDS = {
    "derivations": ["statement", "follows_from", "confidence"],
    "exercises": ["problem", "solution", "difficulty"],
    "missing_angles": ["angle", "where_it_lands", "why_missed"],
    "open_questions": ["question", "how_to_close", "closable"],
    "unstated_assumptions": ["assumption", "impacts_claim"],
    "experiments": ["hypothesis", "design", "predicted_true", "predicted_false"],
    "necessary_connections": ["work", "why_necessary"],
}
DIRECTIONS = {
    "experiments": ["hypothesis", "design"], "open_questions": ["question", "how_to_close"], "missing_angles": ["angle", "where_it_lands"],
    "necessary_connections": ["work", "why_necessary"], "derivations": ["statement", "follows_from"],
}


def _joined(payload: Column, names: list[str], glue: str) -> Column:
    values = F.array(*[F.trim(F.get_json_object(payload, f"$.{n}")) for n in names])
    return F.array_join(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), glue)


def item_summary(bucket: Column, payload: Column) -> Column:
    """'bucket: a | b | c' of an item given as JSON text, a bare text as it is; null for an empty one."""
    line = F.lit(None).cast("string")
    for b, names in PROMPT_FIELDS.items():
        line = F.when(bucket == b, _joined(payload, names, " | ")).otherwise(line)
    line = F.when(F.startswith(F.ltrim(payload), F.lit("{")), line).otherwise(F.trim(payload))
    return F.when(line != "", F.concat(bucket, F.lit(": "), line))


def direction(bucket: Column, payload: Column, most: int = 300) -> Column:
    line = F.lit(None).cast("string")
    for b, names in DIRECTIONS.items():
        line = F.when(bucket == b, F.nullif(_joined(payload, names, " - "), F.lit(""))).otherwise(line)
    return F.substring(line, 1, most)


def direction_rank(bucket: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for k, b in enumerate(DIRECTIONS) for x in (F.lit(b), F.lit(k))]), bucket)


def _list(items: Column, field: str | None, most: int) -> Column:
    values = F.transform(F.slice(items, 1, most), lambda x: x[field] if field else x)
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: F.concat(F.lit("'"), F.coalesce(v, F.lit("None")), F.lit("'"))), ", "), F.lit("]"))


def paper_block(title: Column, paper_id: Column, claims: Column, methods: Column, techniques: Column, equations: Column, lines: Column) -> Column:
    """What a pair prompt shows of a paper: five claims, methods and techniques, three equations, its expansion lines."""
    equation = F.when(F.size(equations) > 0, F.concat(F.lit("\nEquations: "), _list(equations, "expression", 3))).otherwise("")
    expansion = F.when(F.size(lines) > 0, F.concat(F.lit("\nExpansion outputs:\n"), F.array_join(F.transform(lines, lambda s: F.concat(F.lit("- "), s)), "\n"))).otherwise("\nExpansion outputs: none found")
    return F.concat(F.lit("Paper: "), title, F.lit("\nPaper ID: "), paper_id, F.lit("\nClaims: "), _list(claims, "statement", 5), F.lit("\nMethods: "), _list(methods, "name", 5), F.lit("\nTechniques: "), _list(techniques, "name", 5), equation, expansion)


def expansion_context(title: Column, claims: Column, methods: Column, techniques: Column, equations: Column, tags: Column, strategy: Column) -> Column:
    """What an expansion prompt shows: eight claims, six methods, techniques and equations, twelve tags."""
    return F.concat(
        F.lit("Title: "), title, F.lit("\nClaims: "), _list(claims, "statement", 8), F.lit("\nMethods: "), _list(methods, "name", 6), F.lit("\nTechniques: "), _list(techniques, "name", 6),
        F.lit("\nEquations: "), _list(equations, "expression", 6), F.lit("\nTags: "), _list(tags, None, 12), F.lit("\nStrategy: "), strategy,
    )


def strategy(depth: Column) -> Column:
    base = F.when(depth >= 4, "include cross-domain speculative links and transfer opportunities").otherwise("prioritize directly supported, high-evidence inferences")
    return F.concat(F.lit("Depth "), depth.cast("string"), F.lit(" mode, with emphasis on "), base, F.lit("."))


def scope_label(within: str | None = None, cross: tuple | None = None, paper: str | None = None) -> str:
    """A run's name by what it covers."""
    if within:
        return f"within_{within}"
    if cross:
        return f"cross_{cross[0]}_{cross[1]}"
    return f"paper_{paper}" if paper else "all"


def linked_paths(cluster_id: Column) -> Column:
    """Where a cluster's artifacts lie, below the store's root."""
    kinds = ("hypotheses", "triage", "review", "experiments", "prior_art")
    return F.create_map(*[x for k in kinds for x in (F.lit(k), F.concat(F.lit(f"{k}/"), cluster_id, F.lit(".yaml")))])


def relative(path: Column, root: str) -> Column:
    return F.when(F.startswith(path, F.lit(root.rstrip("/") + "/")), F.substr(path, F.lit(len(root.rstrip("/")) + 2))).otherwise(path)


def gap_line(gap: Column) -> Column:
    return F.concat_ws(" | ", gap["gap_type"], gap["description"], F.concat(F.lit("confidence "), gap["confidence"].cast("string")), F.concat(F.lit("feasibility "), gap["feasibility"].cast("string")))


def connection_line(kind: Column, description: Column, score: Column) -> Column:
    return F.concat_ws(" | ", kind, description, F.concat(F.lit("score "), score.cast("string")))


def extraction(title: Column, body: Column, equations: Column, version: int = 1, errors: Column | None = None, most: int = 18_000, anchors: int = 8) -> Column:
    """The prompt that asks for a paper's record: the first `most` characters of its text, `anchors` equations, and the
    errors of a former answer, if there are any."""
    lines = F.transform(F.slice(equations, 1, anchors), lambda e: F.concat(F.lit("- "), F.coalesce(e["label"], F.lit("equation")), F.lit(": "), F.coalesce(e["expression"], F.lit(""))))
    hint = F.when(F.size(equations) > 0, F.concat(F.lit("\n\nLines that look like equations:\n"), F.array_join(lines, "\n"))).otherwise("")
    asked = F.concat(
        F.lit("Give a structured record of this research paper.\n\nTitle: "), F.coalesce(title, F.lit("")), F.lit(f"\n\nSchema version: {version}\n\nAnswer with JSON. State claims so precisely that they could be wrong."),
        hint, F.lit("\n\nText:\n"), F.substring(F.coalesce(body, F.lit("")), 1, most),
    )
    return asked if errors is None else F.concat(asked, F.when(F.size(errors) > 0, F.concat(F.lit("\n\nValidation errors:\n- "), F.array_join(errors, "\n- "))).otherwise(""))
