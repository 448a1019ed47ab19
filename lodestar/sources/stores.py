"""Memory and configuration files in their several shapes, validation targets, artifact registration."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.config import Settings

FOLDERS = ("library", "expansion", "connections", "hypotheses", "registry")


def targets(spark: SparkSession, root: str, given: list[str] | None = None) -> DataFrame:
    """(path) of files to validate: given files and folders, else those of the known folders."""
    out = None
    for p in given or [f"{root}/{f}" for f in FOLDERS]:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            continue
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(p).select("path").where(F.rlike("path", F.lit(r"\.(ya?ml|jsonl?|parquet)$")))
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], "path string") if out is None else out.distinct()


def memory_entry(findings: Column, skill: Column, command: Column, stamp: Column) -> Column:
    """One row of the session log as JSON text; its id follows from its content, so that a repeat is the same row."""
    body = F.struct(stamp.alias("timestamp"), skill.alias("skill"), command.alias("command"), findings.alias("findings"))
    return F.to_json(F.struct(F.substring(F.sha1(F.to_json(body).cast("binary")), 1, 16).alias("id"), body.alias("entry")))


def appended(store: str | None, entries: list[dict]) -> str:
    """A small memory file's text with entries added, in the shape it has: lines, {entries: []}, or {nodes: [], edges: []}."""
    try:
        old = json.loads(store) if store and store.strip() else None
    except json.JSONDecodeError:
        old = None
    if isinstance(old, dict) and "nodes" in old:
        nodes = list(old["nodes"])
        edges = list(old.get("edges", []))
        for e in entries:
            if nodes:
                edges.append({"from": nodes[-1].get("id"), "to": e.get("id"), "kind": "next"})
            nodes.append(e)
        return json.dumps(old | {"nodes": nodes, "edges": edges})
    if isinstance(old, dict) and "entries" in old:
        return json.dumps(old | {"entries": [*old["entries"], *entries]})
    lines = [x for x in (store or "").splitlines() if x.strip()]
    return "\n".join([*lines, *map(json.dumps, entries)]) + "\n"


def saved(settings: Settings) -> str:
    """Settings as JSON text, which config.load takes back."""
    return json.dumps({f: getattr(settings, f) for f in settings.__dataclass_fields__}, indent=1)


def endpoint(provider: str, base: str | None = None) -> str:
    """A chat endpoint of a provider's alias, or below a given base."""
    known = {"local": "http://localhost:11434/api/chat", "compatible": "http://localhost:8000/v1/chat/completions"}
    name = {"ollama": "local", "openai-compatible": "compatible"}.get(provider.strip().lower(), provider.strip().lower())
    if not base:
        return known.get(name, known["compatible"])
    base = base.rstrip("/")
    if base.endswith(("/chat", "/completions")):
        return base
    return f"{base}/api/chat" if name == "local" else f"{base}/chat/completions" if base.endswith("/v1") else f"{base}/v1/chat/completions"


def injected(docs: DataFrame, answer, schema: str = "key string, answer string") -> DataFrame:
    """A table of answers (key, answer) from a function of texts, called by batch on the executors; failures give nulls."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for t in pdf["prompt"]:
                try:
                    out.append(answer(t))
                except Exception:  # noqa: BLE001
                    out.append(None)
            yield pd.DataFrame({"key": pdf["key"].astype(str), "answer": out})

    return docs.select("key", "prompt").mapInPandas(run, schema)
