"""Sources: file listings, document texts, JSON lines, YAML documents, stores, connection tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from lodestar.functions import text

DOCUMENT = "path string, text string, page_count int, encrypted boolean, image_only boolean"


def listing(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """(path, name, length, modified) of the files below a folder with a suffix, in order of path; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").load(path)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified")).orderBy("path")


def counts_by_suffix(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.select(F.regexp_extract("path", r"\.([^./]+)$", 1).alias("suffix")).groupBy("suffix").agg(F.count(F.lit(1)).alias("files"))


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects of a JSON-lines file; blank and malformed lines, and what is no object, are passed over."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json) of YAML files, one mapping each; others give a null."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")

    def run(batches):
        import json

        import yaml

        for pdf in batches:
            out = []
            for value in pdf["value"]:
                try:
                    got = yaml.safe_load(value)
                except yaml.YAMLError:
                    got = None
                out.append(json.dumps(got, default=str) if isinstance(got, dict) else None)
            yield pd.DataFrame({"path": pdf["path"], "json": out})

    return files.mapInPandas(run, "path string, json string")


def documents(spark: SparkSession, path: str, backend=None) -> DataFrame:
    """(path, text, page_count, encrypted, image_only) of documents.

    backend: a function of a file's bytes to (pages, encrypted); without one the files are texts, whose pages a form feed
    parts. A document without text is image_only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                pages, encrypted = backend(bytes(content)) if backend else (bytes(content).decode("utf-8", "replace").split("\f"), False)
                body = "\n".join(pages)
                rows.append((p, body, len(pages), encrypted, not encrypted and not body.strip()))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "encrypted", "image_only"])

    return files.mapInPandas(run, DOCUMENT)


def pdftotext(content: bytes, command: tuple = ("pdftotext", "-layout", "-", "-"), timeout: int = 20) -> tuple[list[str], bool]:
    """(pages, encrypted) of a PDF by an outside program that reads it and writes its text, as a back end for documents();
    one that is absent, fails or takes too long gives no pages."""
    import subprocess

    try:
        done = subprocess.run(command, input=content, capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return [], False
    if done.returncode:
        return [], b"ncorrect password" in done.stderr
    return done.stdout.decode("utf-8", "replace").rstrip("\f").split("\f"), False


def usable(docs: DataFrame) -> DataFrame:
    return docs.where("not encrypted and not image_only")


def sections(docs: DataFrame, key: str = "path") -> DataFrame:
    """(key, pos, title) of section headers, each title once, at its first place."""
    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line")).withColumn("line", F.trim("line"))
    heads = lines.where((F.col("line") != "") & text.is_header(F.col("line"))).withColumn("title", text.header_title(F.col("line")))
    return heads.groupBy(key, "title").agg(F.min("pos").alias("pos"))


def equation_lines(docs: DataFrame, key: str = "path", most: int = 12) -> DataFrame:
    """(key, expression, context, label): the first lines with an equation, numbered, each with the lines around it."""
    from pyspark.sql import Window

    lines = docs.select(key, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("p", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    w = Window.partitionBy(key).orderBy("p")
    near = lines.withColumn("context", F.substring(F.concat_ws(" ", F.lag("line").over(w), "line", F.lead("line").over(w)), 1, 500)).withColumn("expression", text.equation_of(F.col("line")))
    return near.where("expression is not null").withColumn("label", F.row_number().over(w).cast("long")).where(F.col("label") <= most).select(key, "expression", "context", "label")


def reading_order(blocks: DataFrame, page: list[str]) -> DataFrame:
    """blocks (x, y, text and the columns of page) as one text a page: at the median x two columns part, if both hold blocks."""
    from pyspark.sql import Window

    by = Window.partitionBy(*page)
    middle = blocks.withColumn("_m", F.expr("percentile(x, 0.5)").over(by)).withColumn("_c", (F.col("x") > F.col("_m")).cast("int"))
    two = middle.withColumn("_two", (F.min("_c").over(by) == 0) & (F.max("_c").over(by) == 1))
    placed = two.withColumn("_k", F.struct(F.when(F.col("_two"), F.col("_c")).otherwise(0).alias("c"), "y", "x", "text"))
    return placed.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list("_k")), lambda k: k["text"]), "\n").alias("text"))


def store(spark: SparkSession, path: str) -> DataFrame:
    """A vector store; a missing one is empty, and so is what a damaged one holds in files that can't be read."""
    schema = "item_id string, paper_id string, text string, vec array<float>"
    try:
        return spark.read.schema(schema).option("ignoreCorruptFiles", True).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def connections(spark: SparkSession, path: str, scope: str | None = None, domain: str | None = None) -> DataFrame:
    """Connections by scope and domain; both are partition columns, so others' files aren't read."""
    out = spark.read.parquet(path)
    if scope:
        out = out.where(F.col("pair_scope") == scope)
    return out.where(F.col("domain") == domain) if domain else out


def among(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Connections with both ends among ids (paper_id)."""
    for end in ("a", "b"):
        rows = rows.join(ids.select(F.col("paper_id").alias(end)).distinct(), end, "left_semi")
    return rows


def lookup(keys: DataFrame, first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """keys with first's record, else second's; those with neither are dropped."""
    cols = [c for c in first.columns if c != key]
    a = first.select(key, F.struct(*cols).alias("_a"))
    b = second.select(key, F.struct(*cols).alias("_b"))
    return keys.join(a, key, "left").join(b, key, "left").withColumn("_x", F.coalesce("_a", "_b")).where("_x is not null").select(*keys.columns, "_x.*")
