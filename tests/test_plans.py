"""What the plans must and must not hold."""

import re

import pytest
from pyspark.sql import functions as F

from lodestar import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_products(name, spark, sf_dir):
    text = plan(queries.QUERIES[name](spark, sf_dir))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "PythonUDF" not in text


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    text = plan(queries.QUERIES["status_filter"](spark, sf_dir))
    assert "EqualTo(lang,en)" in text and "EqualTo(source,src1)" in text
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(queries.QUERIES["sentence_split"](spark, sf_dir))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,n_chars:bigint>", plan(queries.QUERIES["item_budget"](spark, sf_dir)))


def test_topk_reduces_before_the_shuffle(spark):
    from lodestar.operators import embed

    store = spark.range(100).select(F.col("id").alias("item_id"), F.array((F.col("id") % 7).cast("double"), F.lit(1.0)).alias("vec"))
    text = plan(embed.topk(store, store.where("item_id < 3").withColumnRenamed("item_id", "query_id"), 2))
    assert text.index("Exchange") < text.index("MapInArrow") and "WindowGroupLimit" in text


def test_blocks_of_a_search_are_not_shuffled_for_their_queries(spark):
    from lodestar.operators import embed

    store = spark.range(300).select(F.col("id").alias("item_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.1)).alias("vec"))
    queries_ = store.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    found = embed.topk(store, queries_, 3, block=8, asked=4, small=0)
    assert len(re.findall(r"(?:MergeJoin|HashJoin) ", plan(found))) == 1  # queries with the names of their open blocks
    want = embed.topk(store, queries_, 3)
    of = lambda x: sorted((r.query_id, r.rank, r.item_id) for r in x.collect())
    assert of(found) == of(want)


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) >= len(queries.QUERIES), out.stderr
