from collections import Counter

from lodestar.llm import queries
from tests.llm import data
from tests.llm.test_models import QUESTION
from tests.llm.test_neardup import brute


def tables(spark, path):
    rows = []
    for k in range(300):
        words = data.prose(k + 500, 60).split()
        if k % 6 == 0:
            words[5:8] = ["grumble", "grumpy", "grumling"]
        rows.append((k, " ".join(words)))
    rows += [(300, rows[1][1]), (301, rows[1][1] + " tail"), (302, data.prose(901, 150) + ". " + QUESTION.replace("12", "40")), (303, data.prose(902, 60) + ' token = "abcdef123456" ' + data.prose(903, 60)), (304, None), (305, "")]
    data.documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 0, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return dict(rows)


def test_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    path, texts = f"file://{tmp_path}", tables(spark, f"file://{tmp_path}")
    docs, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        if name != "packing":
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        seen[name] = docs.collect()
    kept = {r.doc_id for r in seen["toxicity"]}
    assert sum(k % 6 == 0 for k in kept if k < 300) < 5 and sum(k % 6 != 0 for k in kept if k < 300) > 245
    want = brute([(d, texts[d]) for d in kept], 5, 80, 100)
    unique = {r.doc_id for r in seen["near_duplicates"]}
    assert unique == {d for d in kept if want[d] == d}
    assert {r.doc_id for r in seen["decontamination"]} == unique - {302}
    masked = {r.doc_id: r.text for r in seen["secrets"]}
    assert "[SECRET]" in masked[303] and "abcdef123456" not in masked[303] and set(masked) == unique - {302}
    lengths = Counter()
    for p in seen["packing"]:
        lengths[p.doc_id] += p.length
    assert set(lengths) == set(masked) and all(lengths[p.doc_id] == p.doc_tokens for p in seen["packing"])
    assert corpus_pipeline.run(spark, path).count() == len(seen["packing"])


def test_every_operator_has_a_query():
    assert {q.split("_")[0] for q in queries.QUERIES if q.startswith("op")} == {f"op{n}" for n in range(1, 11)} and "pipeline" in queries.QUERIES


def test_queries_run_over_the_small_tables(spark, sf_dir):
    from tests.compare import from_duckdb, from_spark

    for name, sql in queries.ORACLES.items():
        assert from_spark(queries.QUERIES[name](spark, sf_dir)) == from_duckdb(sql, sf_dir)
