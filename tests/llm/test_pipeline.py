import corpus_pipeline
from tests.conftest import SMALL
from tessella.llm import decontamination, mixing, pii, simhash, toxicity
from tessella.session import table


def test_stages_and_their_decisions(spark):
    docs = table(spark, SMALL, "documents")
    names = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        folder = f"/tmp/tessella-tests/{name}"
        out.write.mode("overwrite").parquet(folder)
        before, docs = docs, spark.read.parquet(folder)
        seen.append(docs.count())
        if name != "mixing":
            assert docs.columns == names
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.toxicity(before, table(spark, SMALL, "labels")).where("is_toxic").collect()}
            assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in docs.collect()} == bad
        if name == "simhash_near_dedup":
            want = {r["component_id"] for r in simhash.similar_documents(before).collect()}
            assert {r["doc_id"] for r in docs.collect()} == want
        if name == "decontamination":
            assert decontamination.contamination(docs, table(spark, SMALL, "benchmark")).where("contaminated").count() == 0
        if name == "pii":
            assert pii.personal_data(docs).where("spans <> ''").count() == 0
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0
    got = docs.groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 1 for r in got)


def test_run_gives_the_last_stage(spark):
    df = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "taken", "target"} <= set(df.columns) and df.count() > 0
    assert mixing.WEIGHTS == (5, 2, 1)
