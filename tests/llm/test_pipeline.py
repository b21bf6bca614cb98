from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tabloom.llm import decontaminate, toxicity
from tests.harness import DATA
from tests.llm.test_jaccard_join import brute

SF = str(DATA / "sf0.001")


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "sentencepiece"]
    stage = dict(pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF).cache()
    assert clean.columns == columns and 0 < clean.count() < docs.count()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rejected = toxicity.score(docs, model).where(F.col("expected_severity") >= toxicity.THRESHOLD)
    assert clean.join(rejected, "doc_id").count() == 0 and clean.count() + rejected.count() == docs.count()

    single = stage["ngram_jaccard_join"](spark, clean, SF).cache()
    groups = brute([(r["doc_id"], r["text"]) for r in clean.select("doc_id", "text").collect()], 5, 80)
    assert sorted(r["doc_id"] for r in single.collect()) == [i for i, _, c, _ in groups if i == c]

    unique = stage["suffix_array_dedup"](spark, single, SF).cache()
    assert unique.columns == columns
    seen, before = set(), {r["doc_id"]: r["text"] for r in single.collect()}
    after = {r["doc_id"]: r["text"] for r in unique.collect()}
    for i in sorted(before):
        raw = (before[i] or "").encode()
        parts = [raw[a : a + 100] for a in range(len(raw) - 99)]
        if not any(p in seen for p in parts) and len(set(parts)) == len(parts):
            assert after[i] == before[i]
        else:
            assert len(after.get(i, "")) < len(before[i])
        seen.update(parts)

    outside = stage["benchmark_decontamination"](spark, unique, SF).cache()
    assert outside.columns == columns
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r["doc_id"]: r["items"] for r in decontaminate.contamination(unique, items).collect()}
    now = {r["doc_id"]: r["text"] for r in outside.collect()}
    assert all(now[i] == after[i] for i, x in found.items() if not x)
    assert any(found.values()) and all(i not in now or now[i] != after[i] for i, x in found.items() if x)
    assert all(r["n_chars"] == len(r["text"]) for r in outside.collect())

    ids = stage["sentencepiece"](spark, outside, SF)
    assert ids.where("round_trip").count() == outside.count()


def test_run_and_null_rows(spark):
    assert pipeline.run(spark, SF).count() > 0
    empty = spark.createDataFrame([(None, None, None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 3
