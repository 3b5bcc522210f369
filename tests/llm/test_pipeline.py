from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import DOC_SCHEMA
from tests.llm.test_exact_and_near import near_rows


def test_stages_take_effect(spark, tmp_path):
    rows = near_rows(3, 120, 8, 1) + [(500, None, None, "b", 0), (501, "...", None, "b", 0)]
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/out-{k}.parquet")
        seen.append(spark.read.parquet(f"{tmp_path}/out-{k}.parquet"))
    _, langs, exact, near, mixed, packed = seen
    assert {r["doc_id"] for r in langs.collect()} == set(range(120))
    assert exact.select("text").distinct().count() == exact.count() == langs.select("text").distinct().count()
    assert 0 < near.count() < exact.count()
    assert mixed.select("doc_id").distinct().join(near.select("doc_id"), "doc_id", "left_anti").count() == 0
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in mixed.select("doc_id").collect()}
    total = corpus_pipeline.run(spark, str(tmp_path))
    same = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "length", "ids_crc32").collect()))
    assert same(total) == same(packed)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
