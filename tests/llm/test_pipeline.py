"""The pipeline's stages one after another, on documents with clashing column names."""

from pyspark.sql import functions as F

import corpus_pipeline as cp
from logloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_keep_rows_and_columns(spark):
    docs = table(spark, SF, "documents").withColumns(
        {"_text": F.concat(F.lit("x"), F.col("doc_id")), "_id": F.col("doc_id") + 1, "_copies": F.lit("c"), "_rate": F.lit(-1),
         "_toxicity": F.lit("t"), "others": F.lit(7), "a.b": F.lit("dot")})
    names = [n for n, _ in cp.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "secrets", "mixing", "packing"]
    seen = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:4]:
        if name == "secrets":
            continue
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows = out.collect()
        ids = [r.doc_id for r in rows]
        assert rows and set(ids) <= seen
        assert all(r._text == f"x{r.doc_id}" and r._id == r.doc_id + 1 and r._copies == "c" and r._rate == -1
                   and r._toxicity == "t" and r.others == 7 and r["a.b"] == "dot" for r in rows), name
        if name != "mixing":
            assert len(ids) == len(set(ids))


def test_run_packs_what_is_left(spark):
    out = cp.run(spark, SF)
    by = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert by.where("n > 1024 OR n <> end").count() == 0 and out.count() > 0
    empty = cp.reject_toxic(spark, table(spark, SF, "documents").limit(0), SF)
    assert empty.count() == 0 and empty.columns == table(spark, SF, "documents").columns
