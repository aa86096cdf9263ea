import corpus_pipeline
from tidemark.llm import common, queries, tokens
from tidemark.llm import decontaminate as d
from tidemark.llm import mixing as m
from tidemark.llm import simhash as s
from tidemark.llm import toxicity as t

from ..conftest import SF, same


def test_stages_keep_columns_and_run_equals_them_one_by_one(spark):
    docs = common.table(spark, SF, "documents")
    labels, bench = common.table(spark, SF, "labels"), common.table(spark, SF, "benchmark")
    columns, left = docs.columns, docs
    toxic = {r.doc_id for r in t.toxicity(docs, labels).filter("rejected").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in left.select("doc_id").collect()}
        out = stage(spark, left, SF)
        assert out.columns == columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "toxicity":
            assert after == before - toxic
        elif name == "near_dedup":
            gone = {i for g in s.near_duplicate_groups(left).collect() for i in g.doc_ids if i != g.kept_id}
            assert after == before - gone and gone
        elif name == "decontamination":
            bad = {r.doc_id for r in d.contamination(left, bench).filter("contaminated").collect()}
            assert after == before - bad
        else:
            assert after == {r.doc_id for r in m.select_blocks(left).collect()}
        left = spark.createDataFrame(out.toArrow())
    texts = {r.doc_id: r.text for r in left.collect()}
    rows = corpus_pipeline.run(spark, SF).collect()
    encoding = tokens.Encoder().encoding
    assert {r.doc_id: encoding.decode(tokens.Code(r.code).all().tolist()) for r in rows} == texts and len(rows) == len(texts)


def test_sql(spark, duck):
    for name, sql in queries.ORACLES.items():
        if name != "op7_exact_top_k":
            same(queries.QUERIES[name](spark, SF).toPandas(), duck.execute(sql).df())


def test_top_k_sql(spark, duck):
    got = queries.QUERIES["op7_exact_top_k"](spark, SF).toPandas()
    same(got, duck.execute(queries.ORACLES["op7_exact_top_k"]).df())
