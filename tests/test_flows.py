from pyspark.sql import functions as F

from quire.operators.retrieval import identity_rerank
from quire.operators.retrieval import retrieve
from quire.plans import flows
from quire.plans.queries_retrieval import FLAGS, planned
from quire.plans.views import Views
from quire.sources import chunk_index


def test_pages_to_index(spark, sf_dir, tmp_path):
    v = Views(spark, sf_dir)
    made = flows.build_chunks(v.f2, 200, 40)
    vectors = made.select("chunk_id", F.array(F.lit(1.0), F.lit(2.0)).alias("embedding"))
    flows.ingest(v.f2, vectors.dropDuplicates(["chunk_id"]), str(tmp_path / "index"), 200, 40)
    stored = chunk_index.read_chunk_index(spark, str(tmp_path / "index"), "en")
    assert stored.count() == made.filter("subject = 'en'").count() > 0
    assert stored.filter("embedding is null").count() == 0
    assert {"keywords", "section_table", "important_years"} <= set(stored.columns)


def test_questions_to_reports(spark, sf_dir):
    v = Views(spark, sf_dir)
    out = flows.solve(v.qv, v.f6, FLAGS)
    rows = out.select("qid", "answer_text", "score").collect()
    assert len(rows) == v.qv.count() and all(0 <= r.score <= 1 for r in rows)


def test_own_reranker(spark, sf_dir):
    v = Views(spark, sf_dir)
    reverse = lambda hits: identity_rerank(hits).withColumn("final_rank", 100 - F.col("boost_rank"))
    out = retrieve(planned(v), v.f6, FLAGS, reverse)
    assert out.filter("final_rank > 99").count() == 0 and "text" in out.columns


def test_partition_count_does_not_matter(spark, sf_dir):
    from quire.plans.catalog import queries

    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        return [sorted(map(str, queries()[q](spark, sf_dir).collect())) for q in ("g7_retrieve", "c6_chunk_windows", "e10_dedupe_questions")]

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert run(1) == run(8)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
