"""Stores that must not lose rows, and documents as they are really kept."""

import json

import pytest
from pyspark.sql import functions as F

from quire import session
from quire.operators import cache, evaluation, extraction
from quire.operators.retrieval import knn_topk
from quire.sources import answers, chunk_index, logs, suites

CHUNK = "chunk_id string, subject string, book_id string"


def index_rows(spark, root):
    return sorted(tuple(r) for r in chunk_index.read_chunk_index(spark, root).select("chunk_id", "subject", "book_id").collect())


def test_index_adds_and_deletes(spark, tmp_path):
    root = str(tmp_path / "index")
    first, second = [("a", "en", "b1"), ("b", "en", "b1")], [("b", "en", "b1"), ("c", "en", "b2"), ("d", "d/e", "b3")]
    chunk_index.add_chunks(spark, spark.createDataFrame(first, CHUNK), root)
    chunk_index.add_chunks(spark, spark.createDataFrame(second, CHUNK), root)
    assert index_rows(spark, root) == sorted(set(first) | set(second))
    chunk_index.rewrite_without_books(spark, root, spark.createDataFrame([("d/e", "b3"), ("en", "b1")], "subject string, book_id string"))
    assert index_rows(spark, root) == [("c", "en", "b2")]


def test_only_the_buckets_of_a_book_are_touched(spark, tmp_path):
    """Files of other buckets keep their names when a book is deleted or added."""
    root = tmp_path / "index"
    rows = [(f"c{k}", "en", f"b{k % 40}") for k in range(400)] + [("z", "fr", "b1")]
    chunk_index.write_chunk_index(spark.createDataFrame(rows, CHUNK), str(root))
    files = lambda: {str(p.relative_to(root)) for p in root.rglob("*.parquet")}
    before = files()
    chunk_index.rewrite_without_books(spark, str(root), spark.createDataFrame([("en", "b1"), ("en", "none")], "subject string, book_id string"))
    after = files()
    assert index_rows(spark, str(root)) == sorted(r for r in rows if r[1:] != ("en", "b1"))
    assert len({f.rsplit("/", 1)[0] for f in before - after}) == 1 and len(before & after) == len(before) - len(before - after) > 20
    chunk_index.add_chunks(spark, spark.createDataFrame([("c1", "en", "b1"), ("c2", "en", "b2")], CHUNK), str(root))
    assert after <= files() and len(files() - after) <= 1
    assert index_rows(spark, str(root)) == sorted([r for r in rows if r[1:] != ("en", "b1")] + [("c1", "en", "b1")])


def test_indented_and_broken_answers(spark, tmp_path):
    folder = tmp_path / "m1" / "ch 1"
    folder.mkdir(parents=True)
    (folder / "q1.json").write_text(json.dumps({"qid": "q1", "module": "m1", "chapter": "ch 1", "answer_text": "two\nlines", "stale": True}, indent=2))
    (folder / "q2.json").write_text('{"qid": "q2", ')
    rows = {r.qid: r for r in answers.read_answers(spark, str(tmp_path)).collect()}
    assert rows["q1"].answer_text == "two\nlines" and rows["q1"].stale and rows["q1"].corrupt_reason is None
    assert (rows["q2"].module, rows["q2"].chapter, rows["q2"].corrupt_reason) == ("m1", "ch 1", "corrupt_file:json")


def test_packed_answers(spark, tmp_path):
    """As many files as the data has parts, however many answers; broken and empty documents keep their keys."""
    root, keys = str(tmp_path / "packed"), ("m=1", "ch/1 ä")
    texts = {f"q{i}": json.dumps({"qid": f"q{i}", "module": "m=1", "chapter": "ch/1 ä", "answer_text": f"two\nlines {i}"}, indent=2) for i in range(40)}
    texts |= {"q 40": '{"qid":   "qid" : "q', "q41": "", "q42": " \n", "q43": None}
    rows = [(*keys, q, t) for q, t in texts.items()]
    answers.pack_answers(spark.createDataFrame(rows, "module string, chapter string, qid string, value string").coalesce(2), root)
    assert len(list((tmp_path / "packed").rglob("*.parquet"))) <= 2
    found = {r.qid: r for r in answers.read_answers(spark, root, packed=True).collect()}
    assert set(found) == set(texts) and {(r.module, r.chapter) for r in found.values()} == {keys}
    assert all((r.answer_text, r.corrupt_reason) == (f"two\nlines {q[1:]}", None) for q, r in found.items() if int(q[1:]) < 40)
    assert all((r.answer_text, r.corrupt_reason) == (None, "corrupt_file:json") for q, r in found.items() if int(q[1:]) >= 40)


def test_equal_versions_have_one_winner(spark):
    schema = "module string, chapter string, qid string, text string, v int"
    rows = [("m", "c", "q", t, 1) for t in "abcdef"]
    picks = {answers.upsert(spark.createDataFrame(p, schema).limit(0), spark.createDataFrame(p, schema).repartition(n), "v").first().text for n in (1, 3) for p in (rows, rows[::-1])}
    assert len(picks) == 1


def test_suite_documents(spark, tmp_path):
    body = {"version": "v3", "questions": [{"module": "m", "qid": f"q{k}", "marks": k} for k in range(3)]}
    (tmp_path / "v3.json").write_text(json.dumps(body, indent=1))
    assert sorted(r.qid for r in suites.read_eval_suite(spark, str(tmp_path), "v3").collect()) == ["q0", "q1", "q2"]
    with pytest.raises(ValueError, match="v3"):
        suites.read_eval_suite(spark, str(tmp_path), "v9")


def test_log_keeps_mistyped_records(spark, tmp_path):
    (tmp_path / "log").write_text('{"a":1}\n{"a":"x"}\n\t \nplain\n[1]\n')
    rows = sorted((r.a, r.raw) if r.a is not None else (-1, r.raw) for r in logs.read_jsonl_log(spark, str(tmp_path / "log"), "a int").collect())
    assert rows == [(-1, "[1]"), (-1, "plain"), (-1, '{"a":"x"}'), (1, None)]


@pytest.mark.parametrize("wrong", ["short", "long", "none"])
def test_wrong_number_of_replies(spark, wrong):
    def infer(prompts):
        good = evaluation.stub_infer(prompts)
        if len(prompts) == 1:
            return [] if wrong == "none" else good
        return {"short": good[:1], "long": good + good, "none": []}[wrong]

    prompts = spark.createDataFrame([(f"q{k}", f"prompt {k}") for k in range(5)], "qid string, prompt string").coalesce(1)
    for r in evaluation.answer_batch(prompts, infer).collect():
        if wrong == "none":
            assert r.answer_text is None and "0 replies to 1" in r.error
        else:
            assert f"prompt {r.qid[1:]}" in r.answer_text and r.error is None


def test_repeated_revisions_and_many_subjects(spark):
    rows = [(f"q{k}", f"s{k % 1500}", {"prompt": 7}, "model", 1) for k in range(3000)]
    df = spark.createDataFrame(rows, "qid string, subject string, versions map<string,int>, embedding_model string, kb_revision int")
    kb = spark.createDataFrame([(f"s{k}", 1) for k in range(1500)] * 2 + [("s0", 2)], "subject string, revision int")
    out = cache.mark_stale(df, kb, "model", current={"prompt": 7})
    assert out.count() == 3000 and sorted(r.qid for r in out.where("stale").collect()) == ["q0", "q1500"]


def test_neighbours_of_many_subjects(spark):
    vec = lambda k: F.array((F.col("id") % 7).cast("double"), F.lit(float(k)))
    chunks = spark.range(4000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), (F.col("id") % 1200).cast("string").alias("subject"), vec(1).alias("embedding"))
    questions = spark.range(1300).select(F.concat(F.lit("q"), "id").alias("qid"), F.col("id").cast("string").alias("subject"), vec(1).alias("qvec"))
    out = knn_topk(questions, chunks, 2, chunk_block=2)
    assert out.groupBy("qid").count().agg(F.count("*"), F.max("count")).first()[:] == (1200, 2)


def test_blank_questions_are_short(spark):
    df = spark.createDataFrame([("   a", 1), ("what", 2)], "question_text string, pos int")
    assert [r.question_text for r in extraction.dedupe_questions([df], [], "pos").collect()] == ["what"]


def test_bank_names_of_one_module(spark):
    df = spark.createDataFrame([("a_b",), ("zz",)], "module string")
    banks = spark.createDataFrame([("a b",), ("a_b",)], "name string")
    labels = [r.group_label for r in cache.group_by_bank(df, banks).orderBy("module").collect()]
    assert labels[0] in ("a b", "a_b") and labels[1] == "Single answers" and len(labels) == 2


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_records_of_a_run_are_stored_compressed(spark, tmp_path):
    import os

    from quire.sources import suites as S

    records = spark.range(2000).selectExpr("id", "'m1' as module", "0.25D as retrieval_latency_seconds").coalesce(1)
    S.write_benchmark_run(records, records.selectExpr("count(*) as n_records"), str(tmp_path), "r1")
    folder = tmp_path / "r1" / "records"
    assert sum(os.path.getsize(folder / f) for f in os.listdir(folder) if f.startswith("part")) < 2000 * 20
    assert spark.read.json(str(folder)).count() == 2000 and S.list_runs(spark, str(tmp_path)).first().n_records == 2000
