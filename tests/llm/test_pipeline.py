"""The pipeline next to plain versions of its stages."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import plain

import corpus_pipeline as pipeline

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SECRET = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"'


def documents():
    rng = random.Random(8)
    vocabulary = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(40):
        own = rng.choices(vocabulary, k=rng.randrange(20, 90))
        rows.append((k, " ".join(own)))
        if k % 3 == 0:
            rows.append((100 + k, "  ".join(own)))  # equal but for blanks, and longer
        if k % 4 == 0:
            rows.append((200 + k, " ".join(own[:-1] + ["changed"])))
        if k % 5 == 0:
            rows.append((300 + k, " ".join(own[::-1]) + " " + SECRET))
    rows += [(900, None), (901, ""), (902, "123 -- !!"), (903, "x"), (5, rows[5][1])]
    return [(i, t, ("en", "fr", None)[i % 3], "s", len(t or "")) for i, t in rows]


def test_stages(spark, tmp_path):
    rows = documents()
    sf_dir = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf_dir}/documents.parquet")
    want = [(i, t) for i, t, *_ in rows if t and re.search("[a-z]", t)]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(pipeline.STAGES):
        docs = pipeline.keep(stage(spark, docs, sf_dir), "test")
        if number == 1:
            want = [r for r, (_, _, _, kept) in zip(want, plain.exact(want)) if kept]
        if number == 2:
            want = [r for r, (i, _, component) in zip(want, plain.jaccard(want)) if i == component]
        if number == 3:
            want = [(i, t.replace(SECRET[:-1], "[secret]")) for i, t in want]
            assert any("[secret]" in t for _, t in want)
        if number < 4:
            assert docs.columns == COLUMNS
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == sorted(want), name
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == {i for i, _ in want}
    assert all(sum(p.length for p in pieces if p.doc_id == i) == next(p.doc_tokens for p in pieces if p.doc_id == i) for i, _ in want)
    assert [n for n, _ in pipeline.STAGES] == ["language id", "exact dedup", "jaccard join", "secret scans", "packing"]


def test_run_and_empty_table(spark, tmp_path):
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/a").columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert pipeline.run(spark, f"{tmp_path}/b").count() == 0


def test_only_the_result_is_kept(spark, tmp_path):
    """What the stages keep on the way is deleted, tables in the catalogue too; results of others stay."""
    from quire.llm import tables

    other = tables.keep(spark.range(3), "other")
    n, names = tables.kept(), len(spark.catalog.listTables())
    spark.createDataFrame(documents(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    assert tables.kept() == n + 1 and len(spark.catalog.listTables()) <= names
    assert out.count() > 0 and other.count() == 3


def test_a_missing_language_is_filled(spark):
    rows = [(k, "der die das und ist nicht ein haus " * 9, "de") for k in range(9)] + [(20 + k, "the and is not a house of this " * 9, "en") for k in range(9)]
    rows += [(50, "das haus ist ein haus und nicht das", None), (51, "this is the house and not a house", None)]
    docs = spark.createDataFrame([(i, t, g, "s", 0) for i, t, g in rows], SCHEMA)
    got = {r.doc_id: r.lang for r in pipeline.language_id(spark, docs, "").collect()}
    assert got[50] == "de" and got[51] == "en" and got[0] == "de" and len(got) == 20


def test_documents_without_labels(spark):
    """With nothing to learn from, documents stay; texts of hardly any letters go with a model and without."""
    numbers = "4785380592391139 " * 200 + "x"
    signs = "".join(chr(33 + k * 7 % 15) for k in range(3000)) + "x"
    rows = [(1, "plain words of a document"), (2, "的一是不了人我在有他这"), (3, "Reouti 19.37.233.111"), (4, "x"), (5, numbers), (6, signs), (7, None), (8, "12 --")]
    for labels in ((None,), ("en", "fr")):
        docs = spark.createDataFrame([(i, t, labels[i % len(labels)] if i != 2 else None, "s", 0) for i, t in rows], SCHEMA)
        assert sorted(r.doc_id for r in pipeline.language_id(spark, docs, "").collect()) == [1, 2, 3, 4]


def test_clean_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    stays = pipeline.language_id(spark, docs, "")
    assert stays.columns == docs.columns and stays.count() == docs.where(r"text rlike '\\p{L}'").count()
