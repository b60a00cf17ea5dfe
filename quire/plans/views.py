"""Input views over the given tables, for Spark and, as SQL, for the reference database.

Pages number themselves within a book; that numbering is the only view that needs ordering and
goes through the block-wise numbering so that a dominating book is not sent to one task.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.blocked import number_rows
from quire.session import fill_cores
from quire.streaming.runs import use_rocksdb

NL = "chr(10)"

_SUBJECT4 = "case {c} % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end"

_F2_TEXT = """concat(
  case when page_num % 4 = 1 and doc_id % 3 > 0 then concat('CHAPTER ', cast(page_num as string), chr(10)) else '' end,
  case when page_num % 5 = 2 then concat('Page ', cast(page_num as string), ' of 99', chr(10)) else '' end,
  case when page_num % 6 = 3 then concat('D E P A R T M E N T', chr(10)) else '' end,
  'In ', cast(1950 + doc_id % 120 as string), '  there were ', cast(1000 + doc_id % 9000 as string), ' cases.   ', chr(10), chr(10), chr(10), chr(10),
  text, chr(10), cast(page_num as string))"""

# The whole text with all its characters as questions: every 600 give a question with options and one without.
_QUESTIONS = "regexp_replace(text, '(?s)(.{{1,300}})(.{{0,300}})', concat('1. {{1}} (a) one (b) two (c) three{key}', chr(10), '2. Discuss {{2}}', chr(10)){{g}})"

_F3_TEXT = (
    "concat(case when page_num % 3 = 1 then concat('Section ', substring('ABCD', cast(1 + doc_id % 4 as int), 1), ' ', "
    "cast(5 + 5*(doc_id % 2) as string), ' marks', chr(10)) else '' end, "
    "case when doc_id % 2 = 0 then " + _QUESTIONS.format(g="{g}", key=" Key: b") + " else " + _QUESTIONS.format(g="{g}", key="") + " end)"
)

# Bank text with chapter and tier headings on top of the question pages.
_F3H_TEXT = """concat(
  case when page_num % 6 = 1 then concat('CHAPTER ', cast(page_num as string), ': LEGAL PROCEDURE notes', chr(10)) else '' end,
  case when page_num % 3 = 1 then concat('Long answer', chr(10)) when page_num % 3 = 2 then concat('Short notes', chr(10)) else '' end,
  case when page_num % 9 = 4 and subject = 'fr' then concat('Short Essays', chr(10)) else '' end,
  text)"""

_F4 = f"""select concat('q', lpad(cast(conv_id*100+turn as string), 7, '0')) as qid, {_SUBJECT4.format(c='conv_id')} as subject,
  case when turn % 4 = 2 then 'mcq' else 'theory' end as type, case conv_id % 3 when 0 then 5 when 1 then 10 else null end as marks,
  concat(text, case conv_id % 6 when 0 then ' Discuss the management and etiology.' when 1 then ' Describe the diagnosis?' when 2 then ' Classification with diagram and prevention and statistics' when 3 then ' national programme NHM? Mention the epidemiology?' when 4 then ' clinical features of the disorder' else '' end) as question_text,
  concat('ch', cast(conv_id % 5 as string)) as chapter, conv_id, turn from conversations where role = 'user'"""

_F5 = f"""select concat('q', lpad(cast(conv_id*100+turn-1 as string), 7, '0')) as qid, concat('m', cast(conv_id % 7 as string)) as module, concat('ch', cast(conv_id % 5 as string)) as chapter,
  {_SUBJECT4.format(c='conv_id')} as subject,
  concat('Introduction:', chr(10), text, chr(10), case conv_id % 3 when 0 then concat('**Management**', chr(10), '- use [chunk_ab12cd] and WHO and PRAMS', chr(10)) when 1 then concat('Introduction:', chr(10), 'again', chr(10)) else '' end, 'Conclusion:', chr(10), case conv_id % 4 when 0 then 'It is done.' when 1 then 'It ends with' when 2 then 'So on...' else concat('Done.', chr(10), chr(10), chr(10), 'Done.') end) as answer_text,
  case when conv_id % 5 = 0 then null else 5 + conv_id % 3 end as v_prompt, case when conv_id % 5 = 0 then null else 7 end as v_validator, case when conv_id % 6 = 0 then 'old-model' else 'model-a' end as embedding_model, case when conv_id % 4 = 0 then null else conv_id % 3 end as kb_revision,
  case conv_id % 4 when 0 then 3 when 1 then 5 when 2 then 10 else null end as marks, conv_id, turn from conversations where role = 'assistant'"""

_F6 = f"""select concat('c', lpad(cast(e.vec_id as string), 7, '0')) as chunk_id, {_SUBJECT4.format(c='e.label')} as subject, e.embedding, e.vec_id,
  e.vec_id % 2 = 0 as section_management, e.vec_id % 3 = 0 as section_etiology, e.vec_id % 5 = 0 as section_diagnosis, e.vec_id % 7 = 0 as section_diagram, e.vec_id % 4 = 1 as section_classification,
  concat('book', cast(e.vec_id % 11 as string)) as book_id, d.text
  from embeddings e left join documents d on d.doc_id = e.vec_id"""

_F7 = """select event_id, user_id as book_id, ts, case event_type when 'signup' then 'pending' when 'view' then 'running' when 'click' then 'running' when 'purchase' then 'succeeded' else 'failed' end as status, value as percent, props from events"""

_F8 = """select concat('m', cast(l_suppkey % 5 as string)) as module, concat('q', cast(l_orderkey as string), '-', cast(l_linenumber as string)) as qid, case when l_linestatus = 'O' then 'cold' else 'warm' end as path, l_discount < 0.09 as success, l_linestatus <> 'O' as cache_hit, l_returnflag as run_id,
  cast(l_quantity as int) * 10 as prompt_tokens, cast(l_quantity as int) as completion_tokens, l_tax as latency_seconds, case when l_quantity < 5 then cast(0.0 as double) else l_extendedprice / 100000 end as avg_distance,
  l_discount as retrieval_latency_seconds, l_tax + l_discount as generation_latency_seconds, l_tax / 2 as pdf_generation_seconds, cast(floor(l_extendedprice) as bigint) % 4000 as answer_length_chars, l_partkey % 700 as answer_length_words, l_linenumber % 6 as retrieval_chunks from lineitem"""

_F9 = """select concat(lang,'-',source) as book_id, lang as subject, count(*) as pages, cast(floor(count(*) * 1.2) as int) as chunks, min(doc_id) as first_doc, case when min(doc_id) % 4 = 0 then 'archived' else null end as archived_at from documents group by lang, source"""

_QV = """select f4.qid, f4.subject, f4.type, f4.marks, f4.question_text, f4.chapter, f4.conv_id, f4.turn, e.embedding as qvec
  from f4 join embeddings e on e.vec_id = (f4.conv_id * 7 + f4.turn) % {vectors}"""

# Answers with their question, a target, a source text and a few more names and layout elements.
_F5H = """select f5.qid, f5.module, f5.chapter, f5.subject, f5.conv_id, f5.marks, f4.type as qtype, f4.question_text, f4.marks as question_marks,
  concat(f5.answer_text, case when f5.conv_id % 7 = 1 then concat(chr(10), 'The National Rural Scheme and ABQZ of the Orange Valley Mission help the Janani Suraksha Yojana.') when f5.conv_id % 7 = 2 then concat(chr(10), '- see chunk_ab12cd and chunk_ab12cd') else '' end) as answer_text,
  case when f5.conv_id % 5 = 4 then null when f5.conv_id % 5 = 3 then concat(f4.question_text, ' ABQZ ORANGE programme') else f4.question_text end as source_text,
  case f5.conv_id % 4 when 0 then 125 when 1 then 375 when 2 then 750 else null end as target_words
  from f5 left join f4 on f4.qid = f5.qid"""

_RAW_PAGES = """select lang as subject, concat(lang,'-',source) as book_id, case when doc_id % 5 = 0 then 'ocr' else 'text' end as method, text, cast(length(text) as bigint) as char_count, doc_id from documents"""


def _duck(sql: str) -> str:
    return sql.replace("as string)", "as varchar)").replace("{g}", ", 'g'").replace("{1}", "\\1").replace("{2}", "\\2").replace("{vectors}", "(select count(*) from embeddings)")


def _spark(sql: str) -> str:
    return sql.replace("{g}", "").replace("{1}", "$1").replace("{2}", "$2")


DUCK_VIEWS: dict[str, str] = {
    "rawp": _duck(_RAW_PAGES),
    "f1": """select subject, book_id, cast(row_number() over (partition by book_id order by doc_id) as bigint) as page_num,
             method, text, char_count, doc_id from rawp""",
    "f2": "select subject, book_id, page_num, doc_id, " + _duck(_F2_TEXT) + " as text from f1",
    "f3": "select subject, book_id, page_num, doc_id, " + _duck(_F3_TEXT) + " as text from f1",
    "f3h": "select subject, book_id, page_num, doc_id, " + _duck(_F3H_TEXT) + " as text from f3",
    "f4": _duck(_F4),
    "f5": _duck(_F5),
    "f5h": _duck(_F5H),
    "f6": _duck(_F6),
    "f7": _duck(_F7),
    "f8": _duck(_F8),
    "f9": _duck(_F9),
    "qv": _duck(_QV),
}


class Views:
    """Lazily built input views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def for_streams(self) -> "Views":
        """The same views in a session of their own, set up for stateful streams.

        State is split by the cores of the cluster rather than by the batch setting, and kept in
        the disk-backed store.
        """
        session = self.spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", str(self.spark.sparkContext.defaultParallelism))
        session.conf.set("spark.sql.session.timeZone", "UTC")
        use_rocksdb(session)
        return Views(session, self.sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, sql: str, **tables: DataFrame) -> DataFrame:
        for name in tables:
            sql = _named(sql, name)
        return self.spark.sql(_spark(sql), **tables)

    def wide(self, name: str, key: str) -> DataFrame:
        """A table whose rows are costly to process."""
        return fill_cores(self.table(name), key)

    @cached_property
    def raw(self) -> DataFrame:
        return self._sql(_RAW_PAGES, documents=self.wide("documents", "doc_id"))

    @cached_property
    def f1(self) -> DataFrame:
        return number_rows(self.raw, ["book_id"], "doc_id", "page_num")

    def _with_text(self, base: DataFrame, text_sql: str) -> DataFrame:
        return base.select(
            "subject", "book_id", "page_num", "doc_id", F.expr(_spark(text_sql)).alias("text")
        )

    @cached_property
    def f2(self) -> DataFrame:
        return self._with_text(self.f1, _F2_TEXT)

    @cached_property
    def f3(self) -> DataFrame:
        return self._with_text(self.f1, _F3_TEXT)

    @cached_property
    def f3h(self) -> DataFrame:
        return self._with_text(self.f3, _F3H_TEXT)

    @cached_property
    def f4(self) -> DataFrame:
        return self._sql(_F4, conversations=self.wide("conversations", "conv_id"))

    @cached_property
    def f5(self) -> DataFrame:
        return self._sql(_F5, conversations=self.wide("conversations", "conv_id"))

    @cached_property
    def f5h(self) -> DataFrame:
        return self._sql(_F5H, f4=self.f4, f5=self.f5)

    @cached_property
    def f6(self) -> DataFrame:
        return self._sql(_F6, embeddings=self.table("embeddings"), documents=self.table("documents"))

    @cached_property
    def f7(self) -> DataFrame:
        return self._sql(_F7, events=self.table("events"))

    @cached_property
    def f8(self) -> DataFrame:
        return self._sql(_F8, lineitem=self.table("lineitem"))

    @cached_property
    def f9(self) -> DataFrame:
        return self._sql(_F9, documents=self.table("documents"))

    @cached_property
    def qv(self) -> DataFrame:
        vectors = self.table("embeddings")
        return self._sql(_QV.replace("{vectors}", str(max(1, vectors.count()))), f4=self.f4, embeddings=vectors)


def _named(sql: str, name: str) -> str:
    import re

    return re.sub(rf"\b(from|join)\s+{name}\b", rf"\1 {{{name}}} as {name}" if f" {name}." in sql else rf"\1 {{{name}}}", sql)
