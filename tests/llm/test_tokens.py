"""Tokenizing and packing next to the public libraries."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from quire.llm import bpe, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "'", " ", " ", "  ", "\n", "\t", "1", "½", "é", "ß", "\u00a0", "\u3000", "\x1c", "\x85", "!", "-", "<|endoftext|>", "漢", "😀", "\u0301", "S", "٣", "Ⅷ", "can't", "I'LL", "\r\n", "_", "\u200b"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    made = ["".join(rng.choices(PARTS, k=rng.randrange(30))) for _ in range(3000)]
    return made + ["", None, "   ", "'s", "x's", " 's", "\n's", "a" * 4000, "ab " * 2000, made[5], made[5], "\x00", "ſ's"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.rank_file(RANKS), special_tokens={})


def test_encode_and_decode(spark, texts, reference):
    rows = [(k, t, [0]) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded array<int>").repartition(3)
    got = bpe.decode(bpe.encode(df, RANKS), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        want = (texts[r.doc_id] or "")
        assert r.ids == reference.encode_ordinary(want)
        assert bytes(r.decoded) == want.encode()


def test_long_text_in_pieces(reference, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    text = "It's  a\n\nlong-ish text, isn't it?   Yes 123 . " * 100
    assert bpe.rank_codec(RANKS).encode(pa.array([text]))[0].tolist() == reference.encode_ordinary(text)


def test_perfect_hash_is_minimal():
    tokens = list(bpe.rank_file(RANKS))
    found = bpe.rank_codec(RANKS).hash
    assert sorted(found.place.tolist()) == list(range(len(tokens)))


def test_unknown_id_is_an_error(spark):
    df = spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="no token"):
        bpe.decode(df, RANKS).collect()


def test_tokenizer_ids(texts):
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    ids, ends = packing.tokenizer_codec(TOKENIZER).encode(pa.array(texts))
    begin = 0
    for text, end in zip(texts, ends.tolist()):
        assert ids[begin:end].tolist() == library.encode(text or "", add_special_tokens=False).ids
        begin = end


def test_marks_in_a_text_are_ids_of_their_own():
    """As the library has it, also at the ends, next to each other and in a text that is otherwise plain."""
    import pyarrow as pa
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    made = ["<|endoftext|> hi", "hi <|endoftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|>", " a\n<|endoftext|>\n b ", "<|endoftext", None, "", "zqxj <|endoftext|>zqxj"]
    ids, ends = packing.tokenizer_codec(TOKENIZER).encode(pa.array(made))
    want = [library.encode(t or "", add_special_tokens=False).ids for t in made]
    assert want[0] == [50256, 23105]
    assert [ids[a:b].tolist() for a, b in zip([0, *ends.tolist()], ends.tolist())] == want


def test_forgotten_tokens_are_asked_for_again(texts, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing.FileCodec, "REMEMBERED", 20)
    codec, whole = packing.FileCodec(TOKENIZER), packing.tokenizer_codec(TOKENIZER)
    for k in (0, 40, 80, 0, 40, 120):
        part = pa.array(texts[k : k + 40])
        assert codec.encode(part)[0].tolist() == whole.encode(part)[0].tolist()
    assert len(codec.old.keys) > 0


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(64, 3, 64), packing.Limits(64, 8, 20), packing.Limits(1, 1, 1)])
def test_packing(spark, texts, limits):
    few = texts[:150] + texts[-13:]
    df = spark.createDataFrame([(k, t, "start") for k, t in enumerate(few)], "doc_id long, text string, offset string").repartition(2)
    rows = packing.report(df, TOKENIZER, limits=limits, pool=16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    ids, ends = packing.tokenizer_codec(TOKENIZER).encode(__import__("pyarrow").array(few))
    begins = [0, *ends.tolist()]
    for k in range(len(few)):
        whole = np.array([*ids[begins[k] : begins[k + 1]], 0], "<u4")
        at = 0
        for r in sorted(pieces[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(whole[at : at + r.length].tobytes())
            at += r.length
        assert at == len(whole)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments and at <= limits.loss
    if limits == packing.Limits():
        assert len(sequences) <= sum(r.length for r in rows) // 1024 + 2


def test_prompts_bear_no_loss(spark):
    df = spark.createDataFrame([(k, "say " * 50, "answer this " * 20) for k in range(40)], "doc_id long, text string, ask string")
    limits = packing.Limits(256, 8, 60)
    rows = packing.pack(df.coalesce(1), lambda: packing.tokenizer_codec(TOKENIZER), prompt="ask", limits=limits, pool=8).collect()
    bearing = defaultdict(int)
    for r in rows:
        prompt = r.doc_tokens - 51
        bearing[r.sequence_id] += max(0, r.start + r.length - max(r.start, prompt))
    assert max(bearing.values()) <= 60


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(none, RANKS).count() == 0
    assert packing.report(none, TOKENIZER).count() == 0
