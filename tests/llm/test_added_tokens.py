"""Added tokens in texts: the registered packings against a tokenizer left at its defaults."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from docweir.llm import queries
from docweir.llm.tokens import vocabulary, word_ids

TEXTS = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n", "<|endoftext", "plain words", None, "word <|endoftext|> " * 3000]


@pytest.fixture(scope="module")
def default():
    tokenizer = Tokenizer.from_file(vocabulary())
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("added"))
    rows = [(i, t, "en", "a", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return folder


def wanted(default):
    pieces = [(i, at, np.array(ids[at : at + 2048], dtype="<u4"), len(ids)) for i, t in enumerate(TEXTS) for ids in [default(t)] for at in range(0, len(ids), 2048)]
    return Counter((i, at, len(part), zlib.crc32(part), n) for i, at, part, n in pieces)


def test_ids_equal_a_default_tokenizer(default):
    assert default("one <|endoftext|> two")[:-1] == [505, 220, 50256, 734]
    draw = random.Random(6)
    parts = ["a", " ", "  ", "\n", "\t", ".", "é", " word", "<|endoftext|>", "<|endoftext", "|>", "\x00", "don't"]
    for _ in range(2000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 10)))
        assert word_ids(vocabulary(), True).ids(text).tolist() == default(text), repr(text)


def test_op3_and_pipeline_packing(spark, table, default):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for packed in (lambda: queries.op3_tournament_packing(spark, table), lambda: corpus_pipeline.packing(spark, docs, table)):
        assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed().collect()) == wanted(default)


def test_op7_matrices(spark, table, default):
    got = Counter()
    for r in queries.op7_bestfit_matrices(spark, table).collect():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        for d, s, n, at in zip(r.doc_ids, r.starts, r.lengths, r.cu_seqlens, strict=False):
            got[d, s, n, zlib.crc32(ids[at : at + n])] += 1
    assert got == Counter({k[:4]: n for k, n in wanted(default).items()})
