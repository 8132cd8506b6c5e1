"""Token counts against the libraries themselves, over whole random texts."""

from __future__ import annotations

import random

import public_tokenizers as P
import pyarrow as pa
import pytest

from samewise.llm import lengths

ALPHABET = list("ab C'1.,!\n\t  é́ßΣσ<|>▁ 　中文 \r😀Ġ") + ["<|endoftext|>", "<s>", "'s", "'ll", "  ", " ", "the", " the"]


def texts(n: int, longest: int = 40, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def library(name: str, of: list[str]) -> list[int]:
    if name.endswith(".model"):
        import sentencepiece

        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(of)]
    import tokenizers

    return [len(e) for e in tokenizers.Tokenizer.from_file(P.path(name)).encode_batch(of, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_lengths_are_the_librarys(name):
    of = texts(5_000) + texts(3, 40_000, 2) + ["", " ", "x" * 5_000, "a " * 9_000]
    small = lengths.Counter(P.path(name), most=500)  # a memo that is emptied again and again
    assert small.count(of) == library(name, of)


def test_long_texts_are_cut():
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        assert len(lengths.counter(P.path(name)).split("word " * 1_000 + "end")) == 1_001


def test_batches_have_about_equal_bytes():
    of = pa.array(["a" * n for n in (5, 5, 5, 30, 1, 1, 1, 1, 1)] + [None, ""])
    parts = [p.to_pylist() for p in lengths.balanced(of, 10)]
    assert sum(parts, []) == of.to_pylist()
    assert all(sum(len(t or "") for t in p[:-1]) < 10 for p in parts)
    assert [p.to_pylist() for p in lengths.balanced(pa.array([], pa.string()), 10)] == []


def test_count_of_a_table(spark):
    path = P.path("byte_bpe_50k.json")
    rows = [(1, "a b c"), (1, "a b c"), (None, "x"), (2, None), (3, ""), (4, "word " * 600), (5, "<|endoftext|>é")]
    df = spark.createDataFrame([(i, t, 9, 9, "z") for i, t in rows], "doc_id long, text string, n_tokens int, N_BYTES int, over_limit string")
    got = lengths.count(df, path)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = [(i, len((t or "").encode()), n, n > 512) for (i, t), n in zip(rows, library("byte_bpe_50k.json", [t or "" for _, t in rows]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert lengths.count(df.where("false"), path).count() == 0


def test_query_over_a_whole_table(spark):
    from samewise.llm.queries import op13_tokens

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), library("byte_bpe_50k.json", [r.text or "" for r in docs])))
    got = op13_tokens(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in got} == want and len(got) == len(docs)
