"""Token counts through the digest cache, against the tokenizer libraries."""

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from hydrostrata.llm import token_counts
from hydrostrata.llm.common import scratch
from hydrostrata.llm.even_join import even_join

from .helpers import frame, odd_rows

WORDS, PIECES = P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")

#: Pairs that one content key must not join unless their counts are equal.
TRICKY = ["H̱a", "ẖa", "J̌", "ǰ", "ΑΣ ΟΔΟΣ", "ας οδος", "a <|endoftext|> b", "a <|ENDOFTEXT|> b", "A <|endoftext|> b", "quoted <|endoftext|>", "<|endoftext|>", "x<|startoftext|><|endoftext|>y  z", "İstanbul", "istanbul", "It's  WE'LL\tgo", "it's we'll go",
          "a\u0085b", "a b", "a b", "a\x1cb", " ́x", "ｆｕｌｌ", "ẛ̣", "x" * 5000, "😀" * 300, "１２３ 123", "﻿bom", "a b", "'S 'S's", "tab\x0bvt\x0cff"]


def library(path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda x: len(m.encode(x))


def wanted(rows, path, limit=2048):
    count = library(path)
    out = [(i, len((t or "").encode()), n := count(t or ""), n > limit) for i, t in rows]
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()), key=str)


@pytest.mark.parametrize("path", [WORDS, PIECES])
def test_counts(spark, sf_dir, path):
    docs = token_counts.documents(spark, sf_dir)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(token_counts.count_tokens(docs, path, scratch(spark, "c"))) == wanted(rows, path)
    rows = odd_rows() + list(enumerate(TRICKY, 100))
    assert found(token_counts.count_tokens(frame(spark, rows), path, scratch(spark, "c"), 50)) == wanted(rows, path, 50)


def test_keys_join_only_equal_counts(spark):
    count = library(WORDS)
    docs = frame(spark, odd_rows() + list(enumerate(TRICKY, 100))).where("text is not null")
    by_key = {}
    for r in docs.select("text", token_counts.content_key(F.col("text"), WORDS).alias("key")).collect():
        by_key.setdefault(bytes(r["key"]), []).append(r["text"])
    assert all(len({count(t) for t in texts}) == 1 for texts in by_key.values())
    assert any({"It's  WE'LL\tgo", "it's we'll go"} <= set(texts) for texts in by_key.values())
    raw = docs.select(token_counts.content_key(F.col("text"), PIECES).alias("key"), "text").distinct()
    assert raw.count() == raw.select("key").distinct().count()


def test_only_missing_texts_are_encoded(spark, monkeypatch):
    cache, calls, encoded = scratch(spark, "c"), [], token_counts.encoded_counts

    def logged(misses, path, *more):
        calls.append(sorted(bytes(r["key"]) for r in misses.select("key").collect()))
        return encoded(misses, path, *more)

    monkeypatch.setattr(token_counts, "encoded_counts", logged)
    rows = [(1, "One text"), (2, "one  text"), (3, "another"), (4, None), (5, "")]
    first = found(token_counts.count_tokens(frame(spark, rows), WORDS, cache))
    assert len(calls) == 1 and len(set(calls[0])) == 3
    assert found(token_counts.count_tokens(frame(spark, rows), WORDS, cache)) == first and len(calls) == 1
    again = rows + [(6, "a third one"), (7, "A THIRD ONE"), (8, "another")]
    assert found(token_counts.count_tokens(frame(spark, again), WORDS, cache)) == wanted(again, WORDS)
    assert len(calls) == 2 and len(set(calls[1])) == 1
    assert found(token_counts.count_tokens(frame(spark, rows), PIECES, cache)) == wanted(rows, PIECES)
    assert len(calls) == 3 and len(set(calls[2])) > 3  # another tokenizer has counts and keys of its own
    stored = token_counts.cached_counts(spark, cache, token_counts.tokenizer_version(WORDS))
    assert stored.count() == 4
    # what is stored is taken, and a key that was stored twice is one row
    planted = scratch(spark, "c")
    fake = frame(spark, [(1, "x y z")]).select(token_counts.content_key(F.col("text"), WORDS).alias("key"), F.lit(77).cast("long").alias("n_tokens"))
    for batch in "ab":
        fake.write.parquet(f"{planted}/tokenizer={token_counts.tokenizer_version(WORDS)}/batch={batch}")
    assert found(token_counts.count_tokens(frame(spark, [(1, "X Y  z"), (2, "x")]), WORDS, planted)) == [(1, 6, 77, False), (2, 1, 1, False)]


def test_each_miss_is_encoded_once_and_in_blocks(spark):
    rows = [(i, f"text {i % 40} of many " * 200) for i in range(400)]
    docs = frame(spark, rows).repartition(8)
    keyed = docs.select("text", token_counts.content_key(F.col("text"), WORDS).alias("key"))
    misses = token_counts.distinct_texts(keyed, 2000).repartition(3, "key").sortWithinPartitions("key")
    assert misses.count() > 40
    got = token_counts.encoded_counts(misses, WORDS, 10_000).collect()
    assert len(got) == len({bytes(r["key"]) for r in got}) == 40


def test_empty_table_and_hot_key(spark):
    cache = scratch(spark, "c")
    assert token_counts.count_tokens(frame(spark, []), WORDS, cache).count() == 0
    assert token_counts.cached_counts(spark, cache, token_counts.tokenizer_version(WORDS)).count() == 0
    rows = [(i, "hot text" if i % 3 else f"t {i}") for i in range(600)]
    assert found(token_counts.count_tokens(frame(spark, rows), WORDS, cache)) == wanted(rows, WORDS)
    many = spark.createDataFrame([(i, None if i % 2 else i) for i in range(400)], "id long, k long")
    facts = many.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, even_join(many, facts, "k", "n").select("id", "s").collect())) == [(i, 40000 if i % 2 else i) for i in range(400)]
