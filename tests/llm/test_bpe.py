import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cinderlog.llm import bpe, token_counts
from cinderlog.llm.token_counts import with_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = "abcé'sd  \n\t\x0b\x1c\x1f\x85\xa0 ​१²Ⅷ漢字🎉_-ǅͅ"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_tables(PATH))


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*out, "", "a<|endoftext|> b <|endoftext|>", "x" * 5000, "ab" * 3000, " " * 999, "the cat " * 200_000]


def test_ids_and_round_trip_match_the_library(library, encoder):
    xs = texts()
    for x, ids, want in zip(xs, encoder.encode(xs), library.encode_batch(xs, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert bpe.decode(encoder.tables, ids) == library.decode(want.ids, skip_special_tokens=False)


def test_a_pair_with_a_merged_symbol_ranks_after_the_merge_that_makes_it(encoder):
    """Then merging a word's lowest pair everywhere at once gives the same as one pair at a time."""
    t = encoder.tables
    made = dict(zip(t.merged.tolist(), t.rank.tolist(), strict=True))
    for key, rank in zip(t.keys.tolist(), t.rank.tolist(), strict=True):
        assert max(made.get(key >> 32, -1), made.get(key & 0xFFFFFFFF, -1)) < rank


def test_columns_nulls_and_clashing_names(spark, library):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (None, "Hello  wörld<|endoftext|>", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    b = bpe.Bpe(spark, PATH)
    out = df.withColumn("token_ids", b.encode("text")).withColumn("back", b.decode("token_ids"))
    got = out.select("doc_id", "text", "ids", "back", bpe.n_ids("token_ids").alias("n")).collect()
    assert sorted((r.doc_id or 0, r.back, r.n) for r in got) == sorted((i or 0, t or "", len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    both = b.round_trip(df.drop("ids"), ["doc_id", "text"]).collect()
    assert sorted(bytes(r.ids) for r in both) == sorted(bytes(r.token_ids) for r in out.select("token_ids").collect())
    assert all(r.decoded == (r.text or "") for r in both)
    assert df.limit(0).select(b.encode("text")).collect() == []


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.load_tables(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_match_the_library(spark, name):
    path = public_tokenizers.path(name)
    xs = texts()
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(xs, add_special_tokens=False)]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(xs)]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate(xs)] + [(len(xs), None, None)], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: (r.n_tokens, r.over_limit) for r in with_token_counts(df, path, limit=20).select("doc_id", "n_tokens", "over_limit").collect()}
    assert got == {i: (n, n > 20) for i, n in enumerate([*want, 0])}
    assert with_token_counts(df.where(F.lit(False)), path).count() == 0


def test_long_texts_are_counted_in_pieces(spark, library):
    """Of several pieces, with special strings across them, and without a place to cut."""
    xs = ["word another  " * 300_000, "x" * 200_000, ("wörld " * 50_000 + "<|endoftext|>") * 3, "\n" * 300_000]
    df = spark.createDataFrame(list(enumerate(xs)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in with_token_counts(df, PATH).collect()}
    assert got == {i: len(library.encode(x, add_special_tokens=False).ids) for i, x in enumerate(xs)}


def test_frequent_words_come_from_all_documents(spark):
    """Not from the first ones: a word of the last documents only is in the table, and the table is bounded."""
    n = 6000
    df = spark.range(n, numPartitions=6).select(F.when(F.col("id") >= n - n // 6, F.concat(F.lit("omega "), F.col("id").cast("string"))).otherwise(F.concat(F.lit("alpha "), F.col("id").cast("string"))).alias("text"))
    words = token_counts.frequent_words(df, bpe.load_tables(PATH), least=1000)
    assert {"omega", "alpha"} <= set(words) and words[0] != "omega" and len(words) < n
    assert token_counts.frequent_words(df.limit(0), bpe.load_tables(PATH)) == []


def test_frequent_words_are_counted_over_every_document(spark, encoder, monkeypatch):
    """Words that two documents of 20,000 share are in the table, by their whole counts, however small a task's table is."""
    xs = [f"alpha w{k % 10_000:05d}x beta{'!' * (k % 7)}<|endoftext|>{'y' * 40}" for k in range(20_000)] + ["omega " * 200_000, None]
    df = spark.createDataFrame([(x,) for x in xs], "text string").repartition(3)
    want = Counter(w for x in xs if x for part in x.split("<|endoftext|>") for words, _ in encoder.words(part) for w in words if len(w) <= token_counts.LONGEST)
    want = [w for n, w in sorted((-n, w) for w, n in want.items() if n > 1)]
    assert len(want) < token_counts.TIER_WORDS and token_counts.frequent_words(df, encoder.tables) == want
    monkeypatch.setattr(token_counts, "TASK_WORDS", 5)
    monkeypatch.setattr(token_counts, "PIECE", 1000)
    assert token_counts.frequent_words(df, encoder.tables) == want
