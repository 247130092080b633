"""Token counts of whole texts, without moving a pre-token between machines.

Tier 1 is a broadcast table of frequent pre-tokens and their token counts. It holds at most TIER_WORDS entries of at most
32 characters, so its size is bounded whatever the corpus. Tier 2 is each worker's own bounded cache: pre-tokens that the
table lacks are encoded once per worker, in batches. Counting a text is one lookup per pre-token.

Tier 1 comes from the counts of all pre-tokens of all documents. Each task adds up its documents' words in a table of bounded
size, which it hands on whole whenever it is full, so that the sums are exact. Words that occur once have no place in it:
looking them up would save nothing. Which words tier 1 holds changes the speed only, never a count of tokens: words that it
lacks are encoded all the same.

Edge cases: null text counts as the empty text (0 tokens); strings of special tokens inside a text count as the one token
they are; very long texts are counted in pieces cut where pre-tokens end; an empty table gives an empty table; repeated rows
count each. Other columns stay, equal names are replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.bounded import frequent
from cinderlog.llm.bpe import PIECE, Encoder, encoder, load_tables, merge_rounds
from cinderlog.runtime import on_workers

#: Of tier 1: most words, least occurrences and most characters of a word; and words that a task holds before it hands them on.
TIER_WORDS, LEAST, LONGEST, TASK_WORDS = 65_536, 2, 32, 262_144
CACHE_WORDS = 400_000


class Counts(dict):
    """Pre-token -> tokens. A word that is missing is noted, to be counted with the others of its batch."""

    def __init__(self, frequent: dict[str, int], encoder: Encoder):
        super().__init__(frequent)
        self.frequent, self.older, self.long, self.encoder = frequent, {}, [], encoder

    def learn(self, words: set[str]) -> None:
        older = self.older
        new = [w for w in words if w not in self]
        self.update((w, older[w]) for w in new if w in older)
        if new := [w for w in new if w not in older]:
            self.long += [w for w in new if len(w) > 64]
            self.update(zip(new, (len(x) // 4 for x in merge_rounds(self.encoder.tables, [w.encode() for w in new])), strict=True))

    def _flush(self, held: list, out: list[int]) -> None:
        self.learn(set().union(*(w for _, w in held)))
        for k, words in held:
            out[k] += sum(map(self.__getitem__, words))
        held.clear()
        for w in self.long:
            self.pop(w, None)
        self.long.clear()
        if len(self) > len(self.frequent) + CACHE_WORDS:
            self.older = dict(self)
            self.clear()
            self.update(self.frequent)

    def count(self, texts: list[str | None]) -> list[int]:
        out, held, size, special = [0] * len(texts), [], 0, self.encoder.tables.special
        for k, text in enumerate(texts):
            for part in self.encoder.special.split(text) if text and self.encoder.special else [text] if text else []:
                if part in special:
                    out[k] += 1
                elif part:
                    for words, n in self.encoder.words(part):
                        held.append((k, words))
                        size += n
                        if size >= PIECE:
                            self._flush(held, out)
                            size = 0
        if held:
            self._flush(held, out)
        return out


_counts: dict[tuple, Counts] = {}


def frequent_words(df: DataFrame, tables, text: str = "text", least: int = LEAST) -> list[str]:
    """The most frequent pre-tokens of all documents, of those that occur `least` times."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size, e = Counter(), [], 0, encoder(shared.value)

        def add() -> None:
            for w, n in Counter(held).items():
                if len(w) <= LONGEST:
                    seen[w] += n
            held.clear()

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["w", "n"])

        for x in batches:
            for t in x.column(0).to_pylist():
                for part in e.special.split(t) if e.special else [t]:
                    for words, n in e.words(part) if part not in e.tables.special else ():
                        held += words
                        size += n
                        if size >= PIECE:
                            add()
                            size = 0
                            if len(seen) >= TASK_WORDS:
                                yield table()
                                seen.clear()
        add()
        yield table()

    total = df.where(F.col(text).isNotNull()).select(text).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return [r.w for r in sorted(frequent(total.where(F.col("n") >= least), "n", TIER_WORDS, "words"), key=lambda r: (-r.n, r.w))]


def byte_bpe_counter(spark: SparkSession, path: str, df: DataFrame, text: str = "text"):
    """A column function: the number of tokens of a text under the byte-level BPE at path.

    df, text: the documents whose frequent words tier 1 holds.
    """
    on_workers(spark)
    tables = load_tables(path)
    e = Encoder(tables)
    words = frequent_words(df, tables, text)
    for at in range(0, len(words), 8192):
        e.learn(set(words[at : at + 8192]))
    tier = spark.sparkContext.broadcast((tables, {w: len(e.known[w]) // 4 for w in words}))

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (tier.value[0].name, id(tier.value))
        if key not in _counts:
            _counts.clear()
            _counts[key] = Counts(tier.value[1], Encoder(tier.value[0]))
        for x in it:
            yield pa.array(_counts[key].count(x.to_pylist()), pa.int64())

    return F.arrow_udf("long")(batches)


def library_counter(spark: SparkSession, path: str):
    """The same for any other vocabulary file (.json: tokenizers, .model: sentencepiece), by the library itself."""
    on_workers(spark)
    with open(path, "rb") as f:
        blob = spark.sparkContext.broadcast(f.read())
    json = path.endswith(".json")

    def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if json:
            from tokenizers import Tokenizer

            t = Tokenizer.from_buffer(blob.value)
            t.no_truncation()
            t.no_padding()
            count = lambda xs: [len(e.ids) for e in t.encode_batch(xs, add_special_tokens=False)]
        else:
            import sentencepiece

            t = sentencepiece.SentencePieceProcessor(model_proto=blob.value)
            count = lambda xs: [len(x) for x in t.encode(xs, num_threads=1)]
        for x in it:
            texts = [s or "" for s in x.to_pylist()]
            yield pa.array([n for i in range(0, len(texts), 64) for n in count(texts[i : i + 64])], pa.int64())

    return F.arrow_udf("long")(batches)


def with_token_counts(df: DataFrame, path: str, text: str = "text", limit: int = 512, n_tokens: str = "n_tokens", over_limit: str = "over_limit") -> DataFrame:
    """Add the number of tokens of each text and whether it exceeds limit."""
    spark = df.sparkSession
    try:
        counter = byte_bpe_counter(spark, path, df, text)
    except (ValueError, UnicodeDecodeError):
        counter = library_counter(spark, path)
    out = df.withColumn(n_tokens, counter(F.col(text)))
    return out.withColumn(over_limit, F.col(n_tokens) > limit)


def n_bytes(text: Column | str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
