"""Byte-level BPE: encoding and decoding of whole texts in batched numpy merge rounds.

The merge rounds take many words at once. All their symbols stand in one flat array; in each round the rank of every
adjacent pair is found by binary search over the sorted pair keys, each word's lowest rank is taken with one segmented
minimum, and all occurrences of that pair are merged from left to right. Words without a mergeable pair leave the array.

Edge cases: null text counts as the empty text (no ids); null ids decode to the empty text; very long texts are cut into
pieces only where the pre-tokenizer cuts anyway, so memory for words stays bounded and ids are those of the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinderlog.runtime import on_workers

#: The byte-level pre-tokenizer's pattern, as in the public vocabulary's description, with the places of
#: its three character classes (letters stand first: no other alternative starts as theirs does), and Unicode's spaces.
PATTERN = " ?[{L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters of text for which words are held at a time, and words that a worker remembers.
PIECE, REMEMBERED, LONGEST_REMEMBERED = 1 << 20, 150_000, 64
#: Texts whose ids are held at a time on their way out.
STEP = 128
NO_RANK = np.int32(2**31 - 1)


@dataclass
class BpeTables:
    """A vocabulary as arrays: its size is that of the vocabulary file, a few MB, whatever the corpus."""

    name: str
    byte_id: np.ndarray  # symbol of each byte
    keys: np.ndarray  # sorted; left symbol << 32 | right symbol
    rank: np.ndarray  # of each key
    merged: np.ndarray  # symbol that each key's pair becomes
    tokens: list[bytes]
    special: dict[str, int]
    patterns: tuple[str, str]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the others from 256 upwards in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def word_patterns() -> tuple[str, str]:
    """PATTERN for the re module, whose explicit classes match several times as fast as properties do: for texts of
    characters up to U+FFFF, where it is fastest, and for all."""
    import regex

    def runs(kind: str, every: str) -> str:
        return "".join(f"\\U{ord(r[0]):08x}-\\U{ord(r[-1]):08x}" for x in regex.findall(f"\\p{{{kind}}}+", every) for r in split_runs(x))

    low, high = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])), "".join(map(chr, range(0x10000, 0x110000)))
    return tuple(PATTERN.format(L=runs("L", x), N=runs("N", x), S=SPACE) for x in (low, low + high))


def split_runs(x: str) -> list[str]:
    """A run across the surrogates' gap is two."""
    k = sum(c < "\ud800" for c in x)
    return [p for p in (x[:k], x[k:]) if p]


def load_tables(path: str) -> BpeTables:
    """Read a byte-level BPE of the tokenizers library's JSON form; ValueError for any other kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    kind = (model.get("type"), pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex"), spec.get("normalizer"))
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
    plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if kind != ("BPE", "ByteLevel", False, True, None) or odd or not plain:
        raise ValueError(f"{path}: not a plain byte-level BPE")
    vocab, letters = model["vocab"], byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    tokens = [b""] * (max([*vocab.values(), *special.values()]) + 1)
    for token, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in token)
    for token, i in special.items():
        tokens[i] = token.encode()
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
    order = np.argsort(keys, kind="stable")
    merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
    byte_id = np.zeros(256, np.int32)
    for c, b in letters.items():
        byte_id[b] = vocab[c]
    return BpeTables(path, byte_id, keys[order], order.astype(np.int32), merged[order], tokens, special, word_patterns())


def merge_rounds(t: BpeTables, words: list[bytes]) -> list[bytes]:
    """The ids of each word as little-endian unsigned 32-bit integers. Words hold at least one byte."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    syms = t.byte_id[np.frombuffer(b"".join(words), np.uint8)]
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    rank, at = np.full(len(syms), NO_RANK), np.zeros(len(syms), np.int32)
    stale = np.arange(len(syms))  # pairs, by their left symbol's place, whose rank has to be looked up
    done_syms, done_word = [], []
    while len(syms):
        rank[stale] = NO_RANK
        stale = stale[stale < len(syms) - 1]
        stale = stale[word[stale] == word[stale + 1]]
        key = syms[stale].astype(np.int64) << 32 | syms[stale + 1]
        place = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
        found = t.keys[place] == key
        stale, place = stale[found], place[found]
        rank[stale], at[stale] = t.rank[place], place
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(starts, append=len(syms)))
        keep = low != NO_RANK
        done_syms.append(syms[~keep])
        done_word.append(word[~keep])
        hit = np.flatnonzero((rank == low) & keep)
        # In a run of overlapping hits (aaaa), every other one merges, counted from the left.
        first = np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) != 1, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - first) % 2 == 0]
        syms[hit] = t.merged[at[hit]]
        keep[hit + 1] = False
        stale = (np.cumsum(keep) - 1)[hit]
        stale = np.concatenate((stale, stale[stale > 0] - 1))
        syms, word, rank, at = syms[keep], word[keep], rank[keep], at[keep]
    word = np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    flat = np.concatenate(done_syms)[order].astype("<u4").tobytes()
    ends = (np.cumsum(np.bincount(word, minlength=len(words))) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Encodes texts with a bounded memory of words already merged."""

    def __init__(self, tables: BpeTables):
        self.tables, self.known, self.older, self.long = tables, {}, {}, []
        self.low, self.all = (re.compile(p).findall for p in tables.patterns)
        self.high = re.compile("[\U00010000-\U0010ffff]").search
        self.cut = re.compile(r"[A-Za-z](?= [A-Za-z])")
        names = sorted(tables.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def pieces(self, text: str) -> Iterator[str]:
        """Cut between a letter and a space with a letter: there the pre-tokenizer always starts a new word."""
        start = 0
        while len(text) - start > PIECE:
            m = self.cut.search(text, start + PIECE)
            if m is None:
                break
            yield text[start : m.end()]
            start = m.end()
        yield text[start:]

    def find(self, text: str) -> list[str]:
        return self.all(text) if self.high(text) else self.low(text)

    def words(self, text: str) -> Iterator[tuple[list[str], int]]:
        """The text's words, a piece at a time, and the piece's length."""
        for piece in self.pieces(text):
            yield self.find(piece), len(piece)

    def learn(self, words: set[str]) -> None:
        """Know all of words: from memory, else merged in one batch."""
        older = self.older
        new = [w for w in words if w not in self.known]
        self.known.update((w, older[w]) for w in new if w in older)
        if new := [w for w in new if w not in older]:
            self.known.update(zip(new, merge_rounds(self.tables, [w.encode() for w in new]), strict=True))
            self.long += [w for w in new if len(w) > LONGEST_REMEMBERED]

    def trim(self) -> None:
        """Forget long words, and those not met while REMEMBERED others came."""
        for w in self.long:
            self.known.pop(w, None)
        self.long.clear()
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known

    def _flush(self, held: list, out: list[list[bytes]]) -> None:
        every = set().union(*(w for _, w in held))
        self.learn(every)
        ids = self.known.__getitem__
        for k, words in held:
            out[k].append(b"".join(map(ids, words)))
        held.clear()
        self.trim()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        held, size = [], 0
        for k, text in enumerate(texts):
            for part in self.special.split(text) if text and self.special else [text] if text else []:
                if part in self.tables.special:
                    held.append((k, ()))
                    self._flush(held, out)
                    size = 0
                    out[k].append(np.array([self.tables.special[part]], "<u4").tobytes())
                elif part:
                    for words, n in self.words(part):
                        held.append((k, words))
                        size += n
                        if size >= PIECE:
                            self._flush(held, out)
                            size = 0
        if held:
            self._flush(held, out)
        return [b"".join(x) for x in out]


def decode(tables: BpeTables, ids: bytes | None) -> str:
    """The text of ids; bytes that aren't UTF-8 become U+FFFD. IndexError for an id outside the vocabulary."""
    return b"".join(map(tables.tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist())).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(tables: BpeTables) -> Encoder:
    """This worker's encoder; it lives on from task to task."""
    if tables.name not in _encoders:
        _encoders[tables.name] = Encoder(tables)
    return _encoders[tables.name]


class Bpe:
    """Encoding and decoding as column expressions.

    path: the vocabulary file, read on the driver and broadcast (its size is fixed by the vocabulary).
    """

    def __init__(self, spark: SparkSession, path: str):
        on_workers(spark)
        self.tables = spark.sparkContext.broadcast(load_tables(path))
        shared = self.tables

        def encode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            e = encoder(shared.value)
            for x in batches:
                yield pa.array(e.encode(x.to_pylist()), pa.binary())

        def decode_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            t = shared.value
            for x in batches:
                yield pa.array([decode(t, i) for i in x.to_pylist()], pa.string())

        def round_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            e = encoder(shared.value)
            for x in batches:
                for at in range(0, len(x), STEP):
                    part = x.slice(at, STEP)
                    ids = e.encode(part.column(part.num_columns - 1).to_pylist())
                    back = [decode(e.tables, i) for i in ids]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array(back, pa.string())], [*part.schema.names[:-1], "ids", "decoded"])

        self._round_trips = round_trips
        self._encode = F.arrow_udf("binary")(encode_batches)
        self._decode = F.arrow_udf("string")(decode_batches)

    def encode(self, text: Column | str) -> Column:
        """Binary: the token ids of a text as little-endian unsigned 32-bit integers; empty for null."""
        return self._encode(text)

    def decode(self, ids: Column | str) -> Column:
        """String: the text of such ids; empty for null."""
        return self._decode(ids)


    def round_trip(self, df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """keep (neither `ids` nor `decoded`), ids and decoded: the ids of each text and the text decoded from them, in one pass of one worker."""
        schema = T.StructType([*df.select(*keep).schema, T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
        return df.select(*keep, F.col(text).alias("_text")).mapInArrow(self._round_trips, schema)


def n_ids(ids: Column | str) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
