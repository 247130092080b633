"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A shingle is five words in a row (all words of a text with fewer). Its hash is cut to 32 bits; a text's sketch is the k
smallest distinct hashes, in order. Sketches of parts merge into the sketch of the whole, and two sketches estimate the
texts' resemblance and containment; a sketch alone estimates the number of distinct shingles. Up to k shingles all of
these are exact.

Edge cases: null text counts as the empty text, whose sketch is empty; two empty sketches have likeness 1, an empty and
another one 0. Words are runs of characters other than space and \\t to \\r, as they stand.
Keys are whole numbers, ValueError for others; other columns aren't read; very long texts are sketched whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cinderlog.llm.names import need_whole
from cinderlog.runtime import durable

K, WORDS = 128, 5
LOWEST = -(2**63)


def let(x: Column, body: Callable[[Column], Column]) -> Column:
    """body of x, with x computed once however often body names it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """array<int>: the text's sketch."""

    def shingles(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: cut(F.xxhash64(*(F.get(w, i + j) for j in range(n)))))
        return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(cut(F.xxhash64(w)))).otherwise(F.array().cast("array<int>"))

    cut = lambda h: F.shiftright(h, 32).cast("int")
    hashes = let(F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w)), shingles)
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def likeness(a: Column, b: Column, k: int = K) -> Column:
    """Estimated resemblance (Jaccard likeness of the shingle sets), 0 to 1."""
    shared = lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(shared(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: the sketch's size below k, else from how small its largest hash is."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * 2.0**32 / (F.get(a, F.lit(k - 1)).cast("double") + 2.0**31 + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 if a has none."""
    j, na, nb = likeness(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j * (na + nb) / (1 + j) / na))


def fingerprint(a: Column) -> Column:
    """A sketch as a string: eight hex digits for each hash, in order."""
    return F.array_join(F.transform(a, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """Each text beside its edited text, whose last third is the start of the next document in descending order of key.

    (key, n_chars, edited, sketch, edited_sketch, near_edited, near_next); null keys come last, rows of one key in the
    order of a hash of their texts, and rows equal in both count as one document, each with the same result.

    Who is next is found on a narrow table, cut into ranges of the key: a window within each range, and one row a range to
    link them up. Then each text is moved once by its own key and its needed start once to the document before.
    """
    need_whole(docs, key)
    body = F.coalesce(F.col(text), F.lit(""))
    # ik, th: a key of the document without nulls. The last bit of th tells a null key from the lowest number.
    ik = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST))
    th = F.xxhash64(body).bitwiseAND(F.lit(-2)).bitwiseOR(F.col(key).isNull().cast("long"))
    order = ["o", "th"]
    narrow = docs.select(ik.alias("ik"), th.alias("th"), F.length(body).alias("n")).groupBy("ik", "th").agg(F.max("n").alias("n"))
    narrow = narrow.select(F.bitwise_not("ik").alias("o"), "th", "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    narrow = durable(narrow, "next")
    row = F.struct("o", "th", "n")
    ends = narrow.groupBy("part").agg(F.max(row).alias("last"))
    ends = ends.select(F.col("part").alias("p"), F.coalesce(F.lag("last").over(Window.orderBy("part")), F.max("last").over(Window.partitionBy())).alias("end"))
    prior = F.lag(row).over(Window.partitionBy("part").orderBy(*order))
    # One row a partition: as many as there are tasks.
    nav = narrow.select("*", prior.alias("prior")).join(F.broadcast(ends), F.col("part") == F.col("p"))
    nav = nav.withColumn("prior", F.coalesce("prior", "end"))
    nav = nav.select(F.bitwise_not("o").alias("nav_ik"), F.col("th").alias("nav_th"), F.bitwise_not("prior.o").alias("prior_ik"), F.col("prior.th").alias("prior_th"), F.floor(F.col("prior.n") / 3).cast("int").alias("need"))

    full = docs.select(ik.alias("ik"), th.alias("th"), body.alias("body"), sketch(body, k).alias("sk"))
    head = full.join(nav, (F.col("ik") == F.col("nav_ik")) & (F.col("th") == F.col("nav_th")))
    head = head.groupBy("ik", "th").agg(*(F.first(c).alias(c) for c in ("body", "sk", "prior_ik", "prior_th", "need")))
    head = head.select("prior_ik", "prior_th", F.expr("substring(body, 1, need)").alias("head"), F.col("sk").alias("next_sk"))

    both = full.join(head, (F.col("ik") == F.col("prior_ik")) & (F.col("th") == F.col("prior_th")))
    n = F.length("body")
    both = both.withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), n - F.floor(n / 3).cast("int")), "head")).withColumn("edited_sk", sketch(F.col("edited"), k))
    return both.select(
        F.when(F.col("th").bitwiseAND(F.lit(1)) == 0, F.col("ik")).alias(key),
        n.cast("long").alias("n_chars"),
        "edited",
        F.col("sk").alias("sketch"),
        F.col("edited_sk").alias("edited_sketch"),
        likeness(F.col("sk"), F.col("edited_sk"), k).alias("near_edited"),
        likeness(F.col("sk"), F.col("next_sk"), k).alias("near_next"),
    )
