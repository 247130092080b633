"""Template mining by asking a language model, or any function from a prompt to an answer.

Lines that known templates fit need no question: they are matched in Spark. Of the others one line of each key (see
mining.cache_key) is clustered, a chunk at a time; the driver asks once for each cluster, showing it a few lines that differ
the most, and holds nothing but these samples, the templates and the variables met so far. Lines of a cluster that the answer
doesn't fit are asked about in the next round. What remains after the last round, or beyond `most_asked` questions, gets its
template by the rules; the metrics say how many keys did.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.text import squeeze
from cinderlog.operators.clustering import CHUNK, cluster_lines, sample_texts
from cinderlog.operators.mining import WILD, answer_template, cache_key, coarse_groups, generalise, is_template, numbered
from cinderlog.operators.order import with_ordinal
from cinderlog.operators.templates import Templates, match
from cinderlog.runtime import durable

Ask = Callable[[list[str], list[str]], str]
#: How alike, word by word, two templates are that become one; and by how many words a line may differ from a template's own.
ALIKE, WORDS_OFF = 0.8, 1


@dataclass
class Metrics:
    """What a run took: seconds in all and asking, questions and their characters, keys in all, keys that a known template fit,
    keys left to the rules, lines and templates."""

    seconds: float = 0.0
    asking_seconds: float = 0.0
    questions: int = 0
    characters: int = 0
    keys: int = 0
    hits: int = 0
    by_rules: int = 0
    lines: int = 0
    templates: int = 0

    def describe(self) -> dict[str, float | int]:
        return asdict(self)


class Node:
    """Of the tree of templates: what may come next, a word or a wildcard, and the templates that end here."""

    __slots__ = ("ends", "next")

    def __init__(self) -> None:
        self.next: dict[str, Node] = {}
        self.ends: list[int] = []


@dataclass
class TemplateCache:
    """Known templates, with a line that each was made from. `match` finds the one that fits a line by walking the tree of
    their words with all partial matches at once, so the time is bounded by words times nodes, whatever the wildcards."""

    templates: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    root: Node = field(default_factory=Node)

    @staticmethod
    def words(text: str) -> list[str]:
        """Words and marks; a word that holds a wildcard is one, and wildcards side by side are one."""
        out: list[str] = []
        for w in re.findall(r"[^\s\w<*>]|[\w<*>]+", text):
            w = WILD if WILD in w else w
            if w != WILD or out[-1:] != [WILD]:
                out.append(w)
        return out

    def add(self, template: str, line: str = "") -> int:
        """The template's number. One that is alike a known one of as many words is merged with it: words that differ become
        wildcards. -1 for a template that says nothing."""
        words = template.split()
        if not self.words(template) or set(self.words(template)) == {WILD}:
            return -1
        if template in self.templates:
            return self.templates.index(template)
        for k, known in enumerate(self.templates):
            own = known.split()
            if len(own) == len(words) and SequenceMatcher(None, own, words, autojunk=False).ratio() > ALIKE:
                merged = " ".join(a if a == b else WILD for a, b in zip(own, words, strict=True))
                self.remove(k)
                self.templates[k], self.lines[k] = merged, line or self.lines[k]
                self._insert(k)
                return k
        self.templates.append(template)
        self.lines.append(line)
        self._insert(len(self.templates) - 1)
        return len(self.templates) - 1

    def _insert(self, k: int) -> None:
        node = self.root
        for w in self.words(self.templates[k]):
            node = node.next.setdefault(w, Node())
        node.ends.append(k)

    def remove(self, k: int) -> None:
        """Take a template out of the tree; its number stays."""
        node = self.root
        for w in self.words(self.templates[k]):
            node = node.next[w]
        node.ends.remove(k)

    def match(self, line: str) -> int | None:
        """The template that fits the line: of several the one with the most words, then the fewest wildcards. Its own line
        must have as many words, give or take one."""
        here: list[tuple[Node, bool]] = [(self.root, False)]  # a node, and whether a wildcard is open there
        for w in self.words(line):
            then = {}
            for node, open_ in here:
                if open_:
                    then[id(node), True] = (node, True)
                if w in node.next:
                    then[id(node.next[w]), False] = (node.next[w], False)
                if WILD in node.next:
                    then[id(node.next[WILD]), True] = (node.next[WILD], True)
                    if w in node.next[WILD].next:  # an empty wildcard
                        after = node.next[WILD].next[w]
                        then[id(after), False] = (after, False)
            here = list(then.values())
        found = {k for node, _ in here for k in [*node.ends, *(node.next[WILD].ends if WILD in node.next else ())]}
        n = len(line.split())
        fits = [k for k in found if not self.lines[k] or abs(len(self.lines[k].split()) - n) <= WORDS_OFF]
        said = lambda k: [w == WILD for w in self.words(self.templates[k])]
        return min(fits, key=lambda k: (said(k).count(True) - len(said(k)), said(k).count(True), k), default=None)


def variables_of(line: str, template: str) -> list[str]:
    """What stands in a line for a template's wildcards; nothing if it doesn't fit."""
    m = re.fullmatch("(.*?)".join(map(re.escape, template.split(WILD))), line)
    return list(m.groups()) if m else []


def remembered(variables: list[str], known: list[str]) -> list[str]:
    """known with the variables worth showing: neither all digits nor all letters, three words at most, out of brackets."""
    out = list(known)
    for v in variables:
        v = v[1:-1] if v[:1] + v[-1:] in ("()", "[]") else v
        if v and not v.isdigit() and not v.isalpha() and len(v.split()) <= 3 and v not in out:
            out.append(v)
    return out


def shown_variables(known: list[str], k: int = 5) -> list[str]:
    """k of them that differ the most in shape (digits as 0, letters as a)."""
    shape: dict[str, str] = {}
    for v in known:
        shape.setdefault(re.sub("[A-Za-z]", "a", re.sub("[0-9]", "0", v)), v)
    if len(shape) < k:
        return known[:k]
    return [shape[s] for s in sample_texts(list(shape), k)]


def patient(ask: Ask, attempts: int = 10, wait: Callable[[int], float] = lambda n: min(8.0, 2.0**n)) -> Ask:
    """ask, tried again after a pause if it fails; the last failure is raised."""

    def again(lines: list[str], variables: list[str]) -> str:
        for n in range(attempts):
            try:
                return ask(lines, variables)
            except Exception:
                if n == attempts - 1:
                    raise
                time.sleep(wait(n))
        raise ValueError("attempts: 1 at least")

    return again


def _known(keys: DataFrame, templates: list[str]) -> DataFrame:
    """keys with `template`, null where none of the templates fits whole and in its number of words, give or take one."""
    if not templates:
        return keys.withColumn("template", F.lit(None).cast("string"))
    return keys.withColumn("template", match(F.col("sample"), Templates.of(templates, remove_spaces=False, remove_punctuation=False, lowercase=False))["template"])


def mine_by_asking(lines: DataFrame, ask: Ask, line: str = "log", *, known: TemplateCache | None = None, method: str = "dbscan", chunk: int = CHUNK, samples: int = 10, rounds: int = 3, most_asked: int = 1000, sampling: str = "dpp") -> tuple[DataFrame, DataFrame, TemplateCache, Metrics]:
    """(lines with `template`, templates with occurrences and EventId, the templates known now, metrics).

    ask: from sample lines of one cluster and a few variables met before, to an answer with a template in backticks; if it
    fails, the rules make the template. method: dbscan or mean_shift (clusters of a chunk's lines), or hierarchical (groups by
    frequent words and marks).
    """
    began, cache, metrics = time.perf_counter(), known or TemplateCache(), Metrics()
    spark = lines.sparkSession
    text = squeeze(F.coalesce(F.col(line), F.lit("")))
    keyed = durable(lines.withColumn("_key", cache_key(text)).withColumn("_text", text), "lines")
    keys = keyed.groupBy("_key").agg(F.min("_text").alias("sample"), F.count(F.lit(1)).alias("n"))
    keys = durable(with_ordinal(keys, "sample", "_key"), "keys")
    metrics.lines, metrics.keys = keyed.count(), keys.count()
    told = durable(_known(keys, cache.templates), "told")
    metrics.hits = told.where("template is not null").count()
    done, open_ = told.where("template is not null"), told.where("template is null").drop("template")
    variables: list[str] = []

    for _ in range(rounds):
        if metrics.questions >= most_asked or open_.isEmpty():
            break
        if method == "hierarchical":
            group = F.concat_ws("|", "coarse", "fine")
            clustered = coarse_groups(open_.withColumn("log", F.col("sample"))).withColumn("cluster", group).select("_key", "sample", "n", "ord", "cluster")
        else:
            label = cluster_lines(open_, "sample", chunk=chunk, method=method).withColumnRenamed("ord", "_at")
            clustered = open_.join(label, F.col("ord") == F.col("_at")).select("_key", "sample", "n", "ord", F.concat_ws("-", F.col("chunk").cast("string"), F.col("cluster").cast("string")).alias("cluster"))
        clustered = durable(clustered, "clustered")
        # A few lines of each of the largest clusters: all that reaches the driver.
        some = _sampled(clustered, 20 * samples)
        answers = []
        for r in some.orderBy(F.col("n").desc(), "cluster").limit(most_asked - metrics.questions).toLocalIterator():
            chosen = sample_texts(r.lines, samples, sampling)
            asked = time.perf_counter()
            try:
                answer = ask(chosen, shown_variables(variables))
            except Exception:
                answer = ""
            metrics.asking_seconds += time.perf_counter() - asked
            metrics.questions += 1
            metrics.characters += sum(map(len, chosen)) + len(answer)
            answers.append((r.cluster, r.lines[0], answer))
        made = spark.createDataFrame(answers, "cluster string, first string, answer string")
        said = answer_template(F.col("answer"))
        made = made.withColumn("made", F.when(is_template(said), said).otherwise(generalise(F.col("first")))).select("cluster", "first", "made")
        for r in made.collect():
            cache.add(r.made, r.first)
            variables = remembered(variables_of(r.first, r.made), variables)
        # At most `most_asked` rows, a bounded table.
        fitted = clustered.join(F.broadcast(made), "cluster", "left").withColumn("template", F.when(_fits(F.col("sample"), F.col("made")), F.col("made")))
        fitted = durable(fitted.select("_key", "sample", "n", "ord", "template"), "fitted")
        done = done.unionByName(fitted.where("template is not null"))
        open_ = fitted.where("template is null").drop("template")

    by_rule = generalise(F.col("sample"))
    rest = durable(open_.withColumn("template", F.when(is_template(by_rule), by_rule).otherwise(F.col("sample"))), "rest")
    metrics.by_rules = rest.count()
    full = durable(done.unionByName(rest).select("_key", "template"), "templates")
    out = keyed.join(full, "_key").drop("_key", "_text")
    counts = durable(numbered(out.groupBy("template").agg(F.count(F.lit(1)).alias("occurrences"))), "counts")
    metrics.templates = counts.count()
    metrics.seconds = time.perf_counter() - began
    return out, counts, cache, metrics


def _sampled(clustered: DataFrame, most: int) -> DataFrame:
    """(cluster, n, lines): the size of each cluster and `most` of its lines, by a hash, picked with map-side combining: of each
    of `most` buckets of the hash the least line."""
    bucket = F.pmod(F.xxhash64("sample"), F.lit(most))
    cells = clustered.groupBy("cluster", bucket.alias("b")).agg(F.min("sample").alias("line"), F.sum("n").alias("n"))
    return cells.groupBy("cluster").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("line")).alias("lines"))


def _fits(line: Column, template: Column) -> Column:
    """Whether a line is a template's: its literal parts in order, whole. Both are columns, so the pattern is made in Spark."""
    literal = lambda part: F.concat(F.lit("\\Q"), F.replace(part, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit("^"), F.array_join(F.transform(F.split(template, r"<\*>", -1), literal), "[^\n]*?"), F.lit("\\z"))
    return F.coalesce(F.call_function("rlike", line, pattern), F.lit(False))
