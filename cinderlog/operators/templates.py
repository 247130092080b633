"""Template parsing: which of a list of `<*>` templates a log's content is made of, and with what variables.

A few templates become one CASE expression over the content, in a fixed order of priority: cheap tests first (the start and
the least length, on normalised text), then the template's own pattern on the content as it is. Many templates go through
an Arrow UDF of the same rule. Either way it is a map-side step: nothing is shuffled.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderlog.functions.text import groups, literal, squeeze, strip
from cinderlog.runtime import on_workers

#: Templates up to which a CASE expression is used.
NATIVE = 64
NOT_FOUND, TREE_NOT_FOUND = "<Not Found>", "template not found"
WILD = "<*>"
_NAMED = re.compile(r"<([A-Za-z_]\w*)>")


class TemplateError(ValueError):
    """A template list, or a label that names a part of it, is wrong."""


@dataclass
class Templates:
    """raw: the templates with `<*>` wildcards; labels: the wildcards' names of those that have any; events: names of the
    templates; how content is normalised before the cheap tests."""

    raw: list[str]
    labels: dict[int, list[str]] = field(default_factory=dict)
    events: dict[str, int] = field(default_factory=dict)
    remove_spaces: bool = True
    remove_punctuation: bool = True
    lowercase: bool = True

    @classmethod
    def of(cls, lines: list[str], events: list[str | None] | None = None, **options) -> Templates:
        """From lines with `<*>` or with `<name>` wildcards; TemplateError for a line with both."""
        raw, labels = [], {}
        for i, line in enumerate(lines):
            names = _NAMED.findall(line)
            if names and WILD in line:
                raise TemplateError(f"template {i} mixes {WILD} and named wildcards")
            if names:
                labels[i] = names
            raw.append(_NAMED.sub(WILD, line))
        return cls(raw, labels, {e: i for i, e in enumerate(events or []) if e}, **options)

    @classmethod
    def load(cls, path: str, **options) -> Templates:
        """.txt: a template a line; .csv: EventTemplate and, if there is one, EventId as its name."""
        if not Path(path).exists():
            raise FileNotFoundError(path)
        if path.endswith(".txt"):
            with open(path, encoding="utf-8") as f:
                return cls.of([line.strip() for line in f if line.strip()], **options)
        if path.endswith(".csv"):
            with open(path, encoding="utf-8", newline="") as f:
                rows = list(csv.DictReader(f))
            if rows and "EventTemplate" not in rows[0]:
                raise TemplateError(f"{path}: no column EventTemplate")
            return cls.of([r["EventTemplate"] for r in rows], [r.get("EventId") for r in rows], **options)
        raise TemplateError(f"{path}: neither .txt nor .csv")

    def event(self, label: str | int) -> int:
        """A template's number by its number or name."""
        if isinstance(label, int) or re.fullmatch(r"-?\d+", label):
            return int(label)
        if label not in self.events:
            raise TemplateError(f"no template is named {label}")
        return self.events[label]

    def position(self, event: int, label: str | int) -> int:
        """A wildcard's place by its place or name."""
        if isinstance(label, int) or re.fullmatch(r"\d+", label):
            return int(label)
        if label not in self.labels.get(event, ()):
            raise TemplateError(f"template {event} has no wildcard {label}")
        return self.labels[event].index(label)

    def plain(self, text: str) -> str:
        """Text as the cheap tests see it; the same as `normalise` on a column."""
        if self.remove_spaces:
            text = text.replace(" ", "")
        if self.remove_punctuation:
            text = WILD.join(re.sub(r"[^\w\s]", "", part) for part in text.split(WILD))
        text = text.strip()
        if not self.remove_spaces:
            text = re.sub(r"\s+", " ", text)
        return text.lower() if self.lowercase else text

    def normalise(self, text: Column) -> Column:
        text = squeeze(text)
        if self.remove_spaces:
            text = F.replace(text, F.lit(" "), F.lit(""))
        if self.remove_punctuation:
            text = F.regexp_replace(text, r"(?U)[^\w\s]", "")
        text = strip(text)
        return F.lower(text) if self.lowercase else text

    def order(self) -> list[tuple[int, str, int]]:
        """(template, start, least length) by priority: templates with one start stand together, as starts first occur."""
        starts: dict[str, list[tuple[int, str, int]]] = {}
        for i, t in enumerate(self.raw):
            parts = self.plain(t).split(WILD)
            starts.setdefault(parts[0], []).append((i, parts[0], sum(map(len, parts))))
        return [x for group in starts.values() for x in group]

    def last(self) -> dict[str, int]:
        """A template's number; of equal ones the last."""
        return {t: i for i, t in enumerate(self.raw)}


def pattern(template: str) -> str:
    return r"^" + r"([^\n]*?)".join(map(literal, template.split(WILD))) + r"\z"


def match(content: Column, templates: Templates) -> Column:
    """Struct (EventID, template, variables), null where no template matches."""
    both = F.struct(squeeze(content).alias("squeezed"), templates.normalise(content).alias("plain"))
    return F.get(F.transform(F.array(both), lambda x: _first(x["squeezed"], x["plain"], templates)), F.lit(0))


def with_match(df: DataFrame, content: Column, templates: Templates, name: str) -> DataFrame:
    """df with the same struct as `name`. What the cheap tests read is a column by itself, made once a row and not once a
    template."""
    squeezed = df.withColumn("_squeezed", squeeze(content))
    plain = squeezed.withColumn("_plain", templates.normalise(F.col("_squeezed")))
    return plain.withColumn(name, _first(F.col("_squeezed"), F.col("_plain"), templates)).drop("_squeezed", "_plain")


def _first(squeezed: Column, plain: Column, templates: Templates) -> Column:
    last, case = templates.last(), None
    for i, start, least in templates.order():
        raw = templates.raw[i]
        regex = pattern(raw)
        ok = F.lit(True)
        if start:
            ok = ok & plain.startswith(start)
        if least:
            ok = ok & (F.length(plain) >= least)
        ok = ok & squeezed.rlike(regex)
        found = F.struct(F.lit(last[raw]).cast("int").alias("EventID"), F.lit(raw).alias("template"), groups(squeezed, regex, raw.count(WILD)).alias("variables"))
        case = (F if case is None else case).when(ok, found)
    return case if case is not None else F.lit(None).cast("struct<EventID:int,template:string,variables:array<string>>")


def _matcher(templates: Templates):
    def match_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        last, order = templates.last(), templates.order()
        regexes = {i: re.compile("(.*?)".join(map(re.escape, templates.raw[i].split(WILD))) + r"\Z") for i, _, _ in order}
        kind = pa.struct([("EventID", pa.int32()), ("template", pa.string()), ("variables", pa.list_(pa.string()))])
        for batch in batches:
            out = []
            for text in batch.to_pylist():
                squeezed = re.sub(r"\s+", " ", text.strip()) if text is not None else None
                plain = templates.plain(squeezed) if squeezed is not None else ""
                hit = None
                for i, start, least in order if squeezed is not None else ():
                    if plain.startswith(start) and len(plain) >= least and (m := regexes[i].match(squeezed)):
                        hit = {"EventID": last[templates.raw[i]], "template": templates.raw[i], "variables": list(m.groups())}
                        break
                out.append(hit)
            yield pa.array(out, kind)

    return F.arrow_udf("struct<EventID:int,template:string,variables:array<string>>")(match_batches)


def parse_templates(df: DataFrame, templates: Templates, content: str = "content", *, not_found: str = NOT_FOUND, native: bool | None = None) -> DataFrame:
    """df with EventID (-1 if none matches), template and variables."""
    if native is None:
        native = len(templates.raw) <= NATIVE
    if not native:
        on_workers(df.sparkSession)
    out = with_match(df, F.col(content), templates, "_found") if native else df.withColumn("_found", _matcher(templates)(F.col(content)))
    none = F.array().cast("array<string>")
    return out.withColumns({"EventID": F.coalesce("_found.EventID", F.lit(-1)), "template": F.coalesce("_found.template", F.lit(not_found)), "variables": F.coalesce("_found.variables", none)}).drop("_found")


def parse_tree(df: DataFrame, lines: list[str], content: str = "content") -> DataFrame:
    """The tree matcher's rule: of both templates and text nothing but letters, digits and wildcards counts, so that variables
    are what is left of them, too. Of several templates that fit, the first does."""
    bare = lambda t: re.sub(r"[\W_]+", "", t)
    text = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), r"(?U)[\W_]+", "")
    case = None
    for i, raw in enumerate(Templates.of(lines).raw):
        parts = [bare(p) for p in raw.split(WILD)]
        regex = "^" + "(.*?)".join(map(literal, parts)) + r"\z"
        found = F.struct(F.lit(i).alias("EventID"), F.lit(raw).alias("template"), groups(text, regex, len(parts) - 1).alias("variables"))
        case = (F if case is None else case).when(text.rlike(regex), found)
    missing = F.struct(F.lit(-1).alias("EventID"), F.lit(TREE_NOT_FOUND).alias("template"), F.array().cast("array<string>").alias("variables"))
    out = df.withColumn("_found", missing if case is None else case.otherwise(missing))
    return out.withColumns({name: F.col(f"_found.{name}") for name in ("EventID", "template", "variables")}).drop("_found")
