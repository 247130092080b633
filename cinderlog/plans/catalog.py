"""The library's queries over the driver's tables, and the same results in SQL.

Logs are rendered from `events`, one line an event, and parsed again; `event_id` is their order. The first four fifths of
the records are training, the rest is scored.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.functions.text import as_number
from cinderlog.functions.timestamps import to_seconds
from cinderlog.operators import detectors as d
from cinderlog.operators import clustering, mining, stability
from cinderlog.operators import sequences as s
from cinderlog.operators.aggregation import concatenate
from cinderlog.operators.asking import mine_by_asking
from cinderlog.operators.header import FORMATS, parse_header
from cinderlog.operators.history import append, last_templates, load, retained, save
from cinderlog.operators.jsonlog import parse_json
from cinderlog.operators.order import phase, runs, sliding, tumbling, with_ordinal
from cinderlog.operators.templates import Templates, parse_templates, parse_tree
from cinderlog.operators.variables import all_variables
from cinderlog.operators.variables import watched_variables as watched_rows
from cinderlog.plans import lifecycle
from cinderlog.plans.config import ANY_EVENT, watched_variables
from cinderlog.runtime import durable, shared_dir, spread
from cinderlog.sources.readers import from_frame, read_indexed_json, read_log, read_wire
from cinderlog.sources.schemas import LOG, PARSED, conform, equal_messages, from_json_message, is_complete, read_field, to_json_message
from cinderlog.sources.writers import wire_lines, write_json_lines

TYPES = ("click", "error", "purchase", "signup", "view")
TEMPLATES = [f"{t} by user=<*> value=<*> k=<*>" for t in TYPES]
FORMAT = "type=<Type> msg=audit(<Time>:<Line>): <Content>"

#: SQL of the rendered log and its fields.
_FIELDS = """
e as (select event_id ord, event_type ty, user_id u, cast(cast(value as decimal(18,2)) as varchar) v,
  regexp_extract(props, '([0-9]+)', 1) k, epoch(date_trunc('second', ts))::bigint secs,
  list_position(['click','error','purchase','signup','view'], event_type)::int - 1 ev,
  (select count(*) from events) n from events),
t as (select * from e where ord < n * 4 // 5),
x as (select * from e where ord >= n * 4 // 5)"""
#: All variables in long form.
_LONG = """
l as (select ord, secs, ev::varchar event, unnest(['var_0','var_1','var_2','Type','Time','Line']) "name",
  unnest([u::varchar, v, k, ty, secs::varchar, ord::varchar]) "value" from e)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, logID, log)"""
    e = spread(table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "user_id", "value", "props"), "event_id")
    stamp = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp")))
    k = F.regexp_extract("props", "([0-9]+)", 1)
    value = F.col("value").cast("decimal(18,2)").cast("string")
    line = F.concat(F.lit("type="), "event_type", F.lit(" msg=audit("), stamp.cast("string"), F.lit(":"), F.col("event_id").cast("string"), F.lit("): "), "event_type", F.lit(" by user="), F.col("user_id").cast("string"), F.lit(" value="), value, F.lit(" k="), k)
    return e.select(F.col("event_id").alias("ord"), F.col("event_id").cast("string").alias("logID"), line.alias("log"))


def parsed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_templates(parse_header(raw_logs(spark, sf_dir), FORMAT), Templates.of(TEMPLATES))


def stored_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed records as a table, as a parser hands them to the detectors that follow it: parsed once, read as often as learning
    and scoring need."""
    return durable(parsed_logs(spark, sf_dir).select("ord", "logID", "EventID", "variables", "logFormatVariables"), "parsed")


def split(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    n = parsed.agg(F.max("ord")).first()[0]
    cut = ((n if n is not None else -1) + 1) * 4 // 5
    return parsed.where(F.col("ord") < cut), parsed.where(F.col("ord") >= cut)


def events_split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """As split, with the cut read off the table's own order column: parsing isn't needed to count."""
    n = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    cut = ((n if n is not None else -1) + 1) * 4 // 5
    parsed = stored_logs(spark, sf_dir)
    return parsed.where(F.col("ord") < cut), parsed.where(F.col("ord") >= cut)


def watch(*names: str, events: tuple[int | str, ...] = tuple(range(len(TYPES))), instance: str = "i"):
    return [w for e in events for w in watched_variables(list(names), e, instance)]


def shown(alerts: DataFrame) -> DataFrame:
    """Alerts as plain columns, for comparison."""
    found = F.array_join(F.transform(F.array_sort(F.map_entries("alertsObtain")), lambda e: F.concat_ws("=", e["key"], e["value"])), "; ")
    return alerts.select("ord", "alertID", F.array_join("logIDs", ",").alias("log_ids"), F.col("score").cast("double").alias("score"), found.alias("found"))


_IDS = "'{0}_' || (9 + row_number() over (order by ord)) \"alertID\""


def _fit_and_score(detector, spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    return shown(detector.fit(train).transform(test))


# Parsing


def header_parse(spark, sf_dir):
    field = lambda n: F.element_at("logFormatVariables", n).alias(n.lower())
    return parse_header(raw_logs(spark, sf_dir), FORMAT).select("ord", *map(field, ("Type", "Time", "Line", "Content")), "parsedLogID")


def header_unmatched(spark, sf_dir):
    out = parse_header(raw_logs(spark, sf_dir), "type=error msg=audit(<Time>:<Line>): <Content>")
    return out.groupBy(F.size("logFormatVariables").cast("long").alias("fields"), (F.col("content") == F.col("log")).alias("whole_log")).agg(F.count(F.lit(1)).alias("n"))


def template_match(spark, sf_dir):
    return parsed_logs(spark, sf_dir).select("ord", F.col("EventID").alias("event_id"), "template", F.array_join("variables", "|").alias("vars"))


def template_match_udf(spark, sf_dir):
    out = parse_templates(parse_header(raw_logs(spark, sf_dir), FORMAT), Templates.of(TEMPLATES), native=False)
    return out.select("ord", F.col("EventID").alias("event_id"), "template", F.array_join("variables", "|").alias("vars"))


def template_not_found(spark, sf_dir):
    out = parse_templates(parse_header(raw_logs(spark, sf_dir), FORMAT), Templates.of(TEMPLATES[:3]))
    return out.where("EventID = -1").select("ord", "template", F.size("variables").cast("long").alias("n_variables"))


def template_counts(spark, sf_dir):
    return mining.numbered(parsed_logs(spark, sf_dir).groupBy("template").agg(F.count(F.lit(1)).alias("occurrences"))).select("template", "occurrences", F.col("EventId").alias("label"))


def url_template(spark, sf_dir):
    t = Templates.of(["http://<host>/<lang>/<page>", "https://<host>/<lang>/<page>"], ["plain", "secure"])
    out = parse_templates(table(spark, sf_dir, "pages").select("page_id", "url"), t, "url")
    part = lambda name: F.get("variables", F.lit(t.position(0, name))).alias(name)
    return out.select("page_id", F.col("EventID").alias("event_id"), part("host"), part("lang"), part("page"))


def json_parse(spark, sf_dir):
    log = F.to_json(F.struct(F.struct("user_id", "props").alias("who"), F.col("ts").cast("string").alias("eventTime"), F.concat("event_type", F.lit(" of "), F.col("user_id").cast("string")).alias("message")))
    rows = spread(table(spark, sf_dir, "events"), "event_id").select(F.col("event_id").alias("ord"), log.alias("log"))
    out = parse_json(rows, Templates.of([f"{t} of <*>" for t in TYPES]))
    field = lambda n: F.element_at("logFormatVariables", n)
    return out.select("ord", F.col("EventID").alias("event_id"), F.get("variables", F.lit(0)).alias("var_0"), field("Time").alias("time"), field("who.user_id").alias("who"), field("who.props").alias("props"))


def time_normalise(spark, sf_dir):
    ts = F.date_trunc("second", F.col("ts").cast("timestamp"))
    kinds = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss"]
    text = F.lit("nonsense")
    for i, k in enumerate(kinds):
        text = F.when(F.col("event_id") % 8 == i, F.date_format(ts, k)).otherwise(text)
    text = F.when(F.col("event_id") % 8 == 4, F.unix_timestamp(ts).cast("string")).when(F.col("event_id") % 8 == 5, F.concat(F.unix_timestamp(ts).cast("string"), F.lit("123"))).when(F.col("event_id") % 8 == 6, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".250+02:00"))).otherwise(text)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), text.alias("t")).select("ord", to_seconds(F.col("t")).alias("seconds"))


# Detectors


def new_event(spark, sf_dir):
    orders = with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("EventID")), "o_orderkey")
    orders = orders.select("ord", F.col("o_orderkey").cast("string").alias("logID"), "EventID", F.array().cast("array<string>").alias("variables"), F.create_map().cast("map<string,string>").alias("logFormatVariables"))
    train, test = split(orders)
    det = d.NewEvent("NewEvent", []).fit(train)
    return shown(det.transform(test))


def new_value(spark, sf_dir):
    return _fit_and_score(d.NewValue("NewValue", watch("var_1")), spark, sf_dir)


def new_value_global(spark, sf_dir):
    return _fit_and_score(d.NewValue("NewValue", watch("Line", events=(ANY_EVENT,)) + watch("var_2")), spark, sf_dir)


def new_value_combo(spark, sf_dir):
    return _fit_and_score(d.NewValueCombo("Combo", watch("var_0", "var_2")), spark, sf_dir)


def value_range(spark, sf_dir):
    return _fit_and_score(d.ValueRange("Range", watch("var_1", "Line")), spark, sf_dir)


def charset(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("logID"), F.lit(0).alias("EventID"), F.array("text").alias("variables"), F.create_map(F.lit("lang"), F.col("lang")).alias("logFormatVariables"), "lang")
    det = d.Charset("Charset", watch("var_0", events=(0,))).fit(docs.where("lang = 'en'").drop("lang"))
    return shown(det.transform(docs.where("lang <> 'en'").drop("lang")))


def bigram_chances(spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    det = d.BigramFrequency("Bigram", watch("var_1"), threshold=0.1).fit(train)
    return det.chances(watched_rows(test, det.watched).distinct()).select("event", "name", "value", F.round("chance", 9).alias("chance"))


def bigram_defaults(spark, sf_dir):
    """Chances with usual counts to fall back to for pairs that training, fifty records here, lacks."""
    train, test = events_split(spark, sf_dir)
    usual = spark.createDataFrame([(str(a), str(b), 1 + (a * b) % 5) for a in range(10) for b in range(10)], "a string, b string, n long")
    det = d.BigramFrequency("Bigram", watch("var_1"), defaults=usual).fit(train.where(F.col("ord") < 50))
    return det.chances(watched_rows(test, det.watched).distinct()).select("event", "name", "value", F.round("chance", 9).alias("chance"))


def bigram_alerts(spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    det = d.BigramFrequency("Bigram", watch("var_1"), threshold=0.11, once=False).fit(train)
    return det.transform(test).select("ord", "alertID", F.col("score").cast("double").alias("score"))


def rules(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    rows = with_ordinal(c.select("conv_id", "turn", F.col("text").alias("log"), F.when(F.col("role") == "user", "ERROR").otherwise("info").alias("level"), F.when(F.col("turn") == 0, -1).otherwise(0).alias("EventID")), "conv_id", "turn")
    rows = rows.withColumns({"logID": F.col("ord").cast("string"), "logFormatVariables": F.create_map(F.lit("Level"), "level"), "variables": F.array().cast("array<string>")})
    chosen = (("R001 - TemplateNotFound", ()), ("R002 - SpecificKeyword", ("die", "the", "la ")), ("R003 - CheckForExceptions", ()), ("R004 - ErrorLevelFound", ()))
    return shown(d.Rules("Rules", [], rules=chosen).transform(rows))


def random_detector(spark, sf_dir):
    return shown(d.Random("Random", watch("var_0"), threshold=0.99).transform(parsed_logs(spark, sf_dir)))


def numeric_filter(spark, sf_dir):
    rows = all_variables(parsed_logs(spark, sf_dir), "ord").withColumn("number", as_number(F.col("value")))
    return rows.groupBy("event", "name").agg(F.count(F.lit(1)).alias("n"), F.count("number").alias("numeric"))


def event_sequence(spark, sf_dir):
    return _fit_and_score(s.EventSequence("Sequence", 6), spark, sf_dir)


def count_vectors(spark, sf_dir):
    return _fit_and_score(s.CountVectors("Vectors", 6), spark, sf_dir)


def near_count_vectors(spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    det = s.NearCountVectors("Near", 6, validation=0.0, method="default").fit(train)
    return det.unusual(test).select(F.col("last_ord").alias("ord"), F.round("distance", 9).alias("distance"))


def near_count_vectors_mean(spark, sf_dir):
    """With a threshold from vectors of training that the model doesn't have."""
    train, test = events_split(spark, sf_dir)
    det = s.NearCountVectors("Near", 6, validation=0.4).fit(train)
    return det.unusual(test).select(F.col("last_ord").alias("ord"), F.round("distance", 9).alias("distance"), F.round(F.lit(det.threshold), 9).alias("threshold"))


def next_event(spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    det = s.NextEvent("Next", 6).fit(train)
    return det.ranks(s.windows(test, 6)).select(F.col("last_ord").alias("ord"), "rank", F.lit(det.top_k).alias("top_k"))


def next_event_topk(spark, sf_dir):
    return _fit_and_score(s.NextEvent("Next", 6, top_k=3), spark, sf_dir)


def masked_events(spark, sf_dir):
    return _fit_and_score(s.MaskedEvents("Masked", 6, top_k=3), spark, sf_dir)


# Order and windows


def ordinals(spark, sf_dir):
    return with_ordinal(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "ord")


def phase_units(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(phase(F.col("event_id"), 100, 700).alias("phase")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


def tumbling_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "user_id")
    out = tumbling(rows, 7, flush=True)
    return out.select("window", "first_ord", F.array_join(F.transform("records", lambda r: r["user_id"].cast("string")), ",").alias("users"))


def sliding_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), "user_id")
    return sliding(rows, 5, "user_id").select("first_ord", "last_ord", F.array_join(F.transform("records", lambda r: r["user_id"].cast("string")), ",").alias("users"))


def run_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), (F.col("user_id") % 4).alias("k"), (F.col("value") > 20).alias("high"))
    return runs(rows, "high", "k")


def alert_concat(spark, sf_dir):
    train, test = events_split(spark, sf_dir)
    found = d.NewValue("NewValue", watch("var_1")).fit(train).transform(test)
    out = concatenate(found, 3)
    return out.select("window", F.array_join("alertIDs", ",").alias("alert_ids"), F.array_join("logIDs", ",").alias("log_ids"), F.array_join(F.transform("extractedTimestamps", lambda t: t.cast("string")), ",").alias("times"))


# Stability and auto-configuration


def _series(spark, sf_dir):
    return all_variables(stored_logs(spark, sf_dir).withColumn("secs", F.element_at("logFormatVariables", "Time").cast("long")), "ord", "secs")


def stability_means(spark, sf_dir):
    out = stability.segment_means(stability.value_changes(_series(spark, sf_dir)))
    return out.select("event", "name", "n", F.col("kinds").cast("long").alias("kinds"), *(F.round(f"m{k}", 9).alias(f"m{k}") for k in range(4)))


def stability_means_time(spark, sf_dir):
    out = stability.segment_means(stability.value_changes(_series(spark, sf_dir)), mode="time", time="secs")
    return out.select("event", "name", "n", F.col("kinds").cast("long").alias("kinds"), *(F.round(f"m{k}", 9).alias(f"m{k}") for k in range(4)))


def stability_classes(spark, sf_dir):
    return stability.classify(stability.value_changes(_series(spark, sf_dir)), mode="both", time="secs").select("event", "name", F.col("class").alias("class"))


def stability_range(spark, sf_dir):
    return stability.classify(stability.range_changes(_series(spark, sf_dir))).select("event", "name", "n", "class")


def stability_charset(spark, sf_dir):
    return stability.classify(stability.charset_changes(_series(spark, sf_dir))).select("event", "name", F.col("kinds").cast("long").alias("kinds"), "class")


def auto_new_value(spark, sf_dir):
    """A header field with a new value for each quarter of the records: stable, so it is watched, and new at the end."""
    n = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    epoch = F.concat(F.lit("v"), F.floor(F.col("ord") * 4 / n).cast("string"))
    parsed = stored_logs(spark, sf_dir).withColumn("logFormatVariables", F.map_concat("logFormatVariables", F.create_map(F.lit("Epoch"), epoch)))
    found = lifecycle.run(d.NewValue("Auto", []), parsed, configure=n // 2, train=n // 4, auto=lifecycle.choose_variables)
    return shown(found)


def seq_length(spark, sf_dir):
    n = s.choose_length(stored_logs(spark, sf_dir), 2, 7)
    return spark.createDataFrame([(n,)], "length int")


# History and mining


def history_retention(spark, sf_dir):
    return retained(parsed_logs(spark, sf_dir), 500).select("ord", "logID", F.col("EventID").alias("event_id"))


def event_history(spark, sf_dir):
    """Records appended to a history, a folder for each event, in two goes, and read back."""
    path = _folder(spark, "history")
    for part in events_split(spark, sf_dir):
        append(path, part.select("ord", "EventID", "variables"))
    return spark.read.parquet(path).groupBy(F.col("EventID").cast("int").alias("event_id")).agg(F.count(F.lit(1)).alias("n"), F.max("ord").alias("last"), F.max_by(F.array_join("variables", "|"), "ord").alias("vars"))


def saved_model(spark, sf_dir):
    """A model that is saved, loaded again and scores."""
    train, test = events_split(spark, sf_dir)
    path = _folder(spark, "model")
    save(spark, path, {"values": d.NewValue("NewValue", watch("var_1")).fit(train).model}, {"name": "NewValue"})
    tables, about = load(spark, path)
    return shown(d.NewValue(about["name"], watch("var_1"), tables["values"]).transform(test))


def config_coverage(spark, sf_dir):
    """Configured events that training lacks, and those without any of the watched variables."""
    train, _ = events_split(spark, sf_dir)
    watched = watch("var_0", events=(0, 1)) + watch("var_9", events=(2, 3)) + watch("var_0", events=(77,))
    unseen, bare = d.coverage(d.NewValue("N", watched).fit(train).model, watched, train)
    return spark.createDataFrame([(e, "unseen") for e in unseen] + [(e, "no variables") for e in bare], "event string, why string")


# Sources and sinks


def _folder(spark, name):
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def log_file(spark, sf_dir):
    """Lines written as text, in order, and read back as records."""
    path = _folder(spark, "lines")
    raw_logs(spark, sf_dir).repartitionByRange("ord").sortWithinPartitions("ord").select("log").write.text(path)
    return read_log(spark, path, "file", "here").select("ord", "logID", "log", "logSource", "hostname")


def wire_file(spark, sf_dir):
    """Parsed records as messages on the wire, a line each, and back."""
    path = _folder(spark, "wire")
    records = conform(parsed_logs(spark, sf_dir), PARSED, "ord")
    wire_lines(records.repartitionByRange("ord").sortWithinPartitions("ord"), PARSED).write.text(path)
    return read_wire(spark, path, PARSED).select("ord", "logID", F.col("EventID").alias("event_id"), "template", F.array_join("variables", "|").alias("vars"), F.element_at("logFormatVariables", "Time").alias("time"))


def indexed_json_file(spark, sf_dir):
    """One JSON object of numbered records, of a small table."""
    rows = with_ordinal(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    entry = F.struct(F.col("ord").cast("string").alias("key"), F.struct(F.col("n_nationkey").cast("string").alias("logID"), F.col("n_name").alias("log")).alias("value"))
    path = _folder(spark, "json")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(entry)))).coalesce(1).write.text(path)
    return read_indexed_json(spark, path, LOG).select("ord", "logID", "log")


def json_lines_file(spark, sf_dir):
    path = _folder(spark, "lines")
    write_json_lines(conform(raw_logs(spark, sf_dir), LOG, "ord"), path)
    return spark.read.schema("ord long, logID string, log string").json(path)


def frame_records(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    frame = e.select("event_id", F.concat("event_type", F.lit(" by "), F.col("user_id").cast("string")).alias("Content"), F.lit(7).alias("EventIDs"), F.concat("event_type", F.lit(" by <*>")).alias("Templates"), F.array(F.col("user_id").cast("string")).alias("ParamList"), "props")
    return from_frame(frame, "event_id").select("ord", "log", F.col("EventID").alias("event_id"), "template", F.array_join("variables", "|").alias("vars"), F.element_at("logFormatVariables", "props").alias("props"), F.size("logFormatVariables").cast("long").alias("fields"))


def message_fields(spark, sf_dir):
    """Records as messages: presence, defaults of what is absent, and JSON there and back."""
    logs = conform(raw_logs(spark, sf_dir), LOG, "ord")
    back = from_json_message(to_json_message(LOG), LOG)
    same = logs.withColumns({"a": F.struct(*LOG.fieldNames()), "b": back})
    return same.select("ord", is_complete(LOG).alias("complete"), read_field(LOG, "hostname").alias("host"), read_field(LOG, "log").alias("log"), equal_messages("a", "b", LOG).alias("same"), F.col("__version__").alias("version"))


def audit_format(spark, sf_dir):
    """A header by a format of the catalogue."""
    out = parse_header(raw_logs(spark, sf_dir), FORMATS["audit"])
    field = lambda n: F.element_at("logFormatVariables", n).alias(n.lower())
    return out.select("ord", *map(field, ("Type", "Time", "Content")))


def tree_match(spark, sf_dir):
    logs = parse_header(raw_logs(spark, sf_dir), FORMAT)
    out = parse_tree(logs, TEMPLATES[:3])
    return out.select("ord", F.col("EventID").alias("event_id"), "template", F.array_join("variables", "|").alias("vars"))


def lifecycle_run(spark, sf_dir):
    """Records handed to a detector one life long: training, then detection."""
    parsed = stored_logs(spark, sf_dir)
    n = table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0] + 1
    return shown(lifecycle.run(d.NewValue("NewValue", watch("var_1")), parsed, train=n * 4 // 5))


def last_template(spark, sf_dir):
    return last_templates(parsed_logs(spark, sf_dir)).select(F.col("EventID").alias("event_id"), "template")


def mine_templates(spark, sf_dir):
    return mining.mine(parse_header(raw_logs(spark, sf_dir), FORMAT).select(F.col("content").alias("log")))


def coarse_groups(spark, sf_dir):
    out = mining.coarse_groups(parse_header(raw_logs(spark, sf_dir), FORMAT).select("ord", F.col("content").alias("log")))
    return out.groupBy("coarse", "fine").agg(F.count(F.lit(1)).alias("n"))


def cluster_lines(spark, sf_dir):
    return clustering.cluster_lines(parse_header(raw_logs(spark, sf_dir), FORMAT).select("ord", F.col("content").alias("log"))).groupBy("chunk", "cluster").agg(F.count(F.lit(1)).alias("n"))


def mean_shift_lines(spark, sf_dir):
    lines = parse_header(raw_logs(spark, sf_dir), FORMAT).select("ord", F.col("content").alias("log"))
    return clustering.cluster_lines(lines, method="mean_shift").groupBy("chunk", "cluster").agg(F.count(F.lit(1)).alias("n")).select("chunk", "n")


def asked_templates(spark, sf_dir):
    """Templates from a function in the place of a language model: it puts the first sample's numbers in placeholders."""
    lines = parse_header(raw_logs(spark, sf_dir), FORMAT).select(F.col("content").alias("log"))
    ask = lambda samples, variables: "`" + re.sub("[0-9.-]+", "{{n}}", samples[0]) + "`"
    return mine_by_asking(lines, ask)[1]


def line_keys(spark, sf_dir):
    lines = parse_header(raw_logs(spark, sf_dir), FORMAT).select(F.col("content").alias("log"))
    return lines.groupBy(mining.cache_key(F.col("log")).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def line_words(spark, sf_dir):
    lines = parse_header(raw_logs(spark, sf_dir), FORMAT).select(mining.words(F.col("content")).alias("w"))
    return lines.groupBy(F.array_join("w", " ").alias("words")).agg(F.count(F.lit(1)).alias("n"))


QUERIES: list[Callable[[SparkSession, str], DataFrame]] = [
    header_parse, header_unmatched, template_match, template_match_udf, template_not_found, template_counts, url_template, json_parse, time_normalise,
    new_event, new_value, new_value_global, new_value_combo, value_range, charset, bigram_chances, bigram_defaults, bigram_alerts, rules, random_detector, numeric_filter,
    event_sequence, count_vectors, near_count_vectors, near_count_vectors_mean, next_event, next_event_topk, masked_events,
    ordinals, phase_units, tumbling_windows, sliding_windows, run_lengths, alert_concat,
    stability_means, stability_means_time, stability_classes, stability_range, stability_charset, auto_new_value, seq_length,
    history_retention, event_history, saved_model, config_coverage, last_template, mine_templates, asked_templates, coarse_groups, cluster_lines, mean_shift_lines, line_keys, line_words,
    log_file, wire_file, indexed_json_file, json_lines_file, frame_records, message_fields, audit_format, tree_match, lifecycle_run,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


_CONTENT = "ty || ' by user=' || u || ' value=' || v || ' k=' || k"
_MATCH = f"with {_FIELDS} select ord, ev event_id, ty || ' by user=<*> value=<*> k=<*>' template, u || '|' || v || '|' || k vars from e"
_ALERT = _IDS + ", ord::varchar log_ids"


def _variable_alerts(name: str, found: str) -> str:
    """found: (ord, key, message) rows."""
    return f"""with {_FIELDS}, found as ({found})
select ord, {_ALERT.format(name)}, n::double score, found from (
  select ord, count(*) n, string_agg(key || '=' || message, '; ' order by key, message) found from found group by ord)"""


def _flags(series: str, by: str = "event, name") -> str:
    return f"""f as (select *, (row_number() over (partition by {by}, "value" order by ord) = 1)::int changed from {series}),
g as (select *, sum(changed) over (partition by {by}) kinds, row_number() over (partition by {by} order by ord) - 1 i, count(*) over (partition by {by}) n from f)"""


_COUNTED = "greatest(case when i >= (1*n)//4 then 1 else 0 end, case when i >= (2*n)//4 then 2 else 0 end, case when i >= (3*n)//4 then 3 else 0 end)"
_TIMED = """case when max(bad) over w = 0 and max(secs) over w > min(secs) over w then greatest(
  case when secs >= min(secs) over w + 1 * (max(secs) over w - min(secs) over w) / 4 then 1 else 0 end,
  case when secs >= min(secs) over w + 2 * (max(secs) over w - min(secs) over w) / 4 then 2 else 0 end,
  case when secs >= min(secs) over w + 3 * (max(secs) over w - min(secs) over w) / 4 then 3 else 0 end) else """ + _COUNTED + " end"
_MEANS = ", ".join(f"coalesce(avg(changed) filter (s = {k}), 0) m{k}" for k in range(4))
_CLASS = "case when n < 3 then 'INSUFFICIENT_DATA' when kinds = 1 then 'STATIC' when kinds = n then 'RANDOM' when {0} then 'STABLE' else 'UNSTABLE' end"
_STABLE = "m0 < 1.1 and m1 < 0.3 and m2 < 0.1 and m3 < 0.01"
_SERIES_COUNT = f"{_flags('l')}, c as (select event, \"name\", count(*) n, max(kinds)::bigint kinds, {_MEANS} from (select *, {_COUNTED} s from g) group by all)"
_BAD = "(coalesce(secs < lag(secs) over (partition by event, \"name\" order by ord), false))::int bad"
_SERIES_TIME = f"b as (select *, {_BAD} from g), c2 as (select event, \"name\", count(*) n, max(kinds)::bigint kinds, {_MEANS} from (select *, {_TIMED} s from b window w as (partition by event, \"name\")) group by all)"
_ROUNDED = ", ".join(f"round(m{k}, 9) m{k}" for k in range(4))


def _windows(size: int) -> str:
    return f"""w as (select ord, ord - {size - 1} first_ord, list(ev) over r events, list(ord::varchar) over r ids, count(*) over r c from e
  window r as (order by ord rows between {size - 1} preceding and current row)),
wt as (select * from w where c = {size} and ord < (select any_value(n) from e) * 4 // 5),
wx as (select * from w where c = {size} and first_ord >= (select any_value(n) from e) * 4 // 5)"""


_VECTOR = "[len(list_filter(events, lambda q: q = p)) for p in range(-1, 5)]"

#: The first 13 hex digits of an MD5, as a number from 0 to below 1.
_CHANCE = "(('0x' || substr(md5({0}), 1, 13))::bigint * pow(2, -52))"
#: Least distance of each vector of one table to those of another.
_NEAREST = """{out} as (select a.vec, min(list_sum(list_transform(range(1, 7), lambda p: abs(a.vec[p] - w.vec[p])))::double / list_sum(list_transform(range(1, 7), lambda p: greatest(a.vec[p], w.vec[p])))) d
  from {left} a, {right} w group by 1)"""
_NEXT = """{fields}, {windows}, tr as (select *, {aside} aside from wt),
ex as (select part, events, n, case when n = 0 then '' else array_to_string(events[6 - n:5], ',') end context, events[6] ev from (
  select part, events, unnest([0, 1, 2]) n from (select 'm' part, events from tr where not aside union all select 'a', events from tr where aside union all select 'x', events from wx))),
model as (select n, context, ev, row_number() over (partition by n, context order by count(*) desc, ev) rank from ex where part = 'm' group by n, context, ev),
longest as (select distinct on (events) events, n, context, ev from (select distinct events, n, context, ev from ex where (n, context) in (select n, context from model)) order by events, n desc),
ranks as (select l.events, m.rank from longest l left join model m on l.n = m.n and l.context = m.context and l.ev = m.ev)"""

_SEQ_CLASSES = " union all ".join(
    f"""select {n} len, {_CLASS.format(_STABLE)} class from (select count(*) n, max(kinds) kinds, {_MEANS} from (select *, {_COUNTED} s from (
  select *, sum(changed) over () kinds, row_number() over (order by ord) - 1 i, count(*) over () n from (
    select *, (row_number() over (partition by events order by ord) = 1)::int changed from (
      select ord, list(ev) over r events, count(*) over r c from e window r as (order by ord rows between {n - 1} preceding and current row)) where c = {n}))))"""
    for n in range(2, 8)
)

_NEW_VALUE = _variable_alerts("NewValue", "select ord, 'EventID ' || ev || ' - var_1' as key, 'Unknown value: ''' || v || '''' as message from x where (ev, v) not in (select ev, v from t)")
_LINE = f"'type=' || ty || ' msg=audit(' || secs || ':' || ord || '): ' || {_CONTENT}"
_TREE_VARS = "u || '|' || replace(replace(v, '.', ''), '-', '') || '|' || k"
_MINED = """, c as (select ty || ' by user=<*> value=<*> k=<*>' template, count(*) occurrences from e group by 1)
select template, occurrences, 'E' || row_number() over (order by occurrences desc, template) "EventId" from c"""

ORACLES: dict[str, str] = {
    "header_parse": f"with {_FIELDS} select ord, ty \"type\", secs::varchar \"time\", ord::varchar line, {_CONTENT} content, 'CoreParser_' || (ord + 10) \"parsedLogID\" from e",
    "header_unmatched": f"with {_FIELDS} select case when ty = 'error' then 3 else 1 end::bigint fields, ty <> 'error' whole_log, count(*) n from e group by all",
    "template_match": _MATCH,
    "template_match_udf": _MATCH,
    "template_not_found": f"with {_FIELDS} select ord, '<Not Found>' template, 0::bigint n_variables from e where ev > 2",
    "template_counts": f"""with {_FIELDS}, c as (select ty || ' by user=<*> value=<*> k=<*>' template, count(*) occurrences from e group by 1)
select template, occurrences, 'E' || row_number() over (order by occurrences desc, template) label from c""",
    "url_template": r"""select page_id, case when starts_with(url, 'http://') then 0 else 1 end::int event_id,
  regexp_extract(url, '^https?://(.*?)/(.*?)/(.*?)$', 1) host, regexp_extract(url, '^https?://(.*?)/(.*?)/(.*?)$', 2) lang, regexp_extract(url, '^https?://(.*?)/(.*?)/(.*?)$', 3) page from pages""",
    "json_parse": f"with {_FIELDS} select ord, ev event_id, u::varchar var_0, secs::varchar \"time\", u::varchar who, props from e join events on ord = event_id",
    "time_normalise": "select event_id ord, case when event_id % 8 < 6 then epoch(date_trunc('second', ts))::bigint when event_id % 8 = 6 then epoch(date_trunc('second', ts))::bigint - 7200 else 0 end \"seconds\" from events",
    "new_event": f"""with o as (select o_orderkey k, o_custkey c, row_number() over (order by o_orderkey) - 1 ord, count(*) over () n from orders),
x as (select ord, k, c from o where ord >= n * 4 // 5 and c not in (select c from o where ord < n * 4 // 5))
select ord, {_IDS.format("NewEvent")}, k::varchar log_ids, 1::double score, 'EventID ' || c || ' - {{}}=Unknown event ID: ''' || c || '''' found from x""",
    "new_value": _NEW_VALUE,
    "new_value_global": _variable_alerts("NewValue", """select ord, 'Global - Line' as key, 'Unknown value: ''' || ord || '''' as message from x
  union all select ord, 'EventID ' || ev || ' - var_2', 'Unknown value: ''' || k || '''' from x where (ev, k) not in (select ev, k from t)"""),
    "new_value_combo": _variable_alerts("Combo", "select ord, 'EventID ' || ev || ' - var_0, var_2' as key, 'Unknown value combination: (''' || u || ''', ''' || k || ''')' as message from x where (ev, u, k) not in (select ev, u, k from t)"),
    "value_range": _variable_alerts("Range", """select ord, 'EventID ' || ev || ' - ' || nm as key, 'Out of range value: ''' || val || ''' (' || lo || ' - ' || hi || ')' as message from (
    select ord, x.ev, nm, val, lo, hi from (select ord, ev, 'Line' nm, ord::varchar val, ord::double num from x) x
      join (select ev, min(ord)::varchar lo, max(ord)::varchar hi, min(ord) l, max(ord) h from t group by 1) m on x.ev = m.ev where num < l or num > h
    union all
    select ord, x.ev, 'var_1', txt, lo, hi from (select ord, ev, v::double num, case when v::double = floor(v::double) then v::double::bigint::varchar else v::double::varchar end txt from x) x
      join (select ev, min(v::double) l, max(v::double) h, case when min(v::double) = floor(min(v::double)) then min(v::double)::bigint::varchar else min(v::double)::varchar end lo,
        case when max(v::double) = floor(max(v::double)) then max(v::double)::bigint::varchar else max(v::double)::varchar end hi from t group by 1) m on x.ev = m.ev where num < l or num > h)"""),
    "charset": f"""with known as (select distinct unnest(string_split(text, '')) c from documents where lang = 'en'),
x as (select distinct doc_id ord, unnest(string_split(text, '')) c from documents where lang <> 'en'),
u as (select ord, string_agg('''' || c || '''', ', ' order by c) s from x where c not in (select c from known where c is not null) group by 1)
select ord, {_ALERT.format("Charset")}, 1::double score, 'EventID 0 - var_0=Unknown character(s): ' || s found from u""",
    "bigram_chances": f"""with {_FIELDS}, p as (select distinct ev, v from t), q as (select distinct ev, v from x),
pp as (select ev, unnest(range(0, len(v) + 1)) i, v from p), pc as (select ev, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b, count(*) n from pp group by all),
pr as (select ev, a, b, n / sum(n) over (partition by ev, a) pr from pc),
qq as (select ev, v, unnest(range(0, len(v) + 1)) i from q), qc as (select ev, v, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b from qq)
select qc.ev::varchar event, 'var_1' "name", v "value", round(avg(coalesce(pr, 0)), 9) chance from qc left join pr on qc.ev = pr.ev and qc.a = pr.a and qc.b = pr.b group by qc.ev, v""",
    "bigram_defaults": f"""with {_FIELDS}, p as (select distinct ev, v from t where ord < 50), q as (select distinct ev, v from x where ev in (select ev from p)),
pp as (select ev, unnest(range(0, len(v) + 1)) i, v from p), pc as (select ev, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b, count(*) n from pp group by all),
pr as (select ev, a, b, n / sum(n) over (partition by ev, a) pr from pc),
us as (select a::varchar a, b::varchar b, n / sum(n) over (partition by a) pr from (select a, b, 1 + (a * b) % 5 n from range(10) x(a), range(10) y(b))),
qq as (select ev, v, unnest(range(0, len(v) + 1)) i from q), qc as (select ev, v, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b from qq)
select qc.ev::varchar event, 'var_1' "name", v "value", round(avg(coalesce(pr.pr, us.pr, 0)), 9) chance from qc left join pr on qc.ev = pr.ev and qc.a = pr.a and qc.b = pr.b left join us on qc.a = us.a and qc.b = us.b group by qc.ev, v""",
    "bigram_alerts": f"""with {_FIELDS}, pp as (select ev, unnest(range(0, len(v) + 1)) i, v from t), pc as (select ev, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b, count(*) n from pp group by all),
pr as (select ev, a, b, n / sum(n) over (partition by ev, a) pr from pc),
qq as (select ord, ev, v, unnest(range(0, len(v) + 1)) i from x), qc as (select ord, ev, case when i = 0 then '' else v[i] end a, case when i = len(v) then '' else v[i + 1] end b from qq),
f as (select ord, avg(coalesce(pr, 0)) c from qc left join pr on qc.ev = pr.ev and qc.a = pr.a and qc.b = pr.b group by ord)
select ord, {_IDS.format("Bigram")}, 1::double score from f where c < 0.11""",
    "rules": f"""with c as (select row_number() over (order by conv_id, turn) - 1 ord, lower(text) t, role, turn from conversations),
f as (select ord, 'R001 - TemplateNotFound=No template found by parser' m from c where turn = 0
  union all select ord, 'R002 - SpecificKeyword=Found word ''' || case when contains(t, 'die') then 'die' when contains(t, 'the') then 'the' else 'la ' end || ''' in the logs' from c where contains(t, 'die') or contains(t, 'the') or contains(t, 'la ')
  union all select ord, 'R003 - CheckForExceptions=Found word ''' || case when contains(t, 'exception') then 'exception' when contains(t, 'fail') then 'fail' when contains(t, 'error') then 'error' else 'raise' end || ''' in the logs'
    from c where contains(t, 'exception') or contains(t, 'fail') or contains(t, 'error') or contains(t, 'raise')
  union all select ord, 'R004 - ErrorLevelFound=Error found' from c where role = 'user')
select ord, {_ALERT.format("Rules")}, n::double score, found from (select ord, count(*) n, string_agg(m, '; ' order by m) found from f group by ord)""",
    "numeric_filter": f"with {_FIELDS}, {_LONG} select event, \"name\", count(*) n, count(try_cast(\"value\" as double)) \"numeric\" from l group by all",
    "event_sequence": f"""with {_FIELDS}, {_windows(6)}, f as (select * from wx where events not in (select events from wt))
select ord, {_IDS.format("Sequence")}, array_to_string(ids, ',') log_ids, 1::double score,
  'Sequence (' || array_to_string(events, ', ') || ')=EventID sequence of length 6 ending at logID ' || ord || ' was not seen during training.' found from f""",
    "count_vectors": f"""with {_FIELDS}, {_windows(6)}, f as (select * from wx where {_VECTOR} not in (select {_VECTOR} from wt))
select ord, {_IDS.format("Vectors")}, array_to_string(ids, ',') log_ids, 1::double score, 'Count vector=Count vector not found' found from f""",
    "near_count_vectors": f"""with {_FIELDS}, {_windows(6)}, k as (select distinct {_VECTOR} vec from wt), q as (select ord, {_VECTOR} vec from wx),
u as (select distinct vec from q), {_NEAREST.format(out="dist", left="u", right="k")}
select ord, round(d, 9) distance from q join dist on q.vec = dist.vec where d > 0""",
    "near_count_vectors_mean": f"""with {_FIELDS}, {_windows(6)}, every as (select distinct {_VECTOR} vec from wt),
placed as (select vec, row_number() over (order by md5(array_to_string(vec[1:list_max(list_transform(range(1, 7), lambda p: case when vec[p] > 0 or p <= 2 then p else 0 end))], ',')), vec) - 1 o, count(*) over () n from every),
k as (select vec from placed where o < ceil(n * 0.6)), rest as (select vec from placed where o >= ceil(n * 0.6)),
{_NEAREST.format(out="dist", left="rest", right="k")}, th as (select coalesce(avg(d), 0) t from dist),
q as (select ord, {_VECTOR} vec from wx), u as (select distinct vec from q), {_NEAREST.format(out="dist2", left="u", right="k")}
select ord, round(d, 9) distance, round(t, 9) threshold from q join dist2 on q.vec = dist2.vec, th where d > t + 1e-12""",
    "next_event": f"""with {_NEXT.format(aside=_CHANCE.format('first_ord::varchar') + " < 0.2", fields=_FIELDS, windows=_windows(6))},
asked as (select r.rank from (select * from tr where aside) v join ranks r on v.events = r.events),
top as (select min(rank) + 2 top_k from (select rank, count(*) c, max(count(*)) over () m from asked where rank is not null group by rank) where c = m)
select ord, rank::int rank, top_k::int top_k from wx join ranks using (events), top""",
    "next_event_topk": f"""with {_NEXT.format(aside="false", fields=_FIELDS, windows=_windows(6))}, f as (select * from wx join ranks using (events) where coalesce(rank, 1000000) > 3)
select ord, {_IDS.format("Next")}, array_to_string(ids, ',') log_ids, 1::double score, 'Sequence=Next found an unlikely event' found from f""",
    "masked_events": f"""with {_FIELDS}, {_windows(6)}, pl as (select 't' part, ord, first_ord, events, ids, unnest(range(0, 6)) place from wt union all select 'x', ord, first_ord, events, ids, unnest(range(0, 6)) from wx),
pe as (select *, case when place = 0 then -2 else events[place] end bef, events[place + 1] ev, case when place = 5 then -2 else events[place + 2] end aft from pl),
known as (select bef, aft, ev from (select bef, aft, ev, row_number() over (partition by bef, aft order by count(*) desc, ev) r from pe where part = 't' group by bef, aft, ev) where r <= 3),
f as (select distinct ord, ids from pe where part = 'x' and {_CHANCE.format("first_ord::varchar || '|' || place::varchar || '|0'")} < 0.4 and (bef, aft, ev) not in (select bef, aft, ev from known))
select ord, {_IDS.format("Masked")}, array_to_string(ids, ',') log_ids, 1::double score, 'Sequence=Masked found unlikely events' found from f""",
    "random_detector": f"""with {_FIELDS}, f as (select * from e where {_CHANCE.format("ord::varchar || '|' || ev::varchar || '|var_0|0'")} > 0.99)
select ord, {_ALERT.format("Random")}, 1::double score, 'EventID ' || ev || ' - var_0=1.0' found from f""",
    "ordinals": "select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 ord from orders",
    "phase_units": "select case when event_id < 100 then 'configure' when event_id < 800 then 'train' else 'detect' end phase, count(*) n, min(event_id) \"first\" from events group by 1",
    "tumbling_windows": "select event_id // 7 \"window\", min(event_id) first_ord, string_agg(user_id::varchar, ',' order by event_id) users from events group by 1",
    "sliding_windows": """select event_id - 4 first_ord, event_id last_ord, array_to_string(list(user_id::varchar) over r, ',') users from events
window r as (order by event_id rows between 4 preceding and current row) qualify count(*) over r = 5""",
    "run_lengths": """with a as (select event_id ord, user_id % 4 k, value > 20 high from events), b as (select *, row_number() over (partition by k order by ord) - row_number() over (partition by k, high order by ord) g from a)
select k, high, min(ord) "start", count(*) n from b group by k, high, g""",
    "alert_concat": f"""with {_FIELDS}, a as (select ord, secs, row_number() over (order by ord) + 9 id from x where (ev, v) not in (select ev, v from t))
select id - 12 "window", array_to_string(list('NewValue_' || id) over r, ',') alert_ids, array_to_string(list(ord::varchar) over r, ',') log_ids, array_to_string(list(secs::varchar) over r, ',') times
from a window r as (order by ord rows between 2 preceding and current row) qualify count(*) over r = 3""",
    "stability_means": f"with {_FIELDS}, {_LONG}, {_SERIES_COUNT} select event, \"name\", n, kinds, {_ROUNDED} from c",
    "stability_means_time": f"with {_FIELDS}, {_LONG}, {_flags('l')}, {_SERIES_TIME} select event, \"name\", n, kinds, {_ROUNDED} from c2",
    "stability_classes": f"""with {_FIELDS}, {_LONG}, {_SERIES_COUNT}, {_SERIES_TIME},
v as (select c.event, c."name", c.n, c.kinds, (c.m0 < 1.1 and c.m1 < 0.3 and c.m2 < 0.1 and c.m3 < 0.01) and (c2.m0 < 1.1 and c2.m1 < 0.3 and c2.m2 < 0.1 and c2.m3 < 0.01) ok from c join c2 on c.event = c2.event and c."name" = c2."name")
select event, "name", {_CLASS.format('ok')} "class" from v""",
    "stability_range": f"""with {_FIELDS}, {_LONG}, f as (select event, "name", ord, try_cast("value" as double) x from l where try_cast("value" as double) is not null),
g as (select *, coalesce(x < min(x) over p or x > max(x) over p, true)::int changed, row_number() over (partition by event, "name" order by ord) - 1 i, count(*) over (partition by event, "name") n,
  case when min(x) over (partition by event, "name") = max(x) over (partition by event, "name") then 1 else 2 end kinds from f window p as (partition by event, "name" order by ord rows between unbounded preceding and 1 preceding)),
c as (select event, "name", count(*) n, max(kinds) kinds, {_MEANS} from (select *, {_COUNTED} s from g) group by all)
select event, "name", n, {_CLASS.format(_STABLE)} "class" from c""",
    "stability_charset": f"""with {_FIELDS}, {_LONG}, ch as (select event, "name", min(ord) ord, c from (select event, "name", ord, unnest(string_split("value", '')) c from l) group by event, "name", c),
fl as (select event, "name", ord, count(*) k from ch group by all),
g as (select l.event, l."name", l.ord, (fl.k is not null)::int changed, sum(coalesce(fl.k, 0)) over (partition by l.event, l."name") kinds, row_number() over (partition by l.event, l."name" order by l.ord) - 1 i, count(*) over (partition by l.event, l."name") n
  from l left join fl on l.event = fl.event and l."name" = fl."name" and l.ord = fl.ord),
c as (select event, "name", count(*) n, max(kinds)::bigint kinds, {_MEANS} from (select *, {_COUNTED} s from g) group by all)
select event, "name", kinds, {_CLASS.format(_STABLE)} "class" from c""",
    "auto_new_value": f"""with {_FIELDS}, a0 as (select ord, n, ev::varchar event, unnest(['var_0','var_1','var_2','Type','Time','Line','Epoch']) "name",
  unnest([u::varchar, v, k, ty, secs::varchar, ord::varchar, 'v' || (ord * 4 // n)]) "value" from e),
l as (select ord, event, "name", "value" from a0 where ord < n // 2), {_SERIES_COUNT},
ok as (select event, "name" from (select event, "name", {_CLASS.format(_STABLE)} cl from c) where cl in ('STABLE', 'STATIC')),
m as (select distinct event, "name", "value" from a0 where ord < n // 2 + n // 4),
found as (select ord, 'EventID ' || event || ' - ' || "name" as key, 'Unknown value: ''' || "value" || '''' as message from a0
  where ord >= n // 2 + n // 4 and (event, "name") in (select event, "name" from ok) and (event, "name") in (select event, "name" from m) and (event, "name", "value") not in (select event, "name", "value" from m))
select ord, {_ALERT.format("Auto")}, n::double score, found from (select ord, count(*) n, string_agg(key || '=' || message, '; ' order by key, message) found from found group by ord)""",
    "seq_length": f"with {_FIELDS} select max(len)::int length from ({_SEQ_CLASSES}) where class in ('STABLE', 'STATIC')",
    "history_retention": f"with {_FIELDS} select ord, ord::varchar \"logID\", ev event_id from e qualify row_number() over (partition by ev order by ord desc) <= 500",
    "event_history": f"with {_FIELDS} select ev event_id, count(*) n, max(ord) \"last\", max_by(u || '|' || v || '|' || k, ord) vars from e group by ev",
    "saved_model": _NEW_VALUE,
    "lifecycle_run": _NEW_VALUE,
    "config_coverage": "select * from (values ('2', 'no variables'), ('3', 'no variables'), ('77', 'unseen')) t(event, why)",
    "log_file": f"with {_FIELDS} select ord, ord::varchar \"logID\", {_LINE} log, 'file' \"logSource\", 'here' hostname from e",
    "json_lines_file": f"with {_FIELDS} select ord, ord::varchar \"logID\", {_LINE} log from e",
    "wire_file": f"with {_FIELDS} select ord, ord::varchar \"logID\", ev event_id, ty || ' by user=<*> value=<*> k=<*>' template, u || '|' || v || '|' || k vars, secs::varchar \"time\" from e",
    "indexed_json_file": "select row_number() over (order by n_nationkey) - 1 ord, n_nationkey::varchar \"logID\", n_name log from nation",
    "frame_records": "select event_id ord, event_type || ' by ' || user_id log, 7 event_id, event_type || ' by <*>' template, user_id::varchar vars, props, 2::bigint fields from events",
    "message_fields": f"with {_FIELDS} select ord, false complete, '' host, {_LINE} log, true same, '1.0.0' \"version\" from e",
    "audit_format": f"with {_FIELDS} select ord, ty \"type\", secs || ':' || ord \"time\", {_CONTENT} content from e",
    "tree_match": f"with {_FIELDS} select ord, case when ev < 3 then ev else -1 end::int event_id, case when ev < 3 then ty || ' by user=<*> value=<*> k=<*>' else 'template not found' end template, case when ev < 3 then {_TREE_VARS} else '' end vars from e",
    "mine_templates": f"with {_FIELDS} {_MINED}",
    "asked_templates": f"with {_FIELDS} {_MINED}",
    "coarse_groups": f"""with {_FIELDS}, g as (select array_to_string(list_sort([ty, 'user', 'value']), ' ') coarse, case when contains(v, '-') then '-.=' else '.=' end marks from e)
select coarse, coarse || ' | ' || marks fine, count(*) n from g group by all""",
    "cluster_lines": f"with {_FIELDS}, c as (select ord // 30000 chunk, ty, count(*) n, min(ord) f from e group by all) select chunk, (row_number() over (partition by chunk order by f) - 1)::int \"cluster\", n from c",
    "mean_shift_lines": f"with {_FIELDS} select ord // 30000 chunk, count(*) n from e group by chunk, ty",
    "line_keys": f"with {_FIELDS} select sha256(regexp_replace(regexp_replace(regexp_replace({_CONTENT}, '[0-9]', '', 'g'), '[/:,._-]+', '', 'g'), '\\s', '', 'g')) \"key\", count(*) n from e group by 1",
    "last_template": f"with {_FIELDS} select ev event_id, any_value(ty) || ' by user=<*> value=<*> k=<*>' template from e group by ev",
    "line_words": f"with {_FIELDS} select ty || ' by user value k' words, count(*) n from e group by 1",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
