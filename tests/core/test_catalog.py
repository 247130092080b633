"""Queries of the catalog against their SQL, on the smallest tables; the driver compares all at a larger size."""

import duckdb
import pytest
from conftest import SF

from cinderlog.plans import catalog

NAMES = ["header_parse", "template_match", "json_parse", "time_normalise", "new_value_global", "value_range", "charset", "rules", "event_sequence", "near_count_vectors", "near_count_vectors_mean", "next_event", "masked_events", "stability_classes", "alert_concat", "seq_length", "history_retention", "auto_new_value", "mine_templates", "asked_templates", "cluster_lines", "wire_file", "saved_model"]


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for name in ("events", "documents", "pages", "orders", "conversations", "nation"):
        out.execute(f"create view {name} as from '{SF}/{name}.parquet'")
    return out


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = con.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert sorted(map(rounded, df.select(*columns).collect()), key=str) == sorted(map(rounded, found), key=str)


def test_every_oracle_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
