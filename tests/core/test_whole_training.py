"""Queries of the catalog that learn from training learn from all of it: held against plain Python over the same tables."""

import pyarrow.parquet as pq
import pytest
from conftest import SF

from cinderlog.plans import catalog


def vectors(kinds, size, first, end):
    """(last place, count of each kind) of every window of `size` records in first..end."""
    return [(k, tuple(kinds[k - size + 1 : k + 1].count(t) for t in catalog.TYPES)) for k in range(first + size - 1, end)]


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_near_count_vectors(spark, sf):
    t = pq.read_table(f"{sf}/events.parquet", columns=["event_id", "event_type"]).sort_by("event_id").to_pydict()
    assert t["event_id"] == list(range(len(t["event_id"])))
    kinds, cut = t["event_type"], len(t["event_id"]) * 4 // 5
    known = {v for _, v in vectors(kinds, 6, 0, cut)}
    far = lambda v: min(1 - sum(map(min, v, k)) / sum(map(max, v, k)) for k in known)
    want = {o: round(far(v), 9) for o, v in vectors(kinds, 6, cut, len(kinds)) if v not in known}
    got = catalog.near_count_vectors(spark, sf).collect()
    assert {r.ord: r.distance for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("sf", [SF, SF.replace("0.001", "0.01")])
def test_new_event(spark, sf):
    t = pq.read_table(f"{sf}/orders.parquet", columns=["o_orderkey", "o_custkey"]).sort_by("o_orderkey").to_pydict()
    customers, cut = t["o_custkey"], len(t["o_custkey"]) * 4 // 5
    known = set(customers[:cut])
    want = [(o, f"NewEvent_{10 + i}", str(t["o_orderkey"][o]), f"Unknown event ID: '{customers[o]}'") for i, o in enumerate(o for o in range(cut, len(customers)) if customers[o] not in known)]
    got = [(r.ord, r.alertID, r.log_ids, r.found.partition("=")[2]) for r in catalog.new_event(spark, sf).orderBy("ord").collect()]
    assert got == want
