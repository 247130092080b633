from conftest import SF

from cinderlog.operators import clustering
from cinderlog.plans import catalog


def test_cluster_lines_uses_whole_chunks(spark):
    """10,000 lines are fewer than one chunk's."""
    rows = catalog.cluster_lines(spark, SF.replace("0.001", "0.01")).collect()
    assert clustering.CHUNK == 30_000 and {r.chunk for r in rows} == {0}
    assert len(rows) == len(catalog.TYPES) and sum(r.n for r in rows) == 10_000
