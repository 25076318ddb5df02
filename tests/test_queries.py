"""A cross-section of the registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tools.check import connect, rows_of

SMALL = "/root/testdata/sf0.001"
NAMES = (
    "feature_stats", "parse_measure", "width_provenance", "override_diff", "densified_points", "dem_sample", "crossings", "nearest_road",
    "junctions", "affected_chunks", "shortest_distances", "customization_writes", "vegetation", "tile_visits", "opening_errors",
    "normalized_features", "import_diagnostics", "snapshot_rows", "preview_report", "snapped_edges", "override_upsert", "exact_reuse",
)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SMALL)
    cursor = connect(SMALL).execute(entry.oracle_sql()[name])
    want, columns = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got, names = rows_of(df.columns, df.collect())
    assert (names, got) == (columns, want)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
