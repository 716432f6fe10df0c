"""Measured reads of layouts."""

import pytest

from meterline.operators import insights
from meterline.plans import measure, queries
from meterline.plans.queries import LAYOUT_PAIRS, QUERIES, SQL
from tests.oracle import connection, same


def test_reads(spark, sf):
    reads = QUERIES["layout_reads"](spark, sf)
    rows = {r.layout: r for r in reads.collect()}
    assert set(rows) == {"parquet", "csv", "partitioned", "flat", "broadcast", "sort_merge"}
    assert rows["parquet"].bytes_read < rows["csv"].bytes_read and rows["partitioned"].rows_read < rows["flat"].rows_read <= rows["parquet"].rows_read
    assert rows["broadcast"].shuffle_bytes < rows["sort_merge"].shuffle_bytes
    facts = insights.comparison_findings(reads, LAYOUT_PAIRS).collect()
    assert [f.fact for f in facts] == list(LAYOUT_PAIRS) and all("times the bytes" in f.text for f in facts)
    assert measure.measured(spark, lambda: spark.range(0).selectExpr("count(*)"))["bytes_read"] == 0


@pytest.mark.parametrize("name", ["layout_rows", "parse_events_all_months", "clean_stream_all_months", "zone_metrics_all_months", "append_final_windows_all_months", "update_running_windows_all_months"])
def test_queries(spark, sf, name):
    same(connection(sf), SQL[name], QUERIES[name](spark, sf))


def test_the_flat_layout_is_not_written_twice(spark, sf, monkeypatch):
    written = []
    for name in ("write_flat_copy", "write_csv_copy", "write_curated"):
        monkeypatch.setattr(queries.trips, name, lambda df, path, name=name, write=getattr(queries.trips, name): (written.append(name), write(df, path)))
    ways = queries.layouts(spark, sf)
    assert sorted(written) == ["write_csv_copy", "write_curated"]
    answers = {name: sorted(map(tuple, ways[name]().collect())) for name in ways}
    assert answers["parquet"] == answers["csv"] and answers["flat"] == answers["partitioned"] and answers["broadcast"] == answers["sort_merge"]
