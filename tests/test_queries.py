import sys

import duckdb
import pytest

sys.path.insert(0, "tools")

import __spark_entry__ as entry  # noqa: E402
from tools.check_oracle import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
QUICK = ["bin_mean_min_count", "fold_split", "segments_regrid", "window_starts", "asof_roles", "interval_build",
         "parse_archive_text", "exact_medians", "contingency_day", "regression_scores", "leaderboard", "stream_bins"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "hss" in df.columns


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    left = entry.queries()[name](spark, SF).toPandas()
    assert compare(left, con.execute(entry.oracle_sql()[name]).df()) == ""


def test_no_cross_join_in_the_headline_plans(spark):
    for name in ("window_counts_sweep", "align_channels", "fold_split", "asof_roles"):
        plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
