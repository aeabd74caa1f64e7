import os

import duckdb
import pytest

import __spark_entry__
from folium.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", ["quality_verdict", "region_routes", "margin_colors", "protected_bands", "wraptable_after_title", "extract_latex", "greedy_match", "reading_order_match", "open_envs", "table_bands", "plan_cuts", "seam_merge", "ink_runs", "escape_amp_hash", "unicode_to_macro", "settings_problems", "context_tail", "components"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in found.description]
    want = sorted((tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall()), key=repr)
    rows = catalogue.QUERIES[name](spark, SF)
    assert sorted((tuple(r[c] for c in sorted(rows.columns)) for r in rows.collect()), key=repr) == want
