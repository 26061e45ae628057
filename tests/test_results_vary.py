"""No result column of an oracle is constant on the small tables, but for those listed here, so that agreement says something."""

import os

import duckdb
import pytest

from pulseloom.plans import analysis, core, learning, notes, outcomes, registry, relational, rollups, storage, streams  # noqa: F401

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are absent")

#: Constant by what they ask for: one row, one person, one name, one date, or all of a kind.
BY_MEANING = {
    "agg_20_system_statistics": {"readings_1d", "users_1d", "readings_7d", "users_7d", "readings_30d", "users_30d", "readings"},
    "cor_6_cross_correlation": {"lag", "r", "n"}, "cor_8_lead_lag": {"lag", "r", "n", "leads"}, "jon_11_overlapping": {"a"}, "prj_9_list_alerts": {"is_resolved"}, "rpt_1_daily_reports": {"report_date", "series"}, "src_1_metric_scan": {"user_id"},
}
#: Constant on these tables: a month of readings of five types without nulls or repeats, and documents of invented words.
BY_DATA = {
    "agg_16_ingestion_audit": {"days", "nulls", "future", "repeated"}, "agg_28_user_profile": {"quality"}, "agg_31_report_evolution": {"kinds"}, "agg_32_grid_patterns": {"n"}, "agg_33_json_fill_rate": {"key", "rate"}, "agg_6_circadian_context": {"hours"},
    "fcs_2_forecast_features": {"month"}, "fcs_8_forecast_ensemble": {"best"}, "int_4_intervention_summary": {"assessment", "recommendation"}, "pat_10_response_consistency": {"consistency"}, "pat_2_associations": {"n", "association"},
    "tst_8_normality": {"p", "is_normal"}, "tst_9_confidence_factors": {"enough"}, "txt_2_historical_context": {"tags"}, "txt_4_prepare_and_tag": {"tags"}, "win_12_integrity_report": {"missing_types"},
}


def test_results_vary():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = {}
    for name, sql in registry.ORACLES.items():
        result = c.execute(sql)
        names, rows = [x[0] for x in result.description], result.fetchall()
        assert rows, f"{name} has no rows"
        constant = {n for i, n in enumerate(names) if len({str(r[i]) for r in rows}) == 1}
        if constant:
            found[name] = constant
    assert found == BY_MEANING | BY_DATA
