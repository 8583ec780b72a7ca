"""Registered queries against their SQL twins on the smallest tables.

A representative part runs by default; LEVELLOOM_ALL=1 runs every query.
"""

import os

import pytest

from levelloom.checks import REGISTRY
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
CORE = """
parity_gap_reset parity_cross_onset quality_ranking blacklist filter_quality quota_intake cohort_reference bucket_info genre_of_tags split_percent
encode_levels decode_events pair_arcs mirror_tokens structured_slots grammar_report parse_v3 parse_v2 parse_rejects frames_variable_tempo
playability_report check_playability onset_scores content_metrics leaderboard_top predict_onsets sequence_samples lighting_samples onset_windows
cap_density convert_dots fix_parity calm_flips reconnect_arcs smooth_lights classify_sections section_lights color_lights stream_parity stream_sessions
quality_metrics map_index level_fragments parse_tempo note_intervals onset_mean_scores epoch_sample events_with_lights log_scan manifest_files reference_scan stream_utilisation stream_leaderboard
""".split()
NAMES = list(REGISTRY) if os.environ.get("LEVELLOOM_ALL") else CORE


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    if q.sql is None:
        assert df.count() > 0
        return
    problem, _ = compare(df, con, q.sql)
    assert problem is None, problem


def test_every_query_has_a_sql_twin_or_a_reason():
    assert [n for n, q in REGISTRY.items() if q.sql is None] == []
