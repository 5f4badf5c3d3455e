"""Graph documents hold a user's week of every month."""

from datetime import datetime, timedelta

import duckdb
import pytest

from flowloom import plans
from flowloom.plans.fixtures import monthly


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    """Two users with three events in the first week of three months."""
    d = tmp_path_factory.mktemp("months")
    kinds = ["click", "error", "view", "error", "signup", "click", "signup", "error", "view"]
    rows = [(u * 100 + i, u, datetime(2024, 1 + i // 3, 1 + i % 3) + timedelta(hours=u), kinds[i]) for u in (1, 2) for i in range(9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, user_id BIGINT, ts TIMESTAMP, event_type VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{d}/events.parquet'")
    return con, str(d)


@pytest.mark.parametrize("name, n", [("x13_direct_labels", 72), ("j8_symmetric_lookup", 16), ("g3_following_flows", 10), ("g4_merge_points", None), ("g7_reachability", 72), ("g12_branch_relations", None), ("x9_start_votes", None), ("t16_document_split", None)])
def test_months_share_a_document(spark, events, name, n):
    con, d = events
    got = [tuple(r) for r in plans.QUERIES[name](spark, d).collect()]
    assert sorted(got, key=repr) == sorted(con.execute(plans.ORACLES[name]).fetchall(), key=repr)
    assert n is None or len(got) == n


@pytest.mark.parametrize("name", ["g15_nested_gateways", "a2_nested_per_parent", "g10_without_merge", "x1_split_points", "x6_branch_starts", "x8_branch_relations", "t17_capped_relations"])
def test_more_queries_over_whole_documents(spark, events, name):
    """As SQL has them, and not what the months give each for itself."""
    con, d = events
    got = sorted((tuple(r) for r in plans.QUERIES[name](spark, d).collect()), key=repr)
    assert got == sorted(con.execute(plans.ORACLES[name]).fetchall(), key=repr)
    assert got != sorted(con.execute(monthly(plans.ORACLES[name])).fetchall(), key=repr)
