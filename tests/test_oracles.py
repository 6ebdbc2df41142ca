"""Registered queries against their SQL on the smallest tables.

A spread of them by default; KG_ALL=1 runs every one (minutes).
"""

import os

import pytest

from kgspark import plans
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
SOME = ["stats_by_type", "resolve_alias", "mentioned_in_topn", "fixed_chunks", "cosine_topk", "event_poll", "crossref_upsert",
        "page_metadata", "upsert_latest", "code_sql_symbols", "trigram_pairs", "content_hash_diff"]
NAMES = list(plans.QUERIES) if os.environ.get("KG_ALL") else SOME


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name, plans.QUERIES[name], plans.ORACLES.get(name))
    assert ok, note


def test_every_query_is_wired():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.FLAGSHIP in entry.queries()
