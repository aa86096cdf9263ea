"""Every registered query against its SQL."""

import pytest

from tidemark.plans import queries as q

from .conftest import SF, same


#: Queries whose rows come in an order that is part of the result.
ORDERED = {
    "search_sessions", "list_sessions_page", "active_sessions", "search_events", "events_json_filter", "cosine_topk", "full_text_search",
    "full_text_all_roles", "search_tool_events", "vector_search_filtered",
}


@pytest.mark.parametrize("name", list(q.QUERIES))
def test_query(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    got = df.toPandas()
    if name in q.ORACLES:
        want = duck.execute(q.ORACLES[name]).df()
        same(got, want, name in ORDERED)
        assert len(got) or name in ("missing_sequences", "search_tool_events")
        for c in df.columns:  # whole numbers, numbers, texts and the like stay what they are
            assert got[c].dtype.kind == want[c].dtype.kind or got[c].isna().any() or want[c].isna().any(), c
    else:
        assert len(got)
