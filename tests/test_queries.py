import pytest
from oracle import assert_same, connect

from weftwork.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert_same(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_loop_quota_paths_walk_all_edges(spark):
    names, after = ("signup", "view", "click", "error", "purchase"), {}
    events = spark.read.parquet(f"{SF}/events.parquet").orderBy("user_id", "event_id").collect()
    for a, b in zip(events, events[1:]):
        if a.user_id == b.user_id:
            after.setdefault(a.user_id, set()).add((names.index(a.event_type), names.index(b.event_type)))

    def walks(edges, path):
        if path[-1] == 4:
            return [path]
        return [w for s, d in edges if s == path[-1] and path.count(d) < (2 if d == 1 else 1) for w in walks(edges, [*path, d])]

    want = sorted((user, path) for user, edges in after.items() for path in walks(edges, [0]))
    assert sorted((r.user_id, r.path) for r in registry.QUERIES["loop_quota_paths"](spark, SF).collect()) == want
