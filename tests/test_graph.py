import random
from itertools import permutations

import pytest

from tidemark.operators import graph

TRANSFER = "from_account string, to_account string, amount_paid double, timestamp timestamp"


def frame(spark, pairs):
    from datetime import datetime, timedelta
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(a, b, 100.0, start + timedelta(hours=i))
                                  for i, (a, b) in enumerate(pairs)], TRANSFER)


def ring(names):
    return list(zip(names, names[1:] + names[:1]))


def each(sources, targets):
    return [(a, b) for a in sources for b in targets]


def named(prefix, n):
    return [f"{prefix}{i}" for i in range(n)]


# One of each pattern, of sizes that tell them apart: a ring of 4, a hub with 5 payers and
# 3 payees, 2 accounts that share 3 payees, and 4 ways from one account to another.
PLANTED = (ring(named("ring", 4)) + each(named("payer", 5), ["hub"]) + each(["hub"], named("payee", 3))
           + each(named("twin", 2), named("shared", 3)) + each(["start"], named("relay", 4)) + each(named("relay", 4), ["goal"]))


@pytest.fixture(scope="module")
def found(spark):
    return graph.find_patterns(frame(spark, PLANTED))


def test_cycle(found):
    rows = found.parts["cycles"].collect()
    assert [(r.accounts, r.length, r.transaction_count, r.total_amount) for r in rows] == [
        (named("ring", 4), 4, 4, 400.0)]


def test_hubs(found):
    fan_in = {r.account: r for r in found.parts["fan_in"].collect()}
    assert {a: r.degree for a, r in fan_in.items()} == {"hub": 5, "goal": 4}
    assert fan_in["hub"].counterparties == named("payer", 5)
    fan_out = {r.account: r.degree for r in found.parts["fan_out"].collect()}
    assert fan_out == {"hub": 3, "start": 4, "twin0": 3, "twin1": 3}
    assert [r.hub for r in found.parts["gather_scatter"].collect()] == ["hub"]


def test_bipartite_and_scatter_gather(found):
    row, = found.parts["bipartite"].collect()
    assert (row.source_a, row.source_b, row.edge_count) == ("twin0", "twin1", 6)
    assert row.destinations == named("shared", 3)
    row, = found.parts["scatter_gather"].collect()
    assert (row.source, row.destination, row.path_count) == ("start", "goal", 4)
    assert row.intermediaries == named("relay", 4)


def test_memberships_and_their_signals(spark):
    members = graph.pattern_membership(graph.build_edges(frame(spark, PLANTED)))
    got = {(r.account, r.pattern): (r.size, r.strength) for r in members.collect()}
    assert got["hub", "fan_in"] == (5, 5 / 8) and got["hub", "fan_out"] == (3, 0.5) and got["twin1", "bipartite"] == (3, 3 / 5)
    assert {a for a, p in got if p == "cycle"} == set(named("ring", 4)) and got["ring0", "cycle"] == (1, 0.5)
    signals = {r.entity_id: (r.score, sorted(r.flags)) for r in graph.graph_signals(members).collect()}
    assert signals["hub"] == (5 / 8, ["fan_in", "fan_out"]) and signals["twin0"] == (3 / 5, ["bipartite", "fan_out"])


def test_summary_and_limits(spark, found):
    row = found.parts["summary"].first()
    n = len({x for pair in PLANTED for x in pair})
    assert (row.input_rows, row.edges, row.self_loops) == (len(PLANTED), len(PLANTED), 0)
    assert row.nodes == n and row.density == round(len(PLANTED) / (n * (n - 1)), 8)
    df = frame(spark, PLANTED)
    with pytest.raises(ValueError):
        graph.find_patterns(df, max_results=0)
    with pytest.raises(ValueError, match="amount_paid"):
        graph.build_edges(df.drop("amount_paid"))


def test_parallel_blank_and_acyclic(spark):
    df = frame(spark, [("A", "B"), ("A", "B"), (" ", "B"), ("B", "C"), ("C", "D")])
    edges = graph.build_edges(df)
    rows = {(r.src, r.dst): r.transaction_count for r in edges.collect()}
    assert rows == {("A", "B"): 2, ("B", "C"): 1, ("C", "D"): 1}
    assert graph.cycles(edges).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    pairs = {(rng.choice(names), "n0" if rng.random() < .3 else rng.choice(names)) for _ in range(40)}
    pairs |= {("n0", n) for n in rng.sample(names, 5)}
    want = {ring for k in (2, 3, 4) for ring in permutations(names, k)
            if ring[0] == min(ring)
            and all((ring[i], ring[(i + 1) % k]) in pairs for i in range(k))}
    edges = graph.build_edges(frame(spark, sorted(pairs)))
    got = [tuple(r.accounts) for r in graph.cycles(edges).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    want_of = {}
    for ring in want:
        for account in ring:
            want_of[account, len(ring)] = want_of.get((account, len(ring)), 0) + 1
    per = {(r.account, r.length): r for r in graph.cycle_accounts(edges).collect()}
    assert {k: r.cycle_count for k, r in per.items()} == want_of
    assert all(r.transaction_count == r.cycle_count * r.length and r.total_amount == 100.0 * r.transaction_count
               for r in per.values())
    assert {len(g) for g in (tuple(r.accounts) for r in graph.cycles(edges, 2).collect())} <= {2}


def test_pair_queries_list_every_pair(spark, tmp_path):
    """Whole pairs and their counts per account, on shared targets of 3 payers and two-hop ways through 3 others."""
    import duckdb
    import __spark_entry__ as contract
    from datetime import datetime, timedelta
    rows = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), a, "view", 5.0, '{"k": %d}' % b)
            for i, (a, b) in enumerate(each([1, 2, 3], [11, 12, 13]) + each([11, 12, 13], [1, 20]) + [(1, 11), (4, 11)])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
         .write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    for name, columns in (("graph_bipartite", ["source_a", "source_b", "destination_count", "edge_count"]),
                          ("graph_scatter_gather", ["source", "destination", "path_count"]),
                          ("graph_bipartite_accounts", ["account", "pair_count", "edge_count", "widest"]),
                          ("graph_scatter_gather_accounts", ["account", "as_source", "as_destination", "path_count", "widest"])):
        got = contract.queries()[name](spark, str(tmp_path)).select(columns).collect()
        want = con.execute(f"select {', '.join(columns)} from ({contract.oracle_sql()[name]})").fetchall()
        assert want and sorted(map(tuple, got)) == sorted(want), name


def test_cycles_leave_dead_ends_out(spark):
    """Payers nobody pays, and payees that pay nobody, are on no cycle: no way is built through them."""
    dead = each(named("payer", 20), ["x", "y"]) + each(["x", "y"], named("payee", 20)) + [("first", "payer0"), ("payee0", "last")]
    edges = graph.build_edges(frame(spark, ring(["x", "y", "z"]) + dead + [("x", "z"), ("z", "y"), ("y", "x")]))
    ways = graph.square_paths(edges).collect()
    assert ways and {a for r in ways for a in (r.top, r.opposite, r.middle)} == {"x", "y", "z"}
    assert {(r.account, r.length): r.cycle_count for r in graph.cycle_accounts(edges).collect()} == {
        (a, n): c for a in "xyz" for n, c in ((2, 2), (3, 2))}
