"""k-hop expansion on hand-built ledgers (FIXTURES.md §3) and random graphs."""

from __future__ import annotations

import random

import pytest

from hoplens.operators.expand import hop_pairs, khop, seed_frontier
from hoplens.operators.labels import gate_seeds, label_set


def rows(df):
    return sorted(tuple(r) for r in df.select("seed_id", "id", "originalAddress", "label")
                  .collect())


def run(ledger, seeds, ids_of, caps=None, hops=4, labels=None):
    labels = labels if labels is not None else label_set(None, ids_of(seeds, "blacklist"))
    return khop(ledger, ids_of(seeds), labels=labels, hops=hops, caps=caps)


def test_self_transfer_puts_seed_in_hop1(ledger_of, ids_of):
    out = rows(run(ledger_of([(1, "A", "A", 5.0)]), ["A"], ids_of, hops=2))
    assert out == [("A", "A", "A", 1)]  # hop 2: A's only neighbour is its parent


def test_reciprocal_pair_has_no_step_back(ledger_of, ids_of):
    led = ledger_of([(1, "A", "B", 1.0), (2, "B", "A", 2.0)])
    assert rows(run(led, ["A"], ids_of)) == [("A", "B", "A", 1)]


def test_triangle_returns_to_seed(ledger_of, ids_of):
    led = ledger_of([(1, "S", "X", 1.0), (2, "X", "Y", 1.0), (3, "Y", "S", 1.0)])
    out = rows(run(led, ["S"], ids_of, hops=3))
    assert out == [("S", "S", "X", 3), ("S", "X", "S", 1), ("S", "X", "Y", 2),
                   ("S", "Y", "S", 1), ("S", "Y", "X", 2)]


def test_duplicate_edge_counts_once(ledger_of, ids_of):
    led = ledger_of([(1, "A", "B", 1.0), (1, "A", "B", 1.0)])
    assert rows(run(led, ["A"], ids_of, hops=1)) == [("A", "B", "A", 1)]


def test_two_parents_keep_smallest(ledger_of, ids_of):
    led = ledger_of([(1, "S", "X", 1.0), (1, "S", "Y", 1.0), (2, "X", "Z", 1.0),
                     (2, "Y", "Z", 1.0)])
    out = [r for r in rows(run(led, ["S"], ids_of, hops=2)) if r[3] == 2]
    assert ("S", "Z", "X", 2) in out and ("S", "Z", "Y", 2) not in out


def test_null_endpoint_is_dropped(ledger_of, ids_of):
    led = ledger_of([(1, "A", None, 1.0), (1, None, "A", 1.0)])
    assert rows(run(led, ["A"], ids_of)) == []


def test_unlabelled_seed_is_gated_out(ledger_of, ids_of):
    led = ledger_of([(1, "U", "B", 1.0)])
    labels = label_set(ids_of(["L"], "account"), ids_of(["K"], "blacklist"))
    assert rows(khop(led, ids_of(["U"]), labels=labels)) == []
    out = khop(led, ids_of(["U"]), labels=labels, require_labelled=False)
    assert rows(out) == [("U", "B", "U", 1)]


def test_empty_neighbourhood(ledger_of, ids_of):
    led = ledger_of([(1, "A", "B", 1.0)])
    assert rows(run(led, ["Q"], ids_of)) == []


def test_caps_keep_smallest_ids(ledger_of, ids_of):
    led = ledger_of([(1, "S", f"n{i}", 1.0) for i in range(10)])
    out = rows(run(led, ["S"], ids_of, caps=(3,), hops=1))
    assert [r[1] for r in out] == ["n0", "n1", "n2"]


def test_seed_gate_semi_join(ledger_of, ids_of):
    labels = label_set(ids_of(["B"], "account"), ids_of(["A", "A"], "blacklist"))
    got = sorted(r.seed_id for r in gate_seeds(ids_of(["A", "B", "C", "A"]), labels).collect())
    assert got == ["A", "B"]


def test_hop_pairs_directions(ledger_of, ids_of, spark):
    led = ledger_of([(1, "S", "X", 1.0), (2, "X", "Y", 1.0), (3, "Z", "X", 1.0),
                     (4, "X", "S", 1.0)])
    frontier = spark.createDataFrame([("S", "X", "S")], "seed_id string, id string, parent string")
    out = sorted(tuple(r) for r in hop_pairs(led, frontier, "out").collect())
    inn = sorted(tuple(r) for r in hop_pairs(led, frontier, "in").collect())
    assert out == [("S", "X", "Y")]
    assert inn == [("S", "X", "Z")]
    assert seed_frontier(ids_of(["S"])).collect()[0].parent is None


# ---- brute force on random graphs -------------------------------------------

def brute_khop(edges, seeds, labelled, hops, caps):
    adj = {}
    for a, b in edges:
        if a is None or b is None:
            continue
        adj.setdefault(a, set()).add(b)
        adj.setdefault(b, set()).add(a)
    out = set()
    for s in seeds:
        if s not in labelled:
            continue
        frontier = {s: None}
        for h in range(1, hops + 1):
            parents = {}
            for p, gp in frontier.items():
                for b in adj.get(p, ()):
                    if gp is not None and b == gp:
                        continue
                    parents[b] = min(parents.get(b, p), p)
            ids = sorted(parents)
            cap = caps[h - 1] if caps else None
            if cap is not None:
                ids = ids[:cap]
            frontier = {b: parents[b] for b in ids}
            out |= {(s, b, parents[b], h) for b in ids}
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("caps", [None, (3, 4, 2, 5)])
def test_khop_matches_brute_force(ledger_of, ids_of, seed, caps):
    rnd = random.Random(seed)
    nodes = [f"v{i}" for i in range(14)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(30)]
    seeds = rnd.sample(nodes, 4)
    labelled = set(seeds[:3])
    led = ledger_of([(i, a, b, 1.0) for i, (a, b) in enumerate(edges)])
    labels = label_set(None, ids_of(sorted(labelled), "blacklist"))
    got = rows(khop(led, ids_of(seeds), labels=labels, hops=4, caps=caps))
    assert got == brute_khop(edges, seeds, labelled, 4, caps)



FIXTURE = "/root/testdata/sf0.001"


@pytest.mark.skipif(not __import__("os").path.isdir(FIXTURE), reason="test data not present")
def test_fixture_properties(spark):
    from pyspark.sql import functions as F

    from hoplens.operators.labels import flag, blacklist_ratio
    from hoplens.sources import fixtures as fx

    led = fx.ledger(spark, FIXTURE)
    labels = label_set(fx.labelled(spark, FIXTURE), fx.blacklist(spark, FIXTURE))
    seeds = fx.seeds(spark, FIXTURE)
    caps = (30, 25, 20, 10)
    all_rows = rows(khop(led, seeds, labels=labels, caps=caps))
    # caps respected per seed and hop
    per = {}
    for s, _, _, h in all_rows:
        per[(s, h)] = per.get((s, h), 0) + 1
    assert all(n <= caps[h - 1] for (s, h), n in per.items())
    # no step straight back: a hop-h row never has the parent's own parent as id
    parent_of = {(s, i, h): p for s, i, p, h in all_rows}
    for s, i, p, h in all_rows:
        if h > 1:
            assert parent_of.get((s, p, h - 1)) is not None  # parent is in the previous hop
            assert parent_of[(s, p, h - 1)] != i
    # a multi-seed run is the union of single-seed runs
    singles = []
    for r in seeds.collect():
        one = spark.createDataFrame([(r.id,)], "id string")
        singles += rows(khop(led, one, labels=labels, caps=caps))
    assert sorted(singles) == all_rows
    # ratio within [0, 1]
    hop2 = khop(led, seeds, labels=labels, hops=2, caps=None).where(F.col("label") == 2)
    ratios = blacklist_ratio(flag(hop2, fx.blacklist(spark, FIXTURE)), seeds).collect()
    assert all(r.ratio is None or 0.0 <= r.ratio <= 1.0 for r in ratios)


def test_khop_with_hub_matches_brute_force(ledger_of, ids_of):
    # one account carries most transfers (and many duplicate copies of one edge)
    rnd = random.Random(7)
    nodes = [f"v{i:02d}" for i in range(40)]
    edges = [("hub", rnd.choice(nodes)) for _ in range(120)] + [("hub", "v01")] * 200
    edges += [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(40)]
    edges += [(rnd.choice(nodes), "hub") for _ in range(60)]
    seeds = ["v01", "v02", "hub"]
    led = ledger_of([(i, a, b, 1.0) for i, (a, b) in enumerate(edges)])
    labels = label_set(None, ids_of(seeds, "blacklist"))
    for caps in (None, (5, 5, 5, 5)):
        got = rows(khop(led, ids_of(seeds), labels=labels, hops=3, caps=caps))
        assert got == brute_khop(edges, seeds, set(seeds), 3, caps)


def test_khop_without_materialisation_matches(ledger_of, ids_of):
    rnd = random.Random(11)
    nodes = [f"v{i}" for i in range(12)]
    edges = [(rnd.choice(nodes), rnd.choice(nodes)) for _ in range(25)]
    led = ledger_of([(i, a, b, 1.0) for i, (a, b) in enumerate(edges)])
    labels = label_set(None, ids_of(nodes[:3], "blacklist"))
    lazy = rows(khop(led, ids_of(nodes[:4]), labels=labels, caps=(3, 3, 3, 3), checkpoint=False))
    assert lazy == brute_khop(edges, nodes[:4], set(nodes[:3]), 4, (3, 3, 3, 3))
