"""Star, ball, degree, vertex and component operators on a small graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from hoplens.operators import explore
from hoplens.operators.labels import label_set

EDGES = [(1, "S", "A", 1.0), (2, "B", "S", 1.0), (3, "A", "C", 1.0), (4, "A", "C", 1.0),
         (5, "C", "D", 0.0), (6, "E", "C", 1.0), (7, "T", "A", 1.0), (8, "A", "A", 1.0)]


def test_star_edges_and_vertices(ledger_of, ids_of):
    g = ledger_of(EDGES)
    both = explore.star_edges(g, ids_of(["S"]), "both")
    assert sorted((r["from"], r["to"]) for r in both.collect()) == [("B", "S"), ("S", "A")]
    labels = label_set(None, ids_of(["B"], "blacklist"))
    v, e, smp = explore.star_export(g, ids_of(["S"]), ids_of(["A"]), ids_of(["T"]), labels,
                                    fraction=1.0)
    assert sorted((r.id, r.label) for r in v.collect()) == [
        ("A", 0), ("B", 1), ("C", 0), ("S", 0), ("T", 0)]
    assert sorted((r["from"], r["to"]) for r in e.collect()) == [
        ("A", "A"), ("A", "C"), ("B", "S"), ("S", "A"), ("T", "A")]
    assert smp.count() == 1
    none = explore.star_export(g, ids_of(["S"]), ids_of(["A"]), ids_of(["T"]), labels,
                               fraction=0.0)[2]
    assert none.count() == 0


def test_sample_methods_are_bernoulli(ledger_of):
    g = ledger_of([(i, f"x{i}", f"y{i}", 1.0) for i in range(2000)])
    n_hash = explore.sample_rows(g, 0.25, 10, "hash").count()
    n_bern = explore.sample_rows(g, 0.25, 10, "bernoulli").count()
    assert 380 < n_hash < 620 and 380 < n_bern < 620
    assert explore.sample_rows(g, 0.25, 10, "hash").count() == n_hash  # stable


def test_ball_levels_and_edges(ledger_of, ids_of):
    g = ledger_of(EDGES)
    n1, b2, b3, b4 = explore.ball_levels(g, ids_of(["S"]))
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(n1) == ["A"]
    assert ids(b2) == ["A", "C"]
    assert ids(b3) == ["A", "C", "D", "E", "S", "T"]
    assert ids(b4) == ["A", "B", "C", "D", "E", "S", "T"]
    edges = explore.ball_edges(g, b2)
    assert ("E", "C") in [(r.source, r.target) for r in edges.collect()]
    labels = label_set(None, ids_of(["B", "E"], "blacklist"))
    cnt = explore.labelled_count(explore.with_labels(b4, labels), ids_of(["S", "Q"]))
    assert sorted((r.seed_id, r.n) for r in cnt.collect()) == [("Q", 0), ("S", 2)]


def test_out_degree_and_multi_edges(spark, ledger_of):
    g = ledger_of(EDGES)
    ids = spark.createDataFrame([("S", "A"), ("S", "C")], "seed_id string, id string")
    deg = explore.out_degree(g, ids)
    assert sorted((r["from"], r.number) for r in deg.collect()) == [("A", 3), ("C", 1)]
    assert [r["from"] for r in explore.multi_edges(deg, (3,)).collect()] == ["A"]


def test_vertices_and_components(spark, ledger_of, ids_of):
    g = ledger_of(EDGES + [(9, "Z", None, 1.0)])
    v = explore.all_vertices(g)
    assert sorted(r.id for r in v.collect()) == ["A", "B", "C", "D", "E", "S", "T", "Z"]
    comps = spark.createDataFrame([("B", 7), ("E", 7), ("Q", 7), ("S", 8)],
                                  "id string, component int")
    labels = label_set(ids_of(["Q"], "account"), ids_of(["B", "S"], "blacklist"))
    got = explore.component_labelled(comps, labels, g, 7)
    assert sorted(r.id for r in got.collect()) == ["B"]
    assert explore.component_labelled(comps, labels, g).where(F.col("id") == "S").count() == 1
