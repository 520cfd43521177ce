"""The training-data queries that SQL can express against DuckDB, and the
pipeline stage by stage against brute force, on sf0.001."""

from __future__ import annotations

import itertools
import math
import os
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("hoplens.llm")
import corpus_pipeline  # noqa: E402
from hoplens.llm import common, mixing, oracle, probminhash, quality, queries  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_matches_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(oracle.SQL[name])
    names = [d[0] for d in rel.description]
    want = sorted(map(repr, rel.fetchall()))
    con.close()
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert want and sorted(repr(tuple(r)) for r in df.select(*names).collect()) == want


def near_groups(rows):
    """{doc_id: smallest doc_id of its group}, over all pairs of documents."""
    sets = {}
    for r in rows:
        words = (r.text or "").split()
        n = min(5, len(words))
        count = Counter(hash(tuple(words[i:i + n])) & (1 << 63) - 1 for i in range(len(words) - n + 1)) if n else {}
        keys = np.array(sorted(count), np.uint64)
        sets[r.doc_id] = keys, np.array([count[int(k)] for k in keys], float)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if len(a[0]) and len(b[0]) and probminhash.probability_jaccard(*a, *b) >= 0.8 - 1e-9:
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def test_pipeline_stage_by_stage(spark):
    docs = queries.table(spark, SF, "documents")
    frames, out = {}, docs
    for name, step in corpus_pipeline.STAGES:
        out = frames[name] = common.stage(step(spark, out, SF), name)
        assert name == "packed" or out.columns == docs.columns
    rows = {name: df.collect() for name, df in frames.items()}
    before = docs.collect()
    ids = lambda rs: sorted(r.doc_id for r in rs)
    assert len({r.doc_id for r in before}) == len(before)
    score = quality.score_documents(docs, queries.table(spark, SF, "labels")).collect()
    assert ids(rows["quality_filter"]) == ids(r for r in score if r.score >= quality.CUT)
    last = {}
    for r in rows["quality_filter"]:
        last[r.text or ""] = max(r.doc_id, last.get(r.text or "", r.doc_id))
    assert ids(rows["exact_deduplication"]) == sorted(last.values()) and len(last) < len(rows["quality_filter"])
    group = near_groups(rows["exact_deduplication"])
    assert ids(rows["near_deduplication"]) == sorted(set(group.values())) and len(set(group.values())) < len(group)
    words = {r.doc_id: len((r.text or "").split()) for r in before}
    source = {r.doc_id: r.source for r in before}
    whole, taken = Counter(), Counter()
    for r in rows["near_deduplication"]:
        whole[r.source] += words[r.doc_id]
    for r in rows["source_mix"]:
        taken[r.source] += words[r.doc_id]
    order = sorted(whole, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % len(mixing.WEIGHTS)] for i, s in enumerate(order)}
    want, left = {}, set(order)
    while True:
        rest = (sum(whole.values()) - sum(want.values())) / sum(weight[s] for s in left)
        over = {s for s in left if rest * weight[s] > mixing.MAX_REPEATS * whole[s]}
        if not over:
            break
        want |= {s: mixing.MAX_REPEATS * whole[s] for s in over}
        left -= over
    want |= {s: rest * weight[s] for s in left}
    copies = Counter(r.doc_id for r in rows["source_mix"])
    assert set(copies) <= set(ids(rows["near_deduplication"]))
    for i in ids(rows["near_deduplication"]):
        share = want[source[i]] / whole[source[i]]
        assert math.floor(share + 1e-9) <= copies[i] <= math.ceil(share - 1e-9)
    most = {s: max(words[r.doc_id] for r in rows["near_deduplication"] if r.source == s) for s in order}
    assert all(abs(taken[s] - want[s]) <= most[s] for s in order)
    kept = {r.doc_id: tuple(r) for r in before}
    assert all(tuple(r) == kept[r.doc_id] for n in list(frames)[:-1] for r in rows[n])
    packed = Counter()
    for r in rows["packed"]:
        packed[r.doc_id] += r.n_words
    assert packed == Counter({i: n * words[i] for i, n in copies.items()})
    run = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(str, run)) == sorted(map(str, rows["packed"]))
