"""Training-data operators against brute force, plus nulls, ties and empty tables."""

from __future__ import annotations

import hashlib
import itertools
import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("hoplens.llm")
from pyspark.sql import functions as F  # noqa: E402

from hoplens.llm import (common, embedding_dedup, exact_dedup, language, mixing, packing, pii,  # noqa: E402
                         probminhash, quality, queries, repeats, warc)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _x int"


def docs_of(spark, rows):
    """Rows (doc_id, text[, lang, source]) with clashing extra columns."""
    full = [(r[0], r[1], *(list(r[2:]) + ["en", "s"])[:2], len(r[1] or ""), "k", 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


BASE = " ".join(f"w{i}" for i in range(60))
ODD = [(1, "a b c"), (2, None), (3, ""), (4, "a b c"), (None, "x y"), (5, "same"), (5, "same"), (5, "other"),
       (6, BASE), (7, BASE + " end"), (8, "é " * 3000), (9, " \t\n ")]


def by_id(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is not None, r[key] or 0, str(r)))


def test_exact_dedup_odd_rows(spark):
    out = by_id(exact_dedup.exact_duplicates(docs_of(spark, ODD), block_bytes=16))
    assert len(out) == len(ODD)
    groups = {}
    for i, t in ODD:
        groups.setdefault(hashlib.sha256((t or "").encode()).hexdigest(), []).append(i)
    for r in out:
        ids = groups[r["text_sha256"]]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == max(ids, key=lambda i: -1 if i is None else i)
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    assert kept == Counter(groups.keys())
    left = exact_dedup.drop_duplicates(docs_of(spark, ODD), block_bytes=16)
    assert left.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert left.count() == len(groups)


def test_exact_dedup_blocks_of_all_lengths(spark):
    rows = [(i, "ab" * (i % 37)) for i in range(150)]
    out = exact_dedup.exact_duplicates(docs_of(spark, rows), block_bytes=4).collect()
    assert all(r.kept == (r.doc_id == r.keep_id) and r.keep_id % 37 == r.doc_id % 37 for r in out)
    assert sum(r.kept for r in out) == 37


def brute_repeats(rows, length):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] is not None, r[1] or "")):
        b = (t or "").encode()
        cover = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s:s + length]
            cover[s:s + length] |= w in seen
            seen.add(w)
        spans = int(cover[:1].sum()) + int((cover[1:] & ~cover[:-1]).sum())
        keep = hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~cover])).hexdigest()
        out.append((i, len(b), int(cover.sum()), spans, keep))
    return sorted(out, key=str)


@pytest.mark.parametrize("suffixes", [1 << 22, 1 << 9])
def test_repeats_match_brute_force(spark, monkeypatch, suffixes):
    monkeypatch.setattr(repeats, "SUFFIXES", suffixes)  # the small one sends triggers across tasks
    monkeypatch.setattr(repeats, "CHUNK", 1 << 10)
    monkeypatch.setattr(repeats, "COMBINE", 1 << 8)
    rng = np.random.default_rng(3)
    words = ["ab", "cde", "f", "ghij", "éü", "aa", "aaaa"]
    text = lambda n: " ".join(rng.choice(words, n))
    shared = text(80)
    rows = [(i, text(30) + (shared[:int(rng.integers(20, len(shared)))] if i % 2 else "") + text(20))
            for i in range(60)] + ODD + [(100, "a" * 3000), (101, "ab" * 900)]
    got = sorted((tuple(r) for r in repeats.remove_repeats(docs_of(spark, rows), 40, 12).collect()), key=str)
    assert got == brute_repeats(rows, 40)


def test_near_duplicates_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    monkeypatch.setattr(probminhash, "FAN", 3)
    rng = np.random.default_rng(5)
    rows = []
    for g in range(12):
        words = [f"v{x}" for x in rng.integers(0, 5000, 120)]
        for c in range(8):
            w = list(words)
            for at in rng.integers(0, 120, c):
                w[at] = f"z{rng.integers(0, 9999)}"
            rows.append((len(rows) * 3, " ".join(w)))
    rows += [(1000 + (i or 0), t) for i, t in ODD]
    counts = {}
    for i, t in rows:
        w = (t or "").split()
        n = min(5, len(w))
        counts[i, t] = Counter(tuple(w[j:j + n]) for j in range(len(w) - n + 1)) if w else Counter()
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, x), (b, y) in itertools.combinations(counts.items(), 2):
        if x and y and a[0] != b[0]:
            union = x.keys() | y.keys()
            j = sum(1 / sum(max(x[u] / x[s], y[u] / y[s]) for u in union) for s in x.keys() & y.keys())
            if j >= 0.8 - 1e-9:
                p, q = find(a[0]), find(b[0])
                parent[max(p, q)] = min(p, q)
    out = probminhash.near_duplicate_groups(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    unique = Counter(i for i, _ in rows)
    assert all(r.class_id == find(r.doc_id) for r in out if unique[r.doc_id] == 1)
    assert sum(r.kept for r in out) == len({(r.class_id, r.class_size) for r in out if r.doc_id not in
                                            {1005}}) + len([1 for r in out if r.doc_id == 1005 and r.kept])


def test_near_duplicates_of_a_null_id(spark):
    words = [f"n{i}" for i in range(120)]
    rows = [(None, " ".join(words)), (7, " ".join(words) + " end"), (8, "start " + " ".join(words)),
            (3, " ".join(words) + " end"), (9, BASE)]
    out = {r.doc_id: r for r in probminhash.near_duplicate_groups(docs_of(spark, rows)).collect()}
    assert {i: (r.class_id, r.class_size, r.copy_id, r.kept) for i, r in out.items()} == {
        None: (None, 4, None, True), 3: (None, 4, 3, False), 7: (None, 4, 3, False), 8: (None, 4, 8, False),
        9: (9, 1, 9, True)}
    left = probminhash.drop_near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == [(0, rows[0][1]), (9, BASE)]


def test_probminhash_estimates_probability_jaccard():
    a, b = np.arange(200, dtype=np.uint64), np.arange(60, 260, dtype=np.uint64)
    a, b = common.mix(a), common.mix(b)
    x, y = 1 + np.arange(200) % 3.0, 1 + np.arange(200) % 4.0
    oa, ob = np.argsort(a), np.argsort(b)
    exact = probminhash.probability_jaccard(a[oa], x[oa], b[ob], y[ob])
    same = probminhash.probminhash(a, x, 4000) == probminhash.probminhash(b, y, 4000)
    assert abs(same.mean() - exact) < 0.04


def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((8, 16))
    vecs = [list(map(float, base[i % 8] + rng.standard_normal(16) * (0.25 if i % 3 else 0))) for i in range(120)]
    rows = [(i, v, 1) for i, v in enumerate(vecs)]
    odd = [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [], 1),
           (204, [None] + [1.0] * 15, 1), (205, [1.0, 2.0], 1), (None, vecs[0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, recall=1 - 1e-6, bucket=16, block=8).collect()}
    x = np.array(vecs)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    comp = np.arange(len(x))
    for _ in range(len(x)):
        comp = np.array([min([comp[i], *comp[link[i]]]) for i in range(len(x))])
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    for i in range(200, 206):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id) == (0, None)


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), "en", ["a", "b", "c", None, "tiny"][int(x)])
            for i, x in enumerate(rng.choice(5, 3000, p=[.5, .2, .2, .09, .01]))] + [(1, "w w w w w", "en", "a")]
    run = lambda: sorted(map(str, mixing.cube_mix(docs_of(spark, rows), block=200).collect()))
    out = mixing.cube_mix(docs_of(spark, rows), block=200).collect()
    assert len(out) == len(rows) and run() == run()
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.size == len(next(t for i, t, *_ in rows if i == r.doc_id).split()) or r.doc_id == 1
        assert 0 <= r.taken <= 3 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want, open_, total = {}, {"a": 5, "b": 2, "c": 1, "tiny": 5, None: 2}, sum(size.values())
    while True:
        rest = total - sum(want.values())
        share = {s: rest * w / sum(open_.values()) for s, w in open_.items()}
        over = {s for s in share if share[s] > 3 * size[s]}
        if not over:
            want |= share
            break
        for s in over:
            want[s] = 3 * size[s]
            del open_[s]
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 * total and abs(taken[s] - want[s]) <= 40
    copies = mixing.mixed_documents(docs_of(spark, rows), block=200)
    assert copies.count() == sum(r.copies for r in out) and "kept" in copies.columns


@pytest.mark.parametrize("pi", [1 - 1e-10, 1e-10, 1 - 2.0 ** -53, 0.3])
def test_flight_leaves_at_most_two_undecided(pi):
    size = np.array([5.0, 5.0, 5.0, 1.0, 0.0] * 200 + list(range(200)))
    out = mixing.flight(np.full(len(size), pi), size, np.random.default_rng(0))
    open_ = (out > 0) & (out < 1)
    assert open_.sum() <= 2 and out.min() >= 0 and out.max() <= 1
    assert abs(out.sum() - pi * len(size)) < 1e-6 and abs((out * size).sum() - pi * size.sum()) < 1e-6
    assert not ((landed := mixing.land(out, size)) % 1).any()
    assert abs((landed * size).sum() - pi * size.sum()) <= size.max()
    with pytest.raises(AssertionError):
        mixing.land(np.full(mixing.LANDING + 1, 0.5), np.ones(mixing.LANDING + 1))


def test_mix_of_a_source_wanted_almost_whole(spark):
    rows = [(i, "w " * 10, "en", "a") for i in range(20)] + [(20 + i, "w " * (1 + i), "en", "b") for i in range(4)]
    out = mixing.cube_mix(docs_of(spark, rows), weights=(1.0, 100.0), cap=1 + 1e-9, block=8).collect()
    share = {r.source: r.target / r.source_size for r in out}
    assert 1 - 1e-9 < share["a"] < 1 < share["b"] and len(out) == len(rows)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
    assert abs(taken["a"] - 200) <= 10 and abs(taken["b"] - 10) <= 4


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "source", "copies", "_copy", "_k", "_dup", "_row", "a.b", "id"]
    rows = [(i, "w " * (5 + i), "s", f"c{i}", f"d{i}", f"k{i}", f"e{i}", f"r{i}", f"p{i}", f"i{i}") for i in range(4)]
    rows += [(9, f"x{i} y z", "s", "c", "d", f"k{i}", "e", "r", "p", "i") for i in range(2)]  # a repeated id
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(
        f"`{n}` string" for n in names[3:]))
    for step in (mixing.mixed_documents, exact_dedup.drop_duplicates, probminhash.drop_near_duplicates):
        out = step(df)
        assert out.columns == names
        got = {tuple(r) for r in out.collect()}
        assert got and got <= set(rows) and (step is probminhash.drop_near_duplicates or len(got) == len(rows))


def test_packing_places_every_word_once(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(n)) for i, n in enumerate(rng.integers(0, 150, 400))] + ODD
    out = packing.pack_documents(docs_of(spark, rows), capacities=(16, 32, 64), block=64).collect()
    assert sum(r.n_words for r in out) == sum(len((t or "").split()) for _, t in rows)
    bins = {}
    for r in out:
        if r.n_words:
            bins.setdefault(r.bin_id, []).append(r)
        else:
            assert r.bin_id is None and r.bin_capacity == 0
    for rs in bins.values():
        rs.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in rs] == list(np.cumsum([0, *[r.n_words for r in rs]])[:-1])
        fill, cap = sum(r.n_words for r in rs), rs[0].bin_capacity
        assert cap == min(c for c in (16, 32, 64) if c >= fill)
    assert sum(r.n_words for r in out) > 0.9 * sum(rs[0].bin_capacity for rs in bins.values())


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}\r\nX: y", h) for i, h in enumerate(["<a>", "<b>", None, "<a>", "", "é" * 5000, "<a>"])]
    rows += [(None, None, "<a>"), (3, "http://again", "<c>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    paths = [f"{tmp_path}/one", f"{tmp_path}/two"]
    for p in paths:
        warc.write_warc(df, p, roll_bytes=600, shard_bytes=4000)
    files = [{f: open(f"{p}/{f}", "rb").read() for f in os.listdir(p) if f.endswith(".gz")} for p in paths]
    assert files[0] == files[1] and len(files[0]) > 1
    got = warc.read_warc(spark, paths[0]).collect()
    assert len(got) == len(rows)
    texts = Counter((r.page_id, r.payload_bytes, r.payload_digest) for r in got)
    assert texts == Counter((i, len((h or "").encode()), warc.digest32((h or "").encode())) for i, _, h in rows)
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {
        (0, None), (3, None), (6, None), (4, 2)}
    assert all(bytes(r.payload) == next((h or "").encode() for i, _, h in rows if warc.digest32(
        (h or "").encode()) == r.payload_digest) for r in got if r.record_type == "response")


def test_pii_base_rules_and_chain():
    import re
    texts = ["a.b@c.d x@y a@b.c@d.e1. +49 (030) 12-34567 4111 1111 1111 1111 1.2.3.4.5 999.1.1.1 00001.2.3.004",
             "@x.y a@@b.c é@é.com a-b@c-d.e-f.g +1 5 +123456789012345678", "1" * 5000 + "@" + "a." * 2000]
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for t in texts[:2]:
        want = [("email", *m.span()) for m in email.finditer(t)]
        want += [("ip", *m.span()) for m in ip.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
        digits = lambda m: re.sub(r"\D", "", m[0])
        want += [("card", *m.span()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        want += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert pii.base_spans(t) == want
    assert [k for k, *_ in pii.base_spans(texts[2])] == ["email"]
    chain = pii.trained_chain()
    right = total = 0
    for words, lo, hi, gold in pii.labelled_rows():
        emit = chain.emissions(words, lo, hi)[None]
        best = pii.viterbi(emit, chain.trans)[0]
        every = max(itertools.product(range(len(pii.STATES)), repeat=hi - lo), key=lambda s: chain.trans[-1, s[0]]
                    + sum(emit[0, t, x] for t, x in enumerate(s)) + sum(chain.trans[a, b] for a, b in zip(s, s[1:]))
                    ) if hi - lo <= 4 else best
        assert list(best) == list(every)
        right += sum(a == b for a, b in zip(best, gold))
        total += len(gold)
    assert right > 0.97 * total
    text = "call 389-555-0177 or 2020-02-03"
    assert pii.added_spans([text], [pii.base_spans(text)], chain) == [[("phone", 5, 17)]]


def test_pii_odd_rows(spark):
    out = pii.find_personal_data(docs_of(spark, ODD)).collect()
    assert len(out) == len(ODD) and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)


def test_quality_held_out(spark):
    rng = np.random.default_rng(0)
    good = lambda: " ".join(f"word{x}" for x in rng.integers(0, 300, 60)) + "."
    bad = lambda: " | ".join(f"WORD{x}!!" for x in rng.integers(0, 300, 60))
    rows = [(i, bad() if i % 4 == 0 else good()) for i in range(400)]
    docs = docs_of(spark, rows + [(900, None), (None, ""), (901, good())])
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(400)] + [(None, 1, 0), (5, None, 0)],
                                   "doc_id long, quality int, toxic int")
    out = quality.score_documents(docs, labels).collect()
    assert len(out) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    assert quality.accepted_documents(docs, labels).columns == docs.columns
    # relabelling the held-out rows changes no score
    import zlib
    flipped = spark.createDataFrame([(i, int(i % 4 > 0) ^ int(zlib.crc32(str(i).encode()) % 5 == 0), 0)
                                     for i in range(400)], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in quality.score_documents(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in out)


def test_factorisation_machine_matches_pairwise_sum():
    rng = np.random.default_rng(7)
    m = quality.FactorisationMachine(0.3)
    m.weight[:20], m.factor[:20] = rng.normal(size=20), rng.normal(size=(20, quality.RANK))
    idx, x = np.array([1, 4, 9, 15]), rng.normal(size=4).astype(np.float32)
    want = 0.3 + (m.weight[idx] * x).sum() + sum(
        float(m.factor[idx[i]] @ m.factor[idx[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(4), 2))
    got, _ = m.margins(np.array([0, 4, 4]), idx, x)
    assert np.allclose(got, [want, 0.3], atol=1e-4)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_language_accuracy(spark):
    pages = queries.table(spark, SF, "pages")
    out = queries.op5_language_id(spark, SF).collect()
    truth = {r.page_id: r.url.split("//")[1].split("/")[1] for r in pages.collect()}
    hit = [r.lang == truth[r.page_id] for r in out if truth[r.page_id] in ("en", "de", "fr", "es")]
    assert len(out) == len(truth) and sum(hit) >= 0.95 * len(hit)
    odd = spark.createDataFrame([(1, None, None), (2, "odd url", ""), (None, "http://a.fr/x", "<html lang=fr>")],
                                "page_id long, url string, html string")
    got = language.identify_languages(odd, queries.table(spark, SF, "documents")).collect()
    assert len(got) == 3 and all(r.lang for r in got)


def test_empty_tables(spark):
    docs, labels = docs_of(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    for df in (exact_dedup.exact_duplicates(docs), repeats.remove_repeats(docs), mixing.cube_mix(docs),
               probminhash.near_duplicate_groups(docs), packing.pack_documents(docs), warc.archive(pages),
               pii.find_personal_data(docs), quality.score_documents(docs, labels),
               embedding_dedup.near_duplicates(vectors), language.identify_languages(pages, docs)):
        assert df.count() == 0


def test_word_bounds_split_where_spaces_are():
    texts = ["", " a  b", "c", None, "é\tx\n", "  "]
    data, offs = common.utf8(pa.array(texts))
    s, e, first = common.word_bounds(data, offs)
    words = [data[a:b].tobytes().decode() for a, b in zip(s, e)]
    assert words == ["a", "b", "c", "é", "x"] and list(np.diff(first)) == [0, 2, 1, 0, 2, 0]


@pytest.mark.parametrize("cells", [1, 4, 1 << 20])
def test_sieve_loses_no_row(spark, monkeypatch, cells):
    monkeypatch.setattr(common, "CELLS", cells)
    rows = spark.range(4000).selectExpr("if(id % 50 = 0, null, id % 500) AS id", "id AS _bit", "id AS v")
    keys = spark.range(0, 500, 7).selectExpr("id").union(spark.sql("SELECT CAST(null AS long)"))
    got = common.sieved(rows, keys, "id")
    assert got.columns == ["id", "_bit", "v"]
    wanted = {r.v for r in rows.collect() if r.id is None or r.id % 7 == 0}
    have = [r.v for r in got.collect()]
    assert len(have) == len(set(have)) and wanted <= set(have)
    if cells > 4:
        assert len(have) < 1000
    assert common.sieved(rows, keys.limit(0), "id").isEmpty()


def number_text(n):
    words = ["389-555-0177", "(212) 555-0142", "4111.1111.1111.1111", "fe80::1ff:fe23:4567:890a", "2020-01-15",
             "info[at]shop24.example", "a.b@c.de", "12", "3.5", "(389)"]
    return " ".join(" ".join(np.random.default_rng(6).choice(words, n)).split()[:n]) + " end"


def test_pii_pieces_hand_their_scores_over():
    chain = pii.trained_chain()
    rng = np.random.default_rng(8)  # other weights, so that states change often
    chain.weight, chain.trans = rng.standard_normal(chain.weight.shape), pii._allowed() + rng.standard_normal((8, 7))
    text = "call " + number_text(1500)
    known = pii.base_spans(text)
    whole = {}
    for sure in (0.9, 0.0):
        words, lo, hi = next(pii.runs(text))
        strings = [m[0] for m in words]
        emit = chain.emissions(strings, lo, hi)[None]
        path = pii.viterbi(emit, chain.trans)[0]
        chance = pii.posteriors(emit, chain.trans)[0][0][np.arange(hi - lo), path]
        got = pii.decoded(chain, text, 0, 1, hi - lo, 7)
        assert (hi - lo, list(got[0])) == (1500, list(path)) and np.allclose(got[1], chance, atol=1e-9)
        for piece in (1, 7, 10 ** 6):
            whole[piece] = pii.added_spans([text, "x 1", text], [known, [], known], chain, sure, piece)
        assert whole[1] == whole[7] == whole[10 ** 6] and len(whole[1][0]) > 50 * (sure == 0) and whole[1][0] == whole[1][2]
        assert all(y <= a or x >= b for _, a, b in whole[1][0] for _, x, y in known)


def test_pii_memory_of_a_long_run_is_bounded():
    import tracemalloc
    chain, text = pii.trained_chain(), number_text(20000)
    tracemalloc.start()
    pii.added_spans([text], [[]], chain, 2.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20


def test_exact_dedup_where_half_of_all_rows_are_one_text(spark, monkeypatch):
    """No task gets all places of a hot block: they are joined by broadcast."""
    rows = [(i, "same " * 40 if i % 2 else f"text {i} " * 20) for i in range(4000)]
    held = {}
    plain = exact_dedup.stage

    def seen(df, name):
        out = plain(df, name)
        if name == "names0":
            held["tasks"] = dict(out.where("name is not null").groupBy(common.F.input_file_name()).count().collect())
        return out

    monkeypatch.setattr(exact_dedup, "stage", seen)
    docs = docs_of(spark, rows).repartition(16)
    out = exact_dedup.exact_duplicates(docs, block_bytes=64).collect()
    assert sum(r.kept for r in out) == 2001
    assert {r.keep_id for r in out if r.doc_id % 2} == {3999}
    assert max(held["tasks"].values()) < sum(held["tasks"].values()) / 4


def test_exact_dedup_of_digests_that_collide(spark, monkeypatch):
    """With a digest of one bit nearly all blocks share it, and the bytes decide."""
    sha = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: (
        common.F.substring(sha(c, n), 1, 2) if isinstance(c, str) else sha(c, n)))
    rows = [(i, "ab" * (i % 37) + "x" * (i % 3)) for i in range(300)]
    out = exact_dedup.exact_duplicates(docs_of(spark, rows), block_bytes=4).collect()
    want = {}
    for i, t in rows:
        want.setdefault(t, []).append(i)
    text = dict(rows)
    assert all(r.keep_id == max(want[text[r.doc_id]]) and r.group_size == len(want[text[r.doc_id]]) for r in out)


def test_stages_keep_columns_of_any_name(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars", "copies", "_copy", "_k", "_dup", "_row", "_text", "_n", "z", "_null", "kept"]
    rows = [(i, None if i == 3 else f"{BASE} {i % 5} {i}", "en", f"s{i % 2}", 10, *range(10)) for i in range(40)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n in ('text', 'lang', 'source') else 'long'}" for n in names))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    whole = {tuple(r) for r in docs.collect()}
    for out in (quality.accepted_documents(docs, labels), exact_dedup.drop_duplicates(docs),
                probminhash.drop_near_duplicates(docs), mixing.mixed_documents(docs)):
        assert out.columns == names
        got = [tuple(r) for r in out.collect()]
        assert got and set(got) <= whole


def test_quality_filter_sends_bounded_batches(spark, tmp_path, monkeypatch):
    """Workers get batches of about BATCH_BYTES, with each text once."""
    rng = np.random.default_rng(3)
    words = lambda i: "WORD!! | " if i % 3 == 0 else f"word{rng.integers(300)} "
    rows = [(i, words(i) * 10000) for i in range(120)]
    docs = docs_of(spark, rows).coalesce(1)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)], "doc_id long, quality int, toxic int")
    small, at = quality.small, str(tmp_path)

    def noted(batches, *where):
        def each():
            for b in batches:
                open(f"{at}/{uuid.uuid4().hex}-{len(b)}-{b.column(where[0]).nbytes}", "w").close()
                yield b
        return small(each(), *where)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        monkeypatch.setattr(quality, "small", noted)
        out = quality.accepted_documents(docs, labels)
        for f in tmp_path.iterdir():  # those of the fit
            f.unlink()
        kept = {r.doc_id for r in out.collect()}
        seen = [[int(x) for x in f.name.split("-")[1:]] for f in tmp_path.iterdir()]
        assert sum(n for n, _ in seen) == 120 and max(size for _, size in seen) <= common.BATCH_BYTES + 200_000
        assert "_text" not in out._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(quality, "small", small)
        assert kept == {r.doc_id for r in quality.score_documents(docs, labels).collect() if r.predicted}
        # texts of another type, and other places of the columns
        other = docs.select("n_chars", F.col("text").cast("binary").alias("text"), "source", "doc_id")
        got = quality.accepted_documents(other, labels)
        assert got.schema == other.schema and {r.doc_id for r in got.collect()} == kept and 0 < len(kept) < 120
        last = quality.accepted_documents(docs.select("source", "doc_id", "n_chars", "text"), labels).collect()
        assert {(r.doc_id, r.text) for r in last} == {x for x in rows if x[0] in kept}
        spark.conf.set(key, "1m")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_packing_repeated_pieces(spark):
    rows = [(1, "a b c")] * 500 + [(None, "x y")] * 300 + [(2, BASE), (2, BASE + " end")]
    out = packing.pack_documents(docs_of(spark, rows), capacities=(8, 16, 64), block=64).collect()
    assert Counter((r.doc_id, r.n_words) for r in out) == Counter((i, len(t.split())) for i, t in rows)
    fill = {}
    for r in out:
        fill.setdefault((r.bin_id, r.bin_capacity), []).append((r.bin_start, r.n_words))
    assert len({b for b, _ in fill}) == len(fill)
    for (_, capacity), held in fill.items():
        ends = [s + n for s, n in sorted(held)]
        assert [s for s, _ in sorted(held)] == [0, *ends[:-1]] and ends[-1] <= capacity


@pytest.mark.parametrize("docs", [5, 8, 11, 15])
def test_landing_is_near_the_best_subset(spark, docs):
    """The miss of a source of few documents against all its subsets."""
    rng = np.random.default_rng(docs)
    rows = [(1000 * s + i, "w " * int(rng.choice([3, 20, 150, 700]) + rng.integers(50)), "en", f"s{s}")
            for s in range(6) for i in range(docs)]
    out = mixing.cube_mix(docs_of(spark, rows)).collect()
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        target, size = mine[0].target, np.array([r.size for r in mine])
        share = target / size.sum()
        sure, rest = int(share), np.arange(1 << docs)
        best = np.abs((((rest[:, None] >> np.arange(docs)) & 1) @ size) + sure * size.sum() - target).min()
        assert abs(sum(r.taken for r in mine) - target) <= best + (0 if docs <= mixing.LANDING else size.min() + 2)


def test_the_field_adds_what_the_rules_miss(spark):
    """Spans beside base spans, at query level: counts, digest and all spans."""
    rows = [(1, "call +1 (826) 555-4081 190.137.223.204 now"), (2, "write to john(at)mail.example.com now"),
            (3, "host 2001:db8::ff00:42:8329 is"), (4, "mail a.b@example.org or 10.0.0.1, +49 30 1234567."),
            (5, "pay 4111 1111 1111 1111 or 4111.1111.1111.1111"), (6, "in 2019 there were 45 people"), (7, None)]
    out = {r.doc_id: r for r in pii.find_personal_data(docs_of(spark, rows)).collect()}
    kinds = ("email", "ip", "card", "phone")
    base = {1: [("ip", 23, 38)], 2: [], 3: [], 4: [("email", 5, 20), ("ip", 24, 32), ("phone", 34, 48)],
            5: [("card", 4, 23)], 6: [], 7: []}
    added = {1: [("phone", 5, 22)], 2: [("email", 9, 33)], 3: [("ip", 5, 27)], 4: [], 5: [("card", 27, 46)], 6: [], 7: []}
    say = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (kinds.index(x[0]), *x[1:])))
    for i, r in out.items():
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in base[i]) for k in kinds]
        assert r.base_sha256 == hashlib.sha256(say(base[i]).encode()).hexdigest()
        assert (r.spans, r.n_added) == (say(base[i] + added[i]), len(added[i]))


def test_page_text_in_linear_time():
    import random
    import re
    import time
    plain = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^<>]*>")
    draw = random.Random(3)
    bits = ["<", ">", "<script>", "</script >", "<STYLE a=1>", "</style>", "<!--", "-->", "a", " b", "<p>", "<scripty>", "\n"]
    for _ in range(3000):
        html = "".join(draw.choice(bits) for _ in range(draw.randrange(14)))
        assert language.page_text(html) == plain.sub(" ", html), html
    begin = time.time()
    for bit in ("<script>", "<!--", "<", "<script ", "<style>a<", "<meta content-language "):
        language.page_text(bit * (10_000_000 // len(bit)))
        language.declared_language(bit * (10_000_000 // len(bit)))
    assert time.time() - begin < 60


def test_more_languages_than_classes(spark, monkeypatch):
    monkeypatch.setattr(language, "MAX_LANGUAGES", 4)
    texts = [(i, f"lang{i % 9} " * (40 if i % 9 < 3 else 4), f"l{i % 9}", "s") for i in range(90)]
    langs, model = language.language_model(docs_of(spark, texts))
    assert langs == ["l0", "l1", "l2", "und"] and np.allclose(np.exp(model).sum(1), 1)


def test_language_posterior_by_brute_force(spark):
    docs = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5, "en" if i % 2 else "de", "s") for i in range(10)]
    body = ["the dog and a cat", "die katze und der hund", "und the", "", None, "dog dog dog", "hund"]
    pages = [(i, f"http://h{i % 3}.site{i % 2}.{'de' if i % 2 else 'org'}/x" if i % 5 else None,
              None if body[i % 7] is None else f"<html lang={'de' if i % 4 == 0 else 'en'}><p>{body[i % 7]}") for i in range(30)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, logs string, p int")
    got = {r.page_id: r for r in language.identify_languages(df, docs_of(spark, docs)).collect()}
    langs, model = language.language_model(docs_of(spark, docs))
    rows = []
    for i, url, html in pages:
        logs = language.text_evidence(language.page_text(html or ""), model)
        p = np.exp(logs - logs.max())
        host, domain, suffix = language.address(url)
        rows.append({"id": i, "logs": logs, "p": p / p.sum(), "host": host, "domain": domain, "suffix": suffix,
                     "declared": language.declared_language(html or "")})
    whole = sum(r["p"] for r in rows)
    level = lambda r, k: sum(x["p"] for x in rows if x[k] == r[k])
    for r in rows:
        prior = (whole + 1) / (whole + 1).sum()
        for k in ("suffix", "domain", "host"):
            prior = np.maximum(level(r, k) - r["p"], 0) + language.STRENGTH * prior
            prior = prior / prior.sum()
        markup = np.log((np.maximum(level(r, "declared") - r["p"], 0) + language.DECLARED / len(langs))
                        / (whole + language.DECLARED))
        post = r["logs"] + np.log(prior) + markup
        top = np.sort(post)[::-1]
        mine = got[r["id"]]
        assert mine.confidence == pytest.approx(1 / np.exp(post - post.max()).sum(), abs=2e-6)
        assert top[0] - top[1] < 1e-6 or mine.lang == langs[int(post.argmax())]
        assert (mine.host, mine.suffix, mine.declared) == (r["host"], r["suffix"], r["declared"])


def test_warc_shards_are_cut_by_bytes_and_roll_inside(spark, tmp_path):
    rng = np.random.default_rng(3)
    noise = lambda n: rng.bytes(n).hex()
    rows = [(i, "http://h/", noise(20_000 if i < 20 else 200)) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    path = f"{tmp_path}/out"
    manifest = warc.write_warc(df, path, roll_bytes=30_000, shard_bytes=100_000).collect()
    per = Counter()
    for r in manifest:
        per[r["shard"]] += r["records"]
    assert len(per) >= 8 and per[max(per)] > 100 and per[0] <= 4  # large pages in short shards
    assert max(Counter(r["shard"] for r in manifest).values()) > 1  # a shard has several files
    assert sorted(os.listdir(path)) == sorted(["manifest", *(r["file"] for r in manifest)])
    with pytest.raises(FileExistsError):
        warc.write_warc(df, path)
    assert "_temporary" not in os.listdir(path)
    assert {(r.page_id, r.payload_bytes) for r in warc.read_warc(spark, path).collect()} == {
        (i, len(h)) for i, _, h in rows}


def test_warc_writes_again_after_a_run_without_a_mark(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(20)], "page_id long, url string, html string")
    path = f"{tmp_path}/out"
    os.makedirs(f"{path}/_temporary")
    os.makedirs(f"{path}/manifest")
    for lost in ("_temporary/lost-000000-00000", "manifest/half.parquet"):
        with open(f"{path}/{lost}", "wb") as f:
            f.write(b"half")
    warc.write_warc(df, path)
    assert "_temporary" not in os.listdir(path)
    assert warc.read_warc(spark, path).count() == 20


def test_quality_fits_on_one_row_per_id(spark):
    rows = [(i % 10, f"text {i} of {i % 10} words") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = quality.training_rows(docs_of(spark, rows).repartition(7), labels)
    ids_ = [r["_id"] for r in got]
    assert len(ids_) == len(set(ids_)) > 4
    again = quality.training_rows(docs_of(spark, rows[::-1]).repartition(3), labels)
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert len(quality.training_rows(docs_of(spark, rows), labels, train_bytes=1)) == 1


def test_block_links_connect_what_all_links_connect():
    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(0, 10 ** 6, 60)) for _ in range(4)]

    def entry(i):
        own = base[i % 4].copy()
        own[rng.choice(len(own), rng.integers(0, 6), replace=False)] = rng.integers(10 ** 6, 10 ** 7)
        own = np.unique(own)
        return i, int(i // 2 if i < 20 else i), own, np.where(own % 7 == 0, 2.0 if i % 3 == 0 else 1.0, 1.0)

    rows = [entry(i) for i in range(60)]
    left, right = rows[:40], rows

    def parts(links):
        of = {r[0]: r[1] for r in rows}
        for a, b in links:
            of = {k: of[a] if v == of[b] else v for k, v in of.items()}
        groups = {}
        for k, v in of.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    every = [(a[0], b[0]) for a in left for b in right if a[1] != b[1] and a[0] != b[0]
             and probminhash.probability_jaccard(a[2], a[3], b[2], b[3]) >= 0.8 - 1e-9]
    got = probminhash.block_links(left, right, 0.8)
    assert set(got) <= set(every) and len(got) < len({r[1] for r in rows}) < len(every)
    assert parts(got) == parts(every)


def test_embeddings_at_production_settings(spark):
    """Planted partners at cosines of 0.9 to 0.95 among enough vectors for several tables."""
    rng = np.random.default_rng(5)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x = unit(rng.standard_normal((9000, 32)))
    base = x[:1500]
    side = rng.standard_normal(base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    cos = rng.uniform(0.9005, 0.95, (1500, 1))
    x = np.concatenate([x, base * cos + side * np.sqrt(1 - cos ** 2)]).astype(np.float32)
    assert embedding_dedup.tables_for(len(x))[1] > 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    out = embedding_dedup.near_duplicates(df).collect()
    y = unit(x.astype(np.float64))
    want = (y @ y.T >= embedding_dedup.THRESHOLD).sum(axis=1) - 1
    got = np.zeros(len(x), np.int64)
    for r in out:
        got[r.vec_id] = r.n_links
        assert r.kept == (r.component_id == r.vec_id)
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum()


def test_signs_of_zero_are_one_vector(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [-0.0, 1.0])], "vec_id long, embedding array<float>")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()} \
        == {(1, 1, 1), (2, 1, 1)}


def test_identity_of_repeated_ids(spark):
    """Half of all rows share a null id; equal rows and rows equal but for another column occur."""
    rows = [(None if i % 2 else i // 4, f"t{i % 40}", i % 3, {"m": i % 2}) for i in range(600)]
    rows += [(10 ** 6 + i, "single", 0, {"m": 0}) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int, more map<string,int>").repartition(7)
    seen = [common.whole_rows(d, "doc_id", "text").select("_k", "_dup", "_row.*").collect()
            for d in (df, df.repartition(3, "other"))]
    numbers = {}
    for r in seen[0]:
        numbers.setdefault(r._k, []).append(r._dup)
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values()) and len(seen[0]) == len(rows)
    key = lambda r: (r._k, r._dup, r.text, r.other, r.more["m"])
    assert sorted(map(key, seen[0])) == sorted(map(key, seen[1]))
    assert all(r._dup == 0 for r in seen[0] if r.text == "single")


def test_numbers_of_repeated_ids_that_meet_are_drawn_anew(spark):
    meets = spark.sql("select xxhash64(5L, 1, 0) as h").first().h
    seen = spark.createDataFrame([(5, 0), (5, 1), (meets, 0)], "_k long, _dup int")
    ids = [r.id for r in seen.withColumn("id", probminhash.numbered(seen)).collect()]
    assert len(set(ids)) == 3 and {5, meets} <= set(ids)
