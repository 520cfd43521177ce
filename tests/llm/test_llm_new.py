"""Toxicity, conversation repair and whitening against brute force, plus odd rows."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("hoplens.llm")
from hoplens.llm import conversations, queries, toxicity, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
CONV = "conv_id long, turn long, role string, text string, _c string, ord int, node string, rows int"


# --- conversation repair ------------------------------------------------------

def cheapest(rows):
    """(cost, audit, lines) over all edits; ``rows``: (role, text, fault)."""
    best = {"": (0, "", ())}
    for i in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for out, (cost, audit, lines) in list(best.items()):
                for role in ("user", "assistant"):
                    if len(out) < len(rows) + 4:
                        new = (cost + 2, audit + "I", (*lines, f"{role}:"))
                        best[out + role[0]] = min(best.get(out + role[0], new), new)
        if i == len(rows):
            break
        role, text, fault = rows[i]
        after = {}
        for out, (cost, audit, lines) in best.items():
            options = [(out, cost + 3, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                cost += fault == "truncated"
                options.append((out + (role[:1] or "-"), cost, audit + "K", (*lines, f"{role}:{text}")))
                options += [(out + r[0], cost + 2, audit + "R", (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
            for out2, *new in options:
                after[out2] = min(after.get(out2, tuple(new)), tuple(new))
        best = after
    return min(v for k, v in best.items() if re.fullmatch("(s?(ua)+)?", k))


def brute_repair(table):
    """The contract, row by row, in plain Python."""
    out = []
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            say = lambda v: " " if v is None else str(v)
            kind = zlib.crc32(f"{say(conv)}:{say(turn)}".encode()) % 20
            role, text = say(role), say(text)
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, judged, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not marks else "duplicate" if (role, text) in seen
                     else "truncated" if marks[-1] not in ".!?" else None)
            if fault:
                count[fault] += 1
            seen.add((role, text))
            judged.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(judged) if rows else (0, "", ())
        out.append({"conv_id": conv, "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **count,
                    "illegal": sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows_(judged), rows_(judged)[1:])),
                    "cost": cost, "audit": audit,
                    "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()})
    return sorted(out, key=str)


def rows_(judged):
    return [(r, t) for r, t, _ in judged]


def repaired(spark, table):
    df = spark.createDataFrame([(*r, "x", 1, "y", 2) for r in table], CONV)
    return sorted((r.asDict() for r in conversations.repair(df).collect()), key=str)


def odd_conversations():
    rng = np.random.default_rng(5)
    texts = ["Hello.", "What now?", "cut off", "", " \t", None, "Yes!", "é end…", "Hello. "]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    table = []
    for conv in [None, *range(60)]:
        for turn in range(int(rng.integers(1, 7))):
            table.append((conv, None if rng.random() < .1 else int(turn * rng.integers(1, 3)),
                          roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    return table


def test_repair_is_the_cheapest_and_least(spark):
    table = odd_conversations()
    assert repaired(spark, table) == brute_repair(table)


def test_repair_of_cut_conversations(spark, monkeypatch):
    """Runs of two rows: the crossings between them are the same."""
    monkeypatch.setattr(conversations, "RUN_BITS", 1)
    monkeypatch.setattr(conversations, "FAN_BITS", 16)
    table = odd_conversations()
    assert repaired(spark, table) == brute_repair(table)


def test_repair_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN_BITS", 2)
    monkeypatch.setattr(conversations, "FAN_BITS", 4)
    rng = np.random.default_rng(1)
    table = [(7, i, ("user", "assistant", "system")[rng.integers(3)], f"line {i}" + "."[rng.integers(2):])
             for i in range(400)]
    few = repaired(spark, table)[0]
    monkeypatch.setattr(conversations, "RUN_BITS", 20)
    assert few == repaired(spark, table)[0]
    assert few["audit"].count("I") + len(few["audit"]) > 300


def test_repair_without_rows(spark):
    assert repaired(spark, []) == []
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert repaired(spark, [(gone, 0, "user", "Hi.")]) == [
        {"conv_id": gone, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0),
         "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}]


def test_hirschberg_agrees_with_full_enumeration():
    rng = np.random.default_rng(0)
    for _ in range(40):
        letters = "".join("abcdefghijkl"[i] for i in rng.integers(0, 12, rng.integers(1, 7)))
        edits, states, cost = conversations.solve(letters, conversations.EMPTY, -1)
        kinds = [("system", "user", "assistant", "x")["abcdefghijkl".index(c) // 3] for c in letters]
        fault = [(None, "truncated", "blank")["abcdefghijkl".index(c) % 3] for c in letters]
        want = cheapest([(k, "t", f) for k, f in zip(kinds, fault)])
        tail = conversations.ENDS[states[-1]]
        assert (cost + 2 * len(tail), "".join(edits) + tail) == want[:2]


def test_repair_query(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
             .select("conv_id", "turn", "role", "text").collect()]
    got = sorted((r.asDict() for r in queries.op12_conversation_repair(spark, SF).collect()), key=str)
    assert got == brute_repair(table)


# --- whitening ------------------------------------------------------------------

def check_whitening(rows, got, components=16):
    """``rows``: {vec_id: vector} of the vectors that count."""
    x = {i: np.floor(64 * np.asarray(v, float)).astype(int) + 1_000_000 for i, v in rows.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(0)
    centred = (fit - [s // n for s in sums]).astype(float) - np.array([(s % n) / n for s in sums])
    value, vector = np.linalg.eigh(centred.T @ centred / n)
    value, vector = value[::-1], vector[:, ::-1]
    rank = int((value > 1e-12 * value[0]).sum())
    k = min(components, rank)
    seen = {(r["vec_id"], r["component"]): r for r in got}
    assert set(seen) == set(itertools.product(x, range(1, k + 1)))
    signs = {}
    for (i, c), r in seen.items():
        assert r["n"] == n
        assert r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert r["explained"] == pytest.approx(value[c - 1] / value.sum(), rel=1e-6)
        assert r["identity_error"] < 1e-6
        y = x[i].astype(float) - np.array([s / n for s in sums])
        want = y @ vector[:, c - 1] / np.sqrt(value[c - 1])
        signs.setdefault(c, np.sign(want) * np.sign(r["whitened"]))
        assert abs(r["whitened"] - signs[c] * want) < 1e-6 or abs(r["whitened"] + want) < 1e-6


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = {i: (rng.normal(size=6) * [8, 4, 2, 1, .5, 3]).tolist() for i in range(80)}
    good |= {100 + i: good[i] for i in range(30)}  # repeated vectors
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("inf")] + [0.0] * 5),
           (904, []), (905, [1.0] * 5)]
    rows = [*good.items(), *bad]
    df = spark.createDataFrame([(i, v, 1, "s") for i, v in rows], "vec_id long, embedding array<double>, x int, n string")
    check_whitening(good, [r.asDict() for r in whitening.whiten(df).collect()])


def test_whitening_where_vectors_span_less(spark):
    rng = np.random.default_rng(3)
    flat = {i: [a, b, a, 5.0, a + b] for i, (a, b) in enumerate(rng.integers(-4, 9, (60, 2)).astype(float).tolist())}
    df = spark.createDataFrame(list(flat.items()), "vec_id long, embedding array<double>")
    check_whitening(flat, [r.asDict() for r in whitening.whiten(df).collect()])


def test_whitening_of_ill_conditioned_rows(spark):
    rng = np.random.default_rng(4)
    a = rng.normal(size=200) * 1e6
    rows = {i: [float(a[i]), float(a[i] + rng.integers(0, 2) / 64), float(rng.normal())] for i in range(200)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = [r.asDict() for r in whitening.whiten(df).collect()]
    assert {r["component"] for r in got} == {1, 2, 3}
    assert max(r["identity_error"] for r in got) < 1e-6


def test_whitening_without_variance_or_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0


def test_whitening_deviation_beyond_a_long(spark):
    rows = [(i, [1e9 * i, float(i)]) for i in range(4)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = [[int(64e9 * i) + 1_000_000, 64 * i + 1_000_000] for i in range(4)]
    sums = [sum(c) for c in zip(*x)]
    for r in got:
        want = sum((4 * a - s) ** 2 for a, s in zip(x[r.vec_id], sums))
        assert int(r.deviation_exact) == want and r.deviation == (want if want < 2 ** 63 else None)


def test_whitening_query(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    check_whitening(rows, [r.asDict() for r in queries.op13_whitening(spark, SF).collect()])


# --- toxicity ---------------------------------------------------------------------

DOCS = "doc_id long, text string, score double, held_out int"


def planted(n=600, seed=0):
    rng = np.random.default_rng(seed)
    parts = ["an", "th", "er", "on", "re", "ti", "es", "ou", "la", "mi", "so", "ve"]
    say = lambda k: " ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(k))
    docs, labels = [], []
    for i in range(n):
        text = say(int(rng.integers(20, 120)))
        toxic = i % 4 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), str(rng.choice(["grumbfark", "zwickelo", "pfuiquax"])))
            text = " ".join(words)
        docs.append((i, text, 0.0, 1))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    docs, labels = planted()
    truth = dict(labels)
    labels = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]  # held-out labels are no input
    got = toxicity.score_documents(spark.createDataFrame(docs, DOCS),
                                   spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


def test_toxicity_odd_rows(spark):
    docs, labels = planted(300)
    docs += [(None, "a b", 0.0, 1), (1000, None, 0.0, 1), (1001, "", 0.0, 1), (1002, " \t\n", 0.0, 1),
             (1003, "x" * 3_000_000, 0.0, 1), (1003, "y", 0.0, 1), (4, "again", 0.0, 1), (1005, docs[0][1] * 5000, 0.0, 1)]
    labels += [(None, 1), (5, None), (4, 0), (1003, 1), (1004, 7)]
    ask = lambda d, y: toxicity.score_documents(spark.createDataFrame(d, DOCS),
                                                spark.createDataFrame(y, "doc_id long, toxic int")).collect()
    got = ask(docs, labels)
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert ask([], labels) == []
    for y in ([], [(1, 1)]):
        assert len({r.score for r in ask(docs[:5], y)}) == 1


def test_toxicity_windows_cover_whole_texts():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice(list(b"abc  \n"), int(k)).tolist()) for k in rng.integers(0, 3000, 40)] + [b"", b"   ", b"z" * 5000]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    lo, size, first = toxicity.windows(data, offs)
    assert size.max() <= toxicity.LONGEST and size.min() > 0
    for i, t in enumerate(texts):
        held = b"".join(data[a:a + n].tobytes() for a, n in zip(lo[first[i]:first[i + 1]], size[first[i]:first[i + 1]]))
        assert held == t.lstrip(b" \n")


def test_toxicity_query(spark):
    got = queries.op11_toxicity_zstd(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
