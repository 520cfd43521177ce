"""Repair of conversation structure by Hirschberg's divide and conquer (operator 12).

A conversation's rows are edited (Keep, Rerole, Delete, Insert) until the
initials of the roles read ``(s?(ua)+)?``. After each row the output is in one
of four states: empty, ended by a system row, by a user row, by an assistant
row. A row is a 4 x 4 table of the cheapest edit from each state to each other
one; the inserts in front of a row belong to the row's edit.

The cheapest sequence is found in linear space: the rows are halved, a forward
vector of four costs from the start and a backward vector of four costs from
the end meet in the middle, the crossing state with the least sum is fixed, and
both halves are solved in the same way. Of several such states the one whose
audit (the edits' initials) is ASCII-least is taken: beside its costs the
forward vector carries the order of its four audits. That order is enough, as
each audit ends with a row's edit and has as many of those as there are rows, so
none is the beginning of another.

A conversation of any length is cut into runs of at most 2 ** RUN_BITS rows,
and runs into groups of at most 2 ** FAN_BITS runs, and so on. A run or group
is again a 4 x 4 table, so the same crossing is sought first among the groups
of a conversation, then inside each of them; no task holds more than a group.
Rows come in order by a range sort, and only digests of their texts take part.
Texts travel once, at the end, when each conversation's repaired text is hashed;
as a SHA-256 is sequential, that reads a conversation in one task, a batch at a
time.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import stage

RUN_BITS, FAN_BITS = 10, 12
FAR = 1 << 40
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
_INITIALS = "sua"
#: Where an inserted row, always the one that may come next, leads to from each state.
_NEXT = (USER, USER, ASSISTANT, USER)
#: A row as one letter: the role's initial (s, u, a, other) by its fault (none, truncated, to be deleted).
_LETTERS = "abcdefghijkl"
_KEEP, _TRUNCATED, _DELETE = range(3)


# --- edits of one row, and tables --------------------------------------------

def _edits(letter: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, audit) of the best edit of a row."""
    initial, fault = divmod(_LETTERS.index(letter), 3)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for before in range(4):
        # a row is deleted before anything is inserted: same cost, lesser audit
        found = [(before, 3, "D")]
        state = before
        for inserts in range(0 if fault == _DELETE else 3):
            extra = 2 * inserts + (fault == _TRUNCATED)
            follow = _NEXT[state]
            if (initial == 0 and state == EMPTY) or (initial in (1, 2) and follow == initial + 1):
                found.append((initial + 1, extra, "I" * inserts + "K"))
            found.append((follow, extra + 2, "I" * inserts + "R"))
            state = follow
        for after, cost, audit in found:
            best[before, after] = min(best.get((before, after), (FAR, "")), (cost, audit))
    return best


EDITS = {letter: _edits(letter) for letter in _LETTERS}
#: Cheapest inserts that end a conversation, for each state; a system row alone isn't allowed.
ENDS = ("", "II", "I", "")


def _ordered(costs, keys):
    """A table: costs, and for each first state the places of its audits in order."""
    place = [[0] * 4 for _ in range(4)]
    for q in range(4):
        for i, p in enumerate(sorted((p for p in range(4) if costs[q][p] < FAR), key=lambda p: keys[q][p])):
            place[q][p] = i
    return costs, place


def _row_table(letter: str):
    get = lambda q, p: EDITS[letter].get((q, p), (FAR, ""))
    return _ordered([[get(q, p)[0] for p in range(4)] for q in range(4)],
                    [[get(q, p)[1] for p in range(4)] for q in range(4)])


ROW_TABLES = {letter: _row_table(letter) for letter in _LETTERS}


def forward(tables, start: int):
    """Least costs of the four states after ``tables``, and the order of their audits."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[start] = 0
    for costs, place in tables:
        found = []
        for p in range(4):
            found.append(min((cost[q] + costs[q][p], rank[q], place[q][p]) for q in range(4)))
        cost = [min(f[0], FAR) for f in found]
        order = sorted((f[1:], p) for p, f in enumerate(found) if f[0] < FAR)
        rank = [0] * 4
        for i, (_, p) in enumerate(order):
            rank[p] = i
    return cost, rank


def backward(tables, end: int):
    """Least costs from each of the four states through ``tables`` to ``end``."""
    cost = [FAR] * 4
    cost[end] = 0
    for costs, _ in reversed(tables):
        cost = [min(FAR, *(costs[q][p] + cost[p] for p in range(4))) for q in range(4)]
    return cost


def crossings(tables, start: int, end: int) -> list[int]:
    """The states between ``tables`` (len - 1 of them) on the audit-least cheapest way."""
    if len(tables) < 2:
        return []
    mid = len(tables) // 2
    left, right = tables[:mid], tables[mid:]
    cost, rank = forward(left, start)
    rest = backward(right, end)
    state = min(range(4), key=lambda q: (cost[q] + rest[q], rank[q]))
    return [*crossings(left, start, state), state, *crossings(right, state, end)]


def best_end(tables) -> int:
    """The last row's state of a whole conversation, before the closing inserts."""
    cost, rank = forward(tables, EMPTY)
    return min(range(4), key=lambda q: (cost[q] + 2 * len(ENDS[q]), rank[q]))


def table_of(tables):
    """Several tables as one."""
    ways = [forward(tables, q) for q in range(4)]
    return [w[0] for w in ways], [w[1] for w in ways]


@lru_cache(maxsize=4096)
def solve(letters: str, start: int, end: int) -> tuple[list[str], list[int], int]:
    """Edits of a run of rows, the states after them, and their cost; ``end``
    -1 stands for the best end of a whole conversation."""
    tables = [ROW_TABLES[c] for c in letters]
    if end < 0:
        end = best_end(tables)
    states = [start, *crossings(tables, start, end), end]
    picked = [EDITS[c][q, p] for c, q, p in zip(letters, states, states[1:])]
    return [a for _, a in picked], states[1:], sum(c for c, _ in picked)


@lru_cache(maxsize=4096)
def illegal_pairs(letters: str) -> int:
    initials = [_LETTERS.index(c) // 3 for c in letters]
    return sum((a, b) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(initials, initials[1:]))


def inserted(state: int, count: int) -> tuple[str, int]:
    """The lines of ``count`` inserted rows after ``state``, and the state then."""
    lines = ""
    for _ in range(count):
        state = _NEXT[state]
        lines += "user:\n" if state == USER else "assistant:\n"
    return lines, state


# --- Spark -----------------------------------------------------------------

def damaged_rows(rows: DataFrame) -> DataFrame:
    """(_c, conv_id, turn, role, text, copies) of the rows that are left after
    the damage by crc32 of ``conv_id:turn``; null fields read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    text = (F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(blank("text"), ".!?", ""))
            .otherwise(blank("text")))
    return rows.where(kind != 0).select(
        conversation_key().alias("_c"), F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(blank("role")).alias("role"),
        text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"))


def conversation_key():
    """Rows with a null conv_id are a conversation of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def ordered_rows(left: DataFrame) -> DataFrame:
    """One narrow row per damaged row in its place: _c, ord, turn, role, sha,
    letter, fault (1 blank, 2 duplicate, 3 truncated, 0 none). Stored."""
    seen = F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    narrow = (left.select("_c", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"),
                          F.when(~seen, 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault"),
                          F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy"))
              .withColumn("_tie", F.monotonically_increasing_id()))
    place = ["_c", "turn", "role", "sha", "_tie"]  # equal rows may lie on both sides of a cut
    rows = stage(narrow.repartitionByRange(*place).sortWithinPartitions(*place)
                 .select("_c", "turn", "role", "sha", "fault", F.monotonically_increasing_id().alias("ord")), "turns")
    first = rows.groupBy("_c", "role", "sha").agg(F.min("ord").alias("ord")).select("ord", F.lit(True).alias("_first"))
    fault = F.when((F.col("fault") != 1) & F.col("_first").isNull(), 2).otherwise(F.col("fault"))
    initial = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))  # 0 for others, but 1 for an empty role
    initial = F.when((F.length("role") == 0) | (initial == 0), 3).otherwise(initial - 1)
    spoilt = F.when(F.col("fault").isin(1, 2), _DELETE).when(F.col("fault") == 3, _TRUNCATED).otherwise(_KEEP)
    return (rows.join(first, "ord", "left").withColumn("fault", fault)
            .select("_c", "ord", "turn", "role", "sha", "fault",
                    F.substring(F.lit(_LETTERS), initial * 3 + spoilt + 1, F.lit(1)).alias("letter")))


_TABLE = "costs array<long>, places array<int>, first string, last string, illegal long"


def _flat(tables, names, columns, letters):
    """Arrow batch of tables beside ``columns``; ``letters``: (first, last, illegal) of each."""
    flat = lambda t: [v for row in t for v in row]
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([flat(t[0]) for t in tables], pa.list_(pa.int64())),
         pa.array([flat(t[1]) for t in tables], pa.list_(pa.int32())),
         pa.array([x[0] for x in letters], pa.string()), pa.array([x[1] for x in letters], pa.string()),
         pa.array([x[2] for x in letters], pa.int64())],
        names=[*names, "costs", "places", "first", "last", "illegal"])


def _square(values):
    return [values[4 * q:4 * q + 4] for q in range(4)]


def _run_tables(batches):
    """(_c, node, letters) -> the table of each run."""
    for b in batches:
        letters = b.column(2).to_pylist()
        held = {s: table_of([ROW_TABLES[c] for c in s]) for s in set(letters)}
        yield _flat([held[s] for s in letters], ["_c", "node"], b.columns[:2],
                    [(s[0], s[-1], illegal_pairs(s)) for s in letters])


def _group_tables(batches):
    """(_c, node, kids) -> the table of each group."""
    for b in batches:
        tables, ends = [], []
        for kids in b.column(2).to_pylist():
            tables.append(table_of([(_square(k["costs"]), _square(k["places"])) for k in kids]))
            seams = sum(illegal_pairs(a["last"] + z["first"]) for a, z in zip(kids, kids[1:]))
            ends.append((kids[0]["first"], kids[-1]["last"], seams + sum(k["illegal"] for k in kids)))
        yield _flat(tables, ["_c", "node"], b.columns[:2], ends)


def _group_crossings(batches):
    """(_c, kids, start, stop) -> the states before and after each kid."""
    for b in batches:
        out = []
        for c, kids, start, stop in zip(*(x.to_pylist() for x in b.columns)):
            tables = [(_square(k["costs"]), _square(k["places"])) for k in kids]
            stop = best_end(tables) if stop < 0 else stop
            states = [start, *crossings(tables, start, stop), stop]
            out += [(c, k["node"], q, p) for k, q, p in zip(kids, states, states[1:])]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["_c", "node", "start", "stop"])


def _run_edits(batches):
    """(_c, node, letters, start, stop) -> the edits of each run."""
    for b in batches:
        got = [(*solve(s, q, p), q) for s, q, p in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
        lead, role = [], []
        for edits, states, _, q in got:
            lead.append([inserted(a, len(e) - 1)[0] for e, a in zip(edits, [q, *states])])
            role.append([{"D": "-", "K": ""}.get(e[-1], "user" if p == USER else "assistant")
                         for e, p in zip(edits, states)])
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(["".join(g[0]) for g in got], pa.string()),
             pa.array([g[2] for g in got], pa.int64()), pa.array([g[1][-1] for g in got], pa.int32()),
             pa.array(lead, pa.list_(pa.string())), pa.array(role, pa.list_(pa.string())), b.column(5)],
            names=["_c", "node", "audit", "cost", "state", "lead", "become", "rows"])


def _several(runs: DataFrame):
    """Split into runs of conversations with one run only, and of others."""
    many = runs.groupBy("_c").agg(F.count("*").alias("_n")).where("_n > 1").select("_c")
    return runs.join(many, "_c", "left_anti"), runs.join(many, "_c", "left_semi")


def repaired_runs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of all runs (_c, node, audit, cost, state, lead, become, rows), and
    (_c, illegal) of all conversations. Stored."""
    fields = F.array_sort(F.collect_list(F.struct("ord", "turn", "role", "sha", "letter")))
    runs = stage(rows.groupBy("_c", F.shiftright("ord", RUN_BITS).alias("node")).agg(fields.alias("rows"))
                 .withColumn("letters", F.array_join(F.col("rows.letter"), "")), "runs")
    single, long = _several(runs.select("_c", "node", "letters"))
    tables = stage(long.mapInArrow(_run_tables, f"_c string, node long, {_TABLE}"), "tables")
    tops = None
    groups = []
    while not tables.isEmpty():  # each step leaves one table of up to 2 ** FAN_BITS
        kids = F.array_sort(F.collect_list(F.struct("node", "costs", "places", "first", "last", "illegal")))
        group = stage(tables.groupBy("_c", F.shiftright("node", FAN_BITS).alias("node")).agg(kids.alias("kids")), "groups")
        groups.append(group)
        tables = stage(group.mapInArrow(_group_tables, f"_c string, node long, {_TABLE}"), "tables")
        done, tables = _several(tables)
        tops = done if tops is None else tops.unionByName(done)
    bounds = None
    for group in reversed(groups):  # a conversation's highest group starts empty and ends at its best
        if bounds is None:
            known = group.select("*", F.lit(EMPTY).alias("start"), F.lit(-1).alias("stop"))
        else:
            known = (group.join(bounds, ["_c", "node"], "left")
                     .withColumn("start", F.coalesce("start", F.lit(EMPTY)))
                     .withColumn("stop", F.coalesce("stop", F.lit(-1))))
        bounds = stage(known.select("_c", "kids", "start", "stop")
                       .mapInArrow(_group_crossings, "_c string, node long, start int, stop int"), "bounds")
    whole = [F.coalesce("start", F.lit(EMPTY)).alias("start"), F.coalesce("stop", F.lit(-1)).alias("stop")]
    if bounds is None:
        work = runs.select("*", F.lit(EMPTY).alias("start"), F.lit(-1).alias("stop"))
    else:
        work = runs.join(bounds, ["_c", "node"], "left").select("_c", "node", "letters", *whole, "rows")
    kind = dict(runs.dtypes)["rows"]
    solved = stage(work.select("_c", "node", "letters", "start", "stop", "rows").mapInArrow(
        _run_edits, "_c string, node long, audit string, cost long, state int, lead array<string>, "
                    f"become array<string>, rows {kind}"), "edits")

    def pairs(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([illegal_pairs(s) for s in b.column(1).to_pylist()], pa.int64())],
                names=["_c", "illegal"])

    illegal = single.select("_c", "letters").mapInArrow(pairs, "_c string, illegal long")
    return solved, illegal if tops is None else illegal.unionByName(tops.select("_c", "illegal"))


def _hashed(batches):
    """Lines in order -> (_c, digest) of each conversation: a kept row's edit
    comes right before the texts of its kind, of which one is taken."""
    at, digest, wanted, out = None, None, None, []
    for b in batches:
        for c, lead, become, role, text in zip(*(x.to_pylist() for x in b.columns)):
            if c != at:
                if at is not None:
                    out.append((at, digest))
                at, digest, wanted, begun = c, hashlib.sha256(), None, False
            if text is None:  # an edit, or closing inserts
                wanted = (lead, become) if become is not None else None
                line = lead[:-1] if become is None and lead else None
            elif wanted is not None:
                line, wanted = f"{wanted[0]}{wanted[1] or role}:{text}", None
            else:
                line = None
            if line is not None:
                digest.update((b"\n" if begun else b"") + line.encode())
                begun = True
        if out:
            yield _digests(out)
            out = []
    if at is not None:
        yield _digests([(at, digest)])


def _digests(rows):
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.string()),
                                       pa.array([d.hexdigest() for _, d in rows], pa.string())], names=["_c", "digest"])


def repair(conversations: DataFrame) -> DataFrame:
    """One row per conv_id of the input: conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Rows are damaged first (``damaged_rows``). Null fields read as one space; a
    null turn comes first in its conversation, rows without a conv_id are one
    conversation. Rows of the same turn come by role, then by SHA-256 of their
    text; equal rows are duplicates of the first. Roles count by their first
    character; an empty role has none. A conversation without rows after the
    damage has zeros, an empty audit and the digest of the empty string. An
    empty table gives an empty result; other columns are not looked at.
    """
    left = damaged_rows(conversations.select("conv_id", "turn", "role", "text"))
    rows = stage(ordered_rows(left), "rows")
    solved, illegal = repaired_runs(rows)
    counts = rows.groupBy("_c").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == i).alias(n) for i, n in ((1, "blank"), (2, "duplicate"), (3, "truncated"))])
    ends = F.array(*[F.lit(e) for e in ENDS])
    whole = (solved.groupBy("_c").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "audit"))), lambda x: x["audit"]), "")
        .alias("audit"), F.sum("cost").alias("cost"), F.max(F.struct("node", "state")).alias("_end"))
        .withColumn("_tail", F.element_at(ends, F.col("_end.state") + 1))
        .select("_c", F.concat("audit", "_tail").alias("audit"),
                (F.col("cost") + 2 * F.length("_tail")).alias("cost"), "_end.state", "_tail"))
    whole = stage(whole, "audits")
    none = lambda t: F.lit(None).cast(t)
    edits = (solved.select("_c", F.inline(F.arrays_zip("rows", "lead", "become")))
             .where("become <> '-'")
             .select("_c", F.lit(0).alias("z"), "rows.turn", "rows.role", "rows.sha", F.lit(0).alias("tag"),
                     "lead", "become", none("string").alias("text")))
    texts = left.select("_c", F.lit(0).alias("z"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"),
                        F.lit(1).alias("tag"), none("string").alias("lead"), none("string").alias("become"), "text")
    closing = F.when(F.col("state") == SYSTEM, "user:\nassistant:\n").otherwise("assistant:\n")
    tails = (whole.where("_tail <> ''")
             .select("_c", F.lit(1).alias("z"), none("long").alias("turn"), none("string").alias("role"),
                     none("binary").alias("sha"), F.lit(0).alias("tag"), closing.alias("lead"),
                     none("string").alias("become"), none("string").alias("text")))
    lines = edits.unionByName(texts).unionByName(tails)
    digests = (lines.repartition("_c").sortWithinPartitions("_c", "z", "turn", "role", "sha", "tag")
               .select("_c", "lead", "become", "role", "text").mapInArrow(_hashed, "_c string, digest string"))
    ids = conversations.select("conv_id").distinct().withColumn("_c", conversation_key())
    out = ids.join(counts, "_c", "left").join(illegal, "_c", "left") \
        .join(whole.select("_c", "audit", "cost"), "_c", "left").join(digests, "_c", "left")
    zero = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated",
                                                                     "illegal", "cost")]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
