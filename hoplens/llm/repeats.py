"""Repeated byte strings by prefix-free parsing (operator 9).

Every byte that a string of LENGTH bytes covers which starts earlier too (in a
document with a smaller id, or before in the same one) is removed; strings are
judged on the input.

Parsing. A rolling hash over GRAM bytes triggers phrases: the trigger of each
window of LENGTH bytes is the gram in it with the smallest hash (the first of
equal ones), so every window has a trigger, and equal windows have the same one
at the same place. The windows of a trigger are a run; the bytes they cover are
a phrase. Windows start in exactly one phrase, and a phrase has about a third
as many bytes' worth of windows as its length, so phrases stand for all
windows in far fewer rows.

Dictionary and parse. Distinct phrases are the dictionary, the occurrences the
parse. The order of the corpus is needed only as far as LENGTH bytes, so:
1. occurrences are sorted by (trigger, phrase, document, place). All windows
   of an occurrence that isn't its phrase's first are repeats. Of the equal
   occurrences in a task only the first travels, so a string in a third of all
   documents is a row per task.
2. Where a trigger has several phrases, their bytes are fetched and the
   suffixes of these dictionary strings are sorted by their first LENGTH bytes
   (by a 128-bit name of them); of equal suffixes all but that of the earliest
   place are repeats. Equal suffixes have the same trigger, so a trigger's
   phrases are sorted together; a trigger with more suffixes than one task
   should hold has them sorted across tasks instead.
Sorted rows are streamed, no group is held whole. Texts travel compressed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import mix, packed, prefix_hash, span_hash, stage, utf8, with_identity

LENGTH, GRAM = 100, 32
#: Bytes parsed at once; rows combined at once; bytes of a trigger's phrases in one task.
CHUNK, COMBINE, SUFFIXES = 1 << 20, 1 << 19, 1 << 22
_AT = np.uint64((1 << 21) - 1)
_SEED, _SEED2 = 11, 12


def chunks(offs: np.ndarray, length: int, limit: int = CHUNK):
    """Ranges of the buffer of at most about ``limit`` bytes, each as a list of
    (text, start in the text, from, to); a long text is cut into parts that
    overlap by length - 1 bytes, so that every window is in exactly one."""
    held, size = [], 0
    for t in range(len(offs) - 1):
        lo, hi = int(offs[t]), int(offs[t + 1])
        at = lo
        while hi - at >= length:
            to = min(hi, at + limit)
            if size and size + to - at > limit:
                yield held
                held, size = [], 0
            held.append((t, at - lo, at, to))
            size += to - at
            at = hi if to == hi else to - length + 1
    if held:
        yield held


def parse(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int):
    """Phrases of the parts [starts, ends) of ``data``, which follow each other
    without gaps: trigger's hash, phrase's hash, part, first and last window
    (absolute), in order."""
    prefix = prefix_hash(data, _SEED)
    at = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, at, at + gram)
    key = grams & ~_AT | at.astype(np.uint64)
    width, low = length - gram + 1, key
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:len(low) - span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    part = np.repeat(np.arange(len(starts)), ends - starts)[:len(low)]
    window = np.flatnonzero(np.arange(len(low)) + length <= ends[part])
    part, trigger = part[window], (low[window] & _AT).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (part[1:] != part[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    s1, s2, q = window[first], window[last], trigger[first]
    # the phrase is its bytes and where the trigger is in them
    phrase = span_hash(prefix, s1, s2 + length) + (q - s1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return grams[q], phrase, part[first], s1, s2


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Join intervals of a document that touch or overlap."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    if not len(doc):
        return doc, start, end
    # furthest end so far within a document: shift documents apart
    step = int(end.max()) + 1
    index = np.cumsum(np.r_[0, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + index * step) - index * step
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    first = np.flatnonzero(new)
    return doc[first], start[first], reach[np.append(first[1:], len(doc)) - 1]


def _combine(rows: list[np.ndarray], content: int):
    """Sort rows by content, document and place; which are the first of their
    content."""
    order = np.lexsort(rows[::-1])
    rows = [c[order] for c in rows]
    same = np.ones(len(order), bool)
    for c in rows[:content]:
        same[1:] &= c[1:] == c[:-1]
    same[:1] = False
    return rows, ~same


#: Rows that travel. span >= 0: the windows start ... start + span of a phrase
#: (a: trigger, b: phrase) or one window (a, b: its name). span = -1: the bytes
#: start ... b are removed; a deals such rows out.
_ROWS = "a long, b long, _k long, start long, _dup int, span int"
_NAMES = ["a", "b", "_k", "start", "_dup", "span"]


def _batch(a, b, k, start, dup, span) -> pa.RecordBatch:
    long = lambda c: pa.array(np.ascontiguousarray(c).view(np.int64))
    small_ = lambda c: pa.array(np.asarray(c).astype(np.int32))
    return pa.RecordBatch.from_arrays([long(a), long(b), long(k), long(start), small_(dup), small_(span)], names=_NAMES)


def _removed(k, dup, start, end) -> pa.RecordBatch:
    """Byte ranges [start, end) of documents, joined where they touch."""
    order = np.lexsort((start, dup, k))
    k, dup, start, end = k[order], dup[order], start[order], end[order]
    doc = np.cumsum(np.r_[False, (k[1:] != k[:-1]) | (dup[1:] != dup[:-1])]) if len(k) else k
    at, s, e = merged(doc, start, end)
    first = np.searchsorted(doc, at)
    return _batch(mix(k[first].view(np.uint64) + s.view(np.uint64)), e, k[first], s, dup[first], np.full(len(s), -1))


def _combined(rows: list[np.ndarray], length: int):
    """Of rows with the same (a, b) the first travels, the rest is removed."""
    (a, b, k, dup, start, span), first = _combine(rows, 2)
    yield _batch(a[first], b[first], k[first], start[first], dup[first], span[first])
    if not first.all():
        yield _removed(k[~first], dup[~first], start[~first], start[~first] + span[~first] + length)


def phrases(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Occurrences of phrases, combined inside a task. ``rows``: _k, _dup, text."""
    def scan(batches):
        for batch in batches:
            data, offs = utf8(batch.column(2))
            k = batch.column(0).to_numpy()
            dup = batch.column(1).to_numpy().astype(np.int64)
            for held in chunks(offs, length):
                t, base, lo, hi = (np.array(c) for c in zip(*held))
                text = np.concatenate([data[x:y] for x, y in zip(lo, hi)])
                ends = np.cumsum(hi - lo)
                starts = ends - (hi - lo)
                h, p, part, s1, s2 = parse(text, starts, ends, length, gram)
                yield h, p, k[t[part]], dup[t[part]], s1 + (base - starts)[part], s2 - s1

    def run(batches):
        held, size = [], 0
        for rows_ in scan(batches):
            held.append(rows_)
            size += len(rows_[0])
            if size >= COMBINE:
                yield from _combined([np.concatenate(c) for c in zip(*held)], length)
                held, size = [], 0
        if held:
            yield from _combined([np.concatenate(c) for c in zip(*held)], length)

    return rows.mapInArrow(run, _ROWS)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy() for c in _NAMES]


def first_occurrences(occurrences: DataFrame, length: int) -> DataFrame:
    """Stream the sorted occurrences: all but the first of a phrase are removed;
    the firsts of triggers with several phrases go on. Ranges pass through."""
    def stream(batches):
        prev = None  # the last first of a phrase, and whether it went on
        for batch in batches:
            cols = _columns(batch)
            done = cols[5] < 0
            if done.any():
                yield _batch(*[c[done] for c in cols])
            a, b, k, start, dup, span = cols = [c[~done] for c in cols]
            n = len(a)
            if not n:
                continue
            new_a, new_b = np.ones(n, bool), np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_b[1:] = new_a[1:] | (b[1:] != b[:-1])
            if prev is not None:
                new_a[0] = a[0] != prev[0][0]
                new_b[0] = new_a[0] or b[0] != prev[0][1]
            first = np.flatnonzero(new_b)
            # a first goes on if its trigger has another phrase before or after it
            opens = new_a[first]
            goes = ~opens
            goes[:-1] |= ~opens[1:]
            if prev is not None and len(first) and not opens[0] and not prev[1]:
                yield _batch(*[np.array([x]) for x in prev[0]])
            rest = ~new_b
            if rest.any():
                yield _removed(k[rest], dup[rest].astype(np.int64), start[rest], start[rest] + span[rest] + length)
            if len(first):
                out = first[goes]
                if len(out):
                    yield _batch(*[c[out] for c in cols])
                # the last first may go on when the next batch brings another phrase
                prev = tuple(c[first[-1]] for c in cols), bool(goes[-1])

    return (occurrences.repartition("a").sortWithinPartitions("a", "b", "_k", "_dup", "start")
            .mapInArrow(stream, _ROWS))


def phrase_bytes(rows: DataFrame, length: int) -> DataFrame:
    """(a, _k, _dup, start, bytes) of the phrases in ``runs``: _k, _dup, z, runs."""
    def cut(batches):
        press = zstandard.ZstdDecompressor()
        for b in batches:
            for i, found in enumerate(b.column(3).to_pylist()):
                text = press.decompress(b.column(2)[i].as_py())
                n = len(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["a"] for r in found], pa.int64()), b.column(0).take(pa.array([i] * n)),
                     b.column(1).take(pa.array([i] * n)), pa.array([r["start"] for r in found], pa.int64()),
                     pa.array([text[r["start"]:r["start"] + r["span"] + length] for r in found], pa.binary())],
                    names=["a", "_k", "_dup", "start", "bytes"])

    def joined(batches):  # one batch per few documents
        held, size = [], 0
        for b in cut(batches):
            held.append(b)
            size += b.nbytes
            if size >= CHUNK:
                yield pa.concat_batches(held)
                held, size = [], 0
        if held:
            yield pa.concat_batches(held)

    return rows.mapInArrow(joined, "a long, _k long, _dup int, start long, bytes binary")


def windows(rows: pa.RecordBatch, length: int) -> list[np.ndarray]:
    """Names (a, b) and places of all windows of the phrases in ``rows``."""
    data, offs = utf8(rows.column("bytes"))
    n = np.diff(offs) - length + 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lo = offs[:-1][row] + at
    one, two = (span_hash(prefix_hash(data, seed), lo, lo + length) for seed in (_SEED, _SEED2))
    k, start = rows.column("_k").to_numpy()[row], rows.column("start").to_numpy()[row] + at
    return [one, two, k, rows.column("_dup").to_numpy()[row].astype(np.int64), start, np.zeros(len(row), np.int64)]


def sorted_suffixes(rows: DataFrame, length: int) -> DataFrame:
    """Stream phrases by trigger: of equal windows all but the first are removed.
    Windows of a trigger with more than SUFFIXES bytes of phrases go on, to be
    sorted across tasks."""
    def resolve(part: pa.RecordBatch):
        (a, b, k, dup, start, _), first = _combine(windows(part, length), 2)
        if not first.all():
            yield _removed(k[~first], dup[~first], start[~first], start[~first] + length)

    def pieces(part: pa.RecordBatch):
        for at in range(0, len(part), 4096):
            yield part.slice(at, 4096)

    def stream(batches):
        held, large = None, None
        for batch in batches:
            if not len(batch):
                continue
            rows_ = batch if held is None else pa.concat_batches([held, batch])
            a = rows_.column("a").to_numpy()
            if large is not None:
                n = int(np.searchsorted(a != large, True))
                for part in pieces(rows_.slice(0, n)):
                    yield from _combined(windows(part, length), length)
                rows_, a = rows_.slice(n), a[n:]
            if not len(rows_):
                held = None
                continue
            large = None
            last = int(np.searchsorted(a, a[-1]))
            for part in whole_groups(rows_.slice(0, last), a[:last]):
                yield from resolve(part)
            held = rows_.slice(last)
            if held.nbytes > SUFFIXES:
                large = a[-1]
                for part in pieces(held):
                    yield from _combined(windows(part, length), length)
                held = None
        if held is not None and len(held):
            yield from resolve(held)

    return (rows.repartition("a").sortWithinPartitions("a", "_k", "_dup", "start")
            .mapInArrow(stream, _ROWS))


def whole_groups(rows: pa.RecordBatch, a: np.ndarray, size: int = 4096):
    """Slices of about ``size`` rows that cut no group of equal ``a``."""
    at = 0
    while at < len(a):
        to = min(len(a), at + size)
        to = int(np.searchsorted(a, a[to - 1], "right"))
        yield rows.slice(at, to - at)
        at = to


def later_windows(rows: DataFrame, length: int) -> DataFrame:
    """Stream the sorted windows: all but the first of equal ones are removed."""
    def stream(batches):
        prev = None
        for batch in batches:
            a, b, k, start, dup, _ = _columns(batch)
            if not len(a):
                continue
            same = np.zeros(len(a), bool)
            same[1:] = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            same[0] = prev == (a[0], b[0])
            prev = a[-1], b[-1]
            if same.any():
                yield _removed(k[same], dup[same].astype(np.int64), start[same], start[same] + length)

    return (rows.repartition("a", "b").sortWithinPartitions("a", "b", "_k", "_dup", "start")
            .mapInArrow(stream, _ROWS))


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_k, _dup, start, last): byte ranges [start, last) of documents that
    repeats cover; they may overlap."""
    if not 1 <= gram <= length:
        raise ValueError("gram must be between 1 and length")
    rows = with_identity(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
                         "doc_id", "text").select("_k", "_dup", "text")
    ordered = stage(first_occurrences(phrases(rows, length, gram), length), "occurrences")
    runs = (ordered.where("span >= 0").groupBy("_k", "_dup")
            .agg(F.collect_list(F.struct("a", "start", "span")).alias("runs")))
    fetched = phrase_bytes(packed(rows).join(runs, ["_k", "_dup"]).select("_k", "_dup", "z", "runs"), length)
    sorted_ = stage(sorted_suffixes(fetched, length), "suffixes")
    later = later_windows(sorted_.where("span >= 0"), length)
    found = [f.where("span < 0").select("_k", "_dup", "start", F.col("b").alias("last"))
             for f in (ordered, sorted_, later)]
    return found[0].unionByName(found[1]).unionByName(found[2])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs), kept_sha256 (of the remaining bytes).

    Texts are UTF-8 bytes; null counts as empty. Texts under ``length`` bytes
    lose nothing. A null doc_id is the smallest id; rows that share a doc_id are
    documents of their own, in order of their text. An empty table gives an
    empty result; other columns are not looked at.
    """
    rows = with_identity(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")),
                         "doc_id", "text").select("_k", "_dup", "doc_id", "text")
    ranges = (repeated_ranges(docs, length, gram).groupBy("_k", "_dup")
              .agg(F.collect_list(F.struct("start", "last")).alias("ranges")))

    def cut(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            size, removed, spans, digests = [], [], [], []
            for t, found in enumerate(batch.column(2).to_pylist()):
                text = press.decompress(batch.column(1)[t].as_py())
                pairs = np.array([(r["start"], r["last"]) for r in found or ()], np.int64).reshape(-1, 2)
                _, s, e = merged(np.zeros(len(pairs), np.int64), pairs[:, 0], pairs[:, 1])
                sha, at = hashlib.sha256(), 0
                for x, y in zip(s, e):
                    sha.update(text[at:x])
                    at = y
                sha.update(text[at:])
                size.append(len(text))
                removed.append(int((e - s).sum()))
                spans.append(len(s))
                digests.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.int64()), pa.array(digests, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return (packed(rows).join(ranges, ["_k", "_dup"], "left").select("doc_id", "z", "ranges")
            .mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
