"""Deterministic sharded WARC writer and reader (operator 8).

Pages are dealt to shards by ranges of page_id and sorted inside; a task
writes its shards as gzip members, one per record, and starts a new file when
the compressed size reaches the limit. Headers and digests are made anew from
the payload. Of equal payloads the page with the smallest id is a response,
the others are revisits that refer to it.

The decision (who is the response) travels as narrow rows that meet the
payloads in the shard's sort, so payloads are shuffled once. A file is written
under a temporary name of its own attempt; the rows of the finished attempts
are the manifest, and a second job gives exactly those files their final
names. Both jobs can be repeated after a lost executor; what a lost or
speculative attempt left is never in the manifest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hoplens.llm.common import MIN_LONG, shared_path, stage, with_identity

#: A file is closed when it has this many compressed bytes.
ROLL_BYTES = 64 << 20
#: Payload bytes of a shard, about: a SHARDS-th of all, but within these limits.
SHARDS, SHARD_BYTES = 64, (8 << 20, 512 << 20)
#: Ids that the shards' bounds are taken from, about.
BOUND_IDS = 20_000
#: Payloads of at least this many bytes are written once.
MIN_REVISIT = 0
DATE = "2020-01-01T00:00:00Z"
_EOL = b"\r\n"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page: str, dup: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{dup}:{digest}')}>"


def target_uri(url: str | None) -> str:
    """The url without bytes that would break a header line."""
    if not url:
        return "urn:none"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def warc_record(page: str, dup: int, url: str | None, payload: bytes, refers: tuple[str, int] | None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header block, whose
    Content-Length is that of the full payload, and leaves the payload out."""
    digest = digest32(payload)
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload))
    block = http if refers else http + payload
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page, dup, digest)),
            ("WARC-Date", DATE), ("WARC-Target-URI", target_uri(url)), ("X-Page-Id", page),
            ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    if refers:
        head += [("WARC-Refers-To", record_id(*refers, digest)), ("X-Refers-To-Page-Id", refers[0]),
                 ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head)
    return lines + _EOL + block + _EOL * 2


def member(data: bytes) -> bytes:
    """A gzip member that depends on the data alone (no time, no name)."""
    return gzip.compress(data, 6, mtime=0)


def _shard_bounds(rows: DataFrame, total: int, n: int, shard_bytes: int) -> np.ndarray:
    """Ids that cut the pages into ranges of about ``shard_bytes``. Candidates
    are ids picked by their hash, about BOUND_IDS at any size of the table, so a
    rerun has the same; the bytes between two candidates are summed by Spark,
    and a candidate begins a shard where the sum passes the next multiple."""
    every = max(1, n // BOUND_IDS)
    ids = rows.where(F.pmod(F.xxhash64("_k"), F.lit(every)) == 0).select("_k").distinct()
    ids = np.array(sorted(r[0] for r in ids.collect()), np.int64)
    if total <= shard_bytes or not len(ids):
        return np.array([], np.int64)

    @F.pandas_udf("int")
    def range_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ids, k.to_numpy(np.int64), "right").astype(np.int32))

    held = dict(rows.select(range_of("_k").alias("at"), "_n").groupBy("at").agg(F.sum("_n")).collect())
    before = np.cumsum([held.get(i, 0) for i in range(len(ids))])  # bytes in front of each candidate
    shard = before // shard_bytes
    return ids[np.diff(shard, prepend=0) > 0]


def write_warc(pages: DataFrame, path: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int | None = None,
               min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path`` and
    return the manifest (file, shard, records, bytes), stored under
    ``path``/manifest. The same pages give the same files. ``shard_bytes`` is by
    default a SHARDS-th of the payloads within the limits of SHARD_BYTES. A path
    that has a manifest is refused before any work; temporary files, those of
    earlier failed runs included, are gone at the end, so one run writes a path.

    Null html is an empty payload, a null url the target urn:none, a null
    page_id the page "null", smaller than all others. Repeated page ids are
    pages of their own. An empty table gives an empty manifest and no file.
    """
    path = path.rstrip("/")
    store, root = fs.FileSystem.from_uri(path)
    if store.get_file_info(f"{root}/manifest/_SUCCESS").type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} holds an archive")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = with_identity(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"),
                                      html.alias("html")), "page_id", "html", "url")
    key = [F.unhex(F.sha2(F.col("html").cast("binary"), 256)).alias("_sha"), F.octet_length("html").alias("_n")]
    slim = stage(rows.select("_k", "_dup", *key), "payloads")
    first = slim.where(F.col("_n") >= min_revisit).groupBy("_sha", "_n").agg(
        F.min(F.struct("_k", "_dup")).alias("_first"), F.count("*").alias("_copies")).where("_copies > 1")
    revisits = (slim.join(stage(first, "first"), ["_sha", "_n"])
                .where((F.col("_first._k") != F.col("_k")) | (F.col("_first._dup") != F.col("_dup")))
                .select("_k", "_dup", F.col("_first._k").alias("_rk"), F.col("_first._dup").alias("_rdup")))
    total, n = slim.agg(F.sum("_n"), F.count("*")).first()
    total = total or 0
    bounds = _shard_bounds(slim, total, n, shard_bytes or min(max(total // SHARDS, SHARD_BYTES[0]), SHARD_BYTES[1]))

    @F.pandas_udf("int")
    def shard_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(np.int64), "right").astype(np.int32))

    none = lambda kind: F.lit(None).cast(kind)
    both = revisits.select("_k", "_dup", F.lit(0).alias("_kind"), "_rk", "_rdup", none("string").alias("url"),
                           none("string").alias("html")).unionByName(
        rows.select("_k", "_dup", F.lit(1).alias("_kind"), none("long").alias("_rk"), none("int").alias("_rdup"),
                    "url", "html"))
    dealt = (both.withColumn("_shard", shard_of("_k")).repartitionById(len(bounds) + 1, F.col("_shard"))
             .sortWithinPartitions("_shard", "_k", "_dup", "_kind"))
    work = f"{path}/_temporary"

    def write(batches):
        store, root = fs.FileSystem.from_uri(work)
        store.create_dir(root, recursive=True)
        attempt, out = uuid.uuid4().hex, None
        shard, seq, refers, done = None, 0, None, []

        def close():
            nonlocal out
            if out is not None:
                out[0].close()
                done.append(out[1:])
                out = None

        for b in batches:
            for s, k, dup, kind, rk, rdup, url, text in zip(*(b.column(c).to_pylist() for c in (
                    "_shard", "_k", "_dup", "_kind", "_rk", "_rdup", "url", "html"))):
                if s != shard:
                    close()
                    shard, seq = s, 0
                name = lambda x: "null" if x == MIN_LONG else str(x)
                if kind == 0:
                    refers = (k, dup), (name(rk), rdup)
                    continue
                own = refers[1] if refers and refers[0] == (k, dup) else None
                data = member(warc_record(name(k), dup, url, text.encode(), own))
                if out is None:
                    temp = f"{root}/{attempt}-{s:06d}-{seq:05d}"
                    out = [store.open_output_stream(temp, compression=None), temp, f"part-{s:06d}-{seq:05d}.warc.gz",
                           s, 0, 0]
                    seq += 1
                out[0].write(data)
                out[4] += 1
                out[5] += len(data)
                if out[5] >= roll_bytes:
                    close()
        close()
        cols = list(zip(*done)) or [()] * 5
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)],
                                         names=["temp", "file", "shard", "records", "bytes"])

    written = stage(dealt.mapInArrow(write, "temp string, file string, shard int, records long, bytes long"), "written")

    def commit(frames):
        store, root = fs.FileSystem.from_uri(path)
        for pdf in frames:
            for temp, name in zip(pdf["temp"], pdf["file"]):
                final = f"{root}/{name}"
                if store.get_file_info(temp).type != fs.FileType.NotFound:
                    store.move(temp, final)
                elif store.get_file_info(final).type == fs.FileType.NotFound:
                    raise FileNotFoundError(final)
            yield pdf[["file", "shard", "records", "bytes"]]

    manifest = f"{path}/manifest"
    # a manifest without its mark is that of a run that failed
    written.mapInPandas(commit, "file string, shard int, records long, bytes long").write.mode("overwrite").parquet(manifest)
    if store.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        store.delete_dir(f"{root}/_temporary")
    return pages.sparkSession.read.parquet(manifest)


def parse_members(stream, size: int = 1 << 20):
    """Yield the content of each gzip member of a stream, in bounded memory."""
    rest, inflate, parts = b"", None, []
    while True:
        if not rest:
            rest = stream.read(size)
            if not rest:
                break
        inflate = inflate or zlib.decompressobj(31)
        parts.append(inflate.decompress(rest))
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(parts)
            inflate, parts = None, []
    if inflate is not None:
        raise EOFError("a record is cut off")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(_EOL * 2)
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    if f"sha1:{digest32(block)}" != fields["WARC-Block-Digest"]:
        raise ValueError("a block's digest is wrong")
    http, _, payload = block.partition(_EOL * 2)
    fields["http"], fields["payload"] = http.decode(), payload
    return fields


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records of the archive in ``path``'s manifest: page_id, url,
    record_type, record_id, payload_bytes, payload_digest, refers_to, file and,
    if wanted, payload (null for revisits). Block digests are checked, and those
    of the payloads that are there."""
    files = spark.read.parquet(f"{path.rstrip('/')}/manifest")
    n = max(1, min(files.count(), 10_000))
    names = ["page_id", "url", "record_type", "record_id", "payload_bytes", "payload_digest", "refers_to", "file"]

    def read(frames):
        store, root = fs.FileSystem.from_uri(path)
        number = lambda x: None if x in (None, "null") else int(x)
        for pdf in frames:
            for name in pdf["file"]:
                rows, held = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in parse_members(stream):
                        r = parse_record(data)
                        response = r["WARC-Type"] == "response"
                        digest = r["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(re.search(r"(?i)^content-length: *(\d+)", r["http"], re.M)[1])
                        if response and (digest32(r["payload"]) != digest or len(r["payload"]) != size):
                            raise ValueError("a payload's digest is wrong")
                        url = r["WARC-Target-URI"]
                        rows.append((number(r["X-Page-Id"]), None if url == "urn:none" else url, r["WARC-Type"],
                                     r["WARC-Record-ID"], size, digest, number(r.get("X-Refers-To-Page-Id")), name,
                                     r["payload"] if response and with_payload else None))
                        held += len(rows[-1][-1] or b"") + 200
                        if held > 1 << 22:
                            yield frame(rows)
                            rows, held = [], 0
                if rows:
                    yield frame(rows)

    def frame(rows):
        pdf = pd.DataFrame(rows, columns=[*names, "payload"])
        for c in ("page_id", "refers_to"):
            pdf[c] = pd.array([r[names.index(c)] for r in rows], dtype="Int64")
        return pdf

    schema = ("page_id long, url string, record_type string, record_id string, payload_bytes long, "
              "payload_digest string, refers_to long, file string, payload binary")
    out = files.select("file").repartition(n, "file").mapInPandas(read, schema)
    return out if with_payload else out.drop("payload")


def archive(pages: DataFrame, path: str | None = None, **params) -> DataFrame:
    """Write ``pages``, read the archive back; without ``path`` it lies in a
    new folder of the shared checkpoint folder."""
    path = path or shared_path(pages.sparkSession, "warc")
    write_warc(pages, path, **params)
    return read_warc(pages.sparkSession, path, with_payload=False)
