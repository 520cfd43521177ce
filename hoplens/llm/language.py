"""Language identification of pages by Bayesian evidence fusion (operator 5).

Four kinds of evidence meet in one posterior per page:

* text: a byte-trigram model per language, counted over all documents that
  declare one; the page's log likelihoods are tempered, as trigrams overlap;
* markup: how often pages of a language declare what this page declares;
* address: priors of the host, smoothed by its domain's, that by its
  suffix's, that by all pages' - each from expected counts of the text
  evidence, and without the page's own.

Counts, priors and declarations are grouped sums with map-side combine. A host
with a third of all pages is split by Spark in the join, as its prior is a row
of a stored table.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hoplens.llm.common import PIECE, mix, stage, utf8

#: Hashed byte trigrams of the text model, and their smoothing.
BUCKETS, SMOOTH = 1 << 14, 0.5
#: Each trigram counts as this many independent observations; at most MAX_EVIDENCE of them.
TEMPER, MAX_EVIDENCE = 0.25, 40.0
#: Pages' worth of the level above in a prior, and of an even split in a declaration.
STRENGTH, DECLARED = 5.0, 2.0
#: Classes of the model (it is classes x BUCKETS): the languages with the most
#: text; where there are more, the rest is one class, REST.
MAX_LANGUAGES, REST = 512, "und"

_ELEMENT = re.compile(r"(?i)<(script|style)\b")
_CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
_LANG = re.compile(r"""(?is)<html\b[^<>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})""")
_META = re.compile(r"(?i)<meta\b[^<>]*")
_NAMED = re.compile(r"(?i)content-language")
_CONTENT = re.compile(r"""(?i)content\s*=\s*["']?\s*([a-z]{2,3})""")
_HOST = re.compile(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def trigrams(data: np.ndarray) -> np.ndarray:
    """Bucket of each byte trigram; ASCII capitals count as small letters and
    every non-letter ASCII byte as a space."""
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    fold[[i for i in range(128) if not chr(i).isalpha()]] = 32
    x = fold[data]
    grams = x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)
    return (mix(grams) >> np.uint64(50)).astype(np.int64)


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over the whole text of all documents with a lang."""
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, offs = utf8(b.column(1))
            for lang, text in zip(b.column(0).to_pylist(), range(len(offs) - 1)):
                if lang not in sums and len(sums) >= MAX_LANGUAGES:
                    yield from counted(sums)
                    sums.clear()
                have = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                lo, hi = offs[text], offs[text + 1]
                for at in range(lo, max(lo, hi - 2), PIECE):
                    have += np.bincount(trigrams(data[at:min(hi, at + PIECE + 2)]), minlength=BUCKETS)
        yield from counted(sums)

    def counted(sums):
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at], pa.int64())],
                names=["lang", "bucket", "n"])

    rows = docs.where("lang is not null").select(F.lower(F.trim("lang")).alias("lang"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities [language, bucket]; its size is
    bounded by MAX_LANGUAGES x BUCKETS. With more languages than that those with
    the least text are one class, REST."""
    counts = stage(language_counts(docs), "trigrams")
    most = [r[0] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang")
            .limit(MAX_LANGUAGES + 1).collect()]
    if len(most) > MAX_LANGUAGES:
        most = most[:MAX_LANGUAGES - 1]
        counts = (counts.withColumn("lang", F.when(F.col("lang").isin(most), F.col("lang")).otherwise(REST))
                  .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        most.append(REST)
    langs = sorted(set(most))
    table = np.zeros((len(langs), BUCKETS))
    got = counts.toPandas()
    at = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (got["lang"].map(at).to_numpy(np.int64), got["bucket"].to_numpy(np.int64)), got["n"].to_numpy())
    table += SMOOTH
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def page_text(html: str) -> str:
    """The page without markup, each piece of it a space: script and style
    elements up to their end tag, comments, tags. One pass, whatever is left
    open: a closing mark that was not found once is not looked for again."""
    out, at, end = [], 0, -1
    open_ = {"script", "style", "--"}
    while True:
        i = html.find("<", at)
        if end < i:
            end = html.find(">", i)
        if i < 0 or end < 0:  # no markup can follow
            out.append(html[at:])
            return "".join(out)
        to, m = -1, _ELEMENT.match(html, i)
        if m and m[1].lower() in open_:
            close = _CLOSE[m[1].lower()].search(html, end + 1)
            to = close.end() if close else -1
            if not close:
                open_.discard(m[1].lower())
        elif "--" in open_ and html.startswith("<!--", i):
            j = html.find("-->", i + 4)
            to = j + 3 if j >= 0 else -1
            if j < 0:
                open_.discard("--")
        if to < 0:
            after = html.find("<", i + 1, end)
            if after >= 0:  # no tag, as another one begins before it ends
                out.append(html[at:after])
                at = after
                continue
            to = end + 1
        out += [html[at:i], " "]
        at = to


def address(url: str | None) -> tuple[str, str, str]:
    """Host, domain (its last two labels) and suffix; empty if there is none."""
    m = _HOST.match(url or "")
    host = m[1].lower().rstrip(".") if m else ""
    labels = host.split(".")
    return host, ".".join(labels[-2:]), labels[-1]


def declared_language(html: str) -> str:
    m = _LANG.search(html)
    if m:
        return m[1].lower()
    for tag in _META.finditer(html):
        name = _NAMED.search(tag[0])
        m = name and _CONTENT.search(tag[0], name.end())
        if m:
            return m[1].lower()
    return ""


def text_evidence(text: str, model: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of each language."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    total, n = np.zeros(len(model)), max(0, len(data) - 2)
    for at in range(0, n, PIECE):
        hist = np.bincount(trigrams(data[at:at + PIECE + 2]), minlength=BUCKETS)
        seen = np.flatnonzero(hist)
        total += model[:, seen] @ hist[seen]
    return total / max(1, n) * min(MAX_EVIDENCE, TEMPER * n)


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per page: page_id, lang, confidence, text_lang, declared, host,
    suffix.

    Null or empty html has no text evidence and no declaration, a null or odd
    url no address ('' for host and suffix; such pages share one prior); ties
    go to the first language by name. Without a document that has a language
    there is nothing to tell, and lang is null. Repeated rows are pages of
    their own. An empty table gives an empty result.
    """
    langs, model = language_model(docs)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    if not langs:
        return rows.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias(
            "confidence"), F.lit(None).cast("string").alias("text_lang"), F.lit("").alias("declared"),
            F.lit("").alias("host"), F.lit("").alias("suffix"))

    def evidence(frames):
        for pdf in frames:
            html = [x if isinstance(x, str) else "" for x in pdf["html"]]
            logs = np.array([text_evidence(page_text(x), model) for x in html]).reshape(len(html), len(langs))
            like = np.exp(logs - logs.max(axis=1, keepdims=True))
            host = [address(u if isinstance(u, str) else None) for u in pdf["url"]]
            yield pd.DataFrame({
                "page_id": pdf["page_id"].astype("Int64"), "declared": [declared_language(x) for x in html],
                "host": [h[0] for h in host], "domain": [h[1] for h in host], "suffix": [h[2] for h in host],
                "logs": list(logs), "p": list(like / like.sum(axis=1, keepdims=True))})

    seen = stage(rows.mapInPandas(evidence, "page_id long, declared string, host string, domain string, "
                                            "suffix string, logs array<double>, p array<double>"), "pages")
    n = len(langs)

    def sums(*keys):
        # ten decimal places, so that the sums do not hang on the order of the rows
        part = [F.sum(F.col("p")[i].cast("decimal(28,10)")).cast("double") for i in range(n)]
        return seen.groupBy(*keys).agg(F.array(*part).alias("_".join(keys) + "_n"))

    totals = seen.agg(*[F.sum(F.col("p")[i].cast("decimal(28,10)")).cast("double") for i in range(n)]).first()
    out = seen.withColumn("all_n", F.array(*[F.lit(float(x or 0)) for x in totals]))
    for key in ("suffix", "domain", "host", "declared"):
        out = out.join(stage(sums(key), key), key)
    # log prior: counts of the level without this page's own, plus STRENGTH times the level above
    share = lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, y: s + y))
    prior = share(F.transform("all_n", lambda x: x + 1.0))
    for key in ("suffix", "domain", "host"):
        rest = F.zip_with(F.col(f"{key}_n"), F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
        out = out.withColumn("prior", prior).withColumn("prior", share(
            F.zip_with(rest, F.col("prior"), lambda x, y: x + STRENGTH * y)))
        prior = F.col("prior")
    rest = F.zip_with(F.col("declared_n"), F.col("p"), lambda x, y: F.greatest(x - y, F.lit(0.0)))
    markup = F.zip_with(rest, F.col("all_n"), lambda x, y: F.log((x + DECLARED / n) / (y + DECLARED)))
    logs = F.zip_with(F.zip_with(F.col("logs"), F.transform("prior", lambda x: F.log(x)), lambda x, y: x + y),
                      F.col("markup"), lambda x, y: x + y)
    out = out.withColumn("markup", markup).withColumn("post", logs)
    top = F.array_max("post")
    names = F.array(*[F.lit(x) for x in langs])
    best = lambda a: names[F.array_position(a, F.array_max(a)).cast("int") - 1]
    total = F.aggregate(F.transform("post", lambda x: F.exp(x - top)), F.lit(0.0), lambda s, y: s + y)
    return out.select("page_id", best(F.col("post")).alias("lang"), F.round(1 / total, 6).alias("confidence"),
                      best(F.col("logs")).alias("text_lang"), "declared", "host", "suffix")
