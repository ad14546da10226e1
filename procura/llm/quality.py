"""Quality classifier: document evidence with hierarchical empirical-Bayes site priors.

Document evidence is a naive-Bayes log-likelihood ratio over binned text
features, one of them the learnt evidence of runs of three characters, from all labelled rows. Sites form a hierarchy: all documents,
host, path under the host. A site's share of good documents is estimated from the
documents' own probabilities and shrunk towards the level above; how strongly
is estimated from the spread between sites (method of moments). The path's
posterior, without the document itself, is the prior its evidence is weighed with."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import once
from ..session import materialize
from .common import row_key

#: Bins of each feature; the last bin is open.
BINS = {"symbols": 8, "punctuation": 8, "capitals": 8, "repeats": 8, "grams": 16, "size": 12}
BIN_COLUMNS = [f"bin_{name}" for name in BINS]
#: Junk is broad, good text narrow: pseudo-documents spread evenly over a feature's bins, so that a bin neither class
#: has shown speaks against a document, whatever fills it. Sizes say nothing of that kind and get one a bin in both.
GOOD_SPREAD, BAD_SPREAD = 0.5, 8.0
GRAM_BUCKETS = 4096       # three characters in a row are counted under one of these
GRAM_UNIT = 1000          # their log-likelihood ratios are whole thousandths, so sums do not depend on their order
GRAM_STEPS = 4            # bins of a quarter each, from -GRAM_BINS / 2 / GRAM_STEPS upwards
GRAM_LABELS = 65_536      # labelled rows that they are learnt from: those of the least MD5 of their id; the other features take all
PIECE = 1 << 20           # characters of a text looked at together
# Characters that are neither capitals nor marks, and those of ordinary punctuation.
PLAIN = r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}\p{M}\p{N}\p{Z}\x09-\x0D]+"
NO_CAPITAL = r"[^\p{Lu}]+"
NO_PUNCTUATION = r"[^.,;:!?'\"()\x{2018}\x{2019}\x{201C}\x{201D}\x{AB}\x{BB}\x{A1}\x{BF}\x{2026}\x{2013}\x{2014}-]+"
UNIT = 1_000_000          # probabilities are summed as millionths, so sums do not depend on their order
MOST_SHRUNK = 1_000_000.0
EDGE = 0.0001             # priors stay this far from 0 and 1
THRESHOLD = 0.5


def _binned(part: Column, whole: Column, steps: int, feature: str) -> Column:
    """min(last bin, floor(steps * part / whole)), in whole numbers."""
    return F.least(F.lit(BINS[feature] - 1), F.floor((part * steps) / F.greatest(whole, F.lit(1)))).cast("int")


def gram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all runs of three characters of a text, a piece at a time."""
    text = text or ""
    for start in range(0, max(0, len(text) - 2), PIECE):
        c = np.frombuffer(text[start:start + PIECE + 2].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        yield ((c[:-2] * 31 + c[1:-1]) * 31 + c[2:]) % GRAM_BUCKETS


def learn_grams(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str,
                label_id: str = "doc_id", label_col: str = "quality", most: int = GRAM_LABELS) -> list[int]:
    """log P(bucket | good) / P(bucket | bad) in thousandths, from the whole texts of ``most`` labelled rows, add-one smoothed.

    The labelled rows, two numbers each, are broadcast, so texts are not shuffled. A task adds up
    its own texts; one row for each bucket and class reaches the driver."""
    marked = labels.select(F.col(label_id).alias("lid"), F.col(label_col).cast("int").alias("good")) \
        .filter(F.col("good").isin(0, 1) & F.col("lid").isNotNull()) \
        .orderBy(F.md5(F.col("lid").cast("string")), "lid", "good").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")) \
        .join(F.broadcast(marked), F.col("id") == F.col("lid")).select("good", "body")

    def count(batches):
        seen = np.zeros((2, GRAM_BUCKETS), np.int64)
        for batch in batches:
            for good, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for buckets in gram_buckets(body.as_py()):
                    seen[good] += np.bincount(buckets, minlength=GRAM_BUCKETS)
        good, bucket = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(good, pa.int32()), pa.array(bucket, pa.int32()),
                                          pa.array(seen[good, bucket], pa.int64())], ["good", "bucket", "n"])

    total = np.zeros((2, GRAM_BUCKETS))
    for r in texts.mapInArrow(count, "good int, bucket int, n long").groupBy("good", "bucket").agg(F.sum("n").alias("n")).collect():
        total[r["good"], r["bucket"]] = r["n"]
    share = np.log((total + 1.0) / (total.sum(1, keepdims=True) + GRAM_BUCKETS))
    return [int(x) for x in np.floor((share[1] - share[0]) * GRAM_UNIT + 0.5)]


def gram_bin(text: Column, grams: list[int]) -> Column:
    """The bin of the mean ratio of a text's runs of three characters; a text without any has the middle bin."""
    weights, half = np.array(grams, np.int64), BINS["grams"] // 2

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        bins = []
        for text in texts:
            total = n = 0
            for buckets in gram_buckets(text):
                total, n = total + int(weights[buckets].sum()), n + len(buckets)
            bins.append(min(2 * half - 1, max(0, half + (total * GRAM_STEPS // (GRAM_UNIT * n) if n else 0))))
        return pd.Series(bins, dtype="int32")

    return run(text)


def binned_features(docs: DataFrame, text_col: str, carry: list[str], grams: list[int]) -> DataFrame:
    """``carry`` columns and ``bin_<feature>``: symbols a word (characters that are no letter, digit, blank or
    ordinary punctuation), punctuation a word, capitals of any script a character, words equal to the one before,
    the learnt evidence of runs of three characters, and the size in doublings. Arrays are named first, as a lambda
    over an unnamed one builds it for each word."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    taken = once(docs.select(*carry, body.alias("x_text"), gram_bin(body, grams).alias("bin_grams")),
                 x_words=F.split("x_text", r"[\x20\x09-\x0D]+"),
                 x_marks=F.regexp_replace("x_text", PLAIN, ""), x_chars=F.length("x_text")).drop("x_text")
    tokens, marks = F.col("x_words"), F.col("x_marks")
    n = F.size(tokens)
    taken = once(taken, x_capitals=F.length(F.regexp_replace(marks, NO_CAPITAL, "")),
                 x_points=F.length(F.regexp_replace(marks, NO_PUNCTUATION, "")))
    repeats = F.size(F.filter(tokens, lambda x, i: (i > 0) & (x == F.get(tokens, i - 1))))
    size = F.least(F.lit(BINS["size"] - 1), F.length(F.bin((n + 1).cast("long"))) - 1).cast("int")
    return once(taken, bin_symbols=_binned(F.length(marks) - F.col("x_capitals") - F.col("x_points"), n, 8, "symbols"),
                bin_punctuation=_binned(F.col("x_points"), n + 3, 4, "punctuation"),
                bin_capitals=_binned(F.col("x_capitals"), F.col("x_chars"), 16, "capitals"),
                bin_repeats=_binned(repeats, n, 16, "repeats"), bin_size=size) \
        .select(*carry, *BIN_COLUMNS)


def spread(feature: str) -> tuple[float, float]:
    """Pseudo-documents of one bin: of the good class, of the bad class."""
    return (1.0, 1.0) if feature == "size" else (GOOD_SPREAD / BINS[feature], BAD_SPREAD / BINS[feature])


@dataclass(frozen=True)
class Model:
    """``ratios[feature][bin]``: log P(bin | good) / P(bin | bad); ``base``: share of good labels;
    ``mean``: estimated share of good documents; ``paths``: posterior by site."""

    ratios: dict[str, tuple[float, ...]]
    base: float
    mean: float
    host_weight: float
    path_weight: float
    paths: DataFrame


def _logit(p: float) -> float:
    return math.log(p / (1.0 - p))


def learn_evidence(bins: DataFrame, labels: DataFrame, label_id: str = "doc_id",
                   label_col: str = "quality") -> tuple[dict[str, tuple[float, ...]], float]:
    """(log-likelihood ratios, share of good labels) from all labelled rows of
    ``bins`` (id, bin columns), smoothed by :func:`spread`.

    Only the counts, one row for each feature, bin and class, reach the driver."""
    marked = labels.select(F.col(label_id).alias("lid"), F.col(label_col).alias("good")) \
        .filter(F.col("good").isin(0, 1) & F.col("lid").isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"bin_{n}").alias("bin")) for n in BINS]))
    counted = bins.select("id", *BIN_COLUMNS).join(marked, bins["id"] == marked["lid"]).select("good", pairs.alias("x")) \
        .groupBy("x.feature", "x.bin", "good").agg(F.count(F.lit(1)).alias("n")).collect()
    seen = {(r["feature"], r["bin"], r["good"]): r["n"] for r in counted}
    good, bad = (sum(n for (f, _, g), n in seen.items() if f == "size" and g == c) for c in (1, 0))
    ratios = {}
    for f, size in BINS.items():
        more, less = spread(f)
        ratios[f] = tuple(math.log((seen.get((f, b, 1), 0) + more) / (good + more * size))
                          - math.log((seen.get((f, b, 0), 0) + less) / (bad + less * size)) for b in range(size))
    return ratios, (good + 1.0) / (good + bad + 2.0)


def evidence(bins: DataFrame, ratios: dict[str, tuple[float, ...]], base: float, carry: list[str]) -> DataFrame:
    """``carry`` columns, ``evidence`` (log-likelihood ratio) and ``own`` (probability under
    the base rate, in millionths)."""
    total = F.lit(0.0)
    for name in BINS:
        total = total + F.element_at(F.array(*[F.lit(x) for x in ratios[name]]), F.col(f"bin_{name}") + 1)
    own = F.round(F.lit(UNIT) / (F.lit(1.0) + F.exp(-(F.col("evidence") + F.lit(_logit(base)))))).cast("long")
    return bins.select(*carry, total.alias("evidence")).withColumn("own", own)


def _weight(between: float, mean: float, groups: int, rows: int) -> float:
    """Pseudo-documents of the level above: mean (1 - mean) / variance - 1, where the variance
    between sites is what is left of the observed one after sampling noise."""
    spread = between - mean * (1.0 - mean) * groups / max(1, rows)
    if spread <= 0.0:
        return MOST_SHRUNK
    return min(MOST_SHRUNK, max(1.0, mean * (1.0 - mean) / spread - 1.0))


def fit(bins: DataFrame, labels: DataFrame) -> Model:
    """Learn the evidence, then the host and path posteriors over all documents.

    ``bins`` has id, host, path and the bin columns, best stored: it is read twice.
    Sums are grouped by path, then hosts from paths, so a host with a third of all rows is
    combined map-side. Only scalars reach the driver; the site tables stay tables."""
    ratios, base = learn_evidence(bins, labels)
    paths = materialize(evidence(bins, ratios, base, ["host", "path"])
                        .groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("own").alias("s")), "quality_sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.count(F.lit(1)).alias("k"))
    sums = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("k")).first()
    n, groups = sums["n"] or 0, sums["k"] or 0
    mean = min(1.0 - EDGE, max(EDGE, (sums["s"] or 0) / UNIT / n if n else base))
    rate = F.col("hs") / F.lit(float(UNIT)) / F.col("hn")
    by_host = hosts.agg(F.sum(F.col("hn") * F.pow(rate - F.lit(mean), 2.0)).alias("v"), F.count(F.lit(1)).alias("k")).first()
    host_weight = _weight((by_host["v"] or 0.0) / max(1, n), mean, by_host["k"], n)
    posterior = (F.col("hs") / F.lit(float(UNIT)) + F.lit(host_weight * mean)) / (F.col("hn") + F.lit(host_weight))
    hosts = hosts.select(row_key(F.col("host")).alias("hkey"), posterior.alias("host_rate"))
    paths = paths.withColumn("hkey", row_key(F.col("host"))).join(hosts, "hkey").drop("hkey")
    rate = F.col("s") / F.lit(float(UNIT)) / F.col("n")
    between = paths.agg(F.sum(F.col("n") * F.pow(rate - F.col("host_rate"), 2.0)).alias("v")).first()["v"] or 0.0
    path_weight = _weight(between / max(1, n), mean, groups, n)
    return Model(ratios, base, mean, host_weight, path_weight,
                 materialize(paths.select(row_key(F.col("host"), F.col("path")).alias("site"), "n", "s", "host_rate"),
                             "quality_paths"))


def score(bins: DataFrame, model: Model, payload: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """``payload`` columns of ``bins`` (host, path, bin columns, payload) plus ``evidence``, ``host_rate``,
    ``site_prior``, ``quality`` (posterior probability) and ``keep``.

    ``site_prior`` leaves the document's own probability out of its path's sums. A path that the model has
    not seen gets the overall mean."""
    known = evidence(bins, model.ratios, model.base, [*payload, "host", "path"]) \
        .withColumn("x_site", row_key(F.col("host"), F.col("path"))).drop("host", "path") \
        .join(model.paths, F.col("x_site") == F.col("site"), "left")
    host = F.coalesce("host_rate", F.lit(model.mean))
    prior = (F.coalesce((F.col("s") - F.col("own")) / F.lit(float(UNIT)), F.lit(0.0)) + F.lit(model.path_weight) * host) \
        / (F.coalesce(F.col("n") - 1, F.lit(0)) + F.lit(model.path_weight))
    prior = F.least(F.lit(1.0 - EDGE), F.greatest(F.lit(EDGE), prior))
    return known.withColumn("host_rate", host).withColumn("site_prior", prior) \
        .withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(
            -(F.col("evidence") + F.log(F.col("site_prior") / (F.lit(1.0) - F.col("site_prior"))))))) \
        .withColumn("keep", F.col("quality") >= threshold) \
        .select(*payload, "evidence", "host_rate", "site_prior", "quality", "keep")


def _bins(docs: DataFrame, grams: list[int], id_col: str, text_col: str, host_col: str, path_col: str) -> DataFrame:
    slim = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(path_col).alias("path"),
                       F.col(text_col).alias("body"))
    return materialize(binned_features(slim, "body", ["id", "host", "path"], grams), "quality_bins")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """Fit on ``labels`` (doc_id, quality 0/1) and all of ``docs``, then score ``docs``: one row per document with
    ``id``, ``evidence``, ``host_rate``, ``site_prior``, ``quality`` and ``keep``. Texts are read once, labelled ones twice.

    Cases: NULL texts count as empty and are judged by size and site; NULL hosts and paths are sites of
    their own; labels that are NULL, neither 0 nor 1, or without a document are not used; a document
    labelled twice counts twice. Without labels the evidence is 0 and the site prior alone decides.
    Rows repeated with the same id are scored each. No documents give no rows. Other columns are not
    read, whatever their names."""
    bins = _bins(docs, learn_grams(docs, labels, id_col, text_col), id_col, text_col, host_col, path_col)
    return score(bins, fit(bins, labels), ["id"])


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, columns unchanged.

    Rows are scored where they are read, against the site table; texts are not shuffled
    unless that table is too large to broadcast by its measured size."""
    grams = learn_grams(docs, labels, id_col, text_col)
    model = fit(_bins(docs, grams, id_col, text_col, host_col, path_col), labels)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x_row"),
                         F.col(text_col).alias("body"), F.col(host_col).alias("host"), F.col(path_col).alias("path"))
    kept = score(binned_features(packed, "body", ["x_row", "host", "path"], grams), model, ["x_row"]).filter("keep")
    return kept.select(*[F.col("x_row")[c].alias(c) for c in docs.columns])
