"""Substring dedup over the de Bruijn graph of a corpus.

Every run of ``k`` words is an edge from its first ``k - 1`` words to its last.
Edges that several documents have are the repeated ones.

Texts are cut into stretches: maximal runs of edges with one minimizer, the
lowest hash of the shorter word runs inside an edge. Equal edges have equal
minimizers, so a first pass shuffles stretches instead of edges, a fifth as
many. A minimizer that one document has is dropped. If all stretches of a
minimizer are equal, they are one nonbranching path of the graph, and the
stretch is settled whole. Where they differ the graph branches, and only there
edges are built and compared one by one. What is repeated is then compacted
along its text into paths, named by their source coordinates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

K = 13          # words in a window
M = 5           # words in a run that may be a minimizer
NO_ID = 2**63 - 1
_CHUNK = 1 << 20
LONGEST = 1_023  # windows in a stretch; a span packs (first: 53 bits, windows: 10)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _cuts(text: bytes) -> Iterator[bytes]:
    """The text in pieces of about a megabyte, cut at blanks."""
    at = 0
    while at < len(text):
        stop = _BLANK.search(text, min(len(text), at + _CHUNK))
        end = stop.start() if stop else len(text)
        yield text[at:end]
        at = end + 1


def word_hashes(text: bytes) -> np.ndarray:
    parts = [np.array([xxhash.xxh64_intdigest(w) for w in piece.split()], np.uint64) for piece in _cuts(text)]
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def run_hashes(w: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` words: a polynomial, then mixed."""
    n = len(w) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = w[:n].copy()
    for j in range(1, length):
        h *= base
        h += w[j:j + n]
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h ^= h >> np.uint64(shift)
        h *= np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def stretches(w: np.ndarray, k: int = K, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, hash of all its words, first window, windows): maximal runs of windows
    with one minimizer, cut at ``LONGEST`` windows."""
    if len(w) < k:
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = run_hashes(w, min(m, k), _B1)
    width = k - min(m, k) + 1
    low, done = h, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:len(low) - step], low[step:])
        done += step
    first = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    count = np.diff(np.concatenate((first, [len(low)])))
    low = low[first]
    reps = -(-count // LONGEST)
    if reps.max() > 1:
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        count = np.minimum(np.repeat(count, reps) - nth * LONGEST, LONGEST)
        low, first = np.repeat(low, reps), np.repeat(first, reps) + nth * LONGEST
    # Prefix sums of a polynomial give the hash of any span of words.
    powers = np.cumprod(np.full(len(w), _B2, np.uint64))
    inverse = np.cumprod(np.full(len(w), np.uint64(pow(int(_B2), -1, 2**64)), np.uint64))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(w * powers)))
    whole = (sums[first + count + k - 1] - sums[first]) * inverse[first]
    return low, whole ^ (whole >> np.uint64(29)) ^ (count.astype(np.uint64) << np.uint64(53)), first, count


def _zipped(docs: DataFrame) -> DataFrame:
    """(doc, tkey, packed): texts travel through shuffles compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [zip_.compress(t.as_py()) for t in batch.column("utf8")]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tkey"), pa.array(packed, pa.binary())],
                                             ["doc", "tkey", "packed"])

    return docs.mapInArrow(run, "doc long, tkey long, packed binary")


def _stretch_spans(docs: DataFrame, k: int, m: int) -> DataFrame:
    """(doc, tkey, mixed, settled): for each text the spans of stretches whose minimizer another id has as well:
    ``mixed`` those to be compared edge by edge, ``settled`` (span, source) those that go whole."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for doc, tkey, text in zip(batch.column("doc").to_pylist(), batch.column("tkey").to_pylist(),
                                       batch.column("utf8"), strict=True):
                low, whole, first, count = stretches(word_hashes(text.as_py()), k, m)
                if len(low):
                    held.append((low.view(np.int64), whole.view(np.int64), np.full(len(low), doc, np.int64),
                                 np.full(len(low), tkey, np.int64), (first << 10) | count))
                    size += len(low)
                if size >= 200_000:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    def table(held: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)],
                                          ["low", "whole", "doc", "tkey", "span"])

    found = docs.mapInArrow(emit, "low long, whole long, doc long, tkey long, span long")
    shared = found.groupBy("low").agg(F.min("doc").alias("source"), F.max("doc").alias("last"),
                                      F.min("whole").alias("w1"), F.max("whole").alias("w2")) \
        .filter("source < last") \
        .select(F.bitwise_not("low").alias("key"), "source", (F.col("w1") != F.col("w2")).alias("branches"))
    kept = found.select(F.bitwise_not("low").alias("key"), "doc", "tkey", "span").join(shared, "key") \
        .filter("branches or doc > source")
    return materialize(kept.groupBy("doc", "tkey").agg(
        F.collect_set(F.when(F.col("branches"), F.col("span"))).alias("mixed"),
        F.collect_set(F.when(~F.col("branches"), F.struct("span", "source"))).alias("settled")), "substring_spans")


def _keyed(texts: DataFrame) -> DataFrame:
    """Adds ``d`` and ``t``, the join keys of a text, derived from its ``doc`` and ``tkey``."""
    return texts.withColumn("d", F.bitwise_not("doc")).withColumn("t", F.bitwise_not("tkey"))


def _edges(zipped: DataFrame, spans: DataFrame, k: int) -> DataFrame:
    """(doc, tkey, at, edge, check): edges of the mixed stretches, as arrays, one row a text."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, size = [], 0
            for doc, tkey, packed, mixed in zip(*(batch.column(c) for c in ("doc", "tkey", "packed", "mixed")), strict=True):
                span = mixed.values.to_numpy(zero_copy_only=False)
                w = word_hashes(unzip.decompress(packed.as_py()))
                marks = np.zeros(len(w) - k + 2, np.int32)
                first = span >> 10
                np.add.at(marks, first, 1)
                np.add.at(marks, first + (span & 0x3FF), -1)
                at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                edge = run_hashes(w, k, _B1)[at].view(np.int64)
                check = (run_hashes(w, k, _B2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
                rows.append((doc.as_py(), tkey.as_py(), at.astype(np.int32), edge, check))
                size += len(at)
                if size >= 500_000:
                    yield pack(rows, kind)
                    rows, size = [], 0
            if rows:
                yield pack(rows, kind)

    def pack(rows: list, kind: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kind, strict=True)],
                                          ["doc", "tkey", "at", "edge", "check"])

    wanted = _keyed(spans.filter(F.size("mixed") > 0)).select("d", "t", "mixed")
    joined = _keyed(zipped).join(wanted, ["d", "t"]).select("doc", "tkey", "packed", "mixed")
    return materialize(joined.mapInArrow(emit, "doc long, tkey long, at array<int>, edge array<long>, check array<int>"),
                       "substring_edges")


def repeated_edges(edges: DataFrame) -> DataFrame:
    """(doc, tkey, at, n, source): occurrences of edges that a smaller id has as well (n is 1).

    An edge is known by 96 bits of two independent hashes. Occurrences meet their edge's first
    document in a join whose hot keys AQE splits."""
    flat = edges.select("doc", "tkey", F.explode(F.arrays_zip("at", "edge", "check")).alias("e")) \
        .select("doc", "tkey", "e.at", "e.edge", "e.check")
    graph = flat.groupBy("edge", "check").agg(F.min("doc").alias("source"), F.max("doc").alias("last")) \
        .filter("source < last").select(F.bitwise_not("edge").alias("key"), F.bitwise_not("check").alias("tag"), "source")
    return flat.select("doc", "tkey", "at", F.bitwise_not("edge").alias("key"), F.bitwise_not("check").alias("tag")) \
        .join(graph, ["key", "tag"]).filter("doc > source").select("doc", "tkey", F.col("at").cast("long"), F.lit(1).cast("long").alias("n"), "source")


def compacted(repeated: DataFrame) -> DataFrame:
    """(doc, tkey, paths): what follows on in a text with the same source becomes one path (at, edges, source).

    Rows of one id and text bring their spans once each; equal spans fall into one path."""
    text = W.partitionBy("doc", "tkey").orderBy("at", "n")
    stop = F.col("at") + F.col("n")
    follows = (F.col("at") <= F.lag(stop).over(text)) & (F.col("source") == F.lag("source").over(text))
    numbered = repeated.withColumn("opens", F.when(follows, 0).otherwise(1)) \
        .withColumn("path", F.sum("opens").over(text.rowsBetween(W.unboundedPreceding, W.currentRow)))
    paths = numbered.groupBy("doc", "tkey", "path") \
        .agg(F.min("at").alias("at"), (F.max(stop) - F.min("at")).alias("edges"), F.min("source").alias("source"))
    return paths.groupBy("doc", "tkey").agg(F.collect_list(F.struct("at", "edges", "source")).alias("paths"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, m: int = M) -> DataFrame:
    """One row per input row: ``id``, ``n_words``, ``n_removed``, ``kept_text`` (the kept words joined by one
    blank) and ``spans`` (word ranges [start, stop) removed, with the smallest id that has the first window).

    A word goes if a window of ``k`` words that covers it also starts in a
    document with a smaller id; all windows are judged on the input.

    Cases: NULL and short texts keep all words. A NULL id counts as larger
    than any id and is returned as NULL; texts with equal ids (or NULL ids) do
    not remove each other's words (they are told apart by a 64-bit hash of
    the text). An empty table gives no rows. Whole texts
    are read, long ones in pieces; one text is the largest thing a task holds.
    Other columns are not read, whatever their names."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    # ``tkey`` tells texts with the same id apart.
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"),
                       F.xxhash64(body).alias("tkey"), body.cast("binary").alias("utf8"))
    spans, zipped = _stretch_spans(rows, k, m), _zipped(rows)
    settled = spans.select("doc", "tkey", F.explode("settled").alias("s")).select("doc", "tkey", "s.span", "s.source") \
        .select("doc", "tkey", F.shiftrightunsigned("span", 10).alias("at"),
                F.col("span").bitwiseAND(F.lit(0x3FF)).alias("n"), "source")
    repeated = settled.unionByName(repeated_edges(_edges(zipped, spans, k)))
    paths = _keyed(materialize(compacted(repeated), "substring_paths")).select("d", "t", "paths")
    joined = _keyed(zipped).join(paths, ["d", "t"], "left").select("doc", "packed", "paths")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("source", pa.int64())])
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out, size = [], 0
            for doc, packed, found in zip(*(batch.column(c) for c in ("doc", "packed", "paths")), strict=True):
                doc, found = doc.as_py(), found.as_py() or []
                tokens = unzip.decompress(packed.as_py()).split()
                spans: list[dict] = []
                for path in sorted(found, key=lambda x: x["at"]):
                    start, stop = path["at"], path["at"] + path["edges"] + k - 1
                    if spans and start <= spans[-1]["stop"]:
                        spans[-1]["stop"] = max(stop, spans[-1]["stop"])
                    else:
                        spans.append({"start": start, "stop": stop, "source": path["source"]})
                kept, at = [], 0
                for s in spans:
                    kept += tokens[at:s["start"]]
                    at = s["stop"]
                kept += tokens[at:]
                joined_text = b" ".join(kept)
                out.append((None if doc == NO_ID else doc, len(tokens), len(tokens) - len(kept), joined_text, spans))
                size += len(joined_text)
                if size >= 1 << 24:
                    yield pack(out, span)
                    out, size = [], 0
            if out:
                yield pack(out, span)

    def pack(out: list, span: pa.DataType) -> pa.RecordBatch:
        ids, words, removed, kept, spans = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(span))],
            ["id", "n_words", "n_removed", "kept_text", "spans"])

    return joined.mapInArrow(cut, "id long, n_words long, n_removed long, kept_text string, "
                                  "spans array<struct<start:int,stop:int,source:long>>")
