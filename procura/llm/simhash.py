"""SimHash near-dedup: vantage-point trees over fingerprints, then connected components.

A fingerprint's words are split into ``blocks`` disjoint bit ranges. Two
fingerprints within ``max_bits`` differ by at most ``max_bits // blocks`` bits
in one of the ranges, so each range has a tree of its own, searched with that
smaller radius; candidates are checked on all 64 bits. A tree node holds a
vantage point and a radius ``mu``: members nearer than ``mu`` go left, others
right, and by the triangle inequality only members with a distance below
``mu + r`` can be within r of one on the left, so those go left as well. Every
close pair therefore meets in a leaf, which is a shard of the self join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import fresh, row_key

SHINGLE_WORDS = 3
MAX_BITS = 3
BLOCKS = 2
SAMPLE = 16_384      # fingerprints the trees are fitted on (they only steer the split)
LEAF = 2_048         # members aimed at in a leaf
TASK_MEMBERS = 16_384  # a larger leaf is linked in pairs of pieces of this size
_CHUNK = 65_536


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a UTF-8 text: A-Z lower-cased, ASCII-blank separated words, XXH64
    (seed 42) of every shingle; a bit is set if over half the hashes have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    k = min(shingle_words, len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(tokens) - k + 1]
    stops = ends[k - 1:]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(stops), _CHUNK):
        spans = zip(starts[at:at + _CHUNK].tolist(), stops[at:at + _CHUNK].tolist(), strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in spans], np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in range(64) if 2 * int(counts[b]) > len(stops))


def fingerprints(docs: DataFrame, text_col: str, carry: list[str], shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``carry`` columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    source = docs.select(*carry, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("utf8"))
    schema = T.StructType([*source.drop("utf8").schema.fields, T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle_words) for t in batch.column("utf8").to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [fp], [*carry, "fp"])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class VPTree:
    """Nodes as (vantage point, mu, left, right); a negative child is leaf ``-child - 1``."""

    mask: int
    radius: int
    nodes: tuple[tuple[int, int, int, int], ...]
    leaves: int

    def shards(self, fps: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf, positions of the members it gets), own and boundary ones alike."""
        out, todo = [], [(0 if self.nodes else -1, np.arange(len(fps)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((-node - 1, at))
                continue
            point, mu, left, right = self.nodes[node]
            d = np.bitwise_count((fps[at] ^ np.uint64(point)) & np.uint64(self.mask))
            todo.append((left, at[d < mu + self.radius]))
            todo.append((right, at[d >= mu]))
        return out


def fit_tree(sample: np.ndarray, mask: int, radius: int, total: int, leaf: int = LEAF) -> VPTree:
    """A tree fitted on a sample: a node's vantage point and ``mu`` are the ones of
    a few tried that leave the smallest larger side, boundary members included."""
    nodes: list[list[int]] = []
    leaves = 0
    scale = total / max(1, len(sample))

    def grow(members: np.ndarray) -> int:
        nonlocal leaves
        best = None
        if len(members) * scale > leaf and len(members) >= 16:
            for point in members[:: max(1, len(members) // 12)][:12]:
                d = np.bitwise_count((members ^ point) & np.uint64(mask)).astype(np.int64)
                for mu in {int(np.median(d)), int(np.median(d)) + 1}:
                    left, right = int((d < mu + radius).sum()), int((d >= mu).sum())
                    if 0 < left < len(members) and 0 < right < len(members) and (best is None or max(left, right) < best[0]):
                        best = (max(left, right), int(point), mu, d)
        if best is None or best[0] > 0.95 * len(members):
            leaves += 1
            return -leaves
        _, point, mu, d = best
        nodes.append([point, mu, 0, 0])
        at = len(nodes) - 1
        nodes[at][2] = grow(members[d < mu + radius])
        nodes[at][3] = grow(members[d >= mu])
        return at

    grow(sample)
    return VPTree(mask, radius, tuple(tuple(n) for n in nodes), max(1, leaves))


def fit_trees(fps: DataFrame, max_bits: int, blocks: int, sample_size: int, leaf: int) -> list[VPTree]:
    """One tree for each bit range, from a bounded sample (the lowest hashes) of ``fps``."""
    total = fps.count()
    picked = fps.orderBy(F.xxhash64("fp", F.lit(7)), "fp").limit(sample_size).toPandas()["fp"]
    sample = picked.to_numpy(np.int64).view(np.uint64)
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [fit_tree(sample, m, max_bits // blocks, total, leaf) for m in masks]


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the labelled sets that the pairs (a, b) connect; a set's label is its lowest."""
    x, y = labels[a], labels[b]
    differ = x != y
    if not differ.any():
        return labels
    pairs = np.unique(np.stack([np.minimum(x, y)[differ], np.maximum(x, y)[differ]], 1), axis=0)
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (p := parent.get(i, i)) != i:
            parent[i] = parent.get(p, p)
            i = p
        return i

    for i, j in pairs.tolist():
        ri, rj = root(i), root(j)
        if ri != rj:
            parent[max(ri, rj)] = min(ri, rj)
    table = np.arange(len(labels))
    for i in parent:
        table[i] = root(i)
    return table[labels]


def link_members(fps: np.ndarray, side: np.ndarray, max_bits: int, rows: int = 128) -> np.ndarray:
    """For each member, the position of the lowest member it is connected to by pairs
    within ``max_bits``; pairs are all of them (``side`` 0 throughout) or those of
    side 0 with side 1. Compares blocks of rows, so memory is rows x members."""
    order = np.argsort(fps.view(np.int64), kind="stable")
    fps, side = fps[order], side[order]
    labels = np.arange(len(fps))
    one = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if (side == 1).any() else None
    for at in range(0, len(one), rows):
        mine = one[at:at + rows]
        rest = other if other is not None else one[at:]
        close = np.bitwise_count(fps[mine][:, None] ^ fps[rest][None, :]) <= max_bits
        i, j = np.nonzero(close)
        if len(i):
            labels = _merge(labels, mine[i], rest[j])
    out = np.empty(len(fps), np.int64)
    out[order] = order[labels]
    return out


def close_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, sample_size: int = SAMPLE,
                leaf: int = LEAF, task_members: int = TASK_MEMBERS) -> DataFrame:
    """(u, v), u > v: links between distinct fingerprints (column ``fp``) that
    connect all that differ in ``max_bits`` or fewer bits. Each shard reports
    its connected sets as stars, at most one link a member, never all pairs.

    A leaf above ``task_members`` (a dense group) is dealt into pieces, and
    every pair of pieces is a task of its own; none is cut short."""
    trees = fit_trees(fps, max_bits, blocks, sample_size, leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            for t, tree in enumerate(trees):
                for shard, at in tree.shards(fp.view(np.uint64)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), t * 1_000_000 + shard, np.int64)), pa.array(fp[at])], ["shard", "fp"])

    members = materialize(fps.mapInArrow(route, "shard long, fp long"), "simhash_shards")
    # One row a leaf: at most 2 x blocks x sample_size / 16 rows, whatever the data.
    pieces = members.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(task_members)).cast("int").alias("pieces"))
    dealt = members.join(F.broadcast(pieces), "shard") \
        .withColumn("piece", F.pmod(F.xxhash64("fp", F.lit(11)), F.col("pieces")).cast("int")) \
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))) \
        .select("shard", F.least("piece", "with").alias("p"), F.greatest("piece", "with").alias("q"),
                (F.col("piece") > F.col("with")).cast("int").alias("side"), "fp")

    def link(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy(np.int64)
        low = link_members(fp.view(np.uint64), group["side"].to_numpy(), max_bits)
        linked = low != np.arange(len(fp))
        return pd.DataFrame({"u": fp[linked], "v": fp[low[linked]]})

    return dealt.groupBy("shard", "p", "q").applyInPandas(link, "u long, v long").filter("u <> v").distinct()


def connected(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the lowest node reachable over links (u, v), for all nodes
    that have links. Alternates large-star and small-star; each round is written to the shared
    folder, so a lost executor costs one round. Stops when a round changes nothing."""
    def signature(edges: DataFrame):
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    edges = materialize(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    last = signature(edges)
    for _ in range(max_rounds):
        if not last[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")) \
            .select(F.bitwise_not("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").withColumn("k", F.bitwise_not("u")).join(low, "k") \
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.bitwise_not("u").alias("k"), "m")
        small = large.withColumn("k", F.bitwise_not("u")).join(low, "k") \
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").filter("u <> v").distinct()
        edges = materialize(small, "links")
        now = signature(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
                   shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, **options) -> DataFrame:
    """One row per document: ``id``, ``carry`` columns, ``fp`` (signed), ``root``
    (lowest fingerprint of the component) and ``component_id`` (smallest id of
    the component).

    Documents with equal fingerprints are one node, so groups of copies cost
    one member; their rows meet again in a join that AQE can split.

    Cases: NULL, empty and blank texts have fingerprint 0 and are linked like
    any other. NULL ids take part; ``component_id`` is NULL only if all ids of
    the component are. Rows repeated with the same id are judged one by one.
    An empty table gives no rows. Texts are read whole, however long. Other
    columns are not read, whatever their names."""
    picked = docs.select(F.col(id_col).alias("id"), *carry, F.col(text_col).alias("body"))
    rows = materialize(fingerprints(picked, "body", ["id", *carry], shingle_words), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint_nodes")
    roots = connected(close_links(nodes.select("fp"), max_bits, **options))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left") \
        .select("fp", F.coalesce("root", "fp").alias("root"), "least")
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id")) \
        .select(F.bitwise_not("root").alias("rk"), "component_id")
    named = rooted.withColumn("rk", F.bitwise_not("root")).join(lowest, "rk") \
        .select(F.bitwise_not("fp").alias("fk"), "root", "component_id")
    return rows.withColumn("fk", F.bitwise_not("fp")).join(named, "fk") \
        .select("id", *carry, "fp", "root", "component_id")


def hex_fingerprint(fp):
    """16 lowercase hex digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without near copies, columns unchanged: of each
    component the row with the smallest id stays (NULL ids last; ties, and
    rows repeated with the same id and text, by the text's SHA-256)."""
    key, rank, sha = fresh(docs, "near_key"), fresh(docs, "near_rank"), "near_sha"
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    slim = docs.select(F.col(id_col).alias("id"), digest.alias(sha), F.col(text_col).alias("body"))
    groups = simhash_groups(slim, "id", "body", (sha,), **options)
    stay = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col(sha))).alias("m")) \
        .select(row_key(F.col("m.id"), F.col(f"m.{sha}")).alias("stay"))
    keyed = docs.withColumn(key, row_key(F.col(id_col), digest))
    return keyed.join(stay, keyed[key] == stay["stay"], "left_semi") \
        .withColumn(rank, F.row_number().over(W.partitionBy(key).orderBy(key))) \
        .filter(F.col(rank) == 1).drop(key, rank)
