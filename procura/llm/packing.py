"""Best-fit packing into bins of several permitted lengths."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import row_key

CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16.0  # cost of a bin beside its length


@dataclass
class Plan:
    """Where the pieces of each length go, as runs; sorted by (length, first rank).

    A run puts ``count`` pieces of ``length``, from rank ``rank`` on, ``each`` at
    a time into consecutive bins from ``bin`` on, at ``offset`` in the bin.
    ``bin_start/bin_capacity/bin_used`` describe the bins by ranges."""

    length: list[int] = field(default_factory=list)
    rank: list[int] = field(default_factory=list)
    each: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bin_start: list[int] = field(default_factory=list)
    bin_capacity: list[int] = field(default_factory=list)
    bin_used: list[int] = field(default_factory=list)


def opening_size(length: int, waiting: int, fillers: int, capacities: tuple[int, ...], costs: dict[int, float]) -> int:
    """The bin size to open for pieces of ``length``: least cost for each word it can
    hold of the ``waiting`` pieces and of ``fillers`` words in shorter pieces to come."""
    def price(c: int) -> float:
        each = c // length
        bins = max(1, -(-waiting // each))
        held = min(waiting, each) * length if bins == 1 else each * length
        spare = min(c - held, fillers // bins)
        return costs[c] / (held + spare)
    return min((c for c in capacities if c >= length), key=lambda c: (price(c), c))


def plan_bins(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES,
              costs: dict[int, float] | None = None) -> Plan:
    """Best-fit decreasing over a histogram {length: pieces}, all lengths at most the
    largest capacity.

    Pieces of a length are alike, so they are placed in bulk: into the open bins
    with the least room that still fits, filling each as far as it goes, else
    into new bins of the least-cost size. Open bins are kept as ranges of equal
    room. A range's room at least halves whenever a length is placed in it, so
    the runs grow with the number of lengths, not of pieces. At the end every
    bin shrinks to the smallest permitted size that holds its contents."""
    capacities = tuple(sorted(capacities))
    costs = costs or {c: c + OVERHEAD for c in capacities}
    plan, bins = Plan(), 0
    rooms: list[tuple[int, int, int, int]] = []  # (room, first bin, bins, size), sorted
    done: list[tuple[int, int, int]] = []        # (first bin, bins, used)
    fillers = sum(n * c for n, c in histogram.items())

    def put(length: int, rank: int, left: int, start: int, count: int, room: int, size: int) -> int:
        """Fill bins of a range; returns how many pieces went in."""
        each = room // length
        taken = min(left, each * count)
        plan.length.append(length), plan.rank.append(rank), plan.each.append(each)
        plan.bin.append(start), plan.offset.append(size - room)
        whole, extra = divmod(taken, each)
        for first, n, rest in ((start, whole, room - each * length), (start + whole, int(extra > 0), room - extra * length),
                               (start + whole + int(extra > 0), count - whole - int(extra > 0), room)):
            if n and rest:
                bisect.insort(rooms, (rest, first, n, size))
            elif n:
                done.append((first, n, size))
        return taken

    for length in sorted((n for n in histogram if n > 0), reverse=True):
        left, rank = histogram[length], 1
        fillers -= length * left
        while left:
            i = bisect.bisect_left(rooms, (length,))
            if i < len(rooms):
                room, start, count, size = rooms.pop(i)
            else:
                size = room = opening_size(length, left, fillers, capacities, costs)
                start, count = bins, -(-left // (size // length))
                bins += count
            n = put(length, rank, left, start, count, room, size)
            rank, left = rank + n, left - n
    done += [(start, n, size - room) for room, start, n, size in rooms]
    for start, _, used in sorted(done):
        plan.bin_start.append(start)
        plan.bin_used.append(used)
        plan.bin_capacity.append(next(c for c in capacities if c >= used))
    return plan


def pieces_of(rows: DataFrame, largest: int, size_col: str = "size") -> DataFrame:
    """A row per piece: texts longer than ``largest`` are cut into pieces of that
    length and a rest. Adds ``piece`` (from 0), ``start`` and ``length``; a text
    without words has one piece of length 0."""
    n = F.greatest(F.lit(1).cast("long"), F.ceil(F.col(size_col) / F.lit(largest)))
    return rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))) \
        .withColumn("start", F.col("piece") * largest) \
        .withColumn("length", F.least(F.lit(largest).cast("long"), F.col(size_col) - F.col("start")))


def pack(rows: DataFrame, id_col: str = "doc_id", size_col: str = "size", capacities: tuple[int, ...] = CAPACITIES,
         costs: dict[int, float] | None = None) -> DataFrame:
    """(id, piece, start, length, bin_id, capacity, position): words ``start`` to
    ``start + length`` of document ``id`` stand at ``position`` in bin ``bin_id`` of
    ``capacity`` words.

    Only the histogram of piece lengths, at most ``max(capacities)`` rows
    whatever the data, goes to the driver to be planned. The pieces of each
    length are ranked where they are: in seeded buckets, shifted by the counts
    of lower buckets, so a length that a third of all pieces have is ranked by
    many tasks. Ranks are exact and depend on the rows alone, so reruns agree.

    Cases: size NULL or 0: one piece of length 0 with NULL bin, capacity and
    position. Rows repeated with the same id are packed each. A NULL id is
    packed like any other. An empty table gives no rows."""
    capacities, largest = tuple(sorted(capacities)), max(capacities)
    buckets = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slim = materialize(rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("size")),
                       "packing_sizes")
    pieces = pieces_of(slim, largest).drop("size") \
        .withColumn("seeded", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "piece")) \
        .withColumn("bucket", F.shiftrightunsigned("seeded", 1) % F.lit(buckets)) \
        .withColumn("cell", row_key(F.col("length"), F.col("bucket")))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    plan = plan_bins({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()},
                     capacities, costs)
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    shifts = counts.select(row_key(F.col("length"), F.col("bucket")).alias("at"),
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.withColumn("r", F.row_number().over(W.partitionBy("cell").orderBy("seeded", "id", "piece"))) \
        .join(shifts, F.col("cell") == F.col("at")) \
        .select("id", "piece", "start", "length", (F.col("before") + F.col("r")).alias("rank"))

    # Runs by (length, rank): one sorted search places a piece.
    span = 1 << 44
    order = np.argsort(np.array(plan.length, np.int64) * span + np.array(plan.rank, np.int64), kind="stable")
    runs = {k: np.array(getattr(plan, k), np.int64)[order] for k in ("length", "rank", "each", "bin", "offset")}
    heads = runs["length"] * span + runs["rank"]
    starts, sizes = np.array(plan.bin_start, np.int64), np.array(plan.bin_capacity, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            empty = length == 0
            columns = [np.zeros(len(length), np.int64)] * 3
            if not empty.all():
                run = np.maximum(np.searchsorted(heads, length * span + rank, side="right") - 1, 0)
                nth = rank - runs["rank"][run]
                bin_id = runs["bin"][run] + nth // runs["each"][run]
                position = runs["offset"][run] + nth % runs["each"][run] * length
                capacity = sizes[np.maximum(np.searchsorted(starts, bin_id, side="right") - 1, 0)]
                columns = [bin_id, capacity, position]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("id", "piece", "start", "length")]
                + [pa.array(c, pa.int64(), mask=empty) for c in columns],
                ["id", "piece", "start", "length", "bin_id", "capacity", "position"])

    kind = slim.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"id {kind}, piece long, start long, length long, bin_id long, capacity long, position long")
