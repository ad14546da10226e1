"""Periodic run detection over a grammar: stretches of words that repeat with a small period.

The word ids of a text are compressed by Re-Pair: pairs of neighbouring symbols that
occur at least twice become rules, the most frequent first, until none is left. A round
replaces every pair at all places where no more frequent pair overlaps it, for
many texts at once. What is left over is the top sequence; it is halved again and again, so
that every place between two of its symbols is the middle of one part.

Every run lies in the smallest part or rule body that holds it and crosses the
middle of that one, so runs are sought at middles only, once for each rule: a run of
at least four periods has two of them on one side of the middle, so the two words beside
the middle are there again one period further on. What is found in a rule is then
translated to all places where the rule was applied, and overlapping intervals of
one period are merged to maximal runs."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS = 6          # words of a run at least
MIN_PERIODS = 4        # periods of a run at least
SLICE_WORDS = 200_000  # words of texts handled together (a longer text is handled alone)
CANDIDATES = 2_000_000  # pairs of a middle and a period tested together
_PROBE = 10            # words compared for all candidates together before one by one

RUN_SCHEMA = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _text_starts(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))


class Grammar:
    """Re-Pair over texts laid end to end: rules with the places they were applied at, and the top sequences."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        self.rule = np.zeros(0, np.int64)                        # of each application, ascending
        self.lo = self.mid = self.hi = np.zeros(0, np.int64)     # the words it stands for, and its middle
        self.top_text = self.top_pos = self.top_end = np.zeros(0, np.int64)
        if len(ids):
            self._build(ids, text)

    def _build(self, ids: np.ndarray, text: np.ndarray) -> None:
        sym, pos, end = ids.astype(np.int64), np.arange(len(ids)), np.arange(1, len(ids) + 1)
        hot = np.ones(len(ids), bool)  # the pair that starts here may occur again
        text = text.astype(np.int64)
        fresh, n_rules = int(sym.max()) + 1, 0
        applied, tops = [], []
        while len(sym):
            pair = np.zeros(len(sym), bool)
            pair[:-1] = text[1:] == text[:-1]
            equal = np.zeros(len(sym), bool)
            equal[:-1] = pair[:-1] & (sym[1:] == sym[:-1])
            # Of a a a a only every second pair counts, so that occurrences do not overlap.
            places = np.arange(len(sym))
            before = np.concatenate(([False], equal[:-1]))
            odd = equal & ((places - np.maximum.accumulate(np.where(before, 0, places))) & 1 == 1)
            at = np.flatnonzero(pair & (hot | equal) & ~odd)
            key = (text[at] * fresh + sym[at]) * fresh + sym[at + 1]
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([True], key[order][1:] != key[order][:-1])) if len(at) else np.zeros(0, bool)
            group = np.empty(len(at), np.int64)
            group[order] = np.cumsum(new) - 1
            count = np.bincount(group)
            often = count[group] >= 2 if len(at) else np.zeros(0, bool)
            hot[:] = equal
            hot[at[often]] = True
            score = np.zeros(len(sym) + 2, np.int64)  # more frequent first, then a fixed order of pairs
            score[at[often] + 1] = count[group[often]] * (len(count) + 1) + group[often] + 1
            wins = (score[1:-1] > score[:-2]) & (score[1:-1] > score[2:])
            chosen = wins[at]
            again = np.bincount(group[chosen], minlength=len(count)) >= 2
            chosen &= again[group]
            at, group = at[chosen], group[chosen]
            if len(at):
                number = np.cumsum(again) - 1
                applied.append((n_rules + number[group], pos[at], pos[at + 1], end[at + 1]))
                sym[at] = fresh + number[group]
                end[at] = end[at + 1]
                hot[at] = True
                hot[at[at > 0] - 1] = True
                fresh, n_rules = fresh + int(again.sum()), n_rules + int(again.sum())
            live = np.zeros(int(text[-1]) + 1, bool)
            live[text[at]] = True
            keep = live[text]
            tops.append((text[~keep], pos[~keep], end[~keep]))
            keep[at + 1] = False
            sym, text, pos, end, hot = sym[keep], text[keep], pos[keep], end[keep], hot[keep]
        if applied:
            rule, lo, mid, hi = (np.concatenate(x) for x in zip(*applied, strict=True))
            order = np.lexsort((lo, rule))
            self.rule, self.lo, self.mid, self.hi = rule[order], lo[order], mid[order], hi[order]
        top = [np.concatenate(x) for x in zip(*tops, strict=True)]
        order = np.argsort(top[1], kind="stable")
        self.top_text, self.top_pos, self.top_end = (x[order] for x in top)

    def middles(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(lo, mid, hi, application) of every rule, at its first place, and of every part of the top
        sequences (application -1), by the size of parts."""
        first = np.flatnonzero(np.concatenate(([True], self.rule[1:] != self.rule[:-1]))) if len(self.rule) else np.zeros(0, np.int64)
        yield self.lo[first], self.mid[first], self.hi[first], first
        if not len(self.top_text):
            return
        starts = _text_starts(self.top_text)
        sizes = np.diff(np.concatenate((starts, [len(self.top_text)])))
        begin, stop = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)
        nth = np.arange(len(self.top_text)) - begin
        half = 1
        while half < sizes.max():
            m = np.flatnonzero(nth % (2 * half) == half)
            last = np.minimum(m + half, stop[m]) - 1
            yield self.top_pos[m - half], self.top_pos[m], self.top_end[last], np.full(len(m), -1)
            half *= 2


class Bigrams:
    """The places of equal word pairs of a text, in order."""

    def __init__(self, ids: np.ndarray, text: np.ndarray):
        self.n = len(ids)
        wide = int(ids.max()) + 1 if len(ids) else 1
        key = (text[:-1].astype(np.int64) * wide + ids[:-1]) * wide + ids[1:]
        key[text[1:] != text[:-1]] = -1
        self.places = np.argsort(key, kind="stable")
        key = key[self.places]
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1 if len(key) else np.zeros(0, np.int64)
        self.code = group * (self.n + 1) + self.places  # ascending
        self.rank = np.empty(len(key), np.int64)
        self.rank[self.places] = np.arange(len(key))

    def span(self, at: np.ndarray, reach: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks [from, to) of the places of the pair at ``at`` that lie up to ``reach`` before it (``step`` -1) or after it (1)."""
        rank = self.rank[at]
        if step < 0:
            return np.searchsorted(self.code, self.code[rank] - reach), rank
        return rank + 1, np.searchsorted(self.code, self.code[rank] + reach, side="right")


def _expand(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of every value in [start, stop) of every row."""
    n = np.maximum(stop - start, 0)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)


def _same_back(ids: np.ndarray, at: int, q: int, lo: int) -> int:
    """The smallest s with ids[j] == ids[j + q] for all j in [s, at]; at + 1 if none."""
    size = 32
    while at >= lo:
        low = max(lo, at - size + 1)
        differ = np.flatnonzero(ids[low:at + 1] != ids[low + q:at + 1 + q])
        if len(differ):
            return low + int(differ[-1]) + 1
        at, size = low - 1, size * 4
    return lo


def _same_on(ids: np.ndarray, at: int, q: int, hi: int) -> int:
    """The largest e with ids[j] == ids[j + q] for all j in [at, e - q); at + q if none."""
    size = 32
    while at + q < hi:
        top = min(hi - q, at + size)
        differ = np.flatnonzero(ids[at:top] != ids[at + q:top + q])
        if len(differ):
            return at + int(differ[0]) + q
        at, size = top, size * 4
    return hi


def _crossing(ids: np.ndarray, pairs: Bigrams, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(part, start, end, period) of the runs that cross a middle, within its part."""
    tests: list[np.ndarray] = []
    for step in (-1, 1):
        room = np.where(step < 0, mid - lo, hi - mid)
        reach = np.minimum(room // 2, room - 2)
        parts = np.flatnonzero((reach >= 1) & (hi - lo >= MIN_WORDS))
        if not len(parts):
            continue
        beside = mid[parts] - 2 if step < 0 else mid[parts]
        start, stop = pairs.span(beside, reach[parts], step)
        total = np.cumsum(np.maximum(stop - start, 0))
        for cut in range(0, int(total[-1]), CANDIDATES):
            some = slice(np.searchsorted(total, cut, side="right"), np.searchsorted(total, cut + CANDIDATES, side="right"))
            row, rank = _expand(start[some], stop[some])
            q = np.abs(pairs.places[rank] - beside[some][row])
            part = parts[some][row]
            edge = mid[part] - 1 if step < 0 else mid[part]
            for t in range(2, _PROBE):
                there = edge + step * np.minimum(t, q - 1)
                good = ids[there] == ids[there + step * q]
                part, q, edge = part[good], q[good], edge[good]
            tests.append(np.stack((part, q, np.full(len(q), step))))
    if not tests:
        return []
    part, q, step = np.concatenate(tests, axis=1)
    order = np.lexsort((q, part))
    found: list[tuple[int, int, int, int]] = []
    current, known = -1, []
    for k, q, step in np.stack((part[order], q[order], step[order]), axis=1).tolist():
        if k != current:
            current, known = k, []
            low, middle, high = int(lo[k]), int(mid[k]), int(hi[k])
        a, b = (middle - 2 * q, middle) if step < 0 else (middle, middle + 2 * q)
        if any(s <= a and b <= e for s, e in known):  # the two periods lie in a run of a smaller one
            continue
        at = middle - 1 - q if step < 0 else middle
        s, e = _same_back(ids, at, q, low), _same_on(ids, at, q, high)
        if s <= a and b <= e and s < middle < e and e - s >= max(MIN_WORDS, MIN_PERIODS * q):
            found.append((k, s, e, q))
            known.append((s, e))
    return found


def find_runs(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Rows (start, end, period), by start, then period, of the runs of texts laid end to end (``text``: the
    number of each word's text, ascending)."""
    if len(ids) < MIN_WORDS:
        return np.zeros((0, 3), np.int64)
    grammar, pairs = Grammar(ids, text), Bigrams(ids, text)
    pieces: list[np.ndarray] = []
    for lo, mid, hi, applied in grammar.middles():
        for k, s, e, q in _crossing(ids, pairs, lo, mid, hi):
            shift = np.zeros(1, np.int64)
            if applied[k] >= 0:  # to all places where the rule was applied
                a = int(applied[k])
                b = int(np.searchsorted(grammar.rule, grammar.rule[a], side="right"))
                shift = grammar.lo[a:b] - grammar.lo[a]
            pieces.append(np.stack((s + shift, e + shift, np.full(len(shift), q)), axis=1))
    if not pieces:
        return np.zeros((0, 3), np.int64)
    found = np.unique(np.concatenate(pieces), axis=0)
    runs: list[list[int]] = []
    for s, e, q in found[np.lexsort((found[:, 1], found[:, 0], found[:, 2]))].tolist():
        if runs and runs[-1][2] == q and s <= runs[-1][1] - q:
            runs[-1][1] = max(runs[-1][1], e)
        else:
            runs.append([s, e, q])
    runs.sort(key=lambda r: (r[0], r[2]))
    return np.array(runs, np.int64)


def _slices(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """The words of consecutive texts, up to SLICE_WORDS or one text at a time."""
    part: list[list[bytes]] = []
    size = 0
    for t in texts:
        words = t.split()  # bytes split at the ASCII blanks
        if part and size + len(words) > SLICE_WORDS:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def _runs_of(texts: list[list[bytes]]) -> Iterator[tuple[list[dict], bytes]]:
    """Runs and collapsed text of each text's words."""
    known: dict[bytes, int] = {}
    flat = np.array([known.setdefault(w, len(known)) for words in texts for w in words], np.int64)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    runs = find_runs(flat, np.repeat(np.arange(len(texts)), sizes))
    starts = np.cumsum(sizes) - sizes
    first = np.searchsorted(runs[:, 0], starts).tolist() + [len(runs)]
    for i, words in enumerate(texts):
        own = runs[first[i]:first[i + 1]] - [[starts[i], starts[i], 0]]
        kept = words
        if len(own):
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, own[:, 0] + own[:, 2], 1)
            np.add.at(change, own[:, 1], -1)
            kept = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
        yield [{"start": s, "length": e - s, "period": q} for s, e, q in own.tolist()], b" ".join(kept)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The periodic runs of every text, and the text without the repeats.

    Words are separated by ASCII blanks and compared as they are. A run is a stretch of consecutive words with
    smallest period q (words q apart are equal) and at least ``max(6, 4 q)`` words that neither neighbour
    extends with that period.

    Result: one row per input row with ``id``, ``n_words``, ``runs`` (array of start, length, period in words
    from 0, by start, then period) and ``collapsed`` (the words outside all runs and those of each run's first
    period, unless a further run drops them, joined by one space).

    Cases: NULL, empty and blank texts have no word, no run and collapsed text ''. Repeated rows, NULL and repeated
    ids: each row by itself. Memory grows with the longest text (some fifty bytes a word), not with the table; long
    texts are handled alone. Nothing is shuffled. An empty table gives an empty result; other columns are not
    read, whatever their names."""
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("utf8"))
    schema = T.StructType([source.schema["id"], *T.StructType.fromDDL(f"n_words bigint, runs {RUN_SCHEMA}, collapsed string").fields])
    run = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in _slices(batch.column("utf8").to_pylist()):
                found, collapsed = zip(*_runs_of(texts), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(texts)), pa.array(map(len, texts), pa.int64()), pa.array(found, run),
                     pa.array(collapsed, pa.binary()).cast(pa.string(), safe=False)], ["id", "n_words", "runs", "collapsed"])
                at += len(texts)

    return source.mapInArrow(find, schema)


def strongest(runs: str = "runs"):
    """The run with the greatest length a period (exact; ties: the first), NULL without runs."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
