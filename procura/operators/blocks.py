"""Cosine similarities of two blocks of sparse vectors, inside one task (R-7, J-8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TIE_DIGITS = 12      # similarities equal in so many digits tie, whatever the order of summing
CELLS = 4 << 20      # pairs scored at once
DENSE_SHARE = 0.02   # terms that more of the pairs share are multiplied as a matrix
DENSE_TERMS = 512    # columns of that matrix at most
EXPANDED = 2 << 20   # products of the other terms held at once


def _sorted(block: pa.Table) -> pa.Table:
    return block.take(pc.sort_indices(block, sort_keys=[("id", "ascending")]))


def _entries(block: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Terms, vector numbers and weights of the block's entries, vector by vector."""
    lists = pa.concat_arrays(block["terms"].chunks)
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    weights = pa.concat_arrays(block["weights"].chunks).flatten().to_numpy(zero_copy_only=False)
    return lists.flatten(), row, weights


def _scores(n: tuple[int, int], p: tuple, c: tuple, common: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first prompt, prompts x cache similarities), some prompts at a time. ``p``, ``c``: term codes, vector numbers and
    weights; ``common``: by term code, its column in the matrix or -1."""
    width = int(common.max(initial=-1)) + 1

    def dense(code, row, w, rows):
        out = np.zeros((rows, width))
        at = common[code] >= 0
        out[row[at], common[code[at]]] = w[at]
        return out

    c_dense = dense(*c, n[1])
    rare = np.flatnonzero(common[c[0]] < 0)
    rare = rare[np.argsort(c[0][rare], kind="stable")]
    held, row_of, weight_of = (x[rare] for x in c)  # postings of the other terms, by code
    codes = np.arange(len(common))
    start = np.searchsorted(held, codes)
    count = np.searchsorted(held, codes, side="right") - start
    step = max(1, CELLS // n[1])
    for first in range(0, n[0], step):
        lo, hi = np.searchsorted(p[1], (first, first + step))
        code, row, w = p[0][lo:hi], p[1][lo:hi] - first, p[2][lo:hi]
        rows = min(step, n[0] - first)
        out = dense(code, row, w, rows) @ c_dense.T
        flat = out.reshape(-1)
        mine = np.flatnonzero((common[code] < 0) & (count[code] > 0))
        ends = np.cumsum(count[code[mine]])
        at = 0
        while at < len(mine):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + EXPANDED)))
            part = mine[at:to]
            times = count[code[part]]
            which = np.repeat(start[code[part]] - np.cumsum(times) + times, times) + np.arange(times.sum())
            np.add.at(flat, np.repeat(row[part] * n[1], times) + row_of[which], np.repeat(w[part], times) * weight_of[which])
            at = to
        yield first, out


def block_pairs(prompts: pa.Table, cache: pa.Table, threshold: float, best: bool) -> pa.Table:
    """(prompt_id, cache_id, similarity) of the pairs that share a term and reach ``threshold``; with ``best`` only the
    most similar entry of each prompt (ties to the smallest id). Both sides: id, terms (distinct), weights."""
    n = (len(prompts), len(cache))
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    if min(n):
        prompts, cache = _sorted(prompts), _sorted(cache)
        (p_term, p_row, p_w), (c_term, c_row, c_w) = _entries(prompts), _entries(cache)
        codes = pa.concat_arrays([p_term, c_term]).dictionary_encode()
        code = codes.indices.to_numpy()
        p_code, c_code = code[:len(p_row)], code[len(p_row):]
        p_df, c_df = (np.bincount(x, minlength=len(codes.dictionary)).astype(float) for x in (p_code, c_code))
        work = p_df * c_df
        top = np.argsort(-work, kind="stable")[:DENSE_TERMS]
        top = top[work[top] > DENSE_SHARE * n[0] * n[1]]
        common = np.full(len(work), -1)
        common[top] = np.arange(len(top))
        for first, s in _scores(n, (p_code, p_row, p_w), (c_code, c_row, c_w), common):
            if best:
                y = np.round(s, TIE_DIGITS).argmax(axis=1)  # the first of equals has the smallest id
                x = np.arange(len(y))
                kept = (s[x, y] >= threshold) & (s[x, y] > 0)
                x, y = x[kept], y[kept]
            else:
                x, y = np.nonzero((s >= threshold) & (s > 0))
            found.append((x + first, y, s[x, y]))
    x, y, s = (np.concatenate(f) for f in zip(*found, strict=True))
    return pa.table({"prompt_id": prompts["id"].take(x), "cache_id": cache["id"].take(y), "similarity": s})
