"""Substring dedup with sparse suffix arrays: only suffixes that begin at minimiser positions are kept, sorted, and compared
with their neighbours; matches are then extended to the left."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from lattica.llm.repeats import alike, remove_repeats
from lattica.llm.text import U, mix

#: Words of a repeated passage; words of the minimiser.
LENGTH, ANCHOR = 40, 10


def sparse_suffixes(words, first, n, before, group, length, k, again, offsets) -> None:
    """Marks windows that occur in two segments of a group. Suffixes at the anchors are sorted; neighbours' common prefixes
    split them into intervals for each depth; within an interval, equal left contexts extend the match over the window."""
    rows = len(first)
    right = np.zeros((rows, length + 1), dtype=">u4")
    left = np.zeros((rows, length), dtype=np.uint32)
    after = n - before
    for i in range(length):
        inside = i < after
        right[inside, i + 1] = words[(first + before + i)[inside]]
        back = i < before
        left[back, i] = words[(first + before - 1 - i)[back]] + 1
    right[:, 0] = group.astype(np.uint32)
    order = np.argsort(np.ascontiguousarray(right).view(f"V{4 * (length + 1)}").ravel(), kind="stable")
    sorted_right = right[order]
    same = sorted_right[1:] == sorted_right[:-1]
    common = np.where(same.all(1), length + 1, same.argmin(1)) - 1  # words that neighbours share after the group
    # hashes of left contexts of 0, 1, 2... words
    hashes = np.zeros((rows, length), dtype=np.uint64)
    h = np.full(rows, 7, dtype=np.uint64)
    for i in range(length):
        hashes[:, i] = h
        h = mix(h * U(0x9E3779B97F4A7C15) + left[:, i])
    for lead in range(length - k + 1):
        depth = length - lead
        ok = (before[order] >= lead) & (after[order] >= depth)
        if not ok.any():
            continue
        interval = np.concatenate([[0], np.cumsum(common < depth)])[ok]
        segment = order[ok]
        key = mix(hashes[segment, lead] ^ mix(interval.astype(np.uint64) + U(3)))
        # contexts with one hash are compared word by word
        _, which = alike(key, left.ravel(), segment * length, np.full(len(segment), lead))
        _, which = np.unique(which * rows + interval, return_inverse=True)
        hit = segment[np.bincount(which)[which] > 1]
        # the window that has `lead` words before the anchor
        again[offsets[hit] + before[hit] - lead] = True


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **kw) -> DataFrame:
    """See remove_repeats for rows, nulls and limits."""
    return remove_repeats(docs, sparse_suffixes, length, anchor, **kw)
