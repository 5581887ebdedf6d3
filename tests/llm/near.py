"""Exact nearest neighbours of small tables."""

from __future__ import annotations

import numpy as np


def exact(rows, queries, k=10):
    """rows: {vec_id: vector}; the (score, vec_id) of the k nearest of each query."""
    ids, x = np.array(list(rows)), np.array(list(rows.values()), np.float64)
    out = {}
    for q in queries:
        d = np.sqrt(((x - np.array(rows[q], np.float64)) ** 2).sum(1))
        near = sorted((d[i], int(ids[i])) for i in range(len(ids)) if ids[i] != q)[:k]
        out[q] = near
    return out
