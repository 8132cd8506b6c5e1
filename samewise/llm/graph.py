"""Connected components over edges, and over the few of one task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from samewise.llm.common import cut
from samewise.operators.graph import clusters


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id, component (least id that links reach) of every end of edges (a, b); null ends and loops are ignored. Each round is a written table."""
    return clusters(edges, most_rounds, cut).withColumnsRenamed({"node": "id", "cluster": "component"})


def local_roots(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """By node from 0 to n - 1: the least node that the pairs (left, right) reach."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root
