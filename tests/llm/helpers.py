"""Plain restatements that the operators are held against."""

from __future__ import annotations

import numpy as np
import pandas as pd

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, place string, component string"


def docs_frame(spark, rows):
    """Documents of (doc_id, text[, lang[, source]]) with extra columns whose names operators use inside."""
    full = [(*r, *([None] * (4 - len(r))), None, "s", "p", "c") for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def smallest_reachable(n: int, links) -> list[int]:
    label = list(range(n))

    def find(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def auc(score: pd.Series, y: pd.Series) -> float:
    rank, up, down = score.rank(), (y == 1).sum(), (y == 0).sum()
    return float((rank[y == 1].sum() - up * (up + 1) / 2) / (up * down))


def unsigned(values) -> np.ndarray:
    return np.array(values, np.int64).view(np.uint64)
