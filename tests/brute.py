"""Plain NumPy versions of the searches, for small fixtures."""

import numpy as np


def distances(q, x, space):
    q, x = np.asarray(q, float), np.asarray(x, float)
    if space == "l2":
        return ((q[:, None, :] - x[None, :, :]) ** 2).sum(2)
    dots = q @ x.T
    if space == "innerproduct":
        return -dots
    with np.errstate(divide="ignore", invalid="ignore"):
        return 1 - dots / (np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :])


def nearest(q, x, ids, k, space, limit=np.inf):
    """Per query: [(id, distance)] by (rounded distance, id)."""
    out = []
    for row in np.round(distances(q, x, space), 9):
        found = sorted((d, i) for d, i in zip(row, ids) if np.isfinite(d) and d <= limit)
        out.append([(i, d) for d, i in found[:k]])
    return out


def hits_of(df, id_col="_id"):
    """{query_id: [id by rank]} of collected hits."""
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r[id_col])
    return out


def table(spark, x, ids=None, name="_id", parts=3):
    ids = range(len(x)) if ids is None else ids
    rows = [(i, None if v is None else [float(e) for e in v]) for i, v in zip(ids, x)]
    kind = "string" if isinstance(rows[0][0], str) else "bigint"
    return spark.createDataFrame(rows, f"{name} {kind}, vector array<float>").repartition(parts)
