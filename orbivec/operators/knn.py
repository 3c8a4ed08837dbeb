"""Exact, filtered, nested and radial search of a table of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.functions.vectors import at_least, score, score_to_distance, space_of, within
from orbivec.operators import scan, turned
from orbivec.session import materialise

# How a filter takes part in a search.
FILTER_MODES = ("efficient", "post_filter", "boolean", "script")

#: Most hits of one radial query.
RADIAL_CAP = 10_000


def one_of(k=None, max_distance=None, min_score=None) -> None:
    """A search is asked for by exactly one of ``k``, ``max_distance`` and ``min_score``."""
    if sum(v is not None for v in (k, max_distance, min_score)) != 1:
        raise ValueError("give exactly one of k, max_distance and min_score")


def dense_blocks(queries: DataFrame, query_id: str, query_vector: str, block_queries: int,
                 together: bool = False, grow: bool = False) -> Iterator[scan.QueryBlock]:
    """Query blocks with their vectors as one double matrix; queries without a vector are left out."""
    present = queries.filter(F.col(query_vector).isNotNull())
    weight = F.lit(8) * F.size(query_vector)
    for rows in scan.query_blocks(present, query_id, [query_vector], weight, block_queries, together, grow):
        yield scan.QueryBlock(rows.column(query_id).combine_chunks(),
                              {"vectors": scan.matrix(rows.column(query_vector))})


def search(corpus: DataFrame, blocks: Iterator[scan.QueryBlock], scorer, k: int, *, inputs: list[str],
           query_type, id_col: str = "_id", carry: list[str] = (), salts: int | None = None,
           decimals: int = 9, detail: str | None = None, bound: DataFrame | None = None) -> DataFrame:
    """Scan the corpus once per query block and merge: ``(query_id, id, carry..., distance, rank)``.

    ``bound`` may be any subset of the corpus rows. Its k-th distances are
    proven upper bounds of the corpus', so the full scan emits few candidates.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    salts = scan.merge_salts(corpus) if salts is None else salts
    options = dict(inputs=inputs, id_col=id_col, query_type=query_type, decimals=decimals)

    def part(block):
        if bound is not None and len(block):
            near = scan.merge(scan.scan_block(bound, block, scorer, k, **options), k, id_col, salts)
            kth = near.filter(F.col("rank") == k).select("query_id", "distance").toArrow()
            at = {v: i for i, v in enumerate(block.ids.to_pylist())}
            limits = np.full(len(block), np.inf) if block.limits is None else block.limits.copy()
            for q, d in zip(kth.column("query_id").to_pylist(), kth.column("distance").to_pylist()):
                limits[at[q]] = min(limits[at[q]], d)
            block.limits = limits
        return scan.scan_block(corpus, block, scorer, k, carry=carry, detail=detail, **options)

    return scan.in_turn(((block, part(block)) for block in blocks), k, id_col, salts)


def by_query(corpus: DataFrame, queries: DataFrame, scorer, k: int, *, inputs: list[str], weight: Column, query_id: str,
             query_vector: str, block_queries: int = scan.BLOCK_QUERIES, id_col: str = "_id", carry: list[str] = (),
             limit: float | None = None, written: bool = True):
    """Hits of many queries on a corpus that can be sent to them, else None, and both tables, written if that was to be found out.

    ``weight`` is the bytes of a row's inputs. Hits are ``written`` unless they may be many times the queries.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = turned.many(queries, query_id, query_vector, block_queries)
    if asked is None:
        return None, corpus, queries
    pieces = turned.Pieces(corpus, inputs, weight, id_col, carry)
    if not pieces.fit:
        return None, pieces.table, asked
    hits = turned.search(asked, pieces, scorer, k, query_id=query_id, query_vector=query_vector, limit=limit)
    return materialise(hits, "hits") if written else hits, pieces.table, asked


def knn(corpus: DataFrame, queries: DataFrame, k: int = 100, space: str = "l2", where: Column | str | None = None,
        filter_mode: str | None = "efficient", nested: str | None = None, *, id_col: str = "_id",
        vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "vector",
        block_queries: int = scan.BLOCK_QUERIES, salts: int | None = None,
        bound: DataFrame | None = None) -> DataFrame:
    """Exact k nearest rows of ``corpus`` for every row of ``queries``.

    Returns ``(query_id, <id_col>, distance, score, rank)``, ties ranked by id.

    ``where`` restricts the hits: ``efficient`` and ``script`` filter before the
    search (always k hits if there are that many), ``post_filter`` and
    ``boolean`` filter the k nearest (possibly fewer hits). ``nested`` names an
    ``outer.inner`` path; a parent is as close as its closest child, whose
    position in the array is returned as ``child``. Nested search keeps
    ``efficient`` and ``post_filter`` and ignores the other two modes.

    ``block_queries`` queries share a pass over the corpus; from 4,096 on, four times as many if their vectors are short.
    ``bound`` is an optional subset of the (filtered) corpus used to prune.
    """
    space = space_of(space)
    if filter_mode is not None and filter_mode not in FILTER_MODES:
        raise ValueError(f"unsupported filter mode {filter_mode!r}; use one of {FILTER_MODES}")
    if nested and filter_mode in ("boolean", "script"):
        where = None
    condition = F.expr(where) if isinstance(where, str) else where
    rows, carry = corpus, []
    if condition is not None and filter_mode is not None:
        if filter_mode in ("efficient", "script"):
            rows = corpus.filter(condition)
        else:
            # The verdict travels with the candidates: no second look at the corpus.
            rows, carry = corpus.withColumn("__passes", F.coalesce(condition, F.lit(False))), ["__passes"]
    if nested:
        outer, inner = nested.split(".")
        scorer, inputs, detail = scan.nested_scorer(space, outer, inner), [outer], "child"
    else:
        scorer, inputs, detail = scan.dense_scorer(space, vector_col), [vector_col], None
    hits = None
    if not nested and bound is None:
        hits, rows, queries = by_query(rows, queries, scorer, k, inputs=inputs, weight=F.lit(8) * F.size(vector_col), id_col=id_col, carry=carry,
                                       query_id=query_id, query_vector=query_vector, block_queries=block_queries)
    if hits is None:
        hits = search(rows, dense_blocks(queries, query_id, query_vector, block_queries, grow=True), scorer, k, inputs=inputs,
                      query_type=queries.schema[query_id].dataType, id_col=id_col, carry=carry, salts=salts,
                      detail=detail, bound=bound)
    if carry:
        hits = hits.filter("__passes")
    return _hits(hits, id_col, space, detail)


def radial(corpus: DataFrame, queries: DataFrame, space: str = "l2", max_distance: float | None = None,
           min_score: float | None = None, cap: int | None = RADIAL_CAP, where: Column | str | None = None, *,
           id_col: str = "_id", vector_col: str = "vector", query_id: str = "query_id",
           query_vector: str = "vector", block_queries: int = scan.BLOCK_QUERIES, salts: int | None = None) -> DataFrame:
    """All rows within a radius, closest first, at most ``cap`` per query, or every one if that is None.

    The radius is either ``max_distance`` or ``min_score``, both inclusive. If
    the corpus has more rows than ``cap``, a first pass counts distances and
    cuts each query's radius where its cap is reached, so that the second
    hands on little more than the hits. Blocks of few queries share a pass: what
    a task holds is bounded by candidates and bytes, not by queries. Many queries
    get a corpus that fits :data:`orbivec.operators.turned.CORPUS_BYTES` sent to
    them instead; the hits are then a plan that neither shuffles nor writes them.
    """
    one_of(max_distance=max_distance, min_score=min_score)
    space = space_of(space)
    rows = corpus if where is None else corpus.filter(where)
    radius = max_distance
    if radius is None:
        radius = score_to_distance(min_score, space)
        radius += 1e-6 * max(1.0, abs(radius))  # rounding of the score; what is too far is filtered below

    scorer, most = scan.dense_scorer(space, vector_col), scan.EVERY if cap is None else cap
    hits, rows, queries = by_query(rows, queries, scorer, most, inputs=[vector_col], weight=F.lit(8) * F.size(vector_col), id_col=id_col,
                                   query_id=query_id, query_vector=query_vector, block_queries=block_queries, limit=radius, written=False)
    more = hits is None and cap is not None and rows.count() > cap

    def limited():
        for block in dense_blocks(queries, query_id, query_vector, block_queries, together=True):
            block.limits = np.full(len(block), float(radius))
            if more and len(block):
                block.limits = scan.cut_at(rows, block, scorer, cap, inputs=[vector_col])
            yield block

    if hits is None:
        hits = search(rows, limited(), scorer, most, inputs=[vector_col],
                      query_type=queries.schema[query_id].dataType, id_col=id_col, salts=salts)
    hits = _hits(hits, id_col, space, None)
    if max_distance is not None:
        return hits.filter(within(F.col("distance"), max_distance))
    return hits.filter(at_least(F.col("score"), min_score))


def find(corpus: DataFrame, queries: DataFrame, k: int | None = None, max_distance: float | None = None,
         min_score: float | None = None, **options) -> DataFrame:
    """Search by exactly one of ``k``, ``max_distance`` and ``min_score``; see :func:`knn` and :func:`radial`."""
    one_of(k, max_distance, min_score)
    if k is not None:
        return knn(corpus, queries, k, **options)
    return radial(corpus, queries, max_distance=max_distance, min_score=min_score, **options)


def _hits(hits: DataFrame, id_col: str, space: str, detail: str | None) -> DataFrame:
    extra = [detail] if detail else []
    return hits.select("query_id", id_col, *extra, "distance", score(F.col("distance"), space).alias("score"), "rank")
