"""Running k-best lists of one task, kept as NumPy arrays.

A task offers blocks of distances (queries x rows); only candidates that can
still enter a query's list are stored, so memory is bounded by the number of
queries times k, not by the number of rows the task reads.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from orbivec.functions.vectors import RANK_DECIMALS

_FLUSH_ROWS = 2_000_000  # candidates a task holds after compaction before it hands them on


class Nearest:
    """k-best candidates per query, ordered by (rounded distance, tie, id)."""

    def __init__(self, n_queries: int, k: int, limits: np.ndarray | None = None, decimals: int = RANK_DECIMALS):
        self.n, self.k, self.decimals = n_queries, k, decimals
        self.slack = 10.0**-decimals
        # Largest rounded distance that can still enter each list.
        self.limits = np.full(n_queries, np.inf) if limits is None else limits.astype(np.float64).copy()
        self.tie_limits = np.full(n_queries, np.iinfo(np.int64).max, np.int64)
        self.parts: list[tuple] = []
        self.pending = 0
        self._keep = np.empty(0, bool)
        # Twice the lists: they are cut, and bounds fall, with every k new candidates a query.
        self.capacity = min(max(2 * n_queries * k, 65_536), 2 * _FLUSH_ROWS)

    def offer(self, scored, ties: np.ndarray, payload: pa.RecordBatch) -> None:
        """Take over what can still enter a list; ``ties`` and ``payload`` belong to the rows of the batch."""
        queries, rows, block, detail = scored.queries, scored.rows, scored.block, scored.detail
        limits = self.limits[queries]
        slack = self.slack if scored.margin is None else self.slack + scored.margin
        keep = self._within(block, limits + slack)
        if block.shape[1] > self.k and np.count_nonzero(keep) > 2 * self.k * len(queries):
            # Too many to store: the block's own k-th distance is a bound as well.
            kth = np.partition(block, self.k - 1, axis=1)[:, self.k - 1].astype(np.float64)
            limits = np.fmin(limits, np.round(kth + slack, self.decimals))
            lower = queries[limits < self.limits[queries]]
            self.limits[queries] = limits  # k rows of this very block are that close
            self.tie_limits[lower] = np.iinfo(np.int64).max
            keep = self._within(block, limits + slack)
        flat = _places(keep)
        if not len(flat):
            return
        qi, ri = np.divmod(flat, block.shape[1])
        q, r = queries[qi], rows[ri]
        d = block[qi, ri].astype(np.float64) if scored.exact is None else scored.exact(q, r)
        d = np.round(d, self.decimals) + 0.0
        tie = ties[r]
        ok = np.isfinite(d) & ((d < limits[qi]) | ((d == limits[qi]) & (tie <= self.tie_limits[q])))
        q, r, d, tie = q[ok], r[ok], d[ok], tie[ok]
        if not len(q):
            return
        seen = np.zeros(payload.num_rows, bool)
        seen[r] = True
        distinct, back = np.flatnonzero(seen), (np.cumsum(seen) - 1)[r]
        extra = None if detail is None else detail[qi[ok], ri[ok]]
        self.parts.append((q, d, tie, back, payload.take(pa.array(distinct)), extra))
        self.pending += len(q)
        if self.pending > self.capacity:
            self._compact()

    def _within(self, block: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Which distances are within the bounds; valid until the next call."""
        if block.size > len(self._keep):
            self._keep = np.empty(block.size, bool)
        return np.less_equal(block, _as(bounds, block)[:, None], out=self._keep[:block.size].reshape(block.shape))

    def take(self, q: np.ndarray, r: np.ndarray, d: np.ndarray, ties: np.ndarray, payload: pa.RecordBatch) -> None:
        """Take over single pairs of queries and rows; lists are cut at once, so the bounds are those of all pairs so far."""
        d = np.round(d, self.decimals) + 0.0
        ok = (d < self.limits[q]) | ((d == self.limits[q]) & (ties[r] <= self.tie_limits[q]))
        q, r, d = q[ok], r[ok], d[ok]
        if not len(q):
            return
        distinct, back = np.unique(r, return_inverse=True)
        self.parts.append((q, d, ties[r], back, payload.take(pa.array(distinct)), None))
        self._compact()

    def _compact(self) -> None:
        if not self.parts:
            return
        q = np.concatenate([p[0] for p in self.parts])
        d = np.concatenate([p[1] for p in self.parts])
        tie = np.concatenate([p[2] for p in self.parts])
        starts = np.cumsum([0] + [p[4].num_rows for p in self.parts[:-1]])
        at = np.concatenate([p[3] + s for p, s in zip(self.parts, starts)])
        payload = pa.concat_batches([p[4] for p in self.parts])
        extra = None if self.parts[0][5] is None else np.concatenate([p[5] for p in self.parts])
        order = _order(q, d, tie, _text_order(payload.column(0), at))
        q = q[order]
        first = np.searchsorted(q, np.arange(self.n), side="left")
        place = np.arange(len(q)) - first[q]
        kept = place < self.k
        order, q, place = order[kept], q[kept], place[kept]
        full = place == self.k - 1
        self.limits[q[full]] = np.fmin(self.limits[q[full]], d[order[full]])
        self.tie_limits[q[full]] = tie[order[full]]
        back, seen = at[order], np.zeros(payload.num_rows, bool)
        seen[back] = True
        self.parts = [(q, d[order], tie[order], (np.cumsum(seen) - 1)[back], payload.filter(pa.array(seen)),
                       None if extra is None else extra[order])]
        self.pending = len(q)

    def overfull(self) -> bool:
        """True when the lists of all queries are too many to hold and those so far should be handed on."""
        return self.n * self.k > _FLUSH_ROWS and self.pending > min(_FLUSH_ROWS, self.capacity // 2)

    def only(self, n: int) -> None:
        """Go on with the first ``n`` queries; what the others have is dropped."""
        self._compact()
        self.n, self.limits, self.tie_limits = n, self.limits[:n].copy(), self.tie_limits[:n].copy()
        self.parts = [(q[:at], d[:at], tie[:at], back[:at], payload, None if extra is None else extra[:at])
                      for q, d, tie, back, payload, extra in self.parts for at in [int(np.searchsorted(q, n))]]
        self.pending = sum(len(p[0]) for p in self.parts)

    def ranked(self):
        """Yield (query index, distance, rank, payload) of the lists, in order, some at a time."""
        self._compact()
        for q, d, _, back, payload, _ in self.parts:
            rank = (np.arange(len(q)) - np.searchsorted(q, np.arange(self.n))[q] + 1).astype(np.int32)
            for lo in range(0, len(q), 50_000):
                cut = slice(lo, lo + 50_000)
                yield q[cut], d[cut], rank[cut], payload.take(pa.array(back[cut]))

    def drain(self):
        """Yield (query index, distance, tie, payload, detail) and start over; bounds are kept."""
        self._compact()
        for q, d, tie, back, payload, extra in self.parts:
            for lo in range(0, len(q), 50_000):
                cut = slice(lo, lo + 50_000)
                yield q[cut], d[cut], tie[cut], payload.take(pa.array(back[cut])), (
                    None if extra is None else extra[cut])
        self.parts, self.pending = [], 0


def _places(keep: np.ndarray) -> np.ndarray:
    """``np.flatnonzero`` of a matrix that is nearly all False, eight places at a time."""
    keep = keep.reshape(-1)
    whole = len(keep) // 8 * 8
    some = np.flatnonzero(keep[:whole].view(np.uint64))
    row, at = np.nonzero(keep[:whole].reshape(-1, 8)[some])
    return np.concatenate([some[row] * 8 + at, whole + np.flatnonzero(keep[whole:])])


def _as(bounds: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Bounds in the precision of a block, never rounded down."""
    if block.dtype == np.float64:
        return bounds
    return np.nextafter(bounds.astype(block.dtype), block.dtype.type(np.inf))


def _order(q: np.ndarray, d: np.ndarray, tie: np.ndarray, text: list[np.ndarray]) -> np.ndarray:
    """``np.lexsort((*text, tie, d, q))``, by one key of the query and the leading bits of the distance.

    Only rows that share a key are then sorted in full. Distances are finite.
    """
    if not len(q):
        return np.empty(0, np.int64)
    bits = (d + 0.0).view(np.int64)
    far = (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(2**63)
    far -= far.min()
    room = 64 - int(q.max()).bit_length()
    key = (far >> np.uint64(max(0, int(far.max()).bit_length() - room))) | (q.astype(np.uint64) << np.uint64(min(room, 63)))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    run = np.flatnonzero(same[1:] | same[:-1])
    if len(run):
        rows = order[run]
        order[run] = rows[np.lexsort((rows, *[t[rows] for t in text], tie[rows], d[rows], key[run]))]
    return order


def _text_order(ids: pa.Array, at: np.ndarray) -> list[np.ndarray]:
    """Order of string ids, as a key to sort by; numeric ids are already ordered by their tie value."""
    if not (pa.types.is_string(ids.type) or pa.types.is_large_string(ids.type)):
        return []
    _, codes = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)
    return [codes[at]]
