"""Packing by lexical retrieval: token windows filled with the documents most alike.

Every document is tokenised and ends with an end id. What fills whole windows is cut off; the rest, under one window,
meets other rests. Rests are laid out by range of a min-hash of their ids, so that alike texts lie near each other, and
streamed in shards of a fixed number; each shard is a BM25 inverted index over token ids (document frequencies and mean
length are those of all rests). A seed's unused neighbours, best first, fill its window; the one that overflows is cut
and its remainder is the next seed, also across shards. Only the last window of a layout partition can stay short: it
is cut into windows of powers of two, so nothing is padded.

A task holds one shard. Copies of one text, however many, spread over windows and shards.

Defined cases: a null or empty text is the end id alone. Repeated rows are packed each. Ties in scores go to the rest
that comes first by (min-hash, hash, id). A null id is kept. Other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col
from orbivec.llm.tokens import ids_of
from orbivec.session import materialise

SHARD = 512
K1, B = 1.2, 0.75
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenised(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
              keep_ids: bool = False) -> DataFrame:
    """Per row: ``doc_tokens``, checksums of the whole windows, and the rest's ids (with its min-hash and hash)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = ids_of(vocabulary).ids
        for batch in batches:
            rows = []
            for t in batch.column(1):
                ids = encode(t.as_py() or "") + end
                whole = len(ids) // (4 * size) * 4 * size
                rest = ids[whole:]
                sums = [zlib.crc32(ids[i:i + 4 * size]) for i in range(0, whole, 4 * size)]
                distinct = np.frombuffer(rest, "<u4").astype(np.uint64)
                sign = int(((distinct + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).min()) if rest else -1
                rows.append((len(ids) // 4, sums, rest, sign, zlib.crc32(rest), ids[:whole] if keep_ids else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             names=["doc_id", "doc_tokens", "sums", "rest", "sign", "hash", "body"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, doc_tokens long, sums array<long>, rest binary, sign long, hash long, body binary")


def frequencies(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many rests hold each id, how many rests there are, and their mean length. Bounded by the vocabulary."""

    def run(batches):
        seen, n, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for rest in batch.column(0):
                ids = np.unique(np.frombuffer(rest.as_py(), "<u4"))
                if not len(ids):
                    continue
                if ids[-1] >= len(seen):
                    seen = np.concatenate((seen, np.zeros(int(ids[-1]) + 1 - len(seen), np.int64)))
                seen[ids] += 1
                n, tokens = n + 1, tokens + len(rest.as_py()) // 4
        ids = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((ids, [-1, -2]))), pa.array(np.concatenate((seen[ids], [n, tokens])))], names=["id", "n"])

    found = rows.select("rest").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = dict(zip(found.id, found.n, strict=True))
    n, tokens = int(counts.pop(-1, 0)), int(counts.pop(-2, 0))
    made = np.zeros(max(counts, default=0) + 1, np.int64)
    made[list(counts)] = list(counts.values())
    return made, n, tokens / max(n, 1)


class Shard:
    """BM25 postings of a few hundred rests, and which of them are unused."""

    def __init__(self, rests: list[np.ndarray], seen: np.ndarray, total: int, mean: float):
        self.unused = np.ones(len(rests), bool)
        terms, docs, impacts = [], [], []
        for d, ids in enumerate(rests):
            t, n = np.unique(ids, return_counts=True)
            terms.append(t)
            docs.append(np.full(len(t), d, np.int64))
            impacts.append(n * (K1 + 1) / (n + K1 * (1 - B + B * len(ids) / max(mean, 1))))
        self.terms = terms
        flat, docs = np.concatenate(terms), np.concatenate(docs)
        order = np.argsort(flat, kind="stable")
        df = seen[flat]
        self.impacts = (np.concatenate(impacts) * np.log(1 + (total - df + 0.5) / (df + 0.5)))[order]
        self.docs, flat = docs[order], flat[order]
        self.names, self.at = np.unique(flat, return_index=True)
        self.to = np.append(self.at[1:], len(flat))

    def ranked(self, terms: np.ndarray) -> np.ndarray:
        """Unused members, those most alike first."""
        left = np.flatnonzero(self.unused)
        if len(left) < 2:
            return left
        i = np.searchsorted(self.names, terms)
        i = i[(i < len(self.names)) & (self.names[np.minimum(i, len(self.names) - 1)] == terms)]
        lengths = self.to[i] - self.at[i]
        places = np.repeat(self.at[i] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        scores = np.bincount(self.docs[places], self.impacts[places], len(self.unused))
        return left[np.argsort(-scores[left], kind="stable")]


def fill(rests: list[np.ndarray], started: list[tuple], size: int, stats: tuple) -> tuple[list[list[tuple]], list[tuple]]:
    """Full windows as lists of (member, from, to), and the window left open. ``started``: pieces of an open window from before.

    Members are numbers in ``rests``; pieces that come from before carry their own ids and are given back as they are.
    """
    shard, windows, window = Shard(rests, *stats), [], list(started)
    have = sum(p[2] - p[1] for p in window)
    seed, queue = (np.unique(window[0][3]) if window else None), []
    fresh = True
    while shard.unused.any():
        if seed is None:
            member = int(np.flatnonzero(shard.unused)[0])
            seed, queue, fresh = shard.terms[member], [member], False
        elif fresh:
            queue, fresh = list(shard.ranked(seed)[::-1]), False
        if not queue:
            fresh = True
            continue
        member = int(queue.pop())
        if not shard.unused[member]:
            continue
        shard.unused[member] = False
        ids, at = rests[member], 0
        take = min(len(ids), size - have)
        window.append((member, at, take, ids))
        have, at = have + take, take
        if not queue:
            fresh = True
        if have == size:
            windows.append(window)
            window, have, seed, queue, fresh = [], 0, None, [], True
            if at < len(ids):
                window, have, seed = [(member, at, len(ids), ids)], len(ids) - at, shard.terms[member]
    return windows, window


def pack(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 0, doc_id: str = "doc_id", text: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``; ``ids`` too if asked for."""
    rows = materialise(tokenised(docs, vocabulary, size, end_id, doc_id, text, keep_ids), "tokens")
    stats = docs.sparkSession.sparkContext.broadcast(frequencies(rows))

    def run(batches):
        base, count = TaskContext.get().partitionId() << 40, 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
        kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * keep_ids
        out: list[tuple] = []
        members: list[tuple] = []  # (doc id, first token of the rest, ids, doc tokens)
        window: list[tuple] = []  # (member's facts, from, to, ids)

        def emit(pieces):
            nonlocal count
            at = 0
            for (doc, first, tokens), a, b, ids in pieces:
                part = ids[a:b]
                out.append((doc, first + a, b - a, zlib.crc32(part.tobytes()), tokens, base + count, at, *([part] * keep_ids)))
                at += b - a
            count += 1

        def close():
            nonlocal window
            facts = [m[:3] for m in members]
            named = [(n, a, b, ids) for n, (_, a, b, ids) in enumerate(window)]
            kept = [w[0] for w in window]
            full, opened = fill([m[3] for m in members], [(-1 - n, a, b, ids) for n, a, b, ids in named], size, stats.value)
            known = lambda n: kept[-1 - n] if n < 0 else facts[n]
            for pieces in full:
                emit([(known(n), a, b, ids) for n, a, b, ids in pieces])
            window = [(known(n), a, b, ids) for n, a, b, ids in opened]
            members.clear()

        def batch_of():
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            out.clear()
            return made

        for batch in batches:
            for row in batch.to_pylist():
                for n, total in enumerate(row["sums"]):
                    body = [np.frombuffer(row["body"], "<u4", size, 4 * n * size)] if keep_ids else []
                    out.append((row["doc_id"], n * size, size, total, row["doc_tokens"], base + count, 0, *body))
                    count += 1
                if row["rest"]:
                    members.append((row["doc_id"], len(row["sums"]) * size, row["doc_tokens"], np.frombuffer(row["rest"], "<u4")))
                if len(members) >= SHARD:
                    close()
                if len(out) >= 20_000:
                    yield batch_of()
        if members:
            close()
        length = sum(b - a for _, a, b, _ in window)
        while length:  # the last window, by falling powers of two
            part, room = [], 1 << (length.bit_length() - 1)
            length -= room
            while room:
                facts, a, b, ids = window.pop(0)
                cut = min(b - a, room)
                part.append((facts, a, a + cut, ids))
                room -= cut
                if a + cut < b:
                    window.insert(0, (facts, a + cut, b, ids))
            emit(part)
        yield batch_of()

    order = ["sign", "hash", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _PIECES + ", ids array<long>" * keep_ids)


@query("op10_packing")
def op10_packing(spark, sf_dir):
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
