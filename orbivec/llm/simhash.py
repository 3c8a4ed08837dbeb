"""SimHash near-duplicates: 64-bit fingerprints linked at a few differing bits, and their connected components.

A fingerprint is eight positional bytes. Two fingerprints that differ in at most two bits share at least six of them, so
the inverted index is kept over conjunctions of four byte positions (of the four neighbouring byte pairs, two each: six
lists per fingerprint): every linked pair meets in at least one list, while a list of single bytes would hold a 256th of
all fingerprints. Pairs from short lists are counted: shared positional bytes are tallied, pairs below the guaranteed
six go, the rest is verified by its differing bits. In a long list (many near copies share four bytes) no pairs are
formed: two fingerprints within two bits have a common neighbour within one bit of both, so each member is posted under
its 33 neighbours in the four bytes left, and members of one neighbour, at most 33, are linked to the smallest of them.
Both ways are exact.

Work is on distinct fingerprints, so exact copies, however many, are one. Defined cases: a null or empty text has
fingerprint zero and links like any other; documents of one id are one node of their own fingerprints; a null id never
is a component's id unless the component has no other.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import col
from orbivec.session import materialise

#: Lists with more fingerprints are resolved by neighbours instead of pairs. Both give the same links.
LONG_LIST = 32
#: Ids given in several rows up to this number are broadcast; beyond it, both sides are shuffled.
BROADCAST_IDS = 1_000_000
BITS = 2
#: Four positional bytes as one number: the byte pairs at these bit offsets.
LISTS = [(a, b) for a, b in combinations((0, 16, 32, 48), 2)]


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:len(words) - shingle])).tolist()
    pieces = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1:] - 1).tolist(), strict=True)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(seed)), np.uint64, len(pieces))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # a very long text takes no more memory than this block
        block = hashes[at:at + 8192]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > len(pieces), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, version, bits)`` per row: a hash of the text, and the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            made = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made.view(np.int64))], names=["doc_id", "version", "bits"])

    rows = docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"), F.xxhash64(col(text)).alias("version"))
    return rows.mapInArrow(run, "doc_id long, version long, bits long")


def _shared_bytes(a: Column, b: Column) -> Column:
    x = a.bitwiseXOR(b)
    tally = F.lit(0)
    for shift in range(0, 64, 8):
        tally = tally + F.when(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit(255)) == 0, 1).otherwise(0)
    return tally


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect exactly what all pairs of ``bits`` within two differing bits connect."""
    lists = F.array(*[F.struct(F.lit(n).alias("n"),
                               F.shiftleft(F.shiftrightunsigned("bits", a).bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(0xFFFF))).alias("bytes"))
                      for n, (a, b) in enumerate(LISTS)])
    posted = distinct.select("bits", F.inline(lists))
    sizes = materialise(posted.groupBy("n", "bytes").agg(F.count("*").alias("size")).where(F.col("size") > 1), "simhash_lists")
    short = posted.join(sizes.where(F.col("size") <= LONG_LIST), ["n", "bytes"])
    left, right = short.select("n", "bytes", F.col("bits").alias("a")), short.select("n", "bytes", F.col("bits").alias("b"))
    pairs = left.join(right, ["n", "bytes"]).where("a < b")
    pairs = pairs.where(_shared_bytes(F.col("a"), F.col("b")) >= 8 - BITS)
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS).select("a", "b")

    rest = []  # the bits that a list leaves open
    for a, b in LISTS:
        rest.append([p for s in (0, 16, 32, 48) if s not in (a, b) for p in range(s, s + 16)])
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << p) - (1 << 64) if p == 63 else 1 << p) for p in bits]) for bits in rest])
    long = posted.join(sizes.where(F.col("size") > LONG_LIST), ["n", "bytes"])
    near = long.select("n", "bits", F.explode(F.get(flips, F.col("n"))).alias("flip")).select("n", F.col("bits").bitwiseXOR(F.col("flip")).alias("near"), "bits")
    stars = near.groupBy("n", "near").agg(F.collect_set("bits").alias("members")).where(F.size("members") > 1)
    stars = stars.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a < b")
    return pairs.unionAll(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that each node of the links can reach.

    Alternates two steps that keep connections: link every node's larger neighbours, then its smaller ones, to its
    smallest. The number of rounds grows with the logarithm of the diameter; each is a written table.
    """
    edges = materialise(edges.select("a", "b").where("a < b"), "links")
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select("m", "v").where("m < v").distinct()
        down = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select("m", "v").where("m < v").unionAll(least.select("m", F.col("u").alias("v")))
        edges = materialise(small.select(F.col("m").alias("a"), F.col("v").alias("b")).distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.countDistinct("b"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("label"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, version, rows, bits, component, component_id)``: equal rows once, with their number.

    ``component`` is the smallest fingerprint that the row's reaches, ``component_id`` the smallest document id there.
    """
    made = fingerprints(docs, doc_id, text, shingle).groupBy("doc_id", "version", "bits").agg(F.count("*").alias("rows"))
    made = materialise(made, "fingerprints")
    nodes = materialise(made.groupBy("bits").agg(F.min("doc_id").alias("least")), "nodes")
    labels = components(links(nodes.select("bits")))
    named = nodes.join(labels, nodes.bits == labels.node, "left").select("bits", "least", F.coalesce("label", "bits").alias("label"))
    named = materialise(named, "named")
    ids = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of = named.join(ids, "label").select("bits", F.col("label").alias("component"), "component_id")
    return made.join(of, "bits").select("doc_id", "version", "rows", "bits", "component", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, found: DataFrame | None = None) -> DataFrame:
    """One row per component, of its smallest id, all columns as they were; a component without ids keeps one row as well.

    ``found`` has the rows' components, by default those of ``near_duplicates``. Of several texts under that id the one of the smallest hash stays, of several equal rows the first as JSON.
    """
    found = near_duplicates(docs, doc_id, text, shingle) if found is None else found
    found = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = found.groupBy("component", "doc_id").agg(F.min(F.struct("version", "rows")).alias("least"))
    kept = materialise(kept.select(F.col("doc_id").alias("kept_id"), "least.*").withColumnRenamed("version", "kept_version").distinct(), "kept")
    rows = docs.select(F.struct("*").alias("doc"), col(doc_id).cast("long").alias("id"), F.xxhash64(col(text)).alias("version"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("version") == F.col("kept_version"))
    single = rows.join(kept.where("rows = 1"), same).select("doc.*")
    repeated = kept.where("rows > 1")
    many = repeated.count()
    if not many:
        return single
    repeated = rows.join(F.broadcast(repeated) if many <= BROADCAST_IDS else repeated, same)
    first = repeated.groupBy("id", "version").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return single.unionAll(first.select("doc.*"))


@query("op7_simhash")
def op7_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))  # every row as often as it was given
    return found.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")
