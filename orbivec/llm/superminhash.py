"""Near copies by SuperMinHash: signatures of few steps, banding, verification on full sets, and connected components.

A text is its set of word shingles. In SuperMinHash every element deals its numbers over the places of the signature by
a random permutation, its j-th number being j plus a random fraction; a place keeps the least it gets. Once all places
hold less than j, no later step can change them, so a text of n shingles takes some ``max(n, m ln m)`` steps instead of
``n * m``, and the places of one signature are dealt without replacement, which lowers the variance of the agreement.

Two sets of similarity J share a key of ``ROWS`` places with chance J^ROWS, and one of ``BANDS`` keys with chance
1 - (1 - J^ROWS)^BANDS: 0.9994 at J = 0.8, more above. In each list of a key all members are measured on their full sets
against its smallest member, then those outside of its largest component against another one of that. What lies
in lists that still hold several components is joined exactly: sets that similar share one of their rarest shingles
(a fifth of each set), early enough that the rest of both could still reach the similarity. Only such pairs of different
components are measured, so neither large groups of copies nor passages that many texts share are ever paired off, and
no link between components is lost.

Work is on distinct sets, so copies, however many, are one. Defined cases: a null text, an empty one or one of white space
has no shingles and is linked with nothing (``linked_empty``: with its like); a text of fewer words than a shingle is one
shingle; words are cut at ASCII white space, A-Z lower-cased; repeated rows are rows of one set; several texts of one id
are each linked as their own set says; a row without an id is linked like any other, but names a component only when no
row in it has an id. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.simhash import components
from orbivec.llm.texts import col
from orbivec.session import materialise

BANDS, ROWS = 40, 8
#: How often those outside of a list's largest component are measured against one of its members before they are joined exactly.
HUBS = 1
#: Members that share one shipment of their hub's set.
CHUNK = 64
#: Elements signed at once, and rows of text held at once.
BLOCK, TEXTS = 1 << 16, 500
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the published SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of so many words."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    length = min(words, len(found))
    made = np.zeros(len(found) - length + 1, np.uint64)
    for i in range(length):  # a polynomial in an odd number, of the word hashes in order
        made = made * _STEP + hashes[i:i + len(made)]
    return np.unique(mixed(made))


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """A row of ``places`` numbers per set: the step in the upper bits, the random fraction (40 bits) below."""
    made = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    order = sorted((n for n in range(len(sets)) if len(sets[n])), key=lambda n: len(sets[n]))  # small sets take most steps: together
    if not order:
        return made
    elements, owners = np.concatenate([sets[n] for n in order]), np.repeat(order, [len(sets[n]) for n in order])
    for at in range(0, len(elements), BLOCK):
        element, owner = elements[at:at + BLOCK], owners[at:at + BLOCK]
        row = np.arange(len(element))
        dealt = None
        for step in range(places):
            here = np.unique(owner[row])
            open_ = np.zeros(len(sets), bool)
            open_[here] = made[here].max(1) >= np.uint64(step << 40)
            row = row[open_[owner[row]]]
            if not len(row):
                break
            random = mixed(element[row] + np.uint64((step + 1) * int(_STEP) % 2**64))
            place = step + ((random & np.uint64(0xFFFFFF)) * np.uint64(places - step) >> np.uint64(24)).astype(np.int64)
            if step == 0:
                first, to = (row, place), place
            else:
                if dealt is None:  # the permutations, once any element takes a second step
                    seat = np.full(len(element), -1)
                    seat[row] = np.arange(len(row))
                    dealt = np.tile(np.arange(places, dtype=np.uint16), (len(row), 1))
                    was = seat[first[0]] >= 0
                    dealt[seat[first[0][was]], first[1][was]] = 0
                to = dealt[seat[row], place].astype(np.int64)
                dealt[seat[row], place] = dealt[seat[row], step]
            np.minimum.at(made.reshape(-1), owner[row] * places + to, np.uint64(step << 40) | random >> np.uint64(24))
    return made


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A signed long per signature and band."""
    keys = np.tile(mixed(np.arange(1, bands + 1, dtype=np.uint64)), (len(signed), 1))
    for i in range(rows):
        keys = mixed(keys * _STEP + signed.reshape(len(signed), bands, rows)[:, :, i])
    return keys.view(np.int64)


def node_of(grams: np.ndarray) -> int:
    """A set's name: a signed long."""
    return xxhash.xxh64_intdigest(grams.tobytes()) - 2**63


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets share at least this much of their union."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(col(doc_id).cast("long").alias("doc_id"), col(text).cast("string").alias("text"), F.xxhash64(col(text)).alias("version"))


def prints(docs: DataFrame, doc_id: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """``(doc_id, version, node, size, keys)`` per row; ``keys`` is empty without shingles."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                keys = band_keys(signatures(sets, bands * rows), bands, rows)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(2), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k if len(s) else k[:0] for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
                ], names=["doc_id", "version", "node", "size", "keys"])

    return _rows(docs, doc_id, text).mapInArrow(run, "doc_id long, version long, node long, size long, keys array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """``(node, grams)`` of the rows that ``wanted`` names by ``(doc_id, version)``."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                sets = [shingles(t.as_py(), words) for t in batch.column(0).slice(at, TEXTS)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    rows, wanted = _rows(docs, doc_id, text), wanted.select(F.col("doc_id").alias("id"), F.col("version").alias("v"))
    of = rows.join(wanted, (F.col("version") == F.col("v")) & F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    return of.select("text").mapInArrow(run, "node long, grams binary")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``(a, b)`` whose sets are alike; ``a``'s set is shipped once per ``CHUNK`` of its partners."""

    def run(batches):
        hub, its = None, None
        for batch in batches:
            a, b = [], []
            for key, chunk, node, grams in zip(*(batch.column(n).to_pylist() for n in range(3)), batch.column(3), strict=True):
                own = np.frombuffer(grams.as_py(), np.uint64)
                if node == key:
                    hub, its = (key, chunk), own
                elif (key, chunk) == hub and alike(its, own, percent):
                    a.append(key)
                    b.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    chunks = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("node"))
    hubs = dealt.select("a", "chunk", F.col("a").alias("node")).distinct()
    rows = dealt.unionAll(hubs).join(sets, "node").select("a", "chunk", "node", "grams")
    rows = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("node") != F.col("a"))
    return rows.mapInArrow(run, "a long, b long").distinct()


def forest(edges: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect what the given ones do: each task keeps a spanning forest of its own (union-find)."""

    def run(batches):
        up: dict[int, int] = {}

        def root(x):
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = up[x]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        made = [(root(x), x) for x in up]
        for at in range(0, len(made), 10_000):
            part = made[at:at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def rarest(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of different labels among ``(node, label)`` that can be alike by their rarest shingles.

    With the shingles of each set ordered by how many of the sets hold them, two sets that share ``t`` of them share one
    among the first ``size - t + 1`` of both; a first shared one at places i and j leaves at most
    ``1 + min(size - i, size' - j)`` to share. Shingles of one set or one component alone are not written.
    """

    def run(batches):
        for batch in batches:
            for node, label, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                found = np.frombuffer(own.as_py(), np.int64)
                for at in range(0, len(found), 10_000):
                    part = found[at:at + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x, np.int64)) for x in (node, label, len(found))] + [pa.array(part)], names=["node", "label", "size", "gram"])

    flat = nodes.join(sets.dropDuplicates(["node"]), "node").select("node", "label", "grams")
    flat = materialise(flat.mapInArrow(run, "node long, label long, size long, gram long"), "superminhash_grams")
    seen = flat.groupBy("gram").agg(F.count("*").alias("n"), (F.min("label") != F.max("label")).alias("apart")).where("n > 1")
    common = flat.join(seen, "gram")
    single = common.groupBy("node").agg(F.count("*").alias("common"))  # the others come first: one set alone holds them
    placed = common.join(single, "node").withColumn("place", F.col("size") - F.col("common") + F.row_number().over(Window.partitionBy("node").orderBy("n", "gram")))
    placed = placed.where((F.col("place") <= F.col("size") - F.ceil(F.col("size") * percent / 100) + 1) & F.col("apart"))
    placed = materialise(placed.select("gram", "node", "label", "size", "place"), "superminhash_rarest")
    a, b = (placed.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "label", "size", "place")]) for s in "ab")
    left = 1 + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    on = (a.gram == b.gram) & (F.col("label_a") < F.col("label_b"))
    on &= (100 * F.least("size_a", "size_b") >= percent * F.greatest("size_a", "size_b")) & (left * (100 + percent) >= percent * (F.col("size_a") + F.col("size_b")))
    return a.join(b, on).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, node, size, label, most)`` of the lists that hold several components; ``most`` is the largest one's."""
    known = members.select("key", "node", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = materialise(known, "superminhash_known")
    parts = known.groupBy("key", "label").agg(F.count("*").alias("n"))
    most = parts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    return materialise(known.join(most, "key").select("key", "node", "size", "label", "most"), "superminhash_apart")


def _joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The labels once the found links count as well."""
    return components(forest(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).unionAll(found).repartition("a")))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, linked_empty: bool = False, lists: DataFrame | None = None) -> DataFrame:
    """``(doc_id, version, rows, node, size, component, component_id)``, equal rows once with their number.

    ``version`` hashes the text, ``node`` names its set of ``size`` shingles, ``component`` is the smallest node reached
    over pairs that share at least ``percent`` of their union, ``component_id`` the smallest document id there.
    ``lists`` has further lists ``(key, doc_id, version)`` of another method, whose members are compared like those of a key.
    """
    made = materialise(prints(docs, doc_id, text, words, bands, rows), "superminhash")
    kinds = made.groupBy("node", "size").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "version")).alias("row"), F.min("keys").alias("keys"))
    kinds = materialise(kinds, "superminhash_nodes")

    posted = kinds.select("node", "size", F.explode("keys").alias("key"))
    if lists is not None:
        told = lists.select("key", F.col("doc_id").alias("id"), F.col("version").alias("v"))
        of = made.where("size > 0").join(told, (F.col("version") == F.col("v")) & F.col("doc_id").eqNullSafe(F.col("id")))
        posted = posted.unionAll(of.select("node", "size", "key").distinct())
    lists = posted.groupBy("key").agg(F.min("node").alias("hub"), F.min_by("size", "node").alias("hub_size"), F.count("*").alias("n")).where("n > 1")
    members = materialise(posted.join(lists, "key").select("key", "node", "size", "hub", "hub_size"), "superminhash_lists")
    candidates = members.select("node").distinct()
    sets = materialise(full_sets(docs, kinds.join(candidates, "node", "left_semi").select("row.*"), doc_id, text, words), "superminhash_sets")

    def fits(a, b):
        return 100 * F.least(a, b) >= percent * F.greatest(a, b)

    stars = members.where((F.col("node") != F.col("hub")) & fits("size", "hub_size")).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    labels = components(forest(verified(stars, sets, percent)))
    for turn in range(HUBS):
        apart = _apart(members, labels)
        hubs = apart.where("label = most").groupBy("key").agg(F.min_by(F.struct(F.col("node").alias("a"), F.col("size").alias("a_size")), F.xxhash64("node", "key", F.lit(turn))).alias("hub")).select("key", "hub.*")
        pairs = apart.where("label != most").join(hubs, "key").where(fits("size", "a_size")).select("a", F.col("node").alias("b")).distinct()
        found = materialise(verified(pairs, sets, percent), "superminhash_found")
        if found.isEmpty():
            break
        labels = _joined(labels, found)
    found = materialise(verified(rarest(_apart(members, labels).select("node", "label").distinct(), sets, percent), sets, percent), "superminhash_found")
    if not found.isEmpty():
        labels = _joined(labels, found)

    named = kinds.select("node", "size", "least").join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    named = materialise(named.select("node", "least", "component"), "superminhash_named")
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = made.groupBy("doc_id", "version", "node", "size").agg(F.count("*").alias("rows"))
    out = out.join(named.select("node", "component").join(ids, "component"), "node")
    if not linked_empty:
        alone = F.col("size") == 0
        out = out.withColumn("component", F.when(alone, F.xxhash64("doc_id", "node")).otherwise(F.col("component")))
        out = out.withColumn("component_id", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "version", "rows", "node", "size", "component", "component_id")


@query("op13_superminhash", """
with words as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
           else list_sort(list_distinct([array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)])) end as s
    from words),
kinds as (select s, md5(s::varchar) as k, len(s) as n, min(doc_id) as least from sets where len(s) > 0 group by s),
flat as (select k, n, unnest(s) as g from kinds),
shared as (select a.k as x, b.k as y, count(*) as c from flat a join flat b on a.g = b.g and a.k < b.k and 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) group by a.k, b.k, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
links as (select x, y from shared union all select y, x from shared),
reach as (
    with recursive r(k, o) as (select k, k from kinds union select r.k, l.y from r join links l on l.x = r.o)
    select r.k, min(kinds.least) as component_id from r join kinds on kinds.k = r.o group by r.k)
select doc_id, len(s)::bigint as n_shingles, coalesce(component_id, doc_id) as component_id, doc_id = coalesce(component_id, doc_id) as kept
from sets left join kinds using (s) left join reach on reach.k = kinds.k
""")
def op13_superminhash(spark, sf_dir):
    found = near_copies(table(spark, sf_dir, "documents"), words=4, percent=80)
    found = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))  # every row as often as it was given
    return found.select("doc_id", F.col("size").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))
