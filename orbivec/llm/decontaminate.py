"""Benchmark decontamination: word windows of benchmark items, looked up among all windows of all documents.

Benchmark windows are hashed into a set; every document's windows are hashed by doubling (pairs, pairs of pairs, ...),
so a window of ten words costs five hashes of two numbers instead of one of ten words. Windows whose hash is in the set
are candidates; they are compared word by word with the item's window before they count.

Defined cases: a null text has no words and is clean. An item without words has no window; an item with fewer words
than the window length is one window. A null item id still marks words but is not listed. Repeated rows of documents
get the same result each; repeated items count once. Other columns of either table are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import GAP, col, text_of, words_of
from orbivec.session import materialise

#: Window hashes (8 bytes each) up to this number are broadcast; beyond it, windows meet by a shuffle.
BROADCAST_HASHES = 4_000_000
#: Found places (about 100 bytes each) up to this number are broadcast to the documents; beyond it, both are shuffled.
BROADCAST_PLACES = 500_000


def _shifted(a: Column, by: int, n: Column) -> Column:
    return F.slice(a, F.lit(by + 1), F.greatest(n - by, F.lit(0)))


def window_hashes(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``hashes_L`` for each L: hashes of the windows of L consecutive ``words``, by start; empty where words are fewer."""
    df = df.withColumn("n_words", F.size("words")).withColumn("span_1", F.transform("words", lambda w: F.xxhash64(w)))
    width = 1
    while width * 2 <= max(lengths):
        a, n = F.col(f"span_{width}"), F.greatest(F.col("n_words") - (width - 1), F.lit(0))
        joined = F.zip_with(F.slice(a, F.lit(1), F.greatest(n - width, F.lit(0))), _shifted(a, width, n), lambda x, y: F.xxhash64(x, y))
        df, width = df.withColumn(f"span_{width * 2}", joined), width * 2
    for length in lengths:
        parts = [1 << b for b in reversed(range(length.bit_length())) if length >> b & 1]
        made, acc = parts[0], F.col(f"span_{parts[0]}")
        for part in parts[1:]:
            count = F.greatest(F.col("n_words") - (made + part - 1), F.lit(0))
            acc = F.zip_with(F.slice(acc, F.lit(1), count), F.slice(F.col(f"span_{part}"), F.lit(made + 1), count), lambda x, y: F.xxhash64(x, y))
            made += part
        df = df.withColumn(f"hashes_{length}", acc)
    return df


def _placed(length: int) -> Column:
    return F.transform(f"hashes_{length}", lambda h, i: F.struct(h.alias("hash"), i.alias("start"), F.lit(length).alias("length")))


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """Distinct ``(item, length, gram)``: each item's windows as space-joined words."""
    items = benchmark.select(col(item_id).alias("item"), words_of(text_of(text)).alias("words")).where(F.size("words") > 0)
    n = F.size("words")
    items = items.withColumn("length", F.least(n, F.lit(window)))
    starts = F.sequence(F.lit(1), n - F.col("length") + 1)
    return items.select("item", "length", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("length")), " "))).alias("gram")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """Each row of ``docs`` with ``n_words``, ``places`` (sorted array of start, length in words), ``n_hit`` and ``items`` (sorted).

    All columns of ``docs`` are kept under ``doc``, a struct, so that their names clash with none of these.
    """
    grams = materialise(item_windows(benchmark, item_id, item_text, window), "grams")
    lengths = sorted(r[0] for r in grams.select("length").distinct().collect())  # at most ``window`` numbers
    key = [col(doc_id).alias("id"), F.xxhash64(text_of(text)).alias("version")]
    if not lengths:
        found = None
    else:
        hashed = grams.withColumn("words", F.split("gram", " "))
        hashed = reduce(DataFrame.unionAll, [window_hashes(hashed.where(F.col("length") == n), [n]).select(F.element_at(f"hashes_{n}", 1).alias("hash"), "length", "gram", "item") for n in lengths])
        hashed = materialise(hashed, "windows")
        wanted = hashed.select("hash", "length").distinct()
        if wanted.count() <= BROADCAST_HASHES:
            wanted = F.broadcast(wanted)
        scanned = window_hashes(docs.select(*key, words_of(text_of(text)).alias("words")), lengths)
        # Outer forms: else the optimizer filters by the arrays' sizes first and makes them twice.
        if len(lengths) == 1:
            scanned = scanned.select("id", "version", F.posexplode_outer(f"hashes_{lengths[0]}").alias("start", "hash"), F.lit(lengths[0]).alias("length"))
        else:
            scanned = scanned.select("id", "version", F.inline_outer(F.concat(*[_placed(n) for n in lengths]))).select("id", "version", "start", "hash", "length")
        candidates = scanned.join(wanted, ["hash", "length"])
        found = materialise(candidates.join(hashed, ["hash", "length"]).select("id", "version", "start", "length", "gram", "item"), "places")
    rows = docs.select(F.struct("*").alias("doc"), *key, words_of(text_of(text)).alias("words"))
    if found is None:
        rows = rows.withColumn("found", F.expr("cast(null as array<struct<start:int,length:int,gram:string,item:string>>)"))
    else:
        few = found.count() <= BROADCAST_PLACES
        found = found.groupBy(F.col("id").alias("found_id"), F.col("version").alias("found_version")).agg(F.collect_set(F.struct("start", "length", "gram", "item")).alias("found"))
        rows = rows.join(F.broadcast(found) if few else found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version")), "left")
    words = F.col("words")
    real = F.filter(F.coalesce("found", F.array()), lambda x: F.array_join(F.slice(words, x.start + 1, x.length), " ") == x.gram)
    rows = rows.select("doc", F.size("words").cast("long").alias("n_words"), real.alias("found"))
    places = F.array_sort(F.array_distinct(F.transform("found", lambda x: F.struct(x.start.alias("start"), x.length.alias("length")))))
    rows = rows.select("doc", "n_words", places.alias("places"), F.array_sort(F.array_distinct(F.filter(F.transform("found", lambda x: x.item.cast("string")), lambda i: i.isNotNull()))).alias("items"))
    return rows.select("doc", "n_words", "places", covered(F.col("places")).alias("n_hit"), "items")


def covered(places: Column) -> Column:
    """How many words lie in at least one of the sorted places."""
    state = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def step(acc, x):
        end = x.start + x.length
        more = F.greatest(F.lit(0), end - F.greatest(x.start, acc.end))
        return F.struct((acc.words + more).alias("words"), F.greatest(end, acc.end).alias("end"))

    return F.aggregate(places, state, step, lambda acc: acc.words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The documents without any benchmark window, all columns as they were."""
    return contamination(docs, benchmark, **names).where(F.col("n_hit") == 0).select("doc.*")


def cut_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **names) -> DataFrame:
    """All documents; benchmark words go, together with the characters up to the next word."""
    rows = contamination(docs, benchmark, text=text, **names)
    whole = F.coalesce(F.col("doc").getField(text).cast("string"), F.lit(""))
    lead = F.regexp_extract(whole, "^" + GAP, 0)
    pieces = F.regexp_extract_all(whole, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+[\x00-\x2F\x3A-\x60\x7B-\x7F]*"), F.lit(0))
    kept = F.filter(pieces, lambda p, i: ~F.exists("places", lambda x: (x.start <= i) & (i < x.start + x.length)))
    cut = F.when(F.col("n_hit") == 0, F.col("doc").getField(text)).otherwise(F.concat(lead, F.array_join(kept, "")))
    return rows.select(F.col("doc").withField(f"`{text}`", cut).alias("doc")).select("doc.*")


_SQL = r"""
WITH w AS (SELECT item_id, list_filter(regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(ws), 10) l, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' '))) gram FROM w WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws FROM documents),
p AS (SELECT rid, ws, l, unnest(range(1, len(ws) - l + 2)) i FROM d, (SELECT DISTINCT l FROM g)),
s AS (SELECT rid, l, i, array_to_string(list_slice(ws, i, i + l - 1), ' ') gram FROM p),
h AS (SELECT rid, s.l, i, item_id FROM s JOIN g ON g.gram = s.gram AND g.l = s.l),
c AS (SELECT rid, count(DISTINCT j) n_hit FROM (SELECT DISTINCT rid, unnest(range(i, i + l)) j FROM h) GROUP BY rid),
t AS (SELECT rid, count(*) n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) ids FROM (SELECT DISTINCT rid, item_id FROM h WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN t USING (rid)
"""


@query("op4_decontamination", _SQL)
def op4_decontamination(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc.doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
