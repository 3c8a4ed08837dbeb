"""Importance resampling towards a target: hashed word-run features by an automaton over a dictionary of words.

The distinct words of a batch of texts form an Aho-Corasick dictionary, each bounded by delimiters and carrying the CRC
and the length of its bytes. One scan of a text emits the payloads of its words in order; the CRC of a run of words
follows from the payloads of adjacent ones (a CRC is linear: appending n bytes shifts it by n bytes), so no run is ever
built as a string. A feature's bucket is that CRC modulo ``BUCKETS``. Source and target are bucket counts, a document's
weight is the floored mean of its features' gains, and a seeded Gumbel number per id turns the highest scores into a
draw without replacement.

Whole texts are scanned once, where they lie, and each leaves its buckets (two bytes a feature) to counting and scoring;
a task sends one row per bucket, and only narrow rows are sorted for the ranks. Ranks are positions in the sorted, written table.

Defined cases: a null text, an empty one or one without words has no features and weight 0; a null id draws with the
number of the id ``null``; repeated rows count, are drawn and ranked each by itself, in either order; without documents,
or without any that is long enough, nothing is drawn; with an empty target every gain is that of counts of zero. Words
longer than any other are no special case. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.registry import query, table
from orbivec.llm.texts import GAP, col, lower_ascii, text_of
from orbivec.session import materialise, scratch_path
from orbivec.sources.corpus import with_positions

BUCKETS, RUN = 10_000, 2
#: Characters of texts whose words share one dictionary; a longer text has its own.
DICTIONARY = 4_000_000
#: Lengths of which the shifts are kept.
_KEPT = 64


def _doubled(shift: np.ndarray) -> np.ndarray:
    """A linear map of 32 bits, given by the images of the bits, applied twice."""
    return np.array([_image(shift, int(x)) for x in shift], np.uint32)


def _image(shift: np.ndarray, x: int) -> np.uint32:
    found = np.uint32(0)
    for bit in range(32):
        if x >> bit & 1:
            found ^= shift[bit]
    return found


@lru_cache(maxsize=4096)
def shift_tables(length: int) -> np.ndarray:
    """What appending ``length`` bytes makes of a CRC: four tables of 256, by its bytes, to be combined by XOR."""
    one_bit = np.array([0xEDB88320] + [1 << n for n in range(31)], np.uint32)  # fixed value: the reflected polynomial
    power = one_bit
    for _ in range(3):
        power = _doubled(power)
    total = np.array([1 << n for n in range(32)], np.uint32)
    while length:
        if length & 1:
            total = np.array([_image(power, int(x)) for x in total], np.uint32)
        length >>= 1
        if length:
            power = _doubled(power)
    return np.array([[_image(total, byte << 8 * n) for byte in range(256)] for n in range(4)], np.uint32)


@lru_cache(maxsize=1)
def _short_shifts() -> np.ndarray:
    return np.stack([shift_tables(n) for n in range(_KEPT + 1)])


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The CRCs once so many bytes follow, apart from those bytes' own."""
    tables, short = _short_shifts(), np.minimum(length, _KEPT)
    parts = [(crc >> np.uint32(8 * n)) & np.uint32(255) for n in range(4)]
    made = tables[short, 0, parts[0]] ^ tables[short, 1, parts[1]] ^ tables[short, 2, parts[2]] ^ tables[short, 3, parts[3]]
    for at in np.flatnonzero(length > _KEPT):
        own = shift_tables(int(length[at]))
        made[at] = own[0, parts[0][at]] ^ own[1, parts[1][at]] ^ own[2, parts[2][at]] ^ own[3, parts[3][at]]
    return made


class Dictionary:
    """The words of some texts, of which each is single words between single spaces, with a space at both ends."""

    def __init__(self, texts: list[str]):
        words = set()
        for text in texts:
            words.update(text.split(" "))
        words.discard("")
        written = [w.encode("utf-8", "surrogatepass") for w in words]
        self.crc = np.fromiter(map(zlib.crc32, written), np.uint32, len(written))
        self.led = np.fromiter((zlib.crc32(b" " + w) for w in written), np.uint32, len(written))  # as a follower
        self.length = np.fromiter(map(len, written), np.int64, len(written))
        self.automaton = ahocorasick.Automaton()
        for n, word in enumerate(words):
            self.automaton.add_word(f" {word} ", n)
        if words:
            self.automaton.make_automaton()

    def features(self, text: str, run: int) -> np.ndarray:
        """The CRC of every run of up to ``run`` consecutive words."""
        if len(text) < 3 or not len(self.crc):
            return np.zeros(0, np.uint32)
        found = np.fromiter((n for _, n in self.automaton.iter(text)), np.int64)
        made = [crc := self.crc[found]]
        for length in range(1, min(run, len(found))):
            follow = found[length:]
            made.append(crc := shifted(crc[:len(follow)], self.length[follow] + 1) ^ self.led[follow])
        return np.concatenate(made)


def spaced(text: Column) -> Column:
    """Lower-cased words between single spaces, one at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), GAP, " ")), F.lit(" "))


def features(texts: DataFrame, text: str, buckets: int = BUCKETS, run: int = RUN, ids: str | None = None) -> DataFrame:
    """``(doc_id, n_words, made)`` per row: the number of words, and the buckets of all features as bytes of unsigned 32-bit numbers (16-bit ones where they suffice)."""
    kind = _kind(buckets)

    def run_(batches):
        for batch in batches:
            texts, rows, size = [], [], 0
            for n, text in enumerate(batch.column(0)):
                texts.append(text.as_py())
                rows.append(n)
                size += len(texts[-1])
                if size >= DICTIONARY or n + 1 == batch.num_rows:
                    words = Dictionary(texts)
                    made = [(words.features(t, run) % np.uint32(buckets)).astype(kind).tobytes() for t in texts]
                    count = [t.count(" ") - 1 if len(t) > 2 else 0 for t in texts]
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(rows[0], len(rows)), pa.array(count, pa.int64()), pa.array(made, pa.binary())], names=["doc_id", "n_words", "made"])
                    texts, rows, size = [], [], 0

    doc_id = col(ids).cast("long") if ids else F.lit(None).cast("long")
    return texts.select(spaced(text_of(text)).alias("text"), doc_id.alias("doc_id")).mapInArrow(run_, "doc_id long, n_words long, made binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def bucket_counts(made: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)`` of all features, only buckets that hold any; a task sends at most one row per bucket."""
    kind = _kind(buckets)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                total += np.bincount(np.frombuffer(row.as_py(), kind), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    return made.select("made").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, gain)`` for every bucket: how much likelier it is in the target, smoothed by one per bucket, in floored thousandths of a log."""
    both = source.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    both = both.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    s, t, all_s, all_t = (F.col(n).cast("double") for n in ("s", "t", "all_s", "all_t"))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).alias("gain"))  # one row of sums


def gumbel(doc_id: Column, seed: int) -> Column:
    """A floored Gumbel number in thousandths, fixed by seed and id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def weights(made: DataFrame, gain: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` per row of ``features``."""
    gain = np.array([r.gain for r in gain.orderBy("bucket").collect()], np.int64)  # one number per bucket
    told, kind = made.sparkSession.sparkContext.broadcast(gain), _kind(buckets)

    def weigh(batches):
        for batch in batches:
            found = [np.frombuffer(row.as_py(), kind) for row in batch.column(2)]
            weight = [int(told.value[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in ([len(f) for f in found], weight))], names=["doc_id", "n_words", "n_features", "weight"])

    return made.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, run: int = RUN) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` per row; ``rank`` from 1 among the drawn, else null.

    Drawn are the highest scores among rows of at least ``least_words`` words, ``percent`` of those rows, ties to the smaller id.
    """
    spark = docs.sparkSession
    made = materialise(features(docs, text, buckets, run, doc_id), "features")
    aim = bucket_counts(features(target, target_text, buckets, run), buckets)
    rows = weights(made, gains(bucket_counts(made, buckets), aim, buckets), buckets)
    rows = materialise(rows.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "weights")  # sorting by range reads its rows twice
    path = scratch_path(spark, "resampled")
    short = F.col("n_words") < least_words
    rows.orderBy(short, F.col("score").desc(), F.col("doc_id").asc_nulls_last()).write.parquet(path)
    drawn = rows.where(~short).count() * percent // 100
    rank = F.when(F.col("pos") < drawn, F.col("pos") + 1)
    return with_positions(spark, path).select("doc_id", "n_features", "weight", "score", rank.alias("rank"))


CRC_TABLE = """
crcs as (  -- bit by bit: eight steps a byte
    select list(c order by i) as t from (
        select i, list_reduce(range(8), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) as c from range(256) r(i)) x)"""


def crc_sql(text: str) -> str:
    """SQL for the unsigned CRC of a string's bytes, with ``CRC_TABLE`` among the tables."""
    digits = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(0, strlen({text})), lambda k: (instr('0123456789ABCDEF', {digits}[2*k+1]) - 1) * 16 + instr('0123456789ABCDEF', {digits}[2*k+2]) - 1)"
    return f"xor(list_reduce({bytes_}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295::bigint)"


@query("op11_importance", f"""
with {CRC_TABLE.strip()},
words as (
    select kind, n, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w
    from (select 's' as kind, row_number() over () as n, doc_id, coalesce(text, '') as text from documents union all select 't', row_number() over (), item_id, coalesce(text, '') from benchmark) x),
features as (
    select kind, n, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) as f from words),
buckets as (select f, {crc_sql("f")} % 10000 as bucket from (select distinct f from features) d, crcs),
counts as (select bucket, kind, count(*) as n from features join buckets using (f) group by bucket, kind),
gains as (
    select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from counts where kind = 's') + 10000)::double
        / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from counts where kind = 't') + 10000)::double)))::bigint as gain
    from range(10000) b(bucket) left join counts s on s.bucket = b.bucket and s.kind = 's' left join counts t on t.bucket = b.bucket and t.kind = 't'),
weighed as (
    select n, count(*) as n_features, floor(sum(gain)::double / count(*))::bigint as weight from features join buckets using (f) join gains using (bucket) where kind = 's' group by n),
scored as (
    select n, doc_id, len(w) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
        coalesce(weight, 0)::bigint + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
    from words left join weighed using (n) where kind = 's'),
ranked as (select n, row_number() over (order by score desc, doc_id) as place, count(*) over () as eligible from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= eligible * 25 // 100 then place end as rank from scored left join ranked using (n)
""")
def op11_importance(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
