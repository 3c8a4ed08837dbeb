"""Spelling variants: words within one edit of each other, each led to its most frequent neighbour.

Asymmetric chunks: the shorter word of a pair (of two of one length, either) contributes two disjoint chunks, its halves, the
other its positional grams of their lengths. One inserted, deleted or replaced code point leaves one half as it is: the
first at its place, the second shifted by the difference in length, at most one. Grams at other places meet no chunk and
are not written. Many words share a half, so each is completed by a half of what remains: that has the one edit, so one of
its own halves is kept as well. Chunk, completion, place and both lengths are one key, and what meets is verified by its
edit distance inside the join, which only true pairs leave.

Words are counted before they are compared, so frequent ones are one row. A word's form is its neighbour of largest count;
counts at least double from form to form, so the roots are found by doubling steps, a few joins in all. No side of a join
is broadcast: all grow with the words, and their files tell little of their size in memory.

Defined cases: a null text or an empty one has no words; the number of a row without an id is made of the text ``null``;
repeated rows count each; a word that loses its only letter is none; ties go to the smaller word in code-point order;
without any word that is frequent enough the result is empty. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbivec.llm.importance import CRC_TABLE, crc_sql
from orbivec.llm.registry import query, table
from orbivec.llm.texts import col, lower_ascii, text_of
from orbivec.session import materialise

RUNS = "[a-z\\u00C0-\\u00FF]+"


def counted(docs: DataFrame, least_length: int = 5, least_count: int = 3, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``(word, n)``: words of enough code points and occurrences, after runs whose number, of id and run, ``every`` divides have lost a letter."""
    runs = docs.select(F.coalesce(col(doc_id).cast("string"), F.lit("null")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(text_of(text)), F.lit(RUNS), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = F.pmod("h", F.length("run")).cast("int")
    struck = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % every == 0, struck).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def keys(word: Column, shorter: Column, shift: int, longer: bool) -> Column:
    """The four completed chunks of a word of ``shorter`` code points, or the grams where they lie in one longer by ``shift``."""
    half = F.floor(shorter / 2)
    first, second = F.floor(half / 2), half + F.floor((shorter - half) / 2)
    moved = shift if longer else 0
    upto, on = lambda at: F.substring(word, F.lit(1), at.cast("int")), lambda at: F.substring(word, (at + moved + 1).cast("int"), F.length(word))
    found = [upto(second), F.concat(upto(half), on(second)), F.concat(upto(first), on(half)), on(first)]
    return F.array(*[F.xxhash64(F.lit(n), shorter, F.lit(shift), k) for n, k in enumerate(found)])


def near(words: DataFrame) -> DataFrame:
    """Distinct ``(a, a_n, b, b_n)`` of ``(word, n)`` with exactly one edit between them, each pair once."""
    size = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(F.concat(*[keys(F.col("word"), size, s, False) for s in (0, 1)])).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(F.concat(*[keys(F.col("word"), size - s, s, True) for s in (0, 1)])).alias("key"))
    # Never broadcast: Spark sizes both sides by the files of the words, of which each row here is eight.
    meets = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))
    return chunks.hint("merge").join(grams.hint("merge"), "key").where(meets & (F.levenshtein("a", "b", 1) == 1)).select("a", "a_n", "b", "b_n").distinct()


def variants(docs: DataFrame, least_length: int = 5, least_count: int = 3, ratio: int = 2, doc_id: str = "doc_id", text: str = "text", every: int = 97) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)``: the number of words within one edit, the one of them of largest count if that is ``ratio`` times the word's own, and where forms lead in the end."""
    words = materialise(counted(docs, least_length, least_count, doc_id, text, every), "words")
    pairs = materialise(near(words), "near_words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionAll(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    words = words.hint("merge").join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n"))
    enough = F.col("form_n") >= ratio * F.col("n")
    words = materialise(words.withColumn("form", F.when(enough, F.col("form"))).withColumn("form_n", F.when(enough, F.col("form_n"))), "forms")

    leads = materialise(words.where(F.col("form").isNotNull()).select("word", F.col("form").alias("to")), "leads")
    while True:  # each turn doubles the steps taken; a path is no longer than the logarithm of the largest count
        on = leads.select(F.col("word").alias("to"), F.col("to").alias("further"))
        onward = leads.hint("merge").join(on.hint("merge"), "to", "left")
        if onward.where(F.col("further").isNotNull()).isEmpty():
            break
        leads = materialise(onward.select("word", F.coalesce("further", "to").alias("to")), "leads")
    return words.hint("merge").join(leads.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))


@query("op12_spelling", f"""
with recursive {CRC_TABLE.strip()},
runs as (
    select coalesce(doc_id::varchar, 'null') as id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) as run from documents),
seen as (select id || ':' || run as key, run, count(*) as n from runs where length(run) >= 5 group by all),
struck as (select n, run, {crc_sql("key")} as h from seen, crcs),
words as (
    select word, sum(n)::bigint as n from (select n, case when h % 97 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word from struck) x
    where length(word) >= 5 group by word having sum(n) >= 3),
less as (select word, n, i, word[:i - 1] || word[i + 1:] as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words) x),
pairs as (
    select a.word as word, b.word as other, b.n as other_n from less a join less b on a.rest = b.rest and a.i = b.i and a.word <> b.word
    union select less.word, words.word, words.n from less join words on words.word = less.rest
    union select words.word, less.word, less.n from less join words on words.word = less.rest),
near as (select word, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from pairs group by word),
forms as (
    select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * n then other end as form, case when other_n >= 2 * n then other_n end as form_n
    from words left join near using (word)),
paths as (select word, word as at from forms union all select paths.word, forms.form from paths join forms on forms.word = paths.at where forms.form is not null),
roots as (select paths.word, paths.at as root from paths join forms on forms.word = paths.at where forms.form is null)
select word, n, n_near, form, form_n, root from forms join roots using (word)
""")
def op12_spelling(spark, sf_dir):
    return variants(table(spark, sf_dir, "documents"))
