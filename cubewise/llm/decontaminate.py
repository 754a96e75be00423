"""Benchmark decontamination with a distributed positional inverted index.

Benchmark items are cut into windows of consecutive words. Corpus frequencies
of benchmark words, counted over all documents, name the rarest words of each
window. Postings ``(document, word, position)`` are stored for those words
only; each posting also keeps the words around it. The lists of a window's
rarest words are shifted by the words' offsets and intersected, so a
candidate is a place where all of them agree; the kept words then decide the
whole phrase. Places where the rarest words stand near each other without the
phrase are proximity matches.

Documents are named by their id and a hash of their text, so that a doc_id on
several rows mixes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch, few, read_table
from .words import word_array

WIDTH = 10
#: Lists that are intersected for each window.
RAREST = 2
#: Up to this many words (of bounded length) an index vocabulary is sent to all executors; beyond it, postings are shuffled.
SMALL = 100_000
#: Up to this many rare words are written into the plan.
LITERAL = 20_000


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``item_id, window, words`` of ``benchmark(item_id, text)``: every run
    of ``width`` words; an item of fewer, but not none, is one window."""
    items = benchmark.select("item_id", word_array(F.col("text")).alias("all")).where("size(all) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("all") - (width - 1)))
    return items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("all", i, width))).alias("words")) \
        .distinct().select("item_id", "words", F.xxhash64("words").alias("window"))


def postings(docs: DataFrame, terms: DataFrame, width: int = WIDTH) -> DataFrame:
    """``doc, word, at, around`` for every place of ``terms(word)`` in
    ``docs(doc, words)``; ``around`` holds the words from ``width - 1`` before
    to ``width - 1`` after it, null beyond the text's ends.

    Up to ``LITERAL`` terms are looked up inside the word array, so that only
    kept places leave it; more are joined."""
    listed = [r["word"] for r in terms.limit(LITERAL + 1).collect()]
    if len(listed) <= LITERAL:
        hits = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: h["word"].isin(listed))
        places = docs.select("doc", "words", F.explode(hits).alias("hit")).select("doc", "words", "hit.word", "hit.at")
    else:
        places = docs.select("doc", "words", F.posexplode("words").alias("at", "word")).join(few(terms, SMALL), "word")
    around = F.transform(F.sequence(F.col("at") - (width - 1), F.col("at") + (width - 1)), lambda i: F.get("words", i))
    return places.select("doc", "word", "at", around.alias("around"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, width: int = WIDTH) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id``, ``n_words``,
    ``n_hit`` (words inside any occurrence of a window of ``benchmark(item_id,
    text)``), ``n_items`` (items with occurring windows), ``items_sha256`` (of
    their ids, sorted as strings, comma joined), ``contaminated`` (n_hit > 0)
    and ``n_near`` (places where the rarest words of a window stand within
    ``width`` words of each other, but not the phrase).

    A null or empty text has no words and no hits; null and empty items have
    no windows; an item with a null id counts as no item but its windows hit.
    Repeated rows get a result each; other columns are ignored; an empty
    table gives no rows, an empty benchmark no hits.
    """
    base = docs.select("doc_id", "text", F.struct(F.col("doc_id"), F.xxhash64("text").alias("h1"), F.crc32(F.col("text").cast("binary")).alias("h2")).alias("doc"))
    texts = base.select("doc", word_array(F.col("text")).alias("words"))

    wins = scratch.save(windows(benchmark, width))
    unique = wins.select("window", "words").distinct()
    vocabulary = few(unique.select(F.explode("words").alias("word")).distinct(), SMALL)
    counts = texts.select(F.explode("words").alias("word")).join(vocabulary, "word").groupBy("word").count()
    in_windows = unique.select("window", F.posexplode("words").alias("offset", "word")).join(counts, "word", "left") \
        .withColumn("count", F.coalesce("count", F.lit(0)))
    # a window that holds a word of no document occurs nowhere
    rank = F.row_number().over(Window.partitionBy("window").orderBy("count", "offset"))
    least = F.min("count").over(Window.partitionBy("window"))
    rare = scratch.save(in_windows.withColumn("least", least).withColumn("list", rank).where(f"least > 0 and list <= {RAREST}")
                        .join(unique, "window").select("window", "words", "word", "offset", "list"))
    lists = F.least(F.size("words"), F.lit(RAREST))

    index = scratch.save(postings(texts, rare.select("word").distinct(), width))
    shifted = index.join(few(rare, SMALL), "word").select("doc", "window", "words", "list", (F.col("at") - F.col("offset")).alias("start"), "offset", "around")
    here = F.slice("around", width - F.col("offset"), F.size("words"))
    # the first list's posting carries the verdict on the whole phrase
    candidates = shifted.groupBy("doc", "window", "start").agg(
        F.count_distinct("list").alias("agree"), F.max(lists).alias("lists"),
        F.max(F.size("words")).alias("size"), F.bool_or(here == F.col("words")).alias("phrase"))
    found = scratch.save(candidates.where("agree = lists and phrase").select("doc", "window", "start", "size"))

    # words hit: the union of the occurrences, each adding what reaches beyond the furthest end before it
    spans = found.groupBy("doc", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    hit = spans.withColumn("reach", reach).groupBy("doc").agg(
        F.sum(F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce("reach", F.lit(0))))).alias("n_hit"))
    items = found.select("doc", "window").distinct().join(wins.select("window", "item_id"), "window").groupBy("doc").agg(
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))

    # proximity: the second rarest word of a window among the words around its rarest
    second = rare.where("list = 2").select("window", F.col("word").alias("other"))
    near = index.join(few(rare.where("list = 1").join(second, "window").select("window", "words", "word", "offset", "other"), SMALL), "word") \
        .where(F.array_contains("around", F.col("other")) & (F.slice("around", width - F.col("offset"), F.size("words")) != F.col("words"))) \
        .select("doc", "at").distinct().groupBy("doc").agg(F.count("*").alias("n_near"))

    result = base.select("doc_id", "doc", F.size(word_array(F.col("text"))).cast("long").alias("n_words"))
    by_doc = [c.withColumnRenamed("doc", "d").select(F.xxhash64("d").alias("key"), "*") for c in (hit, items, near)]
    result = result.withColumn("key", F.xxhash64("doc"))
    for part in by_doc:
        result = result.join(part, (result["key"] == part["key"]) & result["doc"].eqNullSafe(part["d"]), "left").drop(part["key"], part["d"])
    listed = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return result.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
                         F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
                         F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in all documents."""
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), Scratch(spark, "decontaminate"))
