"""Exact phrase search of test texts in a training corpus with a positional inverted index.

Every window of a test item is looked up by its rarest terms. The corpus is scanned
once for the length of the posting list of each test term, and once more to store the
postings (term, text, position) of the terms that are among the rarest of a window.
Lists are intersected after subtracting the term's place in the item: a text is a
candidate where all rare terms of a window meet at one offset. Candidates are then
compared word for word; those that fail are reported as proximity matches, texts that
have the rare terms of a window at the right distances between other words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldhaul.llm.common import LOWER, UPPER, stored, whole_text

BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), BETWEEN_WORDS), "")


def small(df: DataFrame, column: str) -> DataFrame:
    """With a broadcast hint if the rows and their longest value are counted to be few and short."""
    n, longest = df.agg(F.count("*"), F.coalesce(F.max(F.length(column)), F.lit(0))).first()
    return F.broadcast(df) if n * (longest + 32) <= 64 * BROADCAST_ROWS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (the id as text), its words; items without id or words are left out, repeated rows count once."""
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words(whole_text(benchmark)).alias("iw"))
    rows = rows.where("item is not null and size(iw) > 0").distinct()
    return rows.withColumn("item_key", F.struct("item", F.md5(F.concat_ws(" ", "iw"))))


def find_phrases(docs: DataFrame, benchmark: DataFrame, window: int = 13, rare_terms: int = 3) -> DataFrame:
    """Columns of ``docs`` within a struct ``doc``, with n_words, n_hit, items and near_items.

    ``items`` are the sorted ids whose windows occur, ``near_items`` those that only
    have their rare terms in place. Null texts have no words, an item shorter than
    ``window`` is one window, empty tables give no hits.
    """
    items = stored(items_of(benchmark), "phrase-items")
    terms = items.select(F.explode("iw").alias("term")).distinct()
    texts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), whole_text(docs).alias("t"))
    tokens = texts.select(F.md5("t").alias("key"), words(F.col("t")).alias("w"))

    occurring = tokens.select(F.explode("w").alias("term")).join(small(terms, "term"), "term")
    lengths = stored(occurring.groupBy("term").agg(F.count("*").alias("postings")), "phrase-lengths")

    starts = items.select(
        "item", "item_key", "iw", F.least(F.lit(window), F.size("iw")).alias("width")
    ).select("item", "item_key", "iw", "width", F.explode(F.expr("sequence(0, size(iw) - width)")).alias("s"))
    places = starts.select(
        "item_key", "s", "width", F.posexplode(F.expr("slice(iw, s + 1, width)")).alias("j", "term")
    ).join(lengths, "term", "left")
    order = Window.partitionBy("item_key", "s").orderBy("postings", "j")
    complete = Window.partitionBy("item_key", "s")
    rarest = (
        places.withColumns(
            {"all": F.count("postings").over(complete), "nth": F.row_number().over(order)}
        )
        .where((F.col("all") == F.col("width")) & (F.col("nth") <= rare_terms))
        .select("item_key", "s", "term", (F.col("s") + F.col("j")).alias("q"))
    )
    rarest = stored(rarest, "phrase-rarest")
    # Windows of 13 words are broadcast up to a counted number, joined by key beyond it;
    # without a shuffle by item, one that is found everywhere does not fill a task.
    few = rarest.count() <= BROADCAST_ROWS // 4
    hint = F.broadcast if few else lambda df: df

    looked_up = rarest.select("term").distinct()
    postings = tokens.select("key", F.posexplode("w").alias("p", "term")).join(small(looked_up, "term"), "term")
    index = stored(postings.select("term", "key", "p"), "phrase-index")

    anchors = rarest.select("term", "item_key", "q").distinct()
    aligned = (
        index.join(hint(anchors), "term")
        .groupBy("key", "item_key", (F.col("p") - F.col("q")).alias("delta"))
        .agg(F.collect_set("q").alias("qs"))
    )
    wanted = rarest.groupBy("item_key", "s").agg(F.collect_list("q").alias("need"))
    wanted = wanted.groupBy("item_key").agg(F.collect_list(F.struct("s", "need")).alias("windows"))
    met = (
        aligned.join(hint(wanted), "item_key")
        .withColumn("met", F.expr("filter(windows, x -> size(array_except(x.need, qs)) = 0)"))
        .where("size(met) > 0")
        .select("key", "item_key", "delta", F.explode("met.s").alias("s"))
    )
    phrase = starts.select("item", "item_key", "s", "width", F.expr("slice(iw, s + 1, width)").alias("phrase"))
    candidates = (
        met.join(hint(phrase), ["item_key", "s"])
        .where("delta + s >= 0")
        .groupBy("key")
        .agg(F.collect_set(F.struct("item", (F.col("delta") + F.col("s")).alias("at"), "width", "phrase")).alias("c"))
    )
    # Stored, so that the join has a shuffle of its own and a text with many copies is split.
    candidates = stored(candidates, "phrase-candidates")
    # n_words and the comparison both use the words, so they are split once per text.
    found = texts.withColumn("key", F.md5("t")).join(candidates, "key", "left").select("doc", "c", words(F.col("t")).alias("w"))
    found = found.select(
        "doc",
        F.size("w").cast("long").alias("n_words"),
        F.expr("coalesce(c, array())").alias("c"),
        F.expr("filter(coalesce(c, array()), x -> slice(w, x.at + 1, x.width) = x.phrase)").alias("exact"),
    )
    return found.select(
        "doc",
        "n_words",
        F.expr(
            "cast(size(array_distinct(flatten(transform(exact, x -> sequence(x.at, x.at + x.width - 1))))) as long)"
        ).alias("n_hit"),
        F.expr("sort_array(array_distinct(exact.item))").alias("items"),
        F.expr("sort_array(array_except(c.item, exact.item))").alias("near_items"),
    )


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: hit words, items found, and whether at least 1/20 of the words are hit."""
    return find_phrases(docs.select("doc_id", "text"), benchmark).select(
        "doc.doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    return find_phrases(docs, benchmark).where(f"not ({CONTAMINATED})").select("doc.*")
