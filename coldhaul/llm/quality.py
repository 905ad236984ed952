"""Quality rules with thresholds taken from the data of each language and source.

Each document gets integer measures. Their distribution per (lang, source) is kept
as a mergeable quantile sketch: counts per bucket, where a bucket holds values that
agree in their six leading bits (relative error below 1/32). Sketches are merged by
adding counts, for a language and for the whole corpus, and a small group uses the
nearest larger one. A measure is rejected beyond a fence around the median; the
spread of one half of the distribution sets the fence on the other side, so that up
to half of a group may be junk without moving it. A measure that is 0 in most documents
has no spread; there a few occurrences in a document of the group's median size, read
from the sketch of sizes, take its place. No bound is a constant of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coldhaul.llm.common import WHITE_SPACE, stored, whole_text

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Fence:
    """Reject a measure farther than ``width`` spreads above (or below) the median.

    A spread is at least the relative error of the sketch. ``count`` more occurrences,
    each ``scale`` in a document of size 1, are always allowed at the median of ``size``.
    """

    measure: str
    size: str | None = None
    count: int = 0
    scale: int = 1000
    width: int = 6
    below: bool = False

    @property
    def name(self) -> str:
        return f"{'low' if self.below else 'high'}_{self.measure}"


FENCES = (
    Fence("symbol_permille", "word_chars", 20),
    Fence("dup_line_permille", "n_lines", 3),
    # A window found twice covers six words.
    Fence("repeat_permille", "n_words", 6 * 6),
    Fence("word_centi"),
    Fence("word_centi", below=True),
)
SIZES = [f.size for f in FENCES if f.size]
MEASURES = list(dict.fromkeys(f.measure for f in FENCES)) + SIZES
QUANTILES = {"q25": 25, "q50": 50, "q75": 75}
LEADING_BITS = 6


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and the counts of each document; a null text has no words.

    The stages below are separate selects so that each array is built once: an
    array that is used twice is not inlined into the expressions that use it.
    """
    kept = [F.col(c) for c in keep]
    text = whole_text(docs).alias("t")
    split = docs.select(*kept, text).select(*kept, "t", F.array_remove(F.split("t", WHITE_SPACE), "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        *kept,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.expr(
            "if(size(w) < 3, array(), transform(sequence(2, size(w) - 1), i -> xxhash64(w[i - 2], w[i - 1], w[i])))"
        ).alias("windows"),
    )
    totals = ["n_words", "word_chars", "n_symbols"]
    ordered = counted.select(
        *kept,
        *totals,
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(windows) > size(array_distinct(windows)),"
            " sort_array(transform(windows, (x, i) -> struct(x as h, i as i))), null)"
        ).alias("s"),
    )
    totals += ["n_lines", "n_dup_lines"]
    twice = ordered.select(
        *kept,
        *totals,
        F.expr(
            "sort_array(array_distinct(flatten(zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1),"
            " (a, b) -> if(a.h = b.h, array(a.i, b.i), array())))))"
        ).alias("twice"),
    )
    covered = F.expr(
        "coalesce(aggregate(twice, struct(-3 as last, 0L as n),"
        " (a, p) -> struct(p as last, a.n + least(3, p - a.last) as n), a -> a.n), 0L)"
    )
    return twice.select(*kept, *totals, covered.alias("n_repeat_words"))


def with_measures(rows: DataFrame) -> DataFrame:
    """Add the base rule and the measures the fences look at."""

    def share(part: str, whole: str, scale: int):
        return F.expr(f"if({whole} = 0, 0L, ({scale} * {part}) div {whole})")

    return rows.withColumns(
        {
            "base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"),
            "symbol_permille": share("n_symbols", "word_chars", 1000),
            "dup_line_permille": share("n_dup_lines", "n_lines", 1000),
            "repeat_permille": share("n_repeat_words", "n_words", 1000),
            "word_centi": share("word_chars", "n_words", 100),
        }
    )


def sketch(rows: DataFrame) -> DataFrame:
    """The mergeable sketches: (lang, source, measure, bucket, n) over documents that pass the base rule."""
    each = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = rows.where("not base_failed").selectExpr("lang", "source", f"stack({len(MEASURES)}, {each}) as (measure, v)")
    bits = f"greatest(0, length(bin(v)) - {LEADING_BITS})"
    bucket = F.expr(f"shiftleft(shiftright(v, {bits}), {bits})").alias("bucket")
    return long.groupBy("lang", "source", "measure", bucket).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Merge sketches to ``keys`` and read their quartiles; ``docs`` counts documents."""
    merged = sketches.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    reached = merged.withColumns(
        {"upto": F.sum("n").over(group.orderBy("bucket")), "docs": F.sum("n").over(group)}
    )
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("docs") * q, F.col("bucket"))).alias(name) for name, q in QUANTILES.items()]
    return reached.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), *at)


def fences(sketches: DataFrame, min_docs: int) -> DataFrame:
    """For each lang and source a row with ``low_*`` and ``high_*`` of the measures; null: no bound."""
    sketches = sketches.withColumn("corpus", F.lit(0))
    levels = [["lang", "source"], ["lang"], ["corpus"]]
    found = sketches.select("lang", "source", "corpus", "measure").distinct()
    for i, keys in enumerate(levels):
        q = quantiles(sketches, keys).where(F.col("docs") >= min_docs)
        names = [*keys, "measure"]
        q = q.select(*[F.col(c).alias(f"{c}_{i}") for c in names], F.struct(*QUANTILES).alias(f"level{i}"))
        on = [found[c].eqNullSafe(q[f"{c}_{i}"]) for c in names]
        condition = on[0]
        for part in on[1:]:
            condition = condition & part
        found = found.join(q, condition, "left").drop(*[f"{c}_{i}" for c in names])
    q = F.coalesce("level0", "level1", "level2")
    sketches_of = [F.max(F.when(F.col("measure") == m, q)).alias(m) for m in MEASURES]
    return found.groupBy("lang", "source").agg(*sketches_of).select("lang", "source", *[bound(f).alias(f.name) for f in FENCES])


def bound(f: Fence) -> Column:
    """The fence from the quartiles of the measure and of the sizes, in whole numbers."""
    q = f.measure
    spread = f"{q}.q75 - {q}.q50" if f.below else f"{q}.q50 - {q}.q25"
    steps = [f"{f.width} * ({spread})", f"({f.width} * {q}.q50) div {1 << (LEADING_BITS - 1)}"]
    if f.size:
        steps.append(f"{f.count * f.scale} div greatest(1, {f.size}.q50)")
    return F.expr(f"{q}.q50 {'-' if f.below else '+'} greatest({', '.join(steps)})")


def outside(f: Fence) -> Column:
    """Whether a document is beyond the fence; a missing bound rejects nothing."""
    beyond = F.col(f.measure) < F.col(f.name) if f.below else F.col(f.measure) > F.col(f.name)
    return F.coalesce(beyond, F.lit(False))


def judged(rows: DataFrame, min_docs: int) -> DataFrame:
    """Add ``kept`` and the names of the fences ``beyond`` which it lies to stored rows that have measures, lang and source.

    A group with fewer than ``min_docs`` documents takes the bounds of its language,
    then of the corpus; a smaller corpus has no bounds. Null lang or source is a
    value like any other.
    """
    # Stored, so that their size is known and the documents need not be shuffled to join them.
    bounds = stored(fences(sketch(rows), min_docs), "fences")
    bounds = bounds.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = rows.join(
        bounds, rows["lang"].eqNullSafe(bounds["of_lang"]) & rows["source"].eqNullSafe(bounds["of_source"]), "left"
    )
    beyond = F.array_compact(F.array(*[F.when(outside(f), F.lit(f.name)) for f in FENCES]))
    judged = joined.withColumn("beyond", beyond)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("beyond") == 0))


def fence_report(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """lang, source, fence, bound, documents that pass the base rule, and those of them beyond the fence.

    Null lang or source is a group like any other, an empty table has no rows.
    """
    rows = judged(stored(with_measures(measure(docs, ["lang", "source"])), "quality"), min_docs).where("not base_failed")
    each = ", ".join(f"'{f.name}', `{f.name}`" for f in FENCES)
    long = rows.selectExpr("lang", "source", "beyond", f"stack({len(FENCES)}, {each}) as (fence, bound)")
    hit = F.sum(F.expr("array_contains(beyond, fence)").cast("long"))
    return long.groupBy("lang", "source", "fence", "bound").agg(F.count("*").alias("documents"), hit.alias("beyond"))


def quality_rules(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """One row per document: counts, base rule and verdict.

    ``docs`` has doc_id, text, lang and source, other columns are ignored. Null and
    empty texts have no words and fail the base rule. Repeated rows are judged alike,
    an empty table gives no rows.
    """
    rows = stored(with_measures(measure(docs, ["doc_id", "lang", "source"])), "quality")
    return judged(rows, min_docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def kept_documents(docs: DataFrame, min_docs: int = 50) -> DataFrame:
    """The documents that pass, with the columns they came with; of an empty table none."""
    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text", "lang", "source"
    )
    rows = stored(with_measures(measure(whole, ["whole", "lang", "source"])), "quality")
    return judged(rows, min_docs).where("kept").select("whole.*")
