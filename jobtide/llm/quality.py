"""Quality rules with thresholds that follow each language and source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import settle, words

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Fence:
    """Upper bound ``median + times * max(median - lower decile, floor)`` of a measure in its group."""

    measure: str
    times: float
    floor: float


#: The bounds follow the lower half of a group, so they hold while fewer than half of its documents are junk.
FENCES = (
    Fence("symbol_share", 4.0, 0.015),
    Fence("upper_share", 6.0, 0.05),
    Fence("dup_line_share", 4.0, 0.125),
    Fence("mean_word", 8.0, 1.0),
)
#: Groups with fewer documents take the bounds of their language, then those of the whole table.
MIN_GROUP = 100
ACCURACY = 10_000


def cheap_measures(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` plus the counts that one look at each character gives, and the four shares."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    # Symbols and capitals alone, so that two counts need one look at the text.
    marks = F.regexp_replace(text, r"[^#*$%&|<>\p{Lu}]+", "")
    counted = df.withColumns({"_words": words(F.col(text_col)), "_lines": lines, "_marks": marks}).withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.char_length(F.regexp_replace("_marks", r"\p{Lu}+", "")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        }
    )
    counted = counted.withColumn("_upper", F.char_length("_marks") - F.col("n_symbols"))
    chars = F.greatest("word_chars", F.lit(1))
    return counted.withColumns(
        {
            "symbol_share": F.col("n_symbols") / chars,
            "upper_share": F.col("_upper") / chars,
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
            "mean_word": F.col("word_chars") / F.greatest("n_words", F.lit(1)),
        }
    ).drop("_lines", "_marks", "_upper")


def repeat_words(df: DataFrame) -> DataFrame:
    """``df`` plus ``n_repeat_words``: words inside windows of five that occur twice or more in the text.

    Each window is a hash; only texts whose windows are not all distinct look for the places. There, windows are
    sorted by hash, those with an equal neighbour mark their place, and each place adds the words up to the next one.
    """
    pairs = "zip_with(slice({0}, 1, n_words - {2}), slice({1}, {3}, n_words - {2}), (a, b) -> xxhash64(a, b))"
    many = F.col("n_words") >= WINDOW
    first = df.withColumn("_h1", F.when(many, F.expr("transform(_words, w -> xxhash64(w))")))
    first = first.withColumn("_h2", F.when(many, F.expr(pairs.format("_h1", "_h1", 1, 2))))
    first = first.withColumn("_h4", F.when(many, F.expr(pairs.format("_h2", "_h2", 3, 3))))
    first = first.withColumn("_windows", F.when(many, F.expr(pairs.format("_h4", "_h1", 4, 5))))
    ordered = F.expr("array_sort(transform(_windows, (h, i) -> struct(h, i)))")
    first = first.withColumn("_ordered", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), ordered))
    again = F.expr("filter(_ordered, (w, k) -> w.h = get(_ordered, k - 1).h or w.h = get(_ordered, k + 1).h)")
    placed = first.withColumn("_again", again).withColumn("_places", F.expr("array_sort(transform(_again, w -> w.i))"))
    added = F.expr(f"aggregate(transform(_places, (p, k) -> least({WINDOW}, coalesce(get(_places, k + 1), p + {WINDOW}) - p)), 0L, (a, x) -> a + x)")
    return placed.withColumn("n_repeat_words", F.coalesce(added, F.lit(0).cast("long"))).drop("_h1", "_h2", "_h4", "_windows", "_ordered", "_again", "_places")


def thresholds(measured: DataFrame) -> DataFrame:
    """``_l``, ``_s`` and an upper bound per measure from rows that have both and the measures: quantile sketches of
    every document, merged per language and source; small groups take those of their language or of all.
    Documents without words do not count."""
    sketches = [F.percentile_approx(f.measure, F.array(F.lit(0.1), F.lit(0.5)), ACCURACY).alias(f.measure) for f in FENCES]
    rows = measured.where("n_words > 0").select("_l", "_s", *[f.measure for f in FENCES])
    levels = settle(rows.rollup("_l", "_s").agg(F.grouping_id().alias("_level"), F.count("*").alias("_n"), *sketches))

    def bounds(level: int, mark: str) -> DataFrame:
        found = []
        for f in FENCES:
            q = F.col(f.measure)
            found.append((q[1] + f.times * F.greatest(q[1] - q[0], F.lit(f.floor))).alias(f"{mark}_{f.measure}"))
        return levels.where(F.col("_level") == level).select("_l", "_s", F.col("_n").alias(f"{mark}_n"), *found)

    own, lang = bounds(0, "own"), bounds(1, "lang").drop("_s").withColumnRenamed("_l", "_of")
    whole = bounds(3, "all").drop("_l", "_s").limit(1)
    joined = own.join(lang, own["_l"].eqNullSafe(lang["_of"]), "left").join(F.broadcast(whole), how="left")
    chosen = [
        F.when(F.col("own_n") >= MIN_GROUP, F.col(f"own_{f.measure}"))
        .when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{f.measure}"))
        .otherwise(F.col(f"all_{f.measure}"))
        .alias(f"_max_{f.measure}")
        for f in FENCES
    ]
    return joined.select("_l", "_s", *chosen)


def assess(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) plus ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 10 words, or more than a fifth of them inside repeated windows. ``kept`` is false for
    those and for documents above a bound of their language and source. Each text is measured once; rows and
    measures are settled, fill the sketches, and then meet the bounds, a table whose written size tells Spark how to join.

    Null or blank texts have no words, fail and are not kept. Null languages and sources are groups of their own.
    Repeated rows count each time; ties at a bound are kept; an empty table gives no rows; columns of ``df``
    with the names of the added ones are replaced.
    """
    added = (*COUNTS, "base_failed", "kept")
    row = F.struct(*[c for c in (df.columns if columns is None else columns) if c not in added])
    rows = df.select(row.alias("_row"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_l"), F.col(source_col).alias("_s"))
    measured = settle(repeat_words(cheap_measures(rows, "_text").drop("_text")).drop("_words"))
    limits = settle(thresholds(measured)).withColumnsRenamed({"_l": "_lang", "_s": "_source"})
    judged = measured.join(limits, measured["_l"].eqNullSafe(limits["_lang"]) & measured["_s"].eqNullSafe(limits["_source"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    inside = F.lit(True)
    for f in FENCES:
        inside = inside & (F.col(f.measure) <= F.coalesce(f"_max_{f.measure}", F.lit(float("inf"))))
    return judged.select("_row.*", *COUNTS, failed.alias("base_failed"), (~failed & inside).alias("kept"))


def keep_good(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of ``df`` that ``assess`` keeps, columns unchanged whatever they are called. Null and blank texts go, as they
    have no words; null languages and sources are groups of their own; repeated rows stay or go together; an empty table
    gives no rows."""
    row = df.select(F.struct("*").alias("_all"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    return assess(row, columns=["_all"]).where("kept").select("_all.*")
