"""How the sources of a language differ in their words: exact divergences by cube partitioning."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.llm.common import forget, settle

MIN_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Expected sources in a group block and terms in a term block: a cell holds two group blocks of one term block.
GROUP_BLOCK, TERM_BLOCK = 64, 8192
#: Terms that a counting task holds before it passes them on, and bytes of a text that are cut into words at once.
HELD_TERMS, STRETCH = 300_000, 1 << 20

#: Byte by byte: A-Z lower-cased, a-z and bytes of characters from U+0080 on kept, anything else a blank.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def stretches(text: bytes, size: int = STRETCH) -> Iterator[list[bytes]]:
    """The terms of a text, some of them at a time. No term is cut."""
    plain = text.translate(TERM_BYTES)
    begin = 0
    while begin < len(plain):
        end = plain.find(b" ", begin + size)
        end = len(plain) if end < 0 else end
        yield plain[begin:end].split()
        begin = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the task's rows by language, source and term; a row without a term stands for the group itself."""

    def rows() -> pa.RecordBatch:
        out = []
        for (lang, source), (total, docs) in found.items():
            out.append((lang, source, None, 0, 0))
            out += [(lang, source, term, n, docs[term]) for term, n in total.items()]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["lang", "source", "term", "n", "docs"])

    found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            total, docs = found.setdefault((lang, source), (Counter(), Counter()))
            before, of_text = len(total), set()
            for terms in stretches(text):
                total.update(terms)
                of_text.update(terms)
            docs.update(of_text)
            held += len(total) - before
            if held >= HELD_TERMS:
                yield rows()
                found, held = {}, 0
    if found:
        yield rows()


def _share(count: str, total: str) -> Column:
    """Smoothed share in billionths, in whole numbers. NULL for a language without kept terms."""
    return F.expr(f"1 + ({SCALE}BD * ({count} + {SMOOTHING})) div nullif({total} + {SMOOTHING} * terms, 0)")


def _cell(table: pa.Table) -> pa.Table:
    """Partial divergences of a cell: sources of group block ``i`` against those of ``j``, over one term block."""
    table = table.sort_by("source")
    i, j, width = table["i"][0].as_py(), table["j"][0].as_py(), table["width"][0].as_py()
    lists = table["entries"].combine_chunks()
    flat = lists.flatten()
    row = np.repeat(np.arange(len(table)), np.diff(np.asarray(lists.offsets)))
    place, p = np.asarray(flat.field("place")), np.asarray(flat.field("p"))
    shares = np.repeat(table["rest"].to_numpy()[:, None], width, 1)
    shares[row, place] = p
    block = table["block"].to_numpy()
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    names = table["source"].to_pylist()
    a, b, value = [], [], []
    for k, x in enumerate(left.tolist()):
        others = right[k + 1 :] if i == j else right
        a += [names[x]] * len(others)
        b += [names[y] for y in others.tolist()]
        value.append(np.abs(shares[others] - shares[x]).sum(1))
    sums = np.concatenate([*value, np.empty(0, np.int64)]).astype(np.int64)
    lang = pa.array([table["lang"][0].as_py()] * len(a), pa.string())
    return pa.table([lang, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(sums)], ["lang", "a", "b", "value"])


def shares(df: DataFrame, text_col: str, lang_col: str, source_col: str, min_documents: int, term_block: int, group_block: int) -> tuple[DataFrame, DataFrame]:
    """``(groups, entries)``, both settled. ``groups``: every (lang, source) with its ``block``, the number of group and
    term blocks and terms of its language, and ``rest``, the share of a term it lacks. ``entries``: every kept term that a
    group has, with its share ``p``, the language's share ``q`` and its place in a term block."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).cast("binary").alias("text"))
    counted = rows.mapInArrow(_counted, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    counts = settle(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    by_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    kept = settle(by_term.where(F.col("docs") >= min_documents).select("lang", "term", "total"))
    sources = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("sources"))
    vocabulary = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    langs = sources.join(vocabulary, "lang", "left").select("lang", "sources", zero("terms"), zero("lang_total"))
    langs = settle(langs.withColumns({"group_blocks": F.ceil(F.col("sources") / group_block), "term_blocks": F.greatest(F.ceil(F.col("terms") / term_block), F.lit(1))}))
    placed = kept.join(langs, "lang").withColumn("term_block", F.pmod(F.xxhash64("term"), F.col("term_blocks")))
    in_block = Window.partitionBy("lang", "term_block").orderBy("term")
    placed = placed.select("lang", "term", "term_block", (F.row_number().over(in_block) - 1).alias("place"), _share("total", "lang_total").alias("q"))
    found = settle(counts.where("term is not null").drop("docs").join(placed, ["lang", "term"]))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    known = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang")
    known = known.withColumns({"group_total": F.coalesce("group_total", F.lit(0).cast("long")), "block": F.pmod(F.xxhash64("source"), F.col("group_blocks"))})
    groups = settle(known.select("lang", "source", "block", "group_blocks", "term_blocks", "terms", "group_total", F.coalesce(_share("0L", "group_total"), F.lit(0)).cast("long").alias("rest")))
    entries = found.join(groups.select("lang", "source", "terms", "group_total"), ["lang", "source"])
    entries = settle(entries.select("lang", "source", "term", "term_block", "place", _share("n", "group_total").alias("p"), "q"))
    forget(counts, kept, langs, found)
    return groups, entries


def pair_divergences(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """``lang, a, b, value`` of every two sources of a language, once: the sum over all kept terms of ``abs(p - q)``.

    A slice is a source's shares in one term block. It goes to every cell (group block, group block, term block) that
    needs it, as often as the language has group blocks; cells own their sums, which add up along the terms."""
    widths = entries.groupBy("lang", "term_block").agg(F.max("place").alias("last"))
    blocks = groups.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block"))
    # The widest place seen: kept terms are by definition in some group, so every place of a block shows up.
    blocks = blocks.join(widths, ["lang", "term_block"], "left").withColumn("width", F.coalesce(F.col("last") + 1, F.lit(0)).cast("long"))
    packed = entries.groupBy("lang", "source", "term_block").agg(F.collect_list(F.struct("place", "p")).alias("entries"))
    none = F.array().cast("array<struct<place:int,p:bigint>>")
    slices = blocks.join(packed, ["lang", "source", "term_block"], "left").withColumn("entries", F.coalesce("entries", none))
    cells = F.expr("explode(transform(sequence(0L, group_blocks - 1), o -> struct(least(block, o) as i, greatest(block, o) as j)))")
    dealt = slices.select("lang", "source", "block", "term_block", "rest", "width", "entries", cells.alias("cell")).select("*", "cell.i", "cell.j").drop("cell")
    partial = dealt.groupBy("lang", "i", "j", "term_block").applyInArrow(_cell, "lang string, a string, b string, value long")
    return partial.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_documents: int = MIN_DOCUMENTS,
    top_terms: int = TOP_TERMS,
    group_block: int = GROUP_BLOCK,
    term_block: int = TERM_BLOCK,
) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every group (language, source).

    Terms are runs of ASCII letters and characters from U+0080 on, only A-Z lower-cased; a language keeps those in at least
    ``min_documents`` of its documents. Part ``pair``: each other source of the language with the sum over all kept
    terms of the difference of their smoothed shares. Part ``term``: the ``top_terms`` kept terms that the source has and uses
    more than its language does. All numbers are whole, in billionths; ties go by the item's bytes.

    Null texts, languages and sources count as ''. A group without terms has pairs but no terms; a language without kept
    terms has pairs of value 0; a language's only source has no pairs. Repeated rows count each time; texts of any
    length are cut in stretches; an empty table gives no rows; other columns of ``df`` are not looked at.
    """
    groups, entries = shares(df, text_col, lang_col, source_col, min_documents, term_block, group_block)
    sums = pair_divergences(groups, entries)
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = sums.select("lang", both.alias("pair"), "value").select("lang", "pair.source", F.lit("pair").alias("part"), "pair.item", "value")
    terms = entries.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))).cast("int")
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top_terms))
