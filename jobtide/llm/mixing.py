"""Mixing sources to target weights: whole copies of documents by pivotal dependent rounding."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from jobtide.llm.common import SPACES, forget, settle

#: Weights of the sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: No source gives more than this many times its words.
MAX_TIMES = 3
#: Documents, or leftovers of nodes, that meet in a node of the reduction tree.
FAN_IN = 64
SEED = 12
#: Rows of one fold that come out of one array.
_UNFOLD = 4096
_BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    """Number of words: a blank is put in place of each white space run, one in front, and blanks before a word count."""
    runs = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SPACES, " ")
    trimmed = F.rtrim(runs)
    return (F.char_length(trimmed) - F.char_length(F.replace(trimmed, F.lit(" "), F.lit("")))).cast("long")


def ranked_sources(sources: DataFrame) -> DataFrame:
    """``sources`` plus ``rank``: its place from 0 by code points, null last. Ranges are numbered apart and moved by
    the counts of the ranges before, so no task sees more than its range."""
    dealt = settle(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select("_range", F.coalesce(before, F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.asc_nulls_last("source"))) - 1
    return dealt.join(first, "_range").withColumn("rank", F.col("_first") + inside).drop("_range", "_first")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_times: int = MAX_TIMES) -> DataFrame:
    """``source, n, source_size, target`` from ``source, n, source_size``, settled.

    All words are shared by weight. Sources whose share exceeds ``max_times`` their size stop there; what is left is
    shared among the others, round by round, until nobody exceeds it. Sums are exact and only they reach the driver."""
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    state = settle(ranked_sources(sizes).withColumn("weight", weight.cast("long")))
    most = F.col("source_size").cast(_BIG) * max_times
    total = state.agg(F.sum(F.col("source_size").cast(_BIG))).first()[0] or Decimal(0)
    # A source is full once most / weight lies below the level of the round; levels only rise.
    level: tuple[Decimal, Decimal] | None = None
    full = F.lit(False)
    while True:
        sums = state.agg(F.sum(F.when(full, most).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight").cast(_BIG)))).first()
        new = (total - (sums[0] or 0), sums[1] or Decimal(0))
        if new == level or not new[1]:
            break
        level = new
        full = most * F.lit(level[1]).cast(_BIG) < F.col("weight").cast(_BIG) * F.lit(level[0]).cast(_BIG)
    share = F.col("weight") * F.lit(float(level[0] / level[1]) if level else 0.0)
    done = settle(state.select("source", "n", "source_size", F.when(full, most.cast("double")).otherwise(share).alias("target")))
    forget(state)
    return done


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1 that only depends on its parts and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *parts), 11) / F.lit(float(1 << 53))


def _pivot(state: Column, nxt: Column) -> Column:
    """One step: words move between the carried document and the next until one of them is taken whole or not at all.
    The chance of each direction keeps every document's expected words."""
    held = state["held"]
    up = F.least(held["size"] - held["mass"], nxt["mass"])
    down = F.least(held["mass"], nxt["size"] - nxt["mass"])
    rises = _uniform(held["key"], nxt["key"]) * (up + down) < down
    held_full = held["size"] - held["mass"] <= nxt["mass"]
    held_empty = held["mass"] <= nxt["size"] - nxt["mass"]
    item = lambda of, mass: F.struct(of["size"].alias("size"), of["key"].alias("key"), mass.alias("mass"))
    out = lambda of, take: F.struct(of["size"].alias("size"), of["key"].alias("key"), F.lit(take).alias("take"))
    # Rising, the carried one is filled or the next one is emptied; falling, the other way round.
    settled = F.when(rises & held_full, out(held, 1)).when(rises, out(nxt, 0)).when(held_empty, out(held, 0)).otherwise(out(nxt, 1))
    kept = (
        F.when(rises & held_full, item(nxt, nxt["mass"] - (held["size"] - held["mass"])))
        .when(rises, item(held, held["mass"] + nxt["mass"]))
        .when(held_empty, item(nxt, nxt["mass"] + held["mass"]))
        .otherwise(item(held, held["mass"] - (nxt["size"] - nxt["mass"])))
    )
    first = held.isNull()
    return F.struct(
        F.when(first, item(nxt, nxt["mass"])).otherwise(kept).alias("held"),
        F.when(first, state["done"]).otherwise(F.concat(state["done"], F.array(settled))).alias("done"),
    )


def round_masses(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``source, key, size, take`` (0 or 1) for rows ``source, key, size, mass, nodes`` with ``0 < mass < size``. The sizes
    of a source's taken rows add up to its masses, but for the one row left at the top, which is rounded to the nearest.

    A reduction tree: rows fall into the ``nodes`` nodes of their source by a hash of the key; a node carries one row
    through the others, large ones first, so that what is left tends to be small, and hands it to the node above,
    ``fan_in`` to one. Each level is settled before the next. A node has about ``fan_in`` rows however large its source is."""
    kind = dict(rows.dtypes)["key"]
    entry = F.struct((-F.col("size")).alias("order"), F.xxhash64(F.lit(SEED), "key").alias("mix"), "key", "size", "mass")
    start = F.struct(
        F.lit(None).cast(f"struct<size:double,key:{kind},mass:double>").alias("held"),
        F.array().cast(f"array<struct<size:double,key:{kind},take:int>>").alias("done"),
    )
    node = F.pmod(F.xxhash64(F.lit(SEED + 1), "key"), F.col("nodes"))
    level = rows.select("source", "nodes", node.alias("node"), "key", F.col("size").cast("double"), F.col("mass").cast("double"))
    done = []
    while True:
        ends = level.groupBy("source", "nodes", "node").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
        ends = settle(ends.select("source", "nodes", "node", F.aggregate("entries", start, _pivot).alias("end")))
        done.append(ends.select("source", F.inline("end.done")).select("source", "key", "size", "take"))
        if (ends.agg(F.max("nodes")).first()[0] or 0) <= 1:
            nearest = F.when(F.col("mass") * 2 >= F.col("size"), 1).otherwise(0).alias("take")
            done.append(ends.select("source", "end.held.*").select("source", "key", "size", nearest))
            return reduce(DataFrame.unionByName, done)
        above = [F.ceil(F.col("nodes") / fan_in).alias("nodes"), F.floor(F.col("node") / fan_in).alias("node")]
        level = ends.select("source", *above, "end.held.*")


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    max_times: int = MAX_TIMES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``id_col, source, size, source_size, target, copies, taken``, one row per row of ``df``.

    ``size``: words of the text. The sources, in the order of their names, null last, weigh ``weights`` over and over and
    share the words of all; nobody gives more than ``max_times`` its words (``targets``). Each document is taken
    ``target / source_size`` times: the whole part for certain, the fraction by pivotal rounding (``round_masses``), so a
    source misses its target by half of one document at most. The choice follows from keys and a fixed seed alone.

    A null or blank text has size 0 and no copies. Rows that agree in id, source and text are folded and get
    their copies together, as evenly as whole numbers allow. Null ids are ids like
    others. Documents of any size, ties and sources without words are allowed; an empty table gives no rows; columns of
    ``df`` besides the three are not looked at.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("hash"))
    folded = settle(rows.groupBy("source", "id", "hash", "size").agg(F.count("*").alias("m")))
    of_source = F.sum(F.col("size") * F.col("m")).alias("source_size")
    sources = targets(folded.groupBy("source").agg(F.count("*").alias("n"), of_source), weights, max_times)
    known = sources.withColumnRenamed("source", "_source")
    planned = folded.join(known, folded["source"].eqNullSafe(known["_source"])).drop("_source")
    # Copies per row, all copies of the folded rows, and how much of one more they should have.
    times = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    planned = planned.withColumn("base", F.floor(times)).withColumn("more", F.col("m") * (times - F.col("base")))
    planned = planned.withColumn("extra", F.floor("more")).withColumn("mass", (F.col("more") - F.col("extra")) * F.col("size"))
    key = F.struct("id", "hash", "m", "base", "extra").alias("key")
    open_ = (F.col("mass") > 0) & (F.col("mass") < F.col("size"))
    rounded = round_masses(planned.where(open_).select("source", key, "size", "mass", F.ceil(F.col("n") / fan_in).alias("nodes")), fan_in)
    whole = planned.where(~open_).select("source", key, F.col("size").cast("double"), F.when(F.col("mass") > 0, 1).otherwise(0).alias("take"))
    taken = rounded.unionByName(whole).select("source", "key.*", F.col("size").cast("long").alias("size"), "take")
    # Folded rows come apart again, in two steps so that no array grows with their number.
    some = taken.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "m", F.lit(_UNFOLD).cast("long"))))
    each = some.withColumn("row", F.explode(F.sequence("from", F.least("m", F.col("from") + (_UNFOLD - 1)))))
    copies = F.col("base") + F.when(F.col("row") <= F.col("extra") + F.col("take"), 1).otherwise(0)
    each = each.withColumn("copies", copies)
    out = each.join(known, each["source"].eqNullSafe(known["_source"]))
    return out.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
