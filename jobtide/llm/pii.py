"""Personal data: fixed patterns, and bootstrapped contexts that find identifiers the patterns miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import settle

KINDS = ("email", "ip", "card", "phone")

#: The base patterns, written so that the engine neither recurses nor tries a run of characters again from
#: its inside: a match begins where such a run begins or where the match before it ended. Fixed values.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that every text with a match passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}

_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"

#: Bootstrapping: rounds, least confidence and least number of different seed identifiers of a usable context,
#: least digits of an identifier that the fixed patterns miss, and words of context.
ROUNDS, MIN_CONFIDENCE, MIN_SEEDS, MIN_DIGITS = 3, 0.85, 5, 6

#: What may be an identifier: a run without white space that holds a digit, an at sign or a mark between letters. Runs count from their beginning.
_LETTER = r"\p{L}\p{M}'’"
_MARKED = rf"[^\s{_LETTER}]*+[{_LETTER}]++[^\s{_LETTER}]++[{_LETTER}]"
MENTION = rf"(?:\G|(?<![^\s]))(?:[^\s0-9]*+[0-9]|[^\s@]*+@|{_MARKED})[^\s]*+"
_MAY = rf"[0-9@]|[{_LETTER}][^\s{_LETTER}]++[{_LETTER}]"
#: Runs that may be parts of one number, what may lie between them, and the most digits of a number.
_PART, _GAP, MAX_DIGITS = r"^[0-9()\[\]+./\x20\t\xA0-]*[0-9)\]][^0-9A-Za-z]*$", r"^[\x20\t\xA0()\[\]]+$", 19
_SPAN = "array<struct<kind:int,start:int,end:int>>"


def matches(text: Column, pattern: str, hint: str, valid=lambda found: F.lit(True)) -> Column:
    """Array of ``(start, end, found, before, gap)`` of the valid matches, in code points; ``before`` is the end of the text
    before the match, other matches included, ``gap`` what lies between the match before and this one (null if that is long).
    Other matches only move the place, so long lists of them cost nothing."""
    kind = "array<struct<start:int,end:int,found:string,before:string,gap:string>>"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(found.alias("found"), F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)).alias("before"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(kind).alias("all"))

    def step(acc: Column, p: Column) -> Column:
        tail = F.right(F.concat(acc["tail"], p["before"]), F.lit(80))
        gap = F.when(F.char_length(p["before"]) <= 8, p["before"])
        begin = acc["at"] + F.char_length(p["before"])
        end = begin + F.char_length(p["found"])
        one = F.struct(begin.alias("start"), end.alias("end"), p["found"].alias("found"), tail.alias("before"), gap.alias("gap"))
        return F.struct(end.alias("at"), F.right(F.concat(tail, p["found"]), F.lit(80)).alias("tail"), F.when(valid(p["found"]), F.concat(acc["all"], F.array(one))).otherwise(acc["all"]).alias("all"))

    return F.when(text.rlike(hint), F.aggregate(pairs, start, step, lambda acc: acc["all"])).otherwise(F.array().cast(kind))


def _valid(kind: str):
    """What a match of a base pattern must also satisfy."""
    digits = lambda m: F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        return lambda m: m.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$")
    if kind == "card":
        return lambda m: F.char_length(digits(m)).between(13, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return lambda m: F.char_length(digits(m)).between(9, 15)
    return lambda m: F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of ``(kind, start, end, found)`` of the fixed patterns, by kind as listed, then by start."""
    def of(i: int, kind: str) -> Column:
        found = matches(text, PATTERNS[kind], HINTS[kind], _valid(kind))
        return F.transform(found, lambda m: F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), m["found"].alias("found")))

    return F.concat(*[of(i, k) for i, k in enumerate(KINDS)])


def _digits(text) -> Column:
    return F.char_length(F.regexp_replace(text, "[^0-9]", ""))


def _numbers(runs: Column) -> Column:
    """Runs with neighbouring parts of one number, joined by blanks or brackets, put together."""
    kind = "array<struct<start:int,end:int,found:string,before:string,gap:string>>"
    none = F.struct(F.lit(None).cast("struct<start:int,end:int,found:string,before:string,gap:string>").alias("last"), F.array().cast(kind).alias("all"))

    def step(acc: Column, m: Column) -> Column:
        last = acc["last"]
        # The gap reaches back to the run before, which may be one that is left out.
        near = (m["start"] - F.char_length(m["gap"]) == last["end"]) & m["gap"].rlike(_GAP)
        parts = m["found"].rlike(_PART) & last["found"].rlike(_PART) & last["found"].rlike(r"[0-9)\]]$")
        joins = F.coalesce(near & parts & (_digits(last["found"]) + _digits(m["found"]) <= MAX_DIGITS), F.lit(False))
        both = F.struct(last["start"].alias("start"), m["end"].alias("end"), F.concat(last["found"], m["gap"], m["found"]).alias("found"), last["before"].alias("before"), last["gap"].alias("gap"))
        done = F.when(joins | last.isNull(), acc["all"]).otherwise(F.concat(acc["all"], F.array(last)))
        return F.struct(F.when(joins, both).otherwise(m).alias("last"), done.alias("all"))

    return F.aggregate(runs, none, step, lambda acc: F.when(acc["last"].isNull(), acc["all"]).otherwise(F.concat(acc["all"], F.array(acc["last"]))))


def mentions(df: DataFrame) -> DataFrame:
    """One row per base span and per other possible identifier of each different text: ``_key``, ``start``, ``end``, ``kind`` (null
    unless a base span), ``instance`` and its ``contexts``, the one and the two words before the run it begins in. Runs that
    touch a base span are no other identifiers."""
    one = lambda kind, m, s, e, found: F.struct(kind.cast("int").alias("kind"), s.alias("start"), e.alias("end"), found.alias("found"), m["before"].alias("before"))
    begun = lambda m: F.filter("_base", lambda b: (b["start"] >= m["start"]) & (b["start"] < m["end"]))
    seeds = F.flatten(F.transform("_mentions", lambda m: F.transform(begun(m), lambda b: one(b["kind"], m, b["start"], b["end"], b["found"]))))
    free = F.filter("_mentions", lambda m: ~F.exists("_base", lambda b: (b["start"] < m["end"]) & (b["end"] > m["start"])))
    whole = lambda ms: F.transform(ms, lambda m: one(F.lit(None), m, m["start"], m["end"], m["found"]))
    # A later part may be a number by itself, behind a context that holds a number; the first has the context of the whole.
    later = lambda m: m["found"].rlike(_PART) & m["gap"].rlike(_GAP) & (_digits(m["found"]) >= MIN_DIGITS)
    rows = df.where(F.size("_mentions") > 0).select("_key", "_mentions", seeds.alias("seeds"), free.alias("free"))
    rows = rows.select("_key", F.explode(F.concat("seeds", whole(_numbers(F.col("free"))), whole(F.filter("free", later)))).alias("m"))
    before = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.col("m.before")), "[0-9]", "0"), r"\s+", " "), r"[\s(\[]+$", "")
    contexts = F.array(F.regexp_extract(before, r"([^\s]+)\s*$", 1), F.regexp_extract(before, r"([^\s]+\s+[^\s]+)\s*$", 1))
    rows = rows.select("_key", "m.start", "m.end", "m.kind", F.col("m.found").alias("instance"), contexts.alias("contexts"))
    return rows.dropDuplicates(["_key", "start", "end", "kind"])


def plain_followers(texts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``context`` and ``plain``: how many different words that are no possible identifier come behind each of ``contexts``."""
    words = F.split(F.regexp_replace(F.coalesce("_text", F.lit("")), r"^\s+|\s+$", ""), r"\s+")
    rows = texts.select(words.alias("w")).where(F.size("w") > 1)
    behind = F.arrays_zip(F.slice("w", F.lit(2), F.size("w")).alias("word"), F.col("w").alias("one"), F.concat(F.array(F.lit("")), F.col("w")).alias("two"))
    rows = rows.select(F.explode(behind).alias("p"))
    rows = rows.where("p.word is not null").where(~F.col("p.word").rlike(MENTION))
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    two = F.when(F.col("p.two") != "", F.concat_ws(" ", plain(F.col("p.two")), plain(F.col("p.one"))))
    rows = rows.select(F.col("p.word").alias("word"), F.explode(F.array(plain(F.col("p.one")), two)).alias("context"))
    return rows.join(contexts.select("context").distinct(), "context").distinct().groupBy("context").agg(F.count("*").alias("plain"))


def bootstrap(found: DataFrame, texts: DataFrame, rounds: int = ROUNDS, min_confidence: float = MIN_CONFIDENCE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """Identifiers that only their context gives away: ``_key``, ``kind``, ``start``, ``end``.

    Contexts and instances form a graph. Base spans are certain instances. In each round a context's confidence in a
    kind is the summed certainty of its different instances over their number, one doubt added; contexts with enough
    certain instances pass their confidence on to instances of unknown kind, which take the best one. Only instances with a digit (and base spans)
    count so. Marked words may be e-mail addresses only; for them all different words behind the context of ``texts`` (``_text``) count.
    """
    digit = F.col("instance").rlike("[0-9]")
    edges = found.select("kind", "instance", F.explode("contexts").alias("context")).where("context != ''").groupBy("context", "instance").agg(F.max("kind").alias("kind"))
    edges = settle(edges.withColumn("digit", digit | F.col("kind").isNotNull()))
    sizes = edges.groupBy("context").agg((F.count_if("digit") + 1).alias("size"), (F.count("*") + 1).alias("size_all"))
    seeds = edges.where("kind is not null").select("context", "instance", "kind", "digit", F.lit(1.0).alias("certainty"))
    known, usable, plain = seeds, None, None
    for _ in range(rounds):
        sure = F.sum(F.when(F.col("certainty") >= min_confidence, 1))
        scored = known.groupBy("context", "kind").agg(F.sum(F.when(F.col("digit"), F.col("certainty")).otherwise(0.0)).alias("sum"), F.sum("certainty").alias("sum_all"), sure.alias("sure"))
        scored = scored.where(F.col("sure") >= min_seeds).join(sizes, "context")
        scored = settle(scored.select("context", "kind", (F.col("sum") / F.col("size")).alias("certainty"), "sum_all", "size_all"))
        mail = scored.where((F.col("kind") == KINDS.index("email")) & (F.col("sum_all") / F.col("size_all") >= min_confidence))
        new = mail if plain is None else mail.join(plain, "context", "left_anti")
        if not new.isEmpty():
            counts = new.select("context").join(plain_followers(texts, new), "context", "left").na.fill(0, ["plain"])
            plain = settle(counts if plain is None else plain.unionByName(counts))
        of_digits = scored.where(F.col("certainty") >= min_confidence).select("context", "kind", "certainty", F.lit(True).alias("digit"))
        usable = of_digits
        if plain is not None:
            mail = mail.join(plain, "context").select("context", "kind", (F.col("sum_all") / (F.col("size_all") + F.col("plain"))).alias("certainty"), F.lit(False).alias("digit"))
            usable = of_digits.unionByName(mail.where(F.col("certainty") >= min_confidence))
        usable = settle(usable)
        taught = edges.where("kind is null").drop("kind").join(usable, ["context", "digit"]).groupBy("instance", "kind").agg(F.max("certainty").alias("certainty"))
        known = seeds.unionByName(edges.where("kind is null").select("context", "instance", "digit").join(taught, "instance").select(*seeds.columns))
    enough = _digits("instance") >= MIN_DIGITS
    candidates = found.where("kind is null").drop("kind").where(enough | F.col("instance").rlike(rf"^{_MARKED}")).withColumn("digit", F.explode(F.array_compact(F.array(F.when(enough, True), F.when(F.col("instance").rlike(rf"^{_MARKED}"), False)))))
    best = candidates.select("*", F.explode("contexts").alias("context")).join(usable, ["context", "digit"]).groupBy("_key", "start", "end", "instance")
    best = best.agg(F.max_by("kind", F.struct("certainty", -F.col("kind"))).alias("kind"))
    lead = F.char_length("instance") - F.char_length(F.regexp_replace("instance", r"^(?:[^0-9A-Za-z+@(]*+(?=\([0-9]+\)[^0-9A-Za-z]*[0-9])|[^0-9A-Za-z+@]+)", ""))
    tail = F.char_length("instance") - F.char_length(F.regexp_replace("instance", r"[^0-9A-Za-z]+$", ""))
    return best.select("_key", "kind", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"))


def find_spans(df: DataFrame, text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``df`` (all by default) plus ``base`` and ``spans``, arrays of ``(kind, start, end)``: kinds by their place in
    ``KINDS``, code points, end exclusive, by kind and then start. ``spans`` adds what the contexts give away.

    Each text is searched once and the result settled; words behind e-mail contexts are counted in a pass of their own. Null or empty texts have no spans. Equal texts count once
    as evidence and get the same spans; repeated rows keep their rows. An empty table gives no rows; columns of
    ``df`` named ``base`` or ``spans`` are replaced.
    """
    row = F.struct(*[c for c in (df.columns if columns is None else columns) if c not in ("base", "spans")])
    text = F.coalesce(F.col("_text"), F.lit(""))
    rows = df.select(row.alias("_row"), F.col(text_col).alias("_text"))
    rows = rows.select("_row", "_text", base_spans(text).alias("_base"), matches(text, MENTION, _MAY).alias("_mentions"))
    # Texts without a mention share no key, so they do not meet in one task.
    key = F.when(F.size("_mentions") > 0, F.sha2(F.col("_text"), 256)).otherwise(F.concat(F.lit("none "), F.pmod(F.xxhash64("_text", "_row"), F.lit(4096))))
    rows = settle(rows.select("_row", "_base", "_mentions", key.alias("_key")))
    more = bootstrap(settle(mentions(rows)), df.select(F.col(text_col).alias("_text"))).groupBy("_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    wider = lambda s: F.exists("_more", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"]))
    more = more.withColumn("_more", F.filter("_more", lambda s: ~wider(s)))
    joined = rows.select("_row", "_base", "_key").join(settle(more), "_key", "left")
    base = F.transform("_base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    joined = joined.withColumn("_spans", base)
    spans = F.array_sort(F.concat("_spans", F.coalesce("_more", F.array().cast(_SPAN))))
    return joined.select("_row.*", F.col("_spans").alias("base"), spans.alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its text replaced by its kind in brackets; overlapping spans give the name of the first.
    Columns keep their names and order, whatever they are called; null and empty texts stay as they are, texts of any length are
    searched whole, repeated rows change alike, and an empty table gives no rows."""
    row = df.select(F.struct("*").alias("_all"), F.col(text_col).alias("_body"))
    body = F.col(f"_all.{text_col}")
    found = find_spans(row, "_body", columns=["_all"]).withColumn("_sorted", F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        plain = F.substring(body, acc["at"] + 1, s["start"] - acc["at"])
        label = F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))
        inside = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] < acc["at"], inside).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(plain, label)).alias("out")))

    last = F.aggregate("_sorted", first, step)
    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(body, acc["at"] + 1, F.char_length(body)))
    done = found.withColumn("_last", last)
    text = F.when(F.size("spans") == 0, body).otherwise(rest(F.col("_last")))
    return done.select(*[(text if c == text_col else F.col(f"_all.{c}")).alias(c) for c in df.columns])


def span_counts(spans: Column) -> list[Column]:
    """``n_email``, ``n_ip``, ``n_card``, ``n_phone``."""
    of = lambda i: F.size(F.filter(spans, lambda s: s["kind"] == i)).cast("long")
    return [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
