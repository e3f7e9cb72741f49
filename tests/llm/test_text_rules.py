"""Quality rules, personal data and toxicity against brute force."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from jobtide.llm import pii, quality, toxicity
from tests.llm.conftest import rows_by

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measured(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = collections.Counter(windows)
    covered = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 5)}
    lines = [s for s in text.split("\n") if WORD.search(s)]
    return len(words), sum(map(len, words)), sum(text.count(s) for s in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_and_base_rule(docs):
    rnd = random.Random(2)
    texts = [None, "", " \n\t ", "a", "one two three four five", "a b c d e a b c d e", "x\nx\n\nx y\nx y", "é\x85ü  b", "# $ | <> &*%", "w " * 5000]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    df = docs(texts).withColumnRenamed("n_chars", "kept").withColumn("n_words", F.lit("clash"))
    got = rows_by(quality.assess(df), "doc_id")
    for i, text in enumerate(texts):
        assert tuple(got[i][c] for c in quality.COUNTS) == measured(text), text
        n, repeated = measured(text)[0], measured(text)[4]
        assert got[i]["base_failed"] == (n < 10 or 100 * repeated > 20 * n)
        assert not (got[i]["base_failed"] and got[i]["kept"])


def test_bounds_follow_language_and_source(spark):
    clean = "the quick brown fox number {0} jumps over lazy dog {0} and rests a while {0}b"
    rows = [(i, clean.format(i), "en", "a") for i in range(300)] + [(1000 + i, clean.format(i).replace(" ", "# "), "en", "b") for i in range(300)]
    rows += [(5000, clean.format("x").replace(" ", "# "), "en", "a"), (5001, clean.format("y"), None, None), (5002, clean.format("z"), "en", None)]
    got = rows_by(quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "doc_id")
    assert all(got[i]["kept"] for i in range(300))
    assert all(got[1000 + i]["kept"] for i in range(300))  # there symbols are usual
    assert not got[5000]["kept"]
    assert got[5001]["kept"] and got[5002]["kept"]


def test_quality_of_an_empty_table_and_kept_columns(docs):
    assert quality.assess(docs([])).count() == 0
    df = docs(["a b c d e f g h i j k l"] * 3)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and kept.count() == 3


KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 * (v > 9) for v in doubled) % 10 == 0


def spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_are_those_of_the_patterns(docs):
    rnd = random.Random(3)
    parts = ["a", "_", "@", ".", "b-c.de", "1", "42", "255", "256", "0001", " ", "-", "+1", "(", ")", "é", "\U0001f600", "x@y.zz", "4111 1111 1111 1111", "1.2.3.4", "\n", "%"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "a@b.co_x@d.ef", "1.2.3.4.5.6.7.8", "1 " * 20_000, "7" * 30_000, "a." * 20_000 + "@b.c", "a" * 50_000, "+" + "1-" * 9_000 + "1", "a@" + "b." * 9_000 + "c"]
    got = rows_by(pii.find_spans(docs(texts)).select("doc_id", pii.listed(F.col("base")).alias("b")), "doc_id")
    for i, text in enumerate(texts):
        assert got[i]["b"] == spans(text), repr((text or "")[:60])


def test_contexts_find_what_the_patterns_miss(spark, docs):
    seeds = [f"line {i} reach me under mobile number +49 (170) 555-{1000 + i} any time" for i in range(12)]
    hidden = "please use mobile number 0170/5551234, thanks"
    other = "version number 12345 of the form"
    got = rows_by(pii.find_spans(docs([*seeds, hidden, hidden, other])).select("doc_id", pii.listed(F.col("spans")).alias("s")), "doc_id")
    at = hidden.index("0170")
    assert got[12]["s"] == got[13]["s"] == f"phone:{at}:{at + len('0170/5551234')}"
    assert got[14]["s"] == ""
    assert all(got[i]["s"] == spans(seeds[i]) for i in range(12))


def listed_spans(docs, texts):
    got = rows_by(pii.find_spans(docs(texts)).select("doc_id", pii.listed(F.col("spans")).alias("s")), "doc_id")
    return [got[i]["s"] for i in range(len(texts))]


def test_numbers_written_with_blanks_are_one_identifier(docs):
    seeds = [f"line {i} reach me under mobile number +49 (170) 555-{1000 + i} any time" for i in range(60)]
    texts = [f"call mobile number {n}, thanks" for n in ("(555) 123-4567", "555 123 4567", "( 555 ) 1234567")]
    for text, found, number in zip(texts, listed_spans(docs, [*seeds, *texts])[60:], ("(555) 123-4567", "555 123 4567", "555 ) 1234567"), strict=True):
        assert found == f"phone:{text.index(number)}:{text.index(number) + len(number)}", text


def test_contexts_may_hold_numbers(docs):
    seeds = [f"gate 7 {word} +49 (170) 555-{1000 + i} open" for i, word in enumerate(["line"] * 12)]
    text = "in gate 5 line 0170/5551234 there"
    assert listed_spans(docs, [*seeds, text])[12] == "phone:15:27"
    seeds = [f"reach room 77/1 +49 (170) 555-{1000 + i} open" for i in range(12)]
    text = "so reach room 12/5 0170/5551234 there"
    assert listed_spans(docs, [*seeds, text])[12] == "phone:19:31"


def test_digit_free_addresses_seed_contexts_and_are_found_by_them(docs):
    names = ["ann", "bob", "cid", "dan", "eve", "fay", "gus", "hal", "ida", "joe", "kim", "lea"]
    seeds = [f"please write to mailbox {n}@example.com soon" for n in names]
    hidden = "do write to mailbox jane(at)example.com, thanks"
    at = hidden.index("jane")
    found = listed_spans(docs, [*seeds, hidden])
    assert found[12] == f"email:{at}:{at + len('jane(at)example.com')}"
    assert found[:12] == [spans(s) for s in seeds]
    # Where plain words follow as well, the context tells nothing.
    loose = ["write to mailbox " + "".join(p) for p in zip("abcdefgh", "bcdefghi", "cdefghij", strict=True)]
    assert listed_spans(docs, [*seeds, hidden, *loose])[12] == ""


def test_redaction_keeps_columns_and_replaces_spans(docs):
    df = docs(["é mail a@b.de, ip 1.2.3.4!", None, "", "nothing", "a@b.de"])
    out = pii.redact(df)
    assert out.columns == df.columns
    got = rows_by(out, "doc_id")
    assert [got[i]["text"] for i in range(5)] == ["é mail [EMAIL], ip [IP]!", None, "", "nothing", "[EMAIL]"]
    assert pii.redact(docs([])).count() == 0


def all_segments(scores, drift):
    """Maximal segments by their definition: best run, then left and right of it."""
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-9):
                    best = (total, i, j)
        if best:
            split(a, best[1])
            out.append((best[1], best[2], best[0]))
            split(best[2] + 1, b)

    split(0, len(scores))
    return out


def test_segments_are_the_maximal_ones():
    rnd = random.Random(4)
    for _ in range(200):
        # Odd values, so that no two runs have the same sum.
        scores = [rnd.choice([-0.15, -0.15, -0.15, 1.3, 0.7, 2.9, -2.1]) for _ in range(rnd.randint(0, 25))]
        scores = [s if s == -0.15 else s + rnd.random() / 100 for s in scores]
        got = toxicity.segments([(i, s) for i, s in enumerate(scores) if s != -0.15], -0.15)
        want = all_segments(scores, -0.15)
        assert len(got) == len(want)
        assert sum(s for *_, s in got) == pytest.approx(sum(s for *_, s in want))


def test_toxicity_learns_from_labels_only(spark, docs):
    rnd = random.Random(6)
    plain = ["tree", "river", "cloud", "stone", "field", "water", "light", "house"]
    texts = [" ".join(rnd.choice(plain) for _ in range(40)) for _ in range(300)]
    toxic = [i for i in range(300) if i % 5 == 0]
    for i in toxic:
        texts[i] = texts[i].replace("tree", "vileword", 3) + " vileword"
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(300)] + [(0, None), (None, 1), (5, 1)], "doc_id long, toxic int")
    df = docs([*texts, None, "", "vileword " * 20_000, "cloud vileword İvileword"])
    model = toxicity.learn(df, labels.where(~toxicity.held_out()))
    got = rows_by(toxicity.score_documents(df, model), "doc_id")
    assert all(got[i]["predicted"] == (i in toxic) for i in range(300))
    assert got[300]["score"] == got[301]["score"] == min(r["score"] for r in got.values())
    assert got[302]["predicted"] == 1 and got[302]["passages"]
    for p in got[0]["passages"]:
        assert "vileword" in texts[0][p["start"] : p["end"]]
    none = toxicity.learn(df, labels.where("toxic = 0"))
    assert all(r["score"] < 0.5 for r in toxicity.score_documents(df, none).collect())
    assert toxicity.score_documents(docs([]), model).count() == 0


def test_passages_of_texts_that_lower_casing_would_cut_otherwise(spark, docs):
    rnd = random.Random(8)
    plain = ["tree", "river", "cloud", "stone", "field", "water", "light", "house"]
    texts = [" ".join(rnd.choice(plain) for _ in range(40)) for _ in range(300)]
    for i in range(0, 300, 5):
        texts[i] = texts[i].replace("tree", "vileword", 3) + " vileword"
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    known = "cloud vileword İvileword"
    long = "İstanbul river " + "stone " * 400 + "VILEWORD Vileword vileword vileword" + " cloud" * 400 + " vileword vileword vileword vileword İ"
    df = docs([*texts, known, long])
    model = toxicity.learn(df, labels.where(~toxicity.held_out()))
    got = rows_by(toxicity.score_documents(df, model), "doc_id")
    assert [known[p["start"] : p["end"]] for p in got[300]["passages"]] == ["vileword"]
    found = [long[p["start"] : p["end"]] for p in got[301]["passages"]]
    assert found == ["VILEWORD Vileword vileword vileword", "vileword vileword vileword vileword"]


def test_span_digest_of_no_spans(docs):
    got = pii.find_spans(docs([""])).select(F.sha2(pii.listed(F.col("base")), 256).alias("h")).first()
    assert got["h"] == hashlib.sha256(b"").hexdigest()
