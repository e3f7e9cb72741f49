"""Whole operators and pipeline stages against plain Python."""

import base64
import math
import random
import re
import subprocess
import sys
import time
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from jobtide.llm import clustering, common, divergence, embeddings, jaccard, packing, pii, quality, suffix, toxicity, warc
from jobtide.llm.queries import WORD_BPE
from tests.llm.conftest import rows_by
from tests.llm.test_duplicates import classes, repeated, shingles
from tests.llm.test_text_rules import WORD, measured, spans

FOLDER = "/root/testdata/sf0.001"


def verdicts(rows):
    """``kept`` per place in rows ``(text, lang, source)``: quantiles of sorted measures, group by group."""

    def measures(text):
        n, chars, symbols, dup, _ = measured(text)
        lines = [s for s in (text or "").split("\n") if WORD.search(s)]
        upper = sum(unicodedata.category(c) == "Lu" for c in text or "")
        return [symbols / max(chars, 1), upper / max(chars, 1), dup / max(len(lines), 1), chars / max(n, 1)]

    seen = [(measured(t), measures(t), lang, source) for t, lang, source in rows]
    groups = defaultdict(list)
    for counts, found, lang, source in seen:
        if counts[0]:
            for key in ((lang, source), lang, "all of them"):
                groups[key].append(found)

    def bounds(lang, source):
        key = next(k for k in ((lang, source), lang, "all of them") if k == "all of them" or len(groups[k]) >= quality.MIN_GROUP)
        out = []
        for i, fence in enumerate(quality.FENCES):
            values = sorted(m[i] for m in groups[key])
            low, mid = (values[max(math.ceil(q * len(values)) - 1, 0)] for q in (0.1, 0.5))
            out.append(mid + fence.times * max(mid - low, fence.floor))
        return out

    kept = []
    for counts, found, lang, source in seen:
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        kept.append(not failed and all(m <= b for m, b in zip(found, bounds(lang, source), strict=True)))
    return kept


def test_quality_verdicts_are_those_of_sorted_measures(spark):
    rng = random.Random(4)

    def text(junk):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(8, 60))]
        words = [w.upper() if rng.random() < junk else w + rng.choice("#*$ ") if rng.random() < junk else w for w in words]
        return "".join(w + rng.choice(["\n", " ", " "]) for w in words) + ("\n".join(["same line"] * 9) if rng.random() < junk else "")

    rows = [(text(rng.choice([0.0, 0.02, 0.05, 0.6])), "en", "big" if i % 2 else f"s{i % 40}") for i in range(400)]
    rows += [(text(0.3), lang, source) for lang, source in [("fr", "big"), (None, "x"), ("en", None)] for _ in range(5)] + [(None, "en", "big"), ("", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    got = rows_by(quality.assess(df), "doc_id")
    want = verdicts(rows)
    assert [got[i]["kept"] for i in range(len(rows))] == want and 20 < sum(want) < len(want) - 20


@pytest.fixture(scope="module")
def stages(spark):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.settle(stage(spark, docs, FOLDER))
        seen[name] = ([r.asDict() for r in before.collect()], [r.asDict() for r in docs.collect()])
    return seen


def test_pipeline_quality_stage(stages):
    before, after = stages["quality rules"]
    kept = verdicts([(r["text"], r["lang"], r["source"]) for r in before])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r, k in zip(before, kept, strict=True) if k)


def test_pipeline_near_duplicate_stage(stages):
    before, after = stages["n-gram Jaccard join"]
    before = sorted(before, key=lambda r: r["doc_id"])
    sets = [shingles(r["text"]) for r in before]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert sorted(r["doc_id"] for r in after) == sorted({before[c]["doc_id"] for c in classes(len(sets), linked)})


def test_pipeline_repeat_stage(stages):
    before, after = stages["suffix-array dedup"]
    removed = [r[1] for r in repeated([r["text"] for r in before])]
    texts = {r["doc_id"]: r["text"] for r in after}
    for r, n in zip(before, removed, strict=True):
        # Characters of which only some bytes stay go as well.
        lost = len(r["text"].encode()) - len(texts[r["doc_id"]].encode())
        assert n <= lost <= n + 6 * (n > 0) * 20 if n else texts[r["doc_id"]] == r["text"]
    assert sum(removed) > 0


def test_pipeline_personal_data_stage(stages):
    before, after = stages["PII"]
    texts, found = {r["doc_id"]: r["text"] for r in after}, 0
    for r in before:
        base, now = spans(r["text"]), texts[r["doc_id"]]
        found += bool(base)
        if base:
            for span in base.split(","):
                _, begin, end = span.split(":")
                assert r["text"][int(begin) : int(end)] not in re.sub(r"\[(EMAIL|IP|CARD|PHONE)\]", "", now)
        elif now != r["text"]:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", now)
    assert found


def test_pipeline_packing_stage_and_run(spark, stages):
    before, after = stages["best-fit packing"]
    library = Tokenizer.from_file(WORD_BPE)
    want = []
    for r in before:
        own = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(r["doc_id"], k, len(own[s : s + 4096]), zlib.crc32(own[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(own), 4096))]
    digest = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert digest(after) == sorted(want) == digest(corpus_pipeline.run(spark, FOLDER).collect())


def test_pipeline_stages_take_an_empty_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, FOLDER)
        assert done.count() == 0, name
        docs = done if name != "best-fit packing" else docs


def test_scattered_hits_take_linear_time():
    began = time.monotonic()
    assert len(toxicity.segments([(50 * i, 5.0) for i in range(100_000)])) == 100_000
    assert len(toxicity.segments([(2 * i, 0.1) for i in range(100_000)])) > 0
    assert time.monotonic() - began < 3


def test_vectors_that_share_an_id_are_not_mixed(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.01], [0.0, 1.0, 0.0, 0.0], [1.0, 0.001, 0.0, 0.0]
    rows = [(5, a, 0), (5, b, 0), (7, c, 0), (8, [0.0, 1.0, 0.001, 0.0], 0), (9, [0.0, 0.0, 1.0, 0.0], 0)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False), (9, 0, 9, True)]


def test_recall_of_planted_copies(spark):
    """64 components as in the given tables: pairs on both sides of the bound, nearly all links found, none below it."""
    rng = np.random.default_rng(11)
    rows = []
    for _ in range(150):
        centre = rng.standard_normal(64)
        rows += [centre + rng.standard_normal(64) * s for s in np.concatenate([[0], rng.uniform(0.02, 0.25, 7)])]
    unit = np.stack([v / np.linalg.norm(v) for v in rows])
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = rows_by(embeddings.near_duplicates(df), "vec_id")
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(rows)))
    assert sum(got[i]["n_links"] for i in range(len(rows))) >= 0.99 * links.sum() and links.sum() > 1000


@pytest.mark.parametrize("name", ["http://x/a\\name", "http://x/c\\t", "http://x/\\\\n", "http://x/\\\t\\\n", "http://x/\\", "http://x/\t\n\\n\\t\\\\"])
def test_urls_of_backslashes_and_breaks_come_back(spark, name):
    rows = [(1, name, "one"), (2, name + "\\", "two"), (3, "\\" + name, "one")]
    got = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["url"]) for r in got) == [(i, u) for i, u, _ in rows]


SHIPPED = [
    embeddings.bucket_keys, embeddings.nearest_e8, clustering.reassign, clustering.nearest_two, divergence._counted, divergence._cell,
    jaccard.shingle_set, jaccard._pack, toxicity.evidence, toxicity.segments, warc.parse_record, warc._block_lines, suffix.anchors, packing.WordIds, common.Memo, common.TextMemo, common.worker_cache,
]


@pytest.mark.parametrize("thing", SHIPPED, ids=lambda t: t.__qualname__)
def test_worker_code_loads_without_the_package(thing, tmp_path):
    text = base64.b64encode(cloudpickle.dumps(thing)).decode()
    (tmp_path / "code").write_text(text)
    code = f"import base64, pickle, sys; pickle.loads(base64.b64decode(open({str(tmp_path / 'code')!r}).read())); assert 'jobtide' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)


def test_planted_numbers_that_only_their_context_gives_away(docs):
    """Numbers in forms that no fixed pattern takes, behind a context that mostly stands before plain phone numbers: all are
    found, and numbers behind other contexts are left alone."""
    rng = random.Random(8)
    filler = lambda: " ".join(rng.choice(["some", "plain", "words", "to", "read", "here"]) for _ in range(rng.randint(3, 9)))
    number = lambda: f"0{rng.randint(150, 179)}/{rng.randint(1000000, 9999999)}"
    seeds = [f"{filler()} reach me under mobile number +49 (170) 555-{1000 + i} {filler()}" for i in range(150)]
    planted = [f"{filler()} call the mobile number {number()}, {filler()}" for _ in range(15)]
    other = [f"{filler()} invoice number 2024{rng.randint(100000, 999999)} {filler()}" for _ in range(60)]
    got = rows_by(pii.find_spans(docs([*seeds, *planted, *other])).select("doc_id", F.size("spans").alias("n"), F.size("base").alias("b")), "doc_id")
    more = [got[i]["n"] - got[i]["b"] for i in range(225)]
    found, wrong = sum(m == 1 for m in more[150:165]), sum(m > 0 for m in more[165:])
    assert found == 15 and wrong == 0
