"""Source divergence, source mixing and centroid clustering against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobtide.llm import clustering, divergence, mixing

DOC = "doc_id long, text string, lang string, source string"


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, DOC).repartition(parts)


# --- source divergence -------------------------------------------------------------------------------------------


def terms(text):
    found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in found]


def audit(rows, min_documents, top=50):
    of_lang, of_group, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        of_lang[lang].update(found)
        of_group[lang, source].update(found)
        docs[lang].update(set(found))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_documents]
        p = lambda counts: {t: 1 + 1_000_000_000 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}
        q = p(of_lang[lang])
        own = {s: p(of_group[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(own[s][t] - own[o][t]) for t in kept), o) for o in sources if o != s]
            over = [(own[s][t] - q[t], t) for t in kept if of_group[lang, s][t] and own[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", over)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(found) if part == "pair" or i < top}
    return out


def corpus(n=400, sources=23, seed=5):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Alpha", "été", "наука", "z") for b in ("", "x", "Q", "ß", "İ")] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else f"s{rng.randrange(sources)}"
        text = " ".join(rng.choice(words) + rng.choice(["", ",", "-7", " ", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "fr"]), source))
    rows += rows[:3]
    rows += [(9000, None, "en", None), (9001, "", None, "s1"), (9002, "Alpha", None, None), (9003, "12 34", "xx", "a"), (9004, None, "xx", "b"), (None, "wa wb", "en", "s1")]
    return rows


@pytest.mark.parametrize("group_block,term_block", [(64, 8192), (3, 4), (1, 1)])
def test_divergence_is_that_of_brute_force(spark, group_block, term_block):
    rows = corpus(250 if group_block == 1 else 400, 5 if group_block == 1 else 23)
    got = divergence.audit(table(spark, rows), min_documents=12, top_terms=7, group_block=group_block, term_block=term_block)
    found = [tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == audit(rows, 12, 7)
    assert any(r[2] == "term" for r in found) and ("xx", "a", "pair", "b", 0, 1) in found


def test_divergence_of_long_texts_ties_and_nothing(spark):
    long = "aa bb " * 400_000 + "c" * 2_000_000
    assert Counter(t for part in divergence.stretches(long.encode(), 1000) for t in part) == Counter(long.encode().split())
    rows = [(i, long if i == 0 else "bb aa cc", "en", f"s{i % 3}") for i in range(6)]
    odd = table(spark, rows).withColumn("term", F.lit("x")).withColumn("p", F.lit(None)).withColumn("value", F.lit(1))
    got = {tuple(r) for r in divergence.audit(odd, min_documents=2).collect()}
    assert got == audit(rows, 2)
    assert divergence.audit(table(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0


# --- source mixing -----------------------------------------------------------------------------------------------


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def shared(sizes):
    """Targets by name, resharing until nobody is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else share[s] for s in names}
        full |= over


def mixture(n=900, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c\U0001f600", "c￿", "", None, "tiny"] if i % 9 == 0 else ["a", "b", "c￿"])
        words = 0 if rng.random() < 0.05 else 6000 if rng.random() < 0.002 else rng.randrange(1, 60)
        rows.append((i, rng.choice([" ", " ", "\t"]).join(["w"] * words) or rng.choice([None, "", " \n"]), "en", source))
    return rows + [(5, "x y z", "en", "a")] * 40 + [(None, "p q", "en", "b"), (None, None, None, "empty"), (7000, "", "en", "empty")]


@pytest.mark.parametrize("fan_in", [2, 5, 64])
def test_mix_meets_its_targets(spark, fan_in):
    rows = mixture()
    df = table(spark, rows).withColumn("size", F.lit("other")).withColumn("key", F.lit(1)).withColumn("target", F.lit(0))
    got = mixing.mix(df, fan_in=fan_in).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((i, s, size(t)) for i, t, _, s in rows)
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += size(text)
    want, taken, largest = shared(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-12, abs_tol=1e-9)
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 3 * r["size"]
        ratio = r["target"] / r["source_size"] if r["size"] else 0
        assert math.floor(ratio) <= r["copies"] <= math.ceil(ratio)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert math.isclose(sum(want.values()), sum(sizes.values()))
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6
    again = mixing.mix(df.repartition(7, "text"), fan_in=fan_in).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_each_document_keeps_its_chance(spark):
    """Over many seeds a document's copies average its share, whatever its size."""
    rows = [(i, "a", k, float(3 + 7 * (i % 5)), 0.3 * (3 + 7 * (i % 5)), 8) for k in range(400) for i in range(60)]
    df = spark.createDataFrame(rows, "i int, none string, source int, size double, mass double, nodes int").withColumn("key", F.struct("i", "source"))
    taken = mixing.round_masses(df, 8)
    by_size = {r["size"]: r["rate"] for r in taken.groupBy("size").agg(F.avg("take").alias("rate")).collect()}
    assert len(by_size) == 5 and all(abs(rate - 0.3) < 0.03 for rate in by_size.values())
    sums = taken.groupBy("source").agg(F.sum(F.col("take") * F.col("size")).alias("s")).collect()
    total = 0.3 * sum(3 + 7 * (i % 5) for i in range(60))
    assert all(abs(r["s"] - total) <= 15.5 for r in sums)


def test_mix_of_nothing_and_of_many_equal_rows(spark):
    assert mixing.mix(table(spark, mixture(5)).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(table(spark, [(1, None, None, None)])).collect()] == [0]
    rows = [(1, "same words", "en", "a")] * 9000 + [(2, "b " * 4000, "en", "b"), (3, "c " * 700, "en", "c")]
    got = mixing.mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    of_a = [r for r in got if r["source"] == "a"]
    assert abs(sum(r["taken"] for r in of_a) - of_a[0]["target"]) <= 1 and {r["copies"] for r in of_a} <= {0, 1, 2}


def test_mix_runs_without_python_workers(spark):
    plan = mixing.mix(table(spark, mixture(30)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- centroid clustering -----------------------------------------------------------------------------------------


def lloyd(vectors, clusters, rounds, scale=1024):
    """Plain exact clustering of ``(id, components)`` in Python numbers."""
    x = [(i, tuple(math.floor(scale * c) for c in v)) for i, v in vectors]
    start = sorted(x, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in start[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centroids)), key=lambda k: (far(v, centroids[k]), k))
    for _ in range(rounds):
        groups = defaultdict(list)
        for _, v in x:
            groups[nearest(v)].append(v)
        centroids = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k], strict=True)) if groups[k] else centroids[k] for k in range(len(centroids))]
    found = [(i, nearest(v), far(v, centroids[nearest(v)])) for i, v in x]
    inertia = Counter()
    for _, k, d in found:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in found)


def vectors(n, dimensions, seed=9, centers=7):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (centers, dimensions))
    made = middle[rng.integers(0, centers, n)] + rng.normal(0, 0.4, (n, dimensions))
    return [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(made)]


VEC = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("n,dimensions,clusters,rounds", [(300, 6, 8, 10), (300, 3, 13, 4), (40, 2, 1, 3), (5, 4, 8, 10), (60, 2, 2, 0)])
def test_clusters_are_those_of_plain_rounds(spark, n, dimensions, clusters, rounds):
    rows = vectors(n, dimensions)
    # Copies, ties and a third of all rows in one point.
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)] + [(rows[1][0], rows[1][1])]
    odd = [(7000, None), (7001, [1.0] * (dimensions + 1)), (7002, [float("nan")] * dimensions), (7003, [float("inf")] + [0.0] * (dimensions - 1)), (7004, [None] * dimensions), (7005, [])]
    df = spark.createDataFrame([(i, v, None) for i, v in rows + odd], VEC).repartition(3).withColumn("a", F.lit(1)).withColumn("n", F.lit("x"))
    got = clustering.cluster(df, dimensions=dimensions, clusters=clusters, rounds=rounds).collect()
    assert sorted(map(tuple, got)) == lloyd(rows, clusters, rounds)


def test_clusters_of_few_distinct_points_and_of_none(spark):
    rows = [(i, [float(i % 2), 0.5]) for i in range(30)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VEC)
    assert sorted(map(tuple, clustering.cluster(df, dimensions=2).collect())) == lloyd(rows, 8, 10)
    assert clustering.cluster(df.limit(0), dimensions=2).collect() == [] and clustering.cluster(df).collect() == []
    assert clustering.cluster(df, dimensions=2).schema.names == clustering.cluster(df.limit(0)).schema.names


def test_a_component_beyond_64_bit_distances_is_an_error(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [3e30], 0)], VEC), dimensions=1).collect()


def test_bounds_spare_most_distances():
    """Ten rounds over clustered points measure far fewer distances than comparing with every centroid, with equal results."""
    rng = np.random.default_rng(2)
    x = (rng.normal(0, 800, (40, 16))[rng.integers(0, 40, 4000)] + rng.normal(0, 60, (4000, 16))).astype(np.int64)
    centroids, state, moves, measured = x[:40].copy(), None, None, 0
    for r in range(10):
        *state, n = clustering.reassign(x, centroids, state, moves)
        measured += n
        all_ = ((x[:, None, :] - centroids[None]) ** 2).sum(2)
        assert (state[0] == all_.argmin(1)).all()
        new = np.array([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else centroids[c] for c in range(40)])
        moves, centroids = np.sqrt(clustering.squared(new, centroids).astype(float)) * (1 + clustering.SLACK), new
    assert measured < 0.25 * 10 * 4000 * 40
