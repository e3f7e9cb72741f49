"""Near duplicates, repeated passages and vectors against brute force."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from jobtide.llm import components, embeddings, jaccard, suffix
from tests.llm.conftest import rows_by


def classes(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components_of_paths_stars_and_repeats(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 3), (7, 3), (9, 9)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(6, 90))] for _ in range(25)]
    shared = [rnd.choice(words) for _ in range(30)]
    texts = []
    for b in base:
        for _ in range(rnd.randint(1, 7)):
            t = list(b)
            for _ in range(rnd.randint(0, 3)):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            texts.append(" ".join(t))
        texts.append(" ".join(b + shared))
    return texts + [None, "", "  \n", "One two", "one  TWO", "one two three", "ÀB c d e f", "àB c d e f"]


def test_jaccard_components_are_those_of_all_pairs(docs):
    texts = corpus()
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(linked) > 30
    expected = classes(len(texts), linked)
    got = rows_by(jaccard.near_duplicates(docs(texts).withColumnRenamed("source", "n_shingles")), "doc_id")
    assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == [(len(s), c) for s, c in zip(sets, expected, strict=True)]
    kept = jaccard.keep_first(docs(texts))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected))
    assert jaccard.near_duplicates(docs([])).count() == 0


def test_jaccard_by_blocks_is_the_same(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "PAIR_GROUP", 1)
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 3)
    rnd = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(60):  # edits of one text, about half of the pairs below the bound
        t = list(base)
        for _ in range(rnd.randint(0, 6)):
            t[rnd.randrange(len(t))] = f"x{rnd.randrange(1000)}"
        texts.append(" ".join(t))
    texts += corpus(2)
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(texts)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = rows_by(jaccard.near_duplicates(docs(texts)), "doc_id")
    assert [got[i]["component_id"] for i in range(len(texts))] == classes(len(texts), linked)


def test_jaccard_takes_null_and_repeated_ids(docs):
    same = "a b c d e f g h"
    got = jaccard.near_duplicates(docs([(5, same), (5, same), (None, same), (7, same), (9, None)])).collect()
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in got) == [("5", 5), ("5", 5), ("7", 5), ("9", 9), ("None", None)]
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_first(docs([(5, same), (5, same), (None, same), (7, same)])).collect()) == ["5", "None"]


def repeated(texts):
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        runs = int(np.diff(np.concatenate([[0], gone.astype(int)])).clip(0).sum()) if len(d) else 0
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def passages():
    rnd = random.Random(8)
    text = lambda n: "".join(rnd.choice("abcdé \n") for _ in range(n))
    p, q = text(450), text(230)
    texts = [text(300) + p + text(90), text(40) + p[100:400], q + text(500), text(9) + q[:199], p[:250] + q[20:], text(900), text(150), "ab" * 400, "z" * 1000, "z" * 250]
    return texts + [None, "", "short", "short", texts[5][:], text(700) * 3] + [text(60) + p[50:300] + text(rnd.randint(0, 200)) for _ in range(30)]


def test_repeated_bytes_are_removed_exactly(docs):
    texts = passages()
    expected = repeated(texts)
    for hot in (suffix.HOT_ROWS, 4):  # sorted in tasks, and window by window
        got = rows_by(suffix.repeat_digests(docs(texts), hot_rows=hot), "doc_id")
        assert [tuple(got[i][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(texts))] == expected
    assert suffix.repeat_digests(docs([])).count() == 0


def test_long_texts_are_anchored_in_segments(monkeypatch):
    rnd = random.Random(9)
    data = bytes(rnd.choice(b"abcdef ") for _ in range(5000))
    whole = suffix.anchors(data)
    chosen = {s: p for p, a, b in zip(*whole, strict=True) for s in range(a, b + 1)}
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    cut = suffix.anchors(data)
    assert {s: p for p, a, b in zip(*cut, strict=True) for s in range(a, b + 1)} == chosen
    assert set(chosen) == set(range(4801))


def test_multikey_order_sorts_rows():
    rnd = np.random.default_rng(1)
    rows = rnd.integers(0, 3, (500, 21)).astype(np.uint8)
    order = suffix.multikey_order(rows)
    assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)


def test_removal_keeps_columns(docs):
    texts = passages()
    df = docs(texts)
    out = suffix.remove_repeats(df)
    assert out.columns == df.columns and out.count() == len(texts)
    got = rows_by(out, "doc_id")
    assert got[10]["text"] is None and got[12]["text"] == "short" and got[6]["text"] == texts[6]


def vectors():
    rnd = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rnd.standard_normal(16)
        rows += [(centre + rnd.standard_normal(16) * s, c % 3) for s in np.linspace(0, 0.35, 15)]
    return rows + [(rows[0][0], 0), (rows[0][0] * 7.5, 0), (rows[0][0], 1)] * 3


def test_vectors_link_as_by_brute_force(spark):
    rows = vectors()
    table = [(i, [float(x) for x in v], c) for i, (v, c) in enumerate(rows)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0, None], 0), (1004, table[0][1], None), (1005, [float("inf")] * 16, 0), (1006, [], 0), (1007, [1.0, 2.0], 0), (1008, [1.0, 2.0], 0)]
    df = spark.createDataFrame(table + odd, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = rows_by(embeddings.near_duplicates(df), "vec_id")
    unit = np.stack([v / np.linalg.norm(v) for v, _ in rows])
    labels = np.array([c for _, c in rows])
    links = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i in range(len(rows)))
    assert all(got[i]["n_links"] <= links[i].sum() for i in range(len(rows)))
    assert found >= 0.95 * links.sum()
    expected = classes(len(rows), list(zip(*np.nonzero(links), strict=True)))
    assert sum(got[i]["component_id"] == expected[i] for i in range(len(rows))) >= 0.97 * len(rows)
    for i in range(1000, 1007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert (got[1008]["n_links"], got[1008]["component_id"], got[1008]["kept"]) == (1, 1007, False)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_buckets_are_compared_in_blocks(spark, monkeypatch):
    rnd = np.random.default_rng(5)
    centre = rnd.standard_normal(12)
    table = [(i, [float(x) for x in centre + rnd.standard_normal(12) * 0.02], 1) for i in range(90)]
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 16)
    got = embeddings.near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(89, 0)}


def test_nearest_lattice_points():
    rnd = np.random.default_rng(2)
    near = embeddings.nearest_e8(rnd.uniform(-3, 3, (400, 8)))
    assert len(embeddings.roots()) == 240 and np.allclose((embeddings.roots() ** 2).sum(1), 2)
    assert all(np.allclose(2 * p, np.rint(2 * p)) and np.rint(p.sum()) % 2 == 0 and (np.allclose(p, np.rint(p)) or np.allclose(p - 0.5, np.rint(p - 0.5))) for p in near)
    x = rnd.uniform(-1, 1, (50, 8))
    p = embeddings.nearest_e8(x)
    best = ((x - p) ** 2).sum(1)
    for r in embeddings.roots():
        assert (best <= ((x - p - r) ** 2).sum(1) + 1e-9).all()
