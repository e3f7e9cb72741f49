"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.common import Memo, forget, map_batches, settle

#: Bound on the labelled rows that a model is fitted on, and so on the tokens that it can have.
MAX_TRAINING_ROWS = 20_000
#: Weight of the prior, which spreads like the tokens of all labelled rows, and what every token has besides.
PRIOR, PRIOR_EACH = 1_000.0, 0.5
#: Least z-score of a kept token, and the score of every other token: clean text must lose.
MIN_Z, DRIFT = 4.0, -0.15
#: Segments are listed up to this E-value.
MAX_E = 0.05

#: Beginnings of a word that stand in for words too rare to have a score of their own.
PREFIXES, MIN_WORDS = range(3, 9), 3

_TOKEN = re.compile(r"\w+").findall
_SPANS = re.compile(r"\w+").finditer


def features(token: str) -> list[str]:
    """A token and its beginnings, longest first."""
    return [token, *(token[:k] + "*" for k in reversed(PREFIXES) if k < len(token))]


@dataclass(frozen=True)
class Model:
    """Token scores, the extreme-value parameters of clean text, and the logistic map of evidence to a score."""

    weights: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    k: float = 1.0
    intercept: float = -20.0
    slope: float = 0.0

    def score(self, token: str) -> float | None:
        """The score of the most specific feature of a token that has one."""
        return next((self.weights[f] for f in features(token) if f in self.weights), None)

    def scorer(self):
        """A cached ``score`` of tokens as the text has them; they are lower-cased one by one, so that places stay those of the text."""
        return Memo(lambda token: self.score(token.lower())).__getitem__


def segments(scores: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(first, last, score)`` of a token sequence, best-first disjoint in the sense that no
    segment can be made better by growing or shrinking it. ``scores`` lists the tokens with a score other
    than ``drift``, as ``(place, score)`` in order. Linear time: each segment knows the nearest earlier one with a smaller sum
    before it, so a search jumps over those in between, and no later one looks at them again."""
    found: list[tuple[int, int, float, float, int]] = []  # first, last, sum before, sum after, place of the earlier one
    total, last = 0.0, -1
    for place, score in scores:
        before = total + (place - last - 1) * drift
        total, last = before + score, place
        if score <= 0:
            continue
        first, low, high = place, before, total
        k = len(found) - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= high:
                found.append((first, place, low, high, k))
                break
            first, _, low, _, earlier = found[k]
            del found[k:]
            k = earlier
    return [(a, b, high - low) for a, b, low, high, _ in found]


def evidence(text: str, model: Model, score) -> tuple[float, int, list[tuple[int, int, float]]]:
    """``(evidence, tokens, segments)``: minus the summed log of the segments' E-values in a text of so many tokens."""
    tokens = _TOKEN(text)
    scores = [(i, s) for i, s in enumerate(map(score, tokens)) if s is not None]
    found = segments(scores) if scores else []
    n = max(len(tokens), 1)
    total = 0.0
    for _, _, s in found:
        total += max(0.0, model.decay * s - math.log(model.k * n))
    return total, n, found


def probability(x: float, model: Model) -> float:
    return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, model.intercept + model.slope * x))))


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """A model from labelled documents, at most ``max_rows`` of them, chosen by a hash of their id.

    Tokens and their beginnings count once per document. A score is its log-odds between toxic and clean documents under a
    Dirichlet prior, kept if its z-score is at least ``MIN_Z``. The chosen rows are settled: they are read three times.
    Without labels of both kinds the model has no tokens and scores everything near 0.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("_toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64(id_col), id_col).limit(max_rows))
    rows = settle(df.select(F.col(id_col), F.coalesce(text_col, F.lit("")).alias("_text")).join(chosen, id_col).select("_toxic", "_text"))

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by[toxic > 0].update({f for t in {t.lower() for t in set(_TOKEN(text))} for f in features(t)})
        tokens = list(by[0].keys() | by[1].keys())
        return pa.record_batch([pa.array(tokens, "string"), *(pa.array([c[t] for t in tokens], "int64") for c in by)], ["token", "clean", "toxic"])

    counts = settle(map_batches(rows, count, "token string, clean long, toxic long").groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    totals = counts.agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).first()
    clean_all, toxic_all = totals["c"] or 0, totals["t"] or 0
    if not clean_all or not toxic_all:
        return Model()
    prior = PRIOR * (F.col("clean") + F.col("toxic")) / (clean_all + toxic_all)
    prior = prior + PRIOR_EACH
    odds = lambda y, n: F.log((F.col(y) + prior) / (n + PRIOR))
    scored = counts.where("toxic > 0").withColumn("score", odds("toxic", toxic_all) - odds("clean", clean_all))
    scored = scored.withColumn("z", F.col("score") / F.sqrt(1 / (F.col("toxic") + prior) + 1 / (F.col("clean") + prior)))
    # A beginning stands in for rare words only if several words of toxic rows have it.
    stems = scored.where(~F.col("token").endswith("*")).select("token", F.explode(F.array(*[F.when(F.char_length("token") > k, F.concat(F.substring("token", 1, k), F.lit("*"))) for k in PREFIXES])).alias("stem"))
    usable = stems.where("stem is not null").groupBy("stem").count().where(F.col("count") >= MIN_WORDS).select(F.col("stem").alias("token"))
    scored = scored.where(~F.col("token").endswith("*")).unionByName(scored.join(usable, "token", "left_semi"))
    top = scored.where(F.col("z") >= MIN_Z).collect()
    model = calibrate(rows, Model(weights={r["token"]: r["score"] for r in top}))
    forget(rows, counts)
    return model


def calibrate(rows: DataFrame, model: Model) -> Model:
    """Extreme-value parameters from the clean rows, then the logistic map from all of them.

    In clean text the chance of a segment of score ``s`` in ``n`` tokens is about ``k * n * exp(-decay * s)``; ``decay``
    solves the equation of random scores with the token frequencies of the clean rows, ``k`` fits the
    number of their positive segments.
    """

    def look(batch: pa.RecordBatch) -> pa.RecordBatch:
        out, score = [], model.scorer()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = _TOKEN(text)
            hits = [(i, s) for i, s in enumerate(map(score, tokens)) if s is not None]
            out.append((int(toxic > 0), len(tokens), len(hits), sum(s for _, s in hits), [s for *_, s in segments(hits)]))
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)]
        return pa.record_batch(cols, ["toxic", "n", "hits", "sum", "found"])

    seen = map_batches(rows, look, "toxic int, n long, hits long, sum double, found array<double>").collect()
    clean = [r for r in seen if not r["toxic"]]
    if not clean or len(clean) == len(seen):
        return model
    tokens, hits, total = (sum(r[c] for r in clean) for c in ("n", "hits", "sum"))
    share = (hits + 0.5) / (tokens + 1)
    mean = total / hits if hits else 4.0
    low, high = 1e-6, 50.0
    for _ in range(80):  # share * exp(decay * mean) + (1 - share) * exp(decay * drift) = 1, the root above zero
        decay = (low + high) / 2
        low, high = (decay, high) if share * math.exp(min(700, decay * mean)) + (1 - share) * math.exp(decay * DRIFT) < 1 else (low, decay)
    found = sum(len(r["found"]) for r in clean)
    k = (found + 0.5) * math.exp(min(50, decay * mean)) / max(tokens, 1)
    fitted = Model(model.weights, decay, max(k, 1e-9))
    x = np.array([sum(max(0.0, decay * s - math.log(fitted.k * max(r["n"], 1))) for s in r["found"]) for r in seen])
    y = np.array([r["toxic"] for r in seen], float)
    # One evidence value counts by its logarithm in the logistic map: a passage is enough, more of them add less.
    a, b = _logistic(np.log1p(x), y)
    return Model(model.weights, decay, fitted.k, a, b)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and non-negative slope by Newton steps with a weak ridge."""
    design = np.stack([np.ones_like(x), x], 1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (y - p) - 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta = beta + np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), max(0.0, float(beta[1]))


def score_documents(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score``, ``predicted`` and ``passages``: toxic segments as ``(start, end, e_value)`` in code points.

    A null or empty text has no passage and the least score. Each row gives one row, repeated ones too; an
    empty table gives none; only the text decides, other columns are ignored.
    """

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, passages, score = [], [], model.scorer()
        for text in batch.column(1).to_pylist():
            x, n, found = evidence(text, model, score)
            scores.append(probability(math.log1p(x), model))
            kept = [(a, b, model.k * n * math.exp(-model.decay * s)) for a, b, s in found]
            kept = [p for p in kept if p[2] <= MAX_E]
            spans = [m.span() for m in _SPANS(text)] if kept else []
            passages.append([{"start": spans[a][0], "end": spans[b][1], "e_value": e} for a, b, e in kept])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("e_value", pa.float64())]))
        return pa.record_batch([batch.column(0), pa.array(scores, "float64"), pa.array(passages, kind)], ["id", "score", "passages"])

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, score double, passages array<struct<start:int,end:int,e_value:double>>"
    done = map_batches(rows, work, schema)
    return done.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def held_out(id_col: str = "doc_id"):
    """True for the fifth of the ids that a model must not learn from; null ids are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))
