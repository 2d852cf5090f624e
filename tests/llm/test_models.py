"""Predictions of the trained operators, recomputed plainly."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
import zstandard

from conftest import SF_DIR
from posture.llm import language, quality, toxicity

SMALL = SF_DIR.rsplit("/", 1)[0] + "/sf0.001"


# --- language ------------------------------------------------------------------------------


def plain_counts(text: str) -> Counter:
    """N-grams of one to three characters of words with a blank at either end."""
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    found: Counter = Counter()
    for word in words:
        padded = f" {word} "
        found.update(word)
        for n in (2, 3):
            found.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return found


def plain_ranking(counts: Counter) -> list[str]:
    def code(gram: str) -> int:
        return sum(ord(c) << language.WIDE * i for i, c in enumerate(reversed(gram)))

    return sorted(counts, key=lambda g: (-counts[g], code(g)))[: language.RANKS]


def plain_prediction(text: str | None, profiles: dict[str, list[str]]) -> tuple[str, float]:
    own = plain_ranking(plain_counts(text or ""))
    if not own or not profiles:
        return "und", 0.0
    near = {}
    for name in sorted(profiles):
        at = {gram: rank for rank, gram in enumerate(profiles[name])}
        apart = sum(abs(at[g] - r) if g in at else language.RANKS for r, g in enumerate(own))
        near[name] = 1 - apart / (language.RANKS * len(own))
    best = max(near, key=near.get)  # the first in the alphabet where several are as near
    return best, near[best] / sum(near.values()) if sum(near.values()) > 0 else 0.0


AWKWARD = [
    (9_000_001, None, "en"),
    (9_000_002, "", "en"),
    (9_000_003, "12 !? 3", "fr"),
    (9_000_004, "İstanbul ﬁn ǅ 中文 é́", None),
    (9_000_005, "nospaces" * 3_000, None),
    (9_000_006, "a " * 30_000, None),
    (9_000_007, "ぁぃぅ", None),
    (None, "the man and the house", None),
]


def test_language_against_plain_counting(spark):
    given = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    extra = spark.createDataFrame(AWKWARD, "doc_id bigint, text string, lang string")
    docs = given.unionByName(extra)
    rows = docs.collect()
    counts: dict[str, Counter] = {}
    for row in rows:
        if row["lang"] not in (None, "und") and row["text"] is not None:
            counts.setdefault(row["lang"], Counter()).update(plain_counts(row["text"]))
    profiles = {lang: plain_ranking(found) for lang, found in counts.items()}
    found = language.predict(docs, language.profiles(docs)).collect()
    by_text = {r["text"]: (r["__lang"], r["__score"]) for r in found}
    assert len(found) == len(rows)
    for text, (lang, score) in by_text.items():
        expected, value = plain_prediction(text, profiles)
        assert lang == expected and score == pytest.approx(value, abs=1e-12)


def test_equal_distances_go_to_the_first_language():
    ranks = language.ranking("same words here").tolist()
    judge = language.Judge({"b": ranks, "a": ranks, "c": ranks})
    assert judge.predict("same words") == ("a", pytest.approx(1 / 3))


# --- quality -------------------------------------------------------------------------------


def test_quality_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    model = quality.learn(docs, labels)
    good, bad, slope, intercept, prior = model

    def size(parts: list[bytes], dictionary: bytes) -> int:
        held = zstandard.ZstdCompressionDict(dictionary)
        held.precompute_compress(level=quality.LEVEL)
        coder = zstandard.ZstdCompressor(
            level=quality.LEVEL, dict_data=held, write_content_size=False, write_dict_id=False
        )
        return sum(len(coder.compress(p)) for p in parts)

    texts = [r["text"] for r in docs.orderBy("doc_id").limit(150).collect()]
    texts += [None, "", "x", "  \n", "long text " * 20_000, "é" * 257, texts[0], texts[0]]
    frame = spark.createDataFrame(
        list(enumerate(texts)), "doc_id bigint, text string"
    ).repartition(4)
    found = {r["doc_id"]: r["__score"] for r in quality.score(frame, model).collect()}
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        parts = [bytes(p) for p in itertools.batched(raw, quality.CHUNK)]
        sure = len(raw) / (len(raw) + quality.WEAK)
        told = slope * ((size(parts, bad) - size(parts, good)) / len(raw)) + intercept if raw else 0
        odds = sure * told + (1 - sure) * prior
        assert found[i] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_quality_curve_is_the_best_one():
    rng = np.random.default_rng(5)
    x, sure = rng.normal(0, 0.05, 400), rng.uniform(0.2, 1, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(40 * x + 1)))).astype(float)
    weight = np.where(y == 1, 0.5, 1.5)
    slope, intercept = quality.fit_curve(x, sure, y, weight, 0.7)
    scale = np.abs(x).max()

    def loss(a: float, b: float) -> float:
        odds = sure * (a * x + b) + (1 - sure) * 0.7
        fit = (weight * (np.logaddexp(0, odds) - y * odds)).sum()
        return fit + weight.sum() * (1e-5 * (a * scale) ** 2 + 1e-6 * b**2) / 2

    least = loss(slope, intercept)
    for a, b in itertools.product((-0.1, 0, 0.1), repeat=2):
        assert least <= loss(slope + a, intercept + b) + 1e-9


# --- toxicity ------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_toxicity_fit_against_a_dense_solver(seed):
    rng = np.random.default_rng(seed)
    n, width = 400, 60
    found = [sorted(set((rng.random(12) ** 2 * width).astype(int))) for _ in range(n)]
    rows = toxicity.Rows(found, toxicity._dense(np.array([len(f) for f in found], float)), width)
    beta = toxicity.fit(rows, y := (rng.random(n) < 0.2).astype(float), np.ones(n))
    dense = np.column_stack([rows.times(unit) for unit in np.eye(len(beta))])
    ridge = np.full(len(beta), toxicity.RIDGE * n)
    ridge[width] = 1e-9
    best = np.zeros(len(beta))
    for _ in range(60):
        p = 1 / (1 + np.exp(-dense @ best))
        gradient = dense.T @ (y - p) - ridge * best
        curvature = dense.T @ (dense * (p * (1 - p))[:, None]) + np.diag(ridge)
        best = best + np.linalg.solve(curvature, gradient)
    assert np.abs(dense @ beta - dense @ best).max() < 1e-2
