"""Quality classifier by compression with two dictionaries.

A zstandard dictionary is built from texts labelled good and one from texts labelled bad. A
text, whole and in chunks of ``CHUNK`` bytes so that the dictionaries weigh the same in a
long text as in a short one, is compressed with each; the difference of the compressed
sizes over the uncompressed size is the one feature. A logistic curve fitted on labelled
texts that neither dictionary has seen makes it a probability, with the classes weighted by
the square root of their shares among the labels, so that the rarer one is not drowned. A
text of n bytes is judged by n / (n + ``WEAK``) of the curve's log-odds and for the rest by
the share of good texts: a few bytes tell nothing.

Learning takes at most ``TRAIN_DOCS`` labelled rows of each class, chosen by a hash of the
id, and from these at most ``TRAIN_CHUNKS`` chunks a dictionary: bounds for the cost of
learning only. Every whole text is scored.

Defined results: NULL and empty texts score the share of good texts; without labels of both
classes every score is the share of class 1, or 0.5; rows of ``labels`` with NULL are not
learnt from, repeated ones count each; NULL ids are never learnt from; repeated documents
get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import remainder, table, whole_rows

CHUNK = 512
DICTIONARY = 64 * 1024
LEVEL = 3
TRAIN_DOCS = 3_000
TRAIN_CHUNKS = 16_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3

WEAK = 64.0

#: Dictionaries of good and bad texts; slope, intercept and prior log-odds.
Model = tuple[bytes, bytes, float, float, float]


def chunks(text: str) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return [raw[i : i + CHUNK] for i in range(0, len(raw), CHUNK)]


@lru_cache(maxsize=4)
def _compressor(dictionary: bytes):
    import zstandard

    trained = zstandard.ZstdCompressionDict(dictionary)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=trained, write_content_size=False, write_dict_id=False
    )


def measures(text: str, good: bytes, bad: bytes) -> tuple[float, float]:
    """Bytes that the bad dictionary needs more, per byte of the text; how much that weighs."""
    parts = chunks(text)
    size = sum(map(len, parts))
    if not size:
        return 0.0, 0.0
    with_good, with_bad = _compressor(good).compress, _compressor(bad).compress
    more = sum(len(with_bad(p)) - len(with_good(p)) for p in parts)
    return more / size, size / (size + WEAK)


def build_dictionary(samples: list[bytes]) -> bytes:
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the samples themselves serve
        return b"".join(samples)[-DICTIONARY:]


def fit_curve(
    x: np.ndarray, sure: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float
) -> tuple[float, float]:
    """Slope and intercept of the logistic curve, by Newton steps with a trace of ridge."""
    scale = float(np.abs(x).max()) or 1.0
    design = np.column_stack((x / scale, np.ones(len(x)))) * sure[:, None]
    given = prior * (1 - sure)
    beta = np.zeros(2)
    ridge = np.diag([1e-5, 1e-6]) * weight.sum()
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(design @ beta + given, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - ridge @ beta
        curvature = design.T @ (design * (weight * p * (1 - p))[:, None]) + ridge
        step = np.linalg.solve(curvature, gradient)
        beta = beta + step
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0] / scale), float(beta[1])


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Dictionaries and curve from labelled documents."""
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("__id"), F.col("quality").cast("int").alias("__y")
    ).filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1))
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return b"", b"", 0.0, 0.0, math.log(share / (1 - share))
    drawn = None
    for value in (0, 1):
        part = (
            known.filter(F.col("__y") == value)
            .orderBy(F.xxhash64("__id"), "__id")
            .limit(TRAIN_DOCS)
        )
        drawn = part if drawn is None else drawn.unionByName(part)
    # At most 2 x TRAIN_DOCS rows of two numbers.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), "text").filter(
        F.col("text").isNotNull()
    )
    labelled = texts.join(F.broadcast(drawn), F.col("__doc") == F.col("__id")).select(
        "__doc", "__y", "text"
    )
    even = F.pmod(F.xxhash64("__doc", F.lit("half")), F.lit(2)) == 0

    @F.pandas_udf("array<binary>")
    def chunked(texts):
        return texts.map(chunks)

    dictionaries = []
    for value in (1, 0):
        mine = labelled.filter(even & (F.col("__y") == value))
        parts = mine.select("__doc", F.posexplode(chunked("text")).alias("place", "part"))
        rows = parts.orderBy(F.xxhash64("__doc", "place"), "__doc", "place", "part")
        taken = [bytes(r["part"]) for r in rows.limit(TRAIN_CHUNKS).select("part").collect()]
        dictionaries.append(build_dictionary(taken))
    good, bad = dictionaries
    columns = ("__y", "__x", "__sure")
    measured = with_measures(labelled.filter(~even), good, bad).select(*columns).toPandas()
    if measured["__y"].nunique() < 2:
        measured = with_measures(labelled, good, bad).select(*columns).toPandas()
    y = measured["__y"].to_numpy(dtype=float)
    seen = {v: max(1, int((y == v).sum())) for v in (0, 1)}
    weight = np.where(y == 1, math.sqrt(counts[1]) / seen[1], math.sqrt(counts[0]) / seen[0])
    weight = weight * (len(y) / weight.sum()) if len(y) else weight
    prior = math.log(counts[1] / counts[0])
    if not len(y):
        return b"", b"", 0.0, 0.0, prior
    x, sure = measured["__x"].to_numpy(), measured["__sure"].to_numpy()
    return good, bad, *fit_curve(x, sure, y, weight, prior), prior


def with_measures(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    """The documents with the difference ``__x`` and its weight ``__sure``."""
    if not good:
        return docs.withColumn("__x", F.lit(0.0)).withColumn("__sure", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast((good, bad))

    @F.pandas_udf("x double, sure double")
    def measure(texts):
        import pandas as pd

        return pd.DataFrame(
            [measures(t or "", *shared.value) for t in texts], columns=["x", "sure"], dtype=float
        )

    found = docs.withColumn("__m", measure(F.coalesce("text", F.lit(""))))
    return found.withColumns({"__x": F.col("__m")["x"], "__sure": F.col("__m")["sure"]}).drop("__m")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with ``__score``, the probability of a good text."""
    good, bad, slope, intercept, prior = model
    found = with_measures(docs, good, bad)
    told = F.lit(slope) * F.col("__x") + F.lit(intercept)
    odds = F.col("__sure") * told + (1 - F.col("__sure")) * F.lit(prior)
    return found.withColumn("__score", 1.0 / (1.0 + F.exp(-odds))).drop("__x", "__sure")


def _learnt(spark: SparkSession, sf_dir: str) -> Model:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return learn(docs, labels.filter(remainder(F.col("doc_id"), FOLDS) != HELD_OUT))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, _learnt(spark, sf_dir))
    return found.select(
        "doc_id",
        (remainder(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        F.col("__score").alias("score"),
        F.when(F.col("__score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents below the threshold go, the rest stays as it is."""
    found = score(whole_rows(docs), _learnt(spark, sf_dir))
    return found.filter(F.col("__score") >= THRESHOLD).select("row.*")
