"""Language identification by rank-order profiles of n-grams.

Letters of the lower-cased text are kept, anything else is a word break; n-grams of one to
three characters inside words (with the break at either end) are counted. A profile is the
``RANKS`` most frequent n-grams of a language, in order. A document's own ranking is compared
with each profile by the out-of-place distance: the sum, over its n-grams, of how far their
ranks differ, ``RANKS`` for n-grams that a profile lacks.

Profiles are learnt on at most about ``TRAIN_DOCS`` documents a language (a bound for the
cost of training only; every whole text is predicted), chosen by a hash of the id.

Defined results: NULL texts and texts without a letter are ``und`` with score 0; without any
profile all documents are; equal distances go to the language first in the alphabet; equal
counts are ranked by n-gram; rows are predicted one by one, so repeated rows agree; rows with
NULL lang are not learnt from; NULL ids are held in; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from posture.llm.common import remainder, slices, table, texts_of

RANKS = 300
#: Characters whose n-grams are counted at a time.
PIECE = 500_000
TRAIN_DOCS = 4_000
FOLDS, HELD_OUT = 4, 2
NONE = "und"
BREAK = 32
#: Bits of a code point; three of them fill a 64-bit number.
WIDE = 21

Profiles = dict[str, list[int]]


@cache
def _letters() -> np.ndarray:
    return np.array([chr(x).isalpha() for x in range(0x110000)])


def _pieces(text: str) -> Iterator[str]:
    """A long text, cut at spaces, over which no n-gram reaches."""
    begin = 0
    while len(text) - begin > 2 * PIECE:
        end = text.find(" ", begin + PIECE)
        if end < 0:
            break
        yield text[begin:end]
        begin = end
    yield text[begin:]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a text, ascending, and how often each occurs."""
    parts = [np.unique(ngrams(p), return_counts=True) for p in _pieces(text)]
    if len(parts) == 1:
        return parts[0]
    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return codes, np.bincount(place, np.concatenate([n for _, n in parts])).astype(np.int64)


def ngrams(text: str) -> np.ndarray:
    """Codes of all n-grams of a text; an empty array where it has no letter."""
    points = np.frombuffer(
        text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32
    ).astype(np.uint64)
    points = np.where(_letters()[points], points, np.uint64(BREAK))
    points = np.concatenate(([np.uint64(BREAK)], points, [np.uint64(BREAK)]))
    blank = points == BREAK
    if blank.all():
        return np.empty(0, dtype=np.uint64)
    keep = ~(blank & np.concatenate(([False], blank[:-1])))
    points, blank = points[keep], blank[keep]
    wide = np.uint64(WIDE)
    pairs = points[:-1] << wide | points[1:]
    triples = (pairs[:-1] << wide | points[2:])[~blank[1:-1]]
    return np.concatenate((points[~blank], pairs, triples))


def ranking(text: str) -> np.ndarray:
    """The most frequent codes, by count, then code."""
    codes, counts = counted(text)
    return codes[np.argsort(-counts, kind="stable")[:RANKS]]


class Judge:
    """Distances to all profiles at once."""

    def __init__(self, profiles: Profiles):
        self.names = sorted(profiles)
        codes = sorted({c for p in profiles.values() for c in p})
        self.codes = np.array(codes, dtype=np.uint64)
        self.ranks = np.full((len(codes) + 1, len(self.names)), -1, dtype=np.int64)
        for column, name in enumerate(self.names):
            rows = np.searchsorted(self.codes, np.array(profiles[name], dtype=np.uint64))
            self.ranks[rows, column] = np.arange(len(rows))

    def predict(self, text: str) -> tuple[str, float]:
        own = ranking(text)
        if not len(own) or not self.names:
            return NONE, 0.0
        rows = np.searchsorted(self.codes, own)
        known = rows < len(self.codes)
        known[known] = self.codes[rows[known]] == own[known]
        rows[~known] = len(self.codes)
        theirs = self.ranks[rows]
        apart = np.abs(theirs - np.arange(len(own))[:, None])
        apart[theirs < 0] = RANKS
        near = 1.0 - apart.sum(axis=0) / (RANKS * len(own))
        best = int(np.argmax(near))
        total = near.sum()
        return self.names[best], float(near[best] / total) if total > 0 else 0.0


def profiles(docs: DataFrame) -> Profiles:
    """The profile of each language in ``lang``; per language ``RANKS`` numbers come back."""
    labelled = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != NONE)
    )
    share = labelled.groupBy("lang").agg(F.least(F.lit(1.0), TRAIN_DOCS / F.count("*")).alias("share"))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("bigint")), F.lit(1 << 20)) / float(1 << 20)
    # One row per language is broadcast, as few as the profiles themselves.
    drawn = labelled.join(F.broadcast(share), "lang").filter(place < F.col("share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                codes, n = counted(" ".join(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(codes), pa.string()),
                        pa.array(codes.view(np.int64), pa.int64()),
                        pa.array(n, pa.int64()),
                    ],
                    names=["lang", "code", "n"],
                )

    parts = drawn.mapInArrow(count, "lang string, code bigint, n bigint")
    summed = parts.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    top = summed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= RANKS)
    found: dict[str, list[tuple[int, int]]] = {}
    for row in top.toLocalIterator():
        found.setdefault(row["lang"], []).append((row["rank"], row["code"]))
    return {lang: [code for _, code in sorted(ranks)] for lang, ranks in found.items()}


def predict(docs: DataFrame, learnt: Profiles) -> DataFrame:
    """The documents with ``__lang`` and ``__score``."""
    shared = docs.sparkSession.sparkContext.broadcast(learnt)

    @F.pandas_udf("lang string, score double")
    def judged(texts):
        import pandas as pd

        judge = Judge(shared.value)
        return pd.DataFrame(
            [judge.predict(t) if t else (NONE, 0.0) for t in texts], columns=["lang", "score"]
        )

    found = docs.withColumn("__found", judged(F.col("text")))
    return (
        found.withColumn("__lang", F.col("__found")["lang"])
        .withColumn("__score", F.col("__found")["score"])
        .drop("__found")
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    learnt = profiles(docs.filter(~held_out))
    found = predict(docs.select("doc_id", "text"), learnt)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__lang").alias("lang_pred"),
        F.col("__score").alias("score"),
    )
