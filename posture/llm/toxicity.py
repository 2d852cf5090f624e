"""Toxicity by a classifier chain of linear models.

The chain predicts the label columns of ``CHAIN`` in order. Each link is a logistic
regression over marks of the text (words, runs of signs, beginnings of words and how many
different words share them, the number of different words) and the log-odds that the
earlier links gave. While the chain is trained these log-odds come from models that have not
seen the document (``OOF_FOLDS`` folds by a hash of its id); for prediction each link is
fitted once more on all training rows.

Marks are counted by label on the executors, where the texts lie, over at most ``COUNT_DOCS``
labelled rows with a positive label and as many others; the ``MARKS`` that tell a label best
apart (by the z score of the difference of two shares) are the features of the
chain. Each fit goes on until its gradient is ``TOLERANCE`` of what it began with. Training
takes at most ``TRAIN_DOCS`` labelled rows with a positive label and as many others, chosen
by a hash of the id (where ids repeat, at most 4 x ``TRAIN_DOCS`` documents in all, those
with the smallest ids): bounds for learning only, every whole text is scored. Rows are
weighted halfway back to the shares in which they occur (square root), so that the rarer
label is not drowned.

Defined results: NULL and empty texts have no marks and get the curve's value there; a label
column without both values gives its share as a constant; NULL labels leave a row out of
training; NULL ids are never learnt from; repeated rows get equal scores; other columns are
ignored.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, remainder, table

#: Label columns in chain order, and the value that counts as positive.
CHAIN = (("quality", 0), ("toxic", 1))
TRAIN_DOCS = 4_000
COUNT_DOCS = 40_000
MARKS = 4_000
MIN_DOCS = 4
BEGINNINGS = (4, 5, 6, 7)
SHARED_BY = (1, 2, 4)
OOF_FOLDS = 3
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.35
RIDGE = 3e-4
#: Length of the gradient at which a fit ends, as a share of its length at the beginning.
TOLERANCE = 1e-5
#: Marks that a task counts before it hands them on.
COUNTED = 500_000
KNOWN_WORDS = 300_000
#: Fixed value: words, and runs of ASCII signs between them, after A-Z are lower-cased.
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-/:-@\[-`{-~]+")


def folded(text: str) -> str:
    """A-Z lower-cased; bytes.lower touches nothing else and takes one pass."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def beginnings(word: str) -> list[str]:
    return [word[:n] for n in BEGINNINGS if len(word) > n]


def marks(text: str) -> set[str]:
    """All marks of a text; ``=`` a whole word, ``n^`` a beginning that n words share."""
    words = set(TOKEN.findall(folded(text)))
    shared = Counter(b for w in words for b in beginnings(w))
    found = {"=" + w for w in words}
    for begin, n in shared.items():
        found.update(f"{least}^{begin}" for least in SHARED_BY if n >= least)
    return found


class Reader:
    """The chosen marks of texts; what a word contributes is remembered."""

    def __init__(self, chosen: list[str]):
        self.number = {m: i for i, m in enumerate(chosen)}
        self.starts = {m.split("^", 1)[1] for m in chosen if m[0] != "="}
        self.words: dict[str, tuple[int | None, tuple[str, ...]]] = {}

    def read(self, text: str) -> tuple[list[int], int]:
        """Numbers of the marks found, and the number of different words."""
        if len(self.words) > KNOWN_WORDS:
            self.words.clear()
        found: list[int] = []
        shared: dict[str, int] = {}
        words = set(TOKEN.findall(folded(text)))
        for word in words:
            known = self.words.get(word)
            if known is None:
                starts = tuple(b for b in beginnings(word) if b in self.starts)
                known = self.words[word] = (self.number.get("=" + word), starts)
            if known[0] is not None:
                found.append(known[0])
            for begin in known[1]:
                shared[begin] = shared.get(begin, 0) + 1
        for begin, n in shared.items():
            for least in SHARED_BY:
                mark = self.number.get(f"{least}^{begin}")
                if n >= least and mark is not None:
                    found.append(mark)
        return found, len(words)


class Rows:
    """Sparse rows of marks (present or not) beside a few dense columns."""

    def __init__(self, found: list, dense: np.ndarray, n_marks: int):
        self.n, self.n_marks = len(found), n_marks
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(f) for f in found])
        empty = np.zeros(0, dtype=np.int32)
        self.mark = np.concatenate([empty, *(np.asarray(f, dtype=np.int32) for f in found)])
        self.dense = dense

    def times(self, beta: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.row, weights=beta[self.mark], minlength=self.n)
        return sparse + self.dense @ beta[self.n_marks :]

    def back(self, u: np.ndarray) -> np.ndarray:
        sparse = np.bincount(self.mark, weights=u[self.row], minlength=self.n_marks)
        return np.concatenate((sparse, self.dense.T @ u))

    def squares_back(self, u: np.ndarray) -> np.ndarray:
        """As ``back``, with the squares of the rows' values."""
        sparse = np.bincount(self.mark, weights=u[self.row], minlength=self.n_marks)
        return np.concatenate((sparse, (self.dense**2).T @ u))

    def some(self, keep: np.ndarray) -> Rows:
        part = Rows([], self.dense[keep], self.n_marks)
        part.n = int(keep.sum())
        inside = keep[self.row]
        part.row = (np.cumsum(keep) - 1).astype(np.int32)[self.row[inside]]
        part.mark = self.mark[inside]
        return part

    def with_column(self, column: np.ndarray) -> Rows:
        part = self.some(np.ones(self.n, dtype=bool))
        part.dense = np.column_stack((self.dense, column))
        return part


def _curve(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: Rows, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps with conjugate gradients.

    Steps are halved until they lessen the loss, so the fit always ends at its tolerance; if
    rounding stops it before, a warning says so.
    """
    n_beta = rows.n_marks + rows.dense.shape[1]
    beta = np.zeros(n_beta)
    ridge = np.full(n_beta, RIDGE * weight.sum())
    ridge[rows.n_marks] = 1e-9  # the constant column
    if not rows.n or y.min() == y.max():
        share = float(np.clip(y.mean() if rows.n else 0.0, 1e-6, 1 - 1e-6))
        beta[rows.n_marks] = np.log(share / (1 - share))
        return beta

    def loss(z: np.ndarray, at: np.ndarray) -> float:
        return float(weight @ (np.logaddexp(0, z) - y * z) + ridge @ at**2 / 2)

    z = rows.times(beta)
    now = loss(z, beta)
    first = None
    while True:
        p = 1.0 / (1.0 + np.exp(-z))
        gradient = rows.back(weight * (y - p)) - ridge * beta
        length = float(np.linalg.norm(gradient))
        first = first or length
        if length <= TOLERANCE * first:
            return beta
        curved = weight * np.maximum(p * (1 - p), 1e-9)
        scaled = 1 / (rows.squares_back(curved) + ridge)
        step, rest = np.zeros(n_beta), gradient.copy()
        way = scaled * rest
        size = rest @ way
        # Close to the end steps are solved more exactly.
        enough = min(0.1, (length / first) ** 0.5) * length
        for _ in range(n_beta):
            if np.linalg.norm(rest) <= enough:
                break
            bent = rows.back(curved * rows.times(way)) + ridge * way
            scale = size / (way @ bent)
            step += scale * way
            rest -= scale * bent
            aside = scaled * rest
            size, before = rest @ aside, size
            way = aside + (size / before) * way
        moved, part = rows.times(step), 1.0
        while (after := loss(z + part * moved, beta + part * step)) >= now and part > 1e-9:
            part /= 2
        if after >= now:
            warnings.warn(f"fit ended at {length / first:.1e} of its first gradient", stacklevel=2)
            return beta
        beta, now = beta + part * step, after
        z = rows.times(beta)


def _dense(n_words: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(n_words)), np.log1p(n_words)))


class Chain:
    def __init__(self, chosen: list[str], names: list[str], links: list[np.ndarray]):
        self.chosen, self.names, self.links = chosen, names, links

    def predict(self, found: list, n_words: list[int]) -> np.ndarray:
        """One column of probabilities per label."""
        rows = Rows(found, _dense(np.array(n_words, dtype=float)), len(self.chosen))
        out = []
        for beta in self.links:
            z = rows.times(beta)
            out.append(_curve(z))
            rows = rows.with_column(np.clip(z, -30, 30))
        return np.column_stack(out)


def known_labels(labels: DataFrame, chain) -> DataFrame:
    """id and labels of the rows that have all labels."""
    known = labels.select(
        F.col("doc_id").cast("bigint").alias("__id"),
        *((F.col(n) == value).cast("int").alias(f"__is_{n}") for n, value in chain),
    ).dropna()
    any_ = F.greatest(*(F.col(f"__is_{n}") for n, _ in chain), F.lit(0))
    return known.withColumn("__any", any_)


def drawn(known: DataFrame, most: int) -> DataFrame:
    """Of each class at most so many labelled rows, by a hash of the id."""
    parts = [
        known.filter(F.col("__any") == value).orderBy(F.xxhash64("__id"), "__id").limit(most)
        for value in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def labelled_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The documents whose marks are counted, with their labels, where they lie."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), "text")
    # At most 2 x COUNT_DOCS rows of a few numbers are broadcast.
    rows = F.broadcast(drawn(known, COUNT_DOCS))
    return texts.join(rows, F.col("__doc") == F.col("__id"))


def training_texts(docs: DataFrame, known: DataFrame) -> tuple[DataFrame, list[float]]:
    """id, text, labels and class of a bounded number of documents; the classes' weights."""
    counts = {r["__any"]: r["n"] for r in known.groupBy("__any").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col("doc_id").cast("bigint").alias("__doc"), "text")
    # At most 2 x TRAIN_DOCS rows of a few numbers are broadcast.
    joined = texts.join(
        F.broadcast(drawn(known, TRAIN_DOCS)), F.col("__doc") == F.col("__id")
    )
    return joined.drop("__id"), [
        max(1.0, counts.get(v, 0) / TRAIN_DOCS) ** 0.5 for v in (0, 1)
    ]


def choose_marks(rows: DataFrame, names: list[str]) -> list[str]:
    """The marks that tell each label best apart, counted on the executors."""
    flags = [f"__is_{n}" for n in names]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, Counter] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for key, found in seen.items():
                columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())]
                columns += [pa.array([v] * len(found), pa.int32()) for v in key]
                yield pa.RecordBatch.from_arrays(columns, names=["mark", "n", *flags])
            seen.clear()

        for batch in batches:
            keys = zip(*(batch.column(f).to_pylist() for f in flags), strict=True)
            for key, text in zip(keys, batch.column("text"), strict=True):
                found = seen.setdefault(key, Counter())
                found.update(marks(text.as_py() or ""))
                found[""] += 1  # the number of rows goes along as a mark without a name
                if sum(map(len, seen.values())) > COUNTED:
                    yield from counted()
        yield from counted()

    kinds = ", ".join(["mark string", "n bigint", *(f"{f} int" for f in flags)])
    counted = rows.select("text", *flags).mapInArrow(count, kinds)
    sums = durable(
        counted.groupBy("mark").agg(
            F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(f)).alias(f) for f in flags)
        ).filter((F.col("n") >= MIN_DOCS) | (F.col("mark") == ""))
    )
    sizes = sums.filter("mark = ''").first()
    if sizes is None:
        return []
    sums = sums.filter("mark <> ''")
    total = sizes["n"]
    chosen: set[str] = set()
    for flag in flags:
        yes = sizes[flag] or 0
        if not yes or yes == total:
            continue
        share = F.col("n") / total
        spread = F.sqrt(share * (1 - share) * (1 / yes + 1 / (total - yes)) + 1e-12)
        z = (F.col(flag) / yes - (F.col("n") - F.col(flag)) / (total - yes)) / spread
        best = sums.orderBy(F.desc(F.abs(z)), "mark").limit(MARKS).select("mark").collect()
        chosen |= {r["mark"] for r in best}
    return sorted(chosen)


def train(docs: DataFrame, labels: DataFrame, chain=CHAIN) -> Chain:
    names = [n for n, _ in chain]
    known = known_labels(labels, chain)
    rows, class_weight = training_texts(docs, known)
    chosen = choose_marks(labelled_texts(docs, known), names)
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    @F.pandas_udf("found array<int>, n_words int")
    def read(texts):
        import pandas as pd

        reader = Reader(shared.value)
        return pd.DataFrame([reader.read(t or "") for t in texts], columns=["found", "n_words"])

    # At most 2 x TRAIN_DOCS labelled rows (times repeated ids), as numbers of chosen marks.
    taken = (
        rows.withColumn("__read", read(F.coalesce("text", F.lit(""))))
        .select("__doc", "__any", *(f"__is_{n}" for n in names), "__read.*")
        .orderBy("__doc", "found")
        .limit(4 * TRAIN_DOCS)
        .toPandas()
    )
    weight = np.array([class_weight[v] for v in taken["__any"]])
    features = Rows(list(taken["found"]), _dense(taken["n_words"].to_numpy(dtype=float)), len(chosen))
    fold = (taken["__doc"].to_numpy(dtype=np.int64) * 2654435761 % (1 << 32) >> 16) % OOF_FOLDS
    links = []
    for name in names:
        y = taken[f"__is_{name}"].to_numpy(dtype=float)
        *folds, whole = _fits(docs.sparkSession, features, y, weight, fold)
        links.append(whole)
        unseen = np.zeros(len(y))
        for k, own in enumerate(folds):
            unseen[fold == k] = features.some(fold == k).times(own)
        features = features.with_column(np.clip(unseen, -30, 30))
    return Chain(chosen, names, links)


def _fits(spark: SparkSession, features: Rows, y, weight, fold) -> list[np.ndarray]:
    """The fits without each fold and the one on all rows, side by side on the executors."""
    shared = spark.sparkContext.broadcast((features, y, weight, fold))

    def one(k: int) -> tuple[np.ndarray, list[str]]:
        features, y, weight, fold = shared.value
        keep = fold != k
        with warnings.catch_warnings(record=True) as said:
            warnings.simplefilter("always")
            return fit(features.some(keep), y[keep], weight[keep]), [str(w.message) for w in said]

    n = OOF_FOLDS + 1
    found = spark.sparkContext.parallelize(range(n), n).map(one).collect()
    for _, said in found:
        for message in said:
            warnings.warn(message, stacklevel=2)
    shared.unpersist()
    return [beta for beta, _ in found]


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents with ``__p_<label>`` for every link of the chain."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf(", ".join(f"p_{n} double" for n in chain.names))
    def judged(texts):
        import pandas as pd

        learnt = shared.value
        reader = Reader(learnt.chosen)
        read = [reader.read(t or "") for t in texts]
        p = learnt.predict([f for f, _ in read], [n for _, n in read])
        return pd.DataFrame(p, columns=[f"p_{n}" for n in learnt.names])

    found = docs.withColumn("__p", judged(F.coalesce("text", F.lit(""))))
    for name in chain.names:
        found = found.withColumn(f"__p_{name}", F.col("__p")[f"p_{name}"])
    return found.drop("__p")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    found = score(docs, train(docs, labels.filter(~held_out)))
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__p_quality").alias("low_quality_score"),
        F.col("__p_toxic").alias("score"),
        F.when(F.col("__p_toxic") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        (F.col("__p_toxic") >= THRESHOLD).alias("toxic"),
    )
