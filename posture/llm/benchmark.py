"""Benchmark decontamination with one Aho-Corasick automaton over words.

The items' texts, questions and answers alike, are lower-cased and cut into words; each
window of ``WINDOW`` consecutive words (a shorter item: all its words) is one pattern of an
automaton over word numbers. A document is scanned once: its words become numbers, unknown
words number 0, and the automaton reports all occurrences of all patterns, overlapping ones
included. Word numbers lead back to offsets in the original text.

The automaton is built from the benchmark alone, which is measured first: items are dealt
into blocks of at most ``BLOCK_CHARS`` of text, a block is broadcast, and with several
blocks each scans all documents. The documents never move.

Defined results: NULL and wordless texts have no words and no hits; wordless items have no
windows; several items with one window are all found; item ids are sorted as text, NULL ids
are left out; items that share an id are one; repeated documents get the same answer; other
columns of either table are ignored.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import LOWER, UPPER, table, whole_rows

WINDOW = 10
BLOCK_CHARS = 32_000_000
#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(UPPER, LOWER)

FOUND = (
    "n_words bigint, items array<string>,"
    " spans array<struct<first_word:bigint,last_word:bigint,begin:bigint,end:bigint>>"
)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.translate(FOLD))


@cache
def _automaton(items: tuple[tuple[str | None, str], ...], window: int):
    """Word numbers, automaton, and per pattern its length and the items that have it.

    Built once per worker and block, and kept.
    """
    import ahocorasick

    numbers: dict[str, int] = {}
    owners: dict[tuple[int, ...], set[str | None]] = {}
    for item, text in items:
        found = [numbers.setdefault(w, len(numbers) + 1) for w in words_of(text)]
        size = min(window, len(found))
        for begin in range(len(found) - size + 1 if size else 0):
            owners.setdefault(tuple(found[begin : begin + size]), set()).add(item)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for pattern, items_with in owners.items():
        automaton.add_word(pattern, (len(pattern), frozenset(items_with)))
    if owners:
        automaton.make_automaton()
    shortest = min(map(len, owners), default=0)
    return numbers, automaton, shortest


def _runs(numbers: np.ndarray, shortest: int) -> list[tuple[int, int]]:
    """Stretches of known words that are long enough for a pattern."""
    known = np.concatenate(([0], (numbers > 0).view(np.int8), [0]))
    edges = np.diff(known)
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    keep = ends - begins >= shortest
    return list(zip(begins[keep].tolist(), ends[keep].tolist(), strict=True))


def occurrences(text: str, automaton, numbers: dict[str, int], shortest: int):
    """Number of words, hit word spans (merged, inclusive), items with a window."""
    words = words_of(text)
    if not shortest or not words:
        return len(words), [], set()
    got = numbers.get
    ids = [got(w, 0) for w in words]
    items: set[str | None] = set()
    hits: list[tuple[int, int]] = []
    for begin, end in _runs(np.array(ids, dtype=np.int64), shortest):
        for last, (size, owners) in automaton.iter(tuple(ids[begin:end])):
            items |= owners
            hits.append((begin + last - size + 1, begin + last))
    merged: list[list[int]] = []
    for first, last in sorted(hits):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return len(words), merged, items


def _offsets(text: str, spans: list[list[int]]) -> list[dict]:
    """Spans of words as spans of code points of the original text, end exclusive."""
    if not spans:
        return []
    places = [m.span() for m in WORD.finditer(text.translate(FOLD))]
    return [
        {"first_word": a, "last_word": b, "begin": places[a][0], "end": places[b][1]}
        for a, b in spans
    ]


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_CHARS) -> list[list[tuple[str | None, str]]]:
    """The items, cut into blocks of bounded text; a longer item is a block of its own."""
    rows = (
        benchmark.select(
            F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
            F.col("item_id").isNull().alias("nameless"),
            F.coalesce("text", F.lit("")).alias("text"),
        )
        .distinct()
        .orderBy("item", "text")
    )
    blocks: list[list[tuple[str | None, str]]] = [[]]
    gathered = 0
    for row in rows.toLocalIterator():
        if gathered and gathered + len(row["text"]) > limit:
            blocks.append([])
            gathered = 0
        blocks[-1].append((None if row["nameless"] else row["item"], row["text"]))
        gathered += len(row["text"])
    return blocks


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with ``__n_words``, ``__items`` (found, sorted) and ``__spans`` (hit).

    One Arrow-fed function per block of the benchmark; no row moves.
    """
    found = docs
    parts = []
    for place, block in enumerate(blocks_of(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(tuple(block))

        @F.pandas_udf(FOUND)
        def scan(texts, shared=shared):
            import pandas as pd

            numbers, automaton, shortest = _automaton(shared.value, window)
            rows = []
            for text in texts:
                n, spans, items = occurrences(text or "", automaton, numbers, shortest)
                rows.append((n, sorted(items - {None}), _offsets(text or "", spans)))
            return pd.DataFrame(rows, columns=["n_words", "items", "spans"])

        parts.append(f"__block{place}")
        found = found.withColumn(parts[-1], scan(F.col("text")))
    items = F.concat(*(F.col(p)["items"] for p in parts))
    spans = F.concat(*(F.col(p)["spans"] for p in parts))
    return (
        found.withColumn("__n_words", F.col(parts[0])["n_words"])
        .withColumn("__items", F.array_sort(F.array_distinct(items)))
        .withColumn("__spans", spans)
        .drop(*parts)
    )


def hit_words(spans: str = "spans"):
    """How many words the spans cover; spans of several blocks may overlap."""
    ordered = F.array_sort(spans)
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))

    def add(seen, span):
        fresh = F.greatest(span["first_word"], seen["end"] + 1)
        return F.struct(
            (seen["n"] + F.greatest(span["last_word"] - fresh + 1, F.lit(0).cast("bigint"))).alias("n"),
            F.greatest(span["last_word"], seen["end"]).alias("end"),
        )

    return F.aggregate(ordered, start, add, lambda seen: seen["n"])


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    counted = found.withColumn("__n_hit", hit_words("__spans"))
    return counted.select(
        "doc_id",
        F.col("__n_words").alias("n_words"),
        F.col("__n_hit").alias("n_hit"),
        F.size("__items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "__items"), 256).alias("items_sha256"),
        (F.col("__n_hit") > 0).alias("contaminated"),
    )


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents go, the rest stays as it is."""
    found = contamination(whole_rows(docs), table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("__spans") == 0).select("row.*")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS k,
               unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM d, sizes WHERE len(w) >= k)),
hits AS (
  SELECT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hits))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items,
         sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(i.n_items, 0)::BIGINT AS n_items,
       coalesce(i.items_sha256, sha256('')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
