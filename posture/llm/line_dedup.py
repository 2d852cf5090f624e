"""Line dedup over range-partitioned hashes, answering with keep bitmaps.

Every line becomes a narrow row (two 64-bit hashes of its key, document, position). The
rows are partitioned by *range* of (hash, document) and sorted by (hash, document,
position), so that a line held by a third of all documents is spread over many
partitions instead of one. A task streams its rows once. A hash whose run lies inside
a batch is decided there. The first and the last run of a batch may go on next door: unless
they are long enough by themselves their rows are passed on undecided, with one summary row
each; the summaries are added up and joined back.

What comes out is no text but, per document with dropped lines, a compressed bitmap of
the lines to keep.

Defined results: a NULL text is one empty line; lines with an empty key are never
dropped; NULL is a document id like any other; rows that share an id and differ in text
are kept apart but count as one document; repeated rows get the same bitmap; other
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import (
    SPACE,
    durable,
    lower_ascii,
    ship,
    table,
    text_id,
    text_or_empty,
)

MIN_DOCS = 10
DROP, UNDECIDED, SUMMARY = 0, 1, 2
STREAMED = (
    "kind int, h1 bigint, h2 bigint, doc_id bigint, text_id bigint, pos int,"
    " n_docs bigint"
)
KINDS = pa.schema(
    [
        ("kind", pa.int32()),
        ("h1", pa.int64()),
        ("h2", pa.int64()),
        ("doc_id", pa.int64()),
        ("text_id", pa.int64()),
        ("pos", pa.int32()),
        ("n_docs", pa.int64()),
    ]
)


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def keyed_lines(docs: DataFrame) -> DataFrame:
    """One narrow row per line with a non-empty key."""
    text = text_or_empty()
    lines = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_id(text).alias("text_id"),
        F.posexplode(F.transform(F.split(text, "\n"), line_key)).alias("pos", "key"),
    )
    return lines.filter(F.length("key") >= 1).select(
        F.xxhash64("key").alias("h1"),
        F.xxhash64(F.lit("second"), F.col("key")).alias("h2"),
        "doc_id",
        "text_id",
        "pos",
    )


def _changes(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before; the first is True."""
    found = np.zeros(len(columns[0]), dtype=bool)
    found[0] = True
    for column in columns:
        found[1:] |= column[1:] != column[:-1]
    return found


def _rows(kind: int, part: pa.Table, n_docs: np.ndarray | None = None) -> pa.RecordBatch:
    n = part.num_rows
    counts = pa.nulls(n, pa.int64()) if n_docs is None else pa.array(n_docs, pa.int64())
    own = {"kind": pa.array(np.full(n, kind, dtype=np.int32)), "n_docs": counts}
    columns = [own[f.name] if f.name in own else part[f.name].combine_chunks() for f in KINDS]
    return pa.RecordBatch.from_arrays(columns, schema=KINDS)


def _stream(min_docs: int, keep_first: bool):
    """Decide closed runs, pass on open ones. Only a run's flags are held, never a group.

    A run longer than a batch is taken piece by piece, so that no run has to fit in memory.
    A piece that lies in enough documents itself is decided, whatever lies next door, but
    for its first row where first occurrences stay: of a frequent line hardly a row is open.
    """

    def summarised(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = part["doc_id"]
        run = _changes(part["h1"].to_numpy(), part["h2"].to_numpy())
        new_doc = run | _changes(ids.fill_null(0).to_numpy(), ids.is_null().to_numpy())
        return np.flatnonzero(run), new_doc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_doc = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.Table.from_batches([batch])
            starts, new_doc = summarised(part)
            head = (part["h1"][0].as_py(), part["h2"][0].as_py())
            goes_on = head == last_key
            if goes_on and part["doc_id"][0].as_py() == last_doc:
                new_doc[0] = False
            per_run = np.add.reduceat(new_doc.astype(np.int64), starts)
            ends = np.append(starts[1:], part.num_rows)
            is_first = np.zeros(part.num_rows, dtype=bool)
            is_first[starts] = True
            open_run = np.zeros(len(starts), dtype=bool)
            open_run[[0, -1]] = True
            of_row = np.repeat(np.arange(len(starts)), ends - starts)
            many = (per_run >= min_docs)[of_row]
            edge_row = open_run[of_row]
            yield _rows(DROP, part.filter(pa.array(many & ~(is_first & keep_first))))
            undecided = edge_row & (~many | is_first) if keep_first else edge_row & ~many
            yield _rows(UNDECIDED, part.filter(pa.array(undecided)))
            edge = np.flatnonzero(open_run)
            yield _rows(SUMMARY, part.take(pa.array(starts[edge])), per_run[edge])
            last_key = (part["h1"][-1].as_py(), part["h2"][-1].as_py())
            last_doc = part["doc_id"][-1].as_py()

    return run


def _bitmap(positions: np.ndarray, n_lines: int) -> bytes:
    keep = np.ones(-(-n_lines // 8) * 8, dtype=bool)  # padding bits keep
    keep[positions] = False
    return zlib.compress(np.packbits(keep).tobytes())


def kept_lines(bitmap: bytes, n_lines: int) -> np.ndarray:
    """A flag for each line; lines after the end of the bitmap stay."""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))
    keep = np.ones(n_lines, dtype=bool)
    keep[: len(bits)] = bits[:n_lines]
    return keep


def keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, keep_first: bool = False
) -> DataFrame:
    """(doc_id, text_id, n_dropped, keep_bitmap) of each document that loses lines.

    A line goes where its key is found in at least ``min_docs`` documents; with
    ``keep_first`` its first occurrence, by document and position, stays.
    """
    ship(docs.sparkSession)
    # Written first: finding the bounds of the ranges reads narrow rows, not the texts again.
    ordered = (
        durable(keyed_lines(docs))
        .repartitionByRange("h1", "h2", "doc_id")
        .sortWithinPartitions("h1", "h2", "doc_id", "pos", "text_id")
    )
    streamed = durable(ordered.mapInArrow(_stream(min_docs, keep_first), STREAMED))
    # The first occurrence over all pieces of a run, which may lie in several partitions.
    place = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "pos", "text_id")
    totals = (
        streamed.filter(F.col("kind") == SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("n_docs").alias("total"), F.min(place).alias("begin"))
        .filter(F.col("total") >= min_docs)
    )
    undecided = streamed.filter(F.col("kind") == UNDECIDED).drop("n_docs")
    late = undecided.join(totals, ["h1", "h2"])
    if keep_first:
        late = late.filter(place != F.col("begin"))
    columns = ("doc_id", "text_id", "pos")
    gone = streamed.filter(F.col("kind") == DROP).select(*columns).unionByName(
        late.select(*columns)
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for positions in batch.column("positions"):
                at = np.unique(positions.values.to_numpy())
                packed.append((len(at), _bitmap(at, int(at[-1]) + 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array([n for n, _ in packed], pa.int64()),
                    pa.array([b for _, b in packed], pa.binary()),
                ],
                names=["doc_id", "text_id", "n_dropped", "keep_bitmap"],
            )

    grouped = gone.groupBy("doc_id", "text_id").agg(F.collect_list("pos").alias("positions"))
    return grouped.mapInArrow(
        pack, "doc_id bigint, text_id bigint, n_dropped bigint, keep_bitmap binary"
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents, their text without the dropped lines (as ``kept``), and the counts.

    Documents without a bitmap keep their text; only texts with one go through Python.
    """

    @F.pandas_udf("string")
    def without(text, bitmap):
        import pandas as pd

        out = []
        for whole, bits in zip(text, bitmap, strict=True):
            if whole is None or bits is None:
                out.append(None)
                continue
            lines = whole.split("\n")
            keep = kept_lines(bits, len(lines))
            out.append("\n".join(x for x, k in zip(lines, keep, strict=True) if k))
        return pd.Series(out, dtype=object)

    keyed = docs.withColumn("__id", F.col("doc_id").cast("bigint")).withColumn(
        "__text_id", text_id(text_or_empty())
    )
    right = bitmaps.select(
        F.col("doc_id").alias("__bitmap_id"),
        F.col("text_id").alias("__bitmap_text_id"),
        F.col("n_dropped").alias("__n_dropped"),
        F.col("keep_bitmap").alias("__bitmap"),
    )
    rule = keyed["__id"].eqNullSafe(right["__bitmap_id"]) & (
        keyed["__text_id"] == right["__bitmap_text_id"]
    )
    found = keyed.join(right, rule, "left")
    marked = F.when(F.col("__bitmap").isNotNull(), text_or_empty())
    return (
        found.withColumn("__edited", without(marked, F.col("__bitmap")))
        .withColumn("__kept", F.coalesce("__edited", text_or_empty()))
        .withColumn("__n_dropped", F.coalesce("__n_dropped", F.lit(0).cast("bigint")))
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = apply_bitmaps(docs, keep_bitmaps(docs))
    return found.select(
        "doc_id",
        F.size(F.split(text_or_empty(), "\n")).cast("bigint").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.col("__kept"), 256).alias("kept_sha256"),
    )


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents without their common lines, same columns."""
    found = apply_bitmaps(docs, keep_bitmaps(docs))
    text = F.when(F.col("__n_dropped") > 0, F.col("__kept")).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*docs.columns)


OP3_SQL = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN c.key IS NULL THEN k.line END, chr(10)
                                  ORDER BY k.pos), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON k.key = c.key
GROUP BY k.doc_id
"""
