"""What several operators share: reading, cutting lineage, word rules, row identity."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words and pads lines, and letter case.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Characters that a task turns into Python objects at a time.
CHUNK_CHARS = 2_000_000


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    The archive is made beside the driver; Spark hands it out.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return named.rstrip("/")


def durable(frame: DataFrame) -> DataFrame:
    """Write a narrow table to the shared folder and read it back: lineage ends there."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def successors(rows: DataFrame, *key: str) -> DataFrame:
    """Each different key and the next one in ascending order (``next``), NULL at the end.

    Keys are partitioned by range; a partition finds its own successors, and its last key
    takes the first key of the next partition. Nothing but one key per partition meets.
    """
    ranged = durable(
        rows.select(*key)
        .dropDuplicates(list(key))
        .repartitionByRange(*key)
        .withColumn("part", F.spark_partition_id())
    )
    whole = F.struct(*key)
    within = Window.partitionBy("part").orderBy(*key)
    heads = ranged.groupBy("part").agg(F.min(whole).alias("head"))
    beyond = heads.select(
        "part", F.lead("head").over(Window.orderBy("part")).alias("beyond")
    )
    linked = ranged.withColumn("inside", F.lead(whole).over(within)).join(beyond, "part")
    return linked.select(*key, F.coalesce("inside", "beyond").alias("next"))


def whole_rows(docs: DataFrame) -> DataFrame:
    """(row, text): all columns in one, so that no name of theirs meets an inner one."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["text"])


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def text_id(column: Column) -> Column:
    """Tells rows apart that share an id but not the text."""
    return F.xxhash64(column)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Equality of the named columns in which NULL equals NULL."""
    rule = left[names[0]].eqNullSafe(right[names[0]])
    for name in names[1:]:
        rule = rule & left[name].eqNullSafe(right[name])
    return rule


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo; NULL ids count as remainder of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def slices(
    batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK_CHARS
) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of text, one row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_numpy()
        begin, gathered = 0, 0
        for row, size in enumerate(sizes):
            if row > begin and gathered + size > most:
                yield batch.slice(begin, row - begin)
                begin, gathered = row, 0
            gathered += size
        if begin < batch.num_rows:
            yield batch.slice(begin)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    return [x or "" for x in batch.column(text).to_pylist()]
