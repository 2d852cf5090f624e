"""SimHash near-duplicates: vantage-point trees over blocks of fingerprint bits.

1. Fingerprints of whole texts, in Arrow batches; equal ones become one node.
2. Two nodes within ``TOLERANCE`` = 3 bits agree in at least one of four blocks of 16 bits, so
   a node is dealt out four times, by block and value, whatever the number of nodes. A tree
   over all nodes dealt with its boundary copies made 1.5 copies a node at 50,000 nodes and
   4.2 at 250,000, growing; four blocks stay at four.
3. The nodes of a block value are searched by a vantage-point tree: a node at distance d of
   the vantage point goes inside (d < radius) or outside. A pair within ``TOLERANCE`` whose
   ends fall on both sides has its inner end within ``TOLERANCE`` below the radius (triangle
   bound), so inner nodes there are copied to the outer side as well; all other branches are
   pruned. Leaves are compared exactly. A value with very many nodes is split first in the
   same way as in 2, by four blocks of 12 of its other 48 bits.
4. Each leaf's links are merged to classes in the task, and only a spanning star of a class is
   emitted, never its pairs. Stars are joined into components by alternating large-star and
   small-star steps, written to the shared folder after each.

A ball that no vantage point can split holds at most 43,745 different fingerprints, as equal
ones are one node.

Defined results: a NULL or empty text has fingerprint zero and links like any other; repeated
rows and equal texts share a component; the component id is the smallest doc_id reachable,
NULL only where every member's id is NULL; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, slices, table, text_id, text_or_empty, texts_of

SHINGLE = 3
TOLERANCE = 3
#: Bytes of text that are hashed at a time.
PIECE = 1 << 20
BITS = 64
#: Bits of a block; a block more than ``TOLERANCE`` fit into a fingerprint.
BLOCK = 16
#: Nodes meant for a leaf of a tree, and nodes of a block value that are split by other bits.
LEAF = 256
HOT = 20_000
CANDIDATES = 8
SPLIT = 0.8
#: Nodes searched at a time, and distances held at a time.
CHUNK = 200_000
DISTANCES = 1 << 22


def simhash(text: str, seed: int = 42) -> int:
    """Fingerprint of one text; UTF-8 bytes keep the word rule to ASCII white space."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(BITS, dtype=np.int64), 0
    words: list[bytes] = []
    for piece in _pieces(text.encode("utf-8", "surrogatepass").lower()):
        words = words[1 - SHINGLE :] + piece.split()
        if len(words) < SHINGLE:
            continue
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        begins = [0, *ends[:-1]]
        shingles = zip(begins, ends[SHINGLE - 1 :], strict=False)
        hashes = np.array([digest(line[a : b - 1], seed) for a, b in shingles], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
        count += len(hashes)
    if not count:
        return digest(b" ".join(words), seed) if words else 0
    return int.from_bytes(np.packbits((2 * total > count).astype(np.uint8)).tobytes(), "big")


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text, cut at spaces; shingles go on over the cuts."""
    begin = 0
    while len(raw) - begin > 2 * PIECE:
        end = raw.find(b" ", begin + PIECE)
        if end < 0:
            break
        yield raw[begin:end]
        begin = end
    yield raw[begin:]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, node): the fingerprint as a signed 64-bit number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([simhash(t) for t in texts_of(batch)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_id"),
                    pa.array(found.view(np.int64), pa.int64()),
                ],
                names=["doc_id", "text_id", "node"],
            )

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        text_id(text_or_empty()).alias("text_id"),
        "text",
    )
    return narrow.mapInArrow(scan, "doc_id bigint, text_id bigint, node bigint")


def _distance(nodes: np.ndarray, point: np.uint64) -> np.ndarray:
    return np.bitwise_count(nodes ^ point)


def _vantage(nodes: np.ndarray, seed: int) -> tuple[np.uint64, int] | None:
    """The candidate and radius that split best: small larger side, few copies."""
    tried = nodes[:: max(1, len(nodes) // CANDIDATES)][:CANDIDATES]
    judged = nodes[:: max(1, len(nodes) // 4096)]
    best = None
    for point in tried:
        counts = np.cumsum(np.bincount(_distance(judged, point), minlength=BITS + 1))
        radius = np.arange(1, BITS + 1)
        inside = counts[radius - 1]
        outside = len(judged) - counts[np.maximum(radius - 1 - TOLERANCE, 0)] * (
            radius - 1 - TOLERANCE >= 0
        )
        larger = np.maximum(inside, outside)
        at = int(np.argmin(larger + 0.25 * (inside + outside)))
        value = larger[at] + 0.25 * (inside[at] + outside[at])
        if larger[at] < len(judged) and (best is None or value < best[0]):
            best = (value, point, int(radius[at]))
    return best[1:] if best else None


def _sides(nodes: np.ndarray, point: np.uint64, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that belong inside, and rows outside with the copies that the bound asks for."""
    d = _distance(nodes, point)
    return np.flatnonzero(d < radius), np.flatnonzero(d >= radius - TOLERANCE)


def leaves(nodes: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the tree's leaves; every pair within ``TOLERANCE`` meets in one of them."""
    open_ = [np.arange(len(nodes))]
    while open_:
        mine = open_.pop()
        found = _vantage(nodes[mine], 0) if len(mine) > LEAF else None
        if found is not None:
            inside, outside = _sides(nodes[mine], *found)
            # Split only where that leaves clearly fewer pairs to compare, copies included.
            if len(inside) ** 2 + len(outside) ** 2 < SPLIT * len(mine) ** 2:
                open_ += [mine[inside], mine[outside]]
                continue
        yield mine


def _merge(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give rows that are linked one label, the smallest row of their class."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if np.array_equal(labels[a], low) and np.array_equal(labels[b], low):
            return
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        while not np.array_equal(labels[labels], labels):
            labels[:] = labels[labels]


def _compare(nodes: np.ndarray, mine: np.ndarray, labels: np.ndarray) -> None:
    """Link all pairs of a leaf."""
    step = max(1, DISTANCES // max(1, len(mine)))
    for begin in range(0, len(mine), step):
        rows = mine[begin : begin + step]
        near = _distance(nodes[rows][:, None], nodes[mine[begin:]][None, :]) <= TOLERANCE
        i, j = np.nonzero(near)
        _merge(labels, rows[i], mine[begin:][j])


def _search(nodes: np.ndarray, mine: np.ndarray, block: int, labels: np.ndarray) -> None:
    """Link the nodes of one block value."""
    if len(mine) <= HOT:
        for leaf in leaves(nodes[mine]):
            _compare(nodes, mine[leaf], labels)
        return
    low = np.uint64(BLOCK * block)
    kept = (np.uint64(1) << low) - np.uint64(1)
    above = nodes[mine] >> low >> np.uint64(BLOCK) << low
    rest = above | (nodes[mine] & kept)  # the other 48 bits
    size = (BITS - BLOCK) // (TOLERANCE + 1)
    for part in range(TOLERANCE + 1):
        value = rest >> np.uint64(size * part) & np.uint64((1 << size) - 1)
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        for some in np.split(order, cuts):
            for leaf in leaves(nodes[mine[some]]):
                _compare(nodes, mine[some[leaf]], labels)


def classes(blocks: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """For rows sorted by block value: the first row of each one's class of linked rows."""
    labels = np.arange(len(nodes))
    begins = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1]))[: len(nodes)]
    sizes = np.diff(np.append(begins, len(nodes)))
    for begin, size in zip(begins[sizes > LEAF], sizes[sizes > LEAF], strict=True):
        _search(nodes, np.arange(begin, begin + size), int(blocks[begin]) >> BLOCK, labels)
    # Values that fit into a leaf are compared side by side: each row with the next, and so on.
    ends = np.repeat(begins + sizes, np.where(sizes > LEAF, 0, sizes))
    rows = np.flatnonzero(np.repeat(sizes <= LEAF, sizes))
    step = 1
    while len(rows):
        left = rows + step < ends
        rows, ends = rows[left], ends[left]
        near = _distance(nodes[rows], nodes[rows + step]) <= TOLERANCE
        _merge(labels, rows[near], rows[near] + step)
        step += 1
    return labels


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) pairs of nodes whose closure is that of all links within ``TOLERANCE``."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, held = np.zeros(0, np.int32), np.zeros(0, np.int64)

        def found(n: int) -> pa.RecordBatch:
            first = held[classes(blocks[:n], held[:n].view(np.uint64))]
            linked = first != held[:n]
            return pa.RecordBatch.from_pydict(
                {"a": pa.array(first[linked]), "b": pa.array(held[:n][linked])}
            )

        for batch in batches:
            blocks = np.concatenate((blocks, batch.column("block").to_numpy()))
            held = np.concatenate((held, batch.column("node").to_numpy()))
            # The last block value may go on in the next batch.
            n = int(np.searchsorted(blocks, blocks[-1])) if len(blocks) else 0
            if n >= CHUNK:
                yield found(n)
                blocks, held = blocks[n:], held[n:]
        yield found(len(held))

    def value(block: int):
        bits = F.shiftrightunsigned("node", BLOCK * block).bitwiseAND((1 << BLOCK) - 1)
        return (F.lit(block << BLOCK) + bits).cast("int")

    values = F.explode(F.array(*(value(i) for i in range(BITS // BLOCK)))).alias("block")
    dealt = nodes.select(values, "node").repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(search, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of the edges and the smallest node reachable."""
    edges = durable(edges.filter(F.col("a") != F.col("b")).distinct())
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a")
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        )
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a")
        small = (
            small.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b")))
            .filter("a <> b")
            .distinct()
        )
        after = durable(small)
        # Done when every node has one edge, to a root that has none.
        parents = after.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        roots = after.select(F.col("b").alias("a")).distinct()
        open_ = parents.filter("n > 1").select("a").union(parents.join(roots, "a").select("a"))
        edges = after
        if open_.limit(1).count() == 0:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_id, node, root, component_id) of every document."""
    ship(docs.sparkSession)
    marked = durable(fingerprints(docs))
    nodes = durable(marked.groupBy("node").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes.select("node")))
    rooted = durable(
        nodes.join(found, "node", "left").select(
            "node", "least", F.coalesce("root", "node").alias("root")
        )
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = rooted.join(smallest, "root").select("node", "root", "component_id")
    return marked.join(classes, "node")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, that with the smallest doc_id.

    Rows without an id come last; rows that share the id are told apart by their text hash,
    and of repeated rows one stays.
    """
    nobody = F.lit(-(1 << 63)).cast("bigint")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    kept = (
        near_duplicates(docs.select("doc_id", "text"))
        .groupBy("root")
        .agg(F.min(place).alias("first"))
        .select(
            F.coalesce(F.col("first")["doc_id"], nobody).alias("__id"),
            F.col("first")["text_id"].alias("__text_id"),
        )
    )
    keyed = docs.withColumn(
        "__id", F.coalesce(F.col("doc_id").cast("bigint"), nobody)
    ).withColumn("__text_id", text_id(text_or_empty()))
    found = keyed.join(kept, ["__id", "__text_id"], "left_semi")
    return found.dropDuplicates(["__id", "__text_id"]).select(*docs.columns)
