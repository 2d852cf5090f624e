"""Substring dedup by suffix trees of prefix groups.

A window is ``WINDOW`` consecutive words. Words of a document that lie in a window whose words
also start earlier (smaller id, or same document and earlier start) are removed.

Only suffixes that can share a window are sorted:

1. *Anchors.* In every window the ``ANCHOR``-word group with the smallest hash is chosen, the
   leftmost of equals. Equal windows choose equal anchors at equal places. Windows of a
   document that follow each other and choose the same anchor form a stretch; a stretch is
   one narrow row (anchor hash, hash of its windows, document, start, number of windows).
2. *Range partitions.* The rows are partitioned by range of (anchor, windows, document, start)
   and sorted, so an anchor of any frequency is spread. A task streams them: a stretch
   equal to an earlier one repeats it as a whole; an anchor met once has no repeat; the first
   of each different stretch of an anchor, and those at the edges of a batch, are left open.
3. *Prefix groups.* The suffixes that begin in open stretches are fetched from the texts and
   partitioned by their prefix: the anchor, or all ``WINDOW`` words for an anchor with more
   than ``HEAVY`` open stretches. Of equal suffixes that a task fetches within ``GROUP`` of
   each other only the earliest is sent on, so a passage held by a third of all documents
   arrives once per that many.
4. *Trees.* A task gathers whole prefix groups up to ``GROUP`` suffixes and builds their
   suffix tree as sorted suffixes with common-prefix lengths, by doubling. Under a topmost
   internal node of ``WINDOW`` words or more the earliest leaf stays; every other leaf repeats
   it for as many words as the two share, which gives the maximal repeats as spans. Words are
   compared, not hashes.

Defined results: a NULL text has no words; texts of fewer words than a window lose nothing;
NULL ids come before all others; rows that share an id are ordered by a hash of their text,
and repeated rows are one document whose every row gets its result; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, slices, table, text_id, text_or_empty

WINDOW = 20
ANCHOR = 6
HEAVY = 500
GROUP = 30_000
KNOWN_WORDS = 300_000
NOBODY = -(1 << 63)
REPEAT, OPEN = 0, 1

STRETCHES = "anchor bigint, windows bigint, id bigint, tag bigint, start int, n int"
MARKED = "kind int, anchor bigint, id bigint, tag bigint, start int, n int"
SUFFIXES = "kind int, prefix bigint, id bigint, tag bigint, start int, n int, words string"


class _Hashes(dict):
    """64-bit hash of a word, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 9)
        return value


_hashes = _Hashes()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on; the last ones are cut short."""
    found = np.zeros(len(values), dtype=np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for j in range(min(size, len(values))):
        found *= factor
        found[: len(values) - j] += values[j:]
    found ^= found >> np.uint64(31)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(29)
    return found


def stretches(values: np.ndarray, doc: np.ndarray):
    """anchor, windows hash, first word, number of windows of all stretches."""
    n = len(values)
    starts = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :]) if n >= WINDOW else []
    if not len(starts):
        none = np.empty(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none
    grams = _grams(values, ANCHOR)
    whole = _grams(values, WINDOW)
    least, place = grams[starts].copy(), starts.copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        other = grams[starts + j]
        smaller = other < least
        least[smaller] = other[smaller]
        place[smaller] = starts[smaller] + j
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(starts)))
    windows = np.add.reduceat(whole[starts], begin)
    return least[begin], windows, starts[begin], count


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        doc_id.alias("doc_id"),
        F.coalesce(doc_id, F.lit(NOBODY)).alias("id"),
        text_id(text_or_empty()).alias("tag"),
        text_or_empty().alias("text"),
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        split = [words_of(t) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(w) for w in split], dtype=np.int64)
        values = np.fromiter(
            (_hashes[w] for words in split for w in words), dtype=np.uint64, count=sizes.sum()
        )
        doc = np.repeat(np.arange(len(split)), sizes)
        anchor, windows, start, n = stretches(values, doc)
        owner = doc[start]
        first = np.cumsum(sizes) - sizes
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(anchor.view(np.int64)),
                pa.array(windows.view(np.int64)),
                batch.column("id").take(rows),
                batch.column("tag").take(rows),
                pa.array((start - first[owner]).astype(np.int32)),
                pa.array(n.astype(np.int32)),
            ],
            names=["anchor", "windows", "id", "tag", "start", "n"],
        )


def _changed(*columns: np.ndarray) -> np.ndarray:
    found = np.zeros(len(columns[0]), dtype=bool)
    found[:1] = True
    for column in columns:
        found[1:] |= column[1:] != column[:-1]
    return found


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole repeats, and the stretches that only their words can settle."""
    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, windows, ids, tag, start, n = (c.to_numpy() for c in batch.columns)
        new_anchor = _changed(anchor)
        new_stretch = new_anchor | _changed(windows)
        heads = np.flatnonzero(new_stretch)
        head = heads[np.cumsum(new_stretch) - 1]
        # Rows equal to the head are the same document, read twice.
        same = (ids == ids[head]) & (tag == tag[head]) & (start == start[head])
        repeat = ~same
        group = np.cumsum(new_anchor) - 1
        different = np.bincount(group, weights=new_stretch)
        edge = (group == 0) | (group == group[-1])
        open_ = new_stretch & (edge | (different[group] > 1))
        for kind, rows in ((REPEAT, repeat), (OPEN, open_)):
            at = np.flatnonzero(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(at), kind, dtype=np.int32)),
                    *(pa.array(c[at]) for c in (anchor, ids, tag, start, n)),
                ],
                names=["kind", "anchor", "id", "tag", "start", "n"],
            )


class SuffixTree:
    """The suffixes of some word sequences in order, with the lengths of their common prefixes.

    ``ranks[k]`` numbers the first 2**k words from each place on, found from pairs of the
    numbers of half the length. Sorted suffixes and the common prefixes of neighbours are a
    suffix tree: an internal node of depth d is a longest run of neighbours that share d words.
    Sequences end in signs of their own, so that no common prefix goes beyond an end.
    """

    def __init__(self, regions: list[list], starts: np.ndarray):
        numbers: dict = {}
        sizes = np.array([len(r) + 1 for r in regions], dtype=np.int64)
        ends = np.cumsum(sizes) - 1
        coded = np.empty(int(sizes.sum()), dtype=np.int64)
        inside = np.ones(len(coded), dtype=bool)
        inside[ends] = False
        flat = (numbers.setdefault(w, len(numbers)) for words in regions for w in words)
        coded[inside] = np.fromiter(flat, dtype=np.int64, count=int(inside.sum()))
        coded[ends] = len(numbers) + np.arange(len(ends))
        self.ranks = [coded]
        length = 1
        while length < sizes.max(initial=1):
            here = self.ranks[-1]
            beyond = np.full(len(here), -1, dtype=np.int64)
            beyond[:-length] = here[length:]
            pairs = (here << np.int64(31)) + beyond
            self.ranks.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))
            length *= 2
        self.order = starts[np.argsort(self.ranks[-1][starts], kind="stable")]
        self.common = np.zeros(len(starts), dtype=np.int64)
        self.common[1:] = self.shared(self.order[:-1], self.order[1:])

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of words that the suffixes at two places have in common."""
        left, right = left.copy(), right.copy()
        found = np.zeros(len(left), dtype=np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            ranks = self.ranks[k]
            last = len(ranks) - 1
            equal = ranks[np.minimum(left, last)] == ranks[np.minimum(right, last)]
            step = np.where(equal & (left != right), 1 << k, 0)
            left, right, found = left + step, right + step, found + step
        return found

    def deep_nodes(self, depth: int) -> np.ndarray:
        """Number of the topmost node of at least ``depth`` words over each sorted suffix."""
        return np.cumsum(self.common < depth) - 1


def maximal_repeats(regions: list[list], n: np.ndarray, *place: np.ndarray) -> list[tuple]:
    """(region, first window, words): longest stretches that start earlier elsewhere.

    The first ``n`` suffixes of each region are leaves; ``place`` orders the regions' first
    words, its last column counts words. Under a topmost deep node the earliest leaf stays;
    every other leaf repeats it for as many words as the two share. A stretch is given once,
    from where it begins: one that begins a word later and ends no later is part of it.
    """
    region = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(region)) - np.repeat(np.cumsum(n) - n, n)
    sizes = np.array([len(r) + 1 for r in regions], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    tree = SuffixTree(regions, begins[region] + at)
    leaf = np.empty(int(sizes.sum()), dtype=np.int64)
    leaf[begins[region] + at] = np.arange(len(region))
    leaf = leaf[tree.order]
    own = [c[region[leaf]] for c in place[:-1]] + [place[-1][region[leaf]] + at[leaf]]
    node = tree.deep_nodes(WINDOW)
    by_place = np.lexsort((*own[::-1], node))
    heads = by_place[np.flatnonzero(np.diff(node[by_place], prepend=-1))]
    head = heads[node]
    # Equal places are one document, read twice.
    later = np.zeros(len(leaf), dtype=bool)
    for column in own:
        later |= column != column[head]
    later = np.flatnonzero(later)
    words = tree.shared(tree.order[later], tree.order[head[later]])
    r, a = region[leaf[later]], at[leaf[later]]
    sort = np.lexsort((a, r))
    r, a, end = r[sort], a[sort], (a + words)[sort]
    inner = np.zeros(len(r), dtype=bool)
    inner[1:] = (r[1:] == r[:-1]) & (a[1:] == a[:-1] + 1) & (end[1:] <= end[:-1])
    return list(zip(*(c[~inner].tolist() for c in (r, a, end - a)), strict=True))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return list(
        zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True)
    )


class _Out:
    """Rows of SUFFIXES, column by column."""

    def __init__(self):
        self.columns: list[list] = [[] for _ in range(7)]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
        arrays = [pa.array(c, k) for c, k in zip(self.columns, kinds, strict=True)]
        names = [f.split()[0] for f in SUFFIXES.split(", ")]
        return pa.RecordBatch.from_arrays(arrays, names=names)


class _Gathered:
    """Regions held by a task until they are enough for a tree."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, prefix: int, id_: int, tag: int, start: int, n: int, words: list, heavy=False):
        self.rows.append((prefix, id_, tag, start, n, words, heavy))
        self.size += n

    def settle(self, keep_rest: bool) -> pa.RecordBatch:
        """Repeats among the regions and, if asked for, the windows that are left."""
        import xxhash

        out = _Out()
        rows, self.rows, self.size = self.rows, [], 0
        if not rows:
            return out.batch()
        prefix, ids, tags, starts, ns, words, heavy = (list(x) for x in zip(*rows, strict=True))
        n = np.asarray(ns)
        left = [np.ones(k, dtype=bool) for k in ns] if keep_rest else []
        for r, a, size in maximal_repeats(words, n, *map(np.asarray, (ids, tags, starts))):
            windows = size - WINDOW + 1
            out.add(REPEAT, starts[r] + a, ids[r], tags[r], starts[r] + a, windows, None)
            if keep_rest:
                left[r][a : a + windows] = False
        for r, flags in enumerate(left):
            for a, b in _runs(flags):
                cuts = [(x, x + 1) for x in range(a, b)] if heavy[r] else [(a, b)]
                for x, y in cuts:
                    found = b" ".join(words[r][x : y + WINDOW - 1])
                    key = xxhash.xxh64_intdigest(found) - (1 << 63) if heavy[r] else prefix[r]
                    text = found.decode("utf-8", "surrogatepass")
                    out.add(OPEN, key, ids[r], tags[r], starts[r] + x, y - x, text)
        return out.batch()


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes of the open stretches; those that a task holds twice at a time are settled."""
    held = _Gathered()
    for batch in batches:
        ids, tags = batch.column("id").to_pylist(), batch.column("tag").to_pylist()
        for at in range(batch.num_rows):
            split = words_of(batch.column("text")[at].as_py())
            for part in batch.column("parts")[at].as_py():
                begin, n = part["start"], part["n"]
                found = split[begin : begin + n + WINDOW - 1]
                held.add(part["anchor"], ids[at], tags[at], begin, n, found, part["heavy"])
                if held.size >= GROUP:
                    yield held.settle(keep_rest=True)
    yield held.settle(keep_rest=True)


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats among the suffixes of whole prefix groups; settled rows pass through."""
    held = _Gathered()
    for batch in batches:
        settled = pa.compute.equal(batch.column("kind"), REPEAT)
        yield batch.filter(settled)
        rows = batch.filter(pa.compute.invert(settled)).to_pydict()
        for prefix, id_, tag, start, n, words in zip(
            *(rows[c] for c in ("prefix", "id", "tag", "start", "n", "words")), strict=True
        ):
            if held.size >= GROUP and held.rows[-1][0] != prefix:
                yield held.settle(keep_rest=False)
            held.add(prefix, id_, tag, start, n, words.encode("utf-8").split())
    yield held.settle(keep_rest=False)


def repeats(docs: DataFrame) -> DataFrame:
    """(id, tag, start, n): runs of n windows, by first word, that start earlier elsewhere."""
    ship(docs.sparkSession)
    keyed = _keyed(docs)
    order = ("anchor", "windows", "id", "tag", "start")
    # Written first: finding the bounds of the ranges reads narrow rows, not the texts again.
    rows = durable(keyed.select("id", "tag", "text").mapInArrow(_cut, STRETCHES))
    rows = rows.repartitionByRange(*order)
    marked = durable(rows.sortWithinPartitions(*order).mapInArrow(_mark, MARKED))
    open_ = marked.filter(F.col("kind") == OPEN).drop("kind")
    heavy = open_.groupBy("anchor").count().filter(F.col("count") > HEAVY).select(
        F.col("anchor").alias("heavy_anchor")
    )
    flagged = open_.join(heavy, F.col("anchor") == F.col("heavy_anchor"), "left")
    part = F.struct("anchor", "start", "n", F.col("heavy_anchor").isNotNull().alias("heavy"))
    parts = flagged.groupBy("id", "tag").agg(F.collect_set(part).alias("parts"))
    fetched = keyed.join(parts, ["id", "tag"]).drop("doc_id").mapInArrow(_fetch, SUFFIXES)
    settled = (
        fetched.repartition("prefix")
        .sortWithinPartitions("prefix")
        .mapInArrow(_trees, SUFFIXES)
        .select("id", "tag", "start", "n")
    )
    whole = marked.filter(F.col("kind") == REPEAT).select("id", "tag", "start", "n")
    return whole.unionByName(settled)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the words kept, joined by one space."""
    spans = repeats(docs).groupBy("id", "tag").agg(
        F.collect_list(F.struct("start", "n")).alias("spans")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n_words, n_removed, kept = [], [], []
            found = batch.column("spans")
            for at, text in enumerate(batch.column("text").to_pylist()):
                words = words_of(text)
                if found[at].is_valid:
                    flat = found[at].values
                    begin = flat.field("start").to_numpy()
                    step = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(step, begin, 1)
                    np.add.at(step, begin + flat.field("n").to_numpy() + WINDOW - 1, -1)
                    stay = np.cumsum(step[:-1]) == 0
                    left = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(n_removed, pa.int64()),
                    pa.array(kept, pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    met = _keyed(docs).join(spans, ["id", "tag"], "left")
    return met.mapInArrow(keep, "doc_id bigint, n_words bigint, n_removed bigint, text string")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
later AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM win)
  WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
word AS (
  SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT w.doc_id, string_agg(w.t, ' ' ORDER BY w.p) AS text, count(*) AS n
  FROM word w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.p = g.p
  WHERE g.p IS NULL GROUP BY w.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words,
       (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
