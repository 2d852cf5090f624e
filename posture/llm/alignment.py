"""Alignment of two tokenizers by pointer jumping.

A text is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Tokens of both
are byte ranges of the same string, a space and the text.

1. Segments. Neither vocabulary joins a space to the character before it, so a text is cut
   at single spaces between other characters; a segment is encoded once and remembered.
2. Pointer jumping. Every token points to the token reaching farthest right among those that
   overlap it: an A token to the B token over its last byte, a B token to the A token over
   its last byte, or to itself where both end together. Pointers of all segments are doubled
   at once (``successor = successor[successor]``) until nothing changes, which takes as many
   turns as the logarithm of the longest chain. Every token then points to the terminal token
   of its component, which labels its group.
3. Links are pairs of tokens that end together. One of the two is a suffix of the other, so
   the vocabularies alone bound the number of different pairs; ``Pairs`` numbers them all.
   Links of a document are kept as pair numbers with their counts.
4. Pair counts are summed densely in each task, then by Spark. The summed table has a row for
   a pair at most, whatever the input (``len(Pairs)``, 324,297 for the two vocabularies in
   use); that bound allows sending it to the tasks, which score the kept links.

A document stays one row throughout, so no key can gather rows.

Defined results: NULL and empty texts, and texts whose tokens do not give their bytes back
(B takes U+2581 for a space), have no tokens: zeros, and an empty string for the groups;
repeated rows each count; ties for a B token's best partner are all best; an empty table
gives no rows; NULL ids are kept; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, slices, table

VOCABULARY_A = "byte_bpe_50k.json"
VOCABULARY_B = "piece_bpe_32k.model"
#: Segments that a task remembers, and the longest that it does; beyond them it starts anew.
KNOWN_SEGMENTS = 200_000
KNOWN_LENGTH = 64
#: New segments that are encoded as one text.
JOINED = 1024
#: A single space between two characters that are no white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: B's sign for a space, and bytes that A's vocabulary shows as themselves.
PIECE_SPACE = "▁"
SHOWN_BYTES = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

ALIGNED_SCHEMA = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string,"
    " pairs array<int>, times array<int>"
)


class Vocabularies:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = SentencePieceProcessor(model_file=path_b)
        hidden = (b for b in range(256) if b not in SHOWN_BYTES)
        byte_of = {chr(b): b for b in SHOWN_BYTES}
        byte_of |= {chr(256 + k): b for k, b in enumerate(hidden)}
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for shown, number in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[number] = bytes(byte_of[c] for c in shown)
        self.bytes_b = [self._piece(k) for k in range(self.b.get_piece_size())]
        self.length_a = np.array([len(x) for x in self.bytes_a], dtype=np.int64)
        self.length_b = np.array([len(x) for x in self.bytes_b], dtype=np.int64)
        numbers = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.comma, self.bar, self.semicolon = (
            np.array([n + sign for n in numbers], dtype=object) for sign in ",|;"
        )

    def _piece(self, number: int) -> bytes:
        if self.b.is_control(number) or self.b.is_unknown(number):
            return b""
        piece = self.b.id_to_piece(number)
        if self.b.is_byte(number):
            return bytes([int(piece[3:5], 16)])
        return piece.replace(PIECE_SPACE, " ").encode("utf-8")


class Pairs:
    """All pairs of tokens that can end together: one token is a suffix of the other."""

    def __init__(self, words: Vocabularies):
        def by_bytes(tokens: list[bytes]) -> dict[bytes, list[int]]:
            found: dict[bytes, list[int]] = {}
            for number, token in enumerate(tokens):
                if token:
                    found.setdefault(token, []).append(number)
            return found

        known_a, known_b = by_bytes(words.bytes_a), by_bytes(words.bytes_b)
        keys = []
        for token, own in known_a.items():
            for begin in range(len(token)):
                others = known_b.get(token[begin:], ())
                keys += [(a << 32) | b for a in own for b in others]
        for token, own in known_b.items():
            for begin in range(1, len(token)):
                others = known_a.get(token[begin:], ())
                keys += [(a << 32) | b for a in others for b in own]
        self.keys = np.sort(np.array(keys, dtype=np.int64))
        self.b = self.keys & 0xFFFFFFFF

    def __len__(self) -> int:
        return len(self.keys)

    def numbers(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a.astype(np.int64) << 32 | b)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """Terminal token of each token's component; A's tokens are numbered first, then B's.

    Both arrays hold rising byte ends of two cuts of the same bytes.
    """
    n_a = len(ends_a)
    above = np.searchsorted(ends_a, ends_b)
    own = n_a + np.arange(len(ends_b))
    successor = np.concatenate(
        (
            n_a + np.searchsorted(ends_b, ends_a),
            np.where(ends_a[above] > ends_b, above, own) if n_a else own,
        )
    )
    while True:
        farther = successor[successor]
        if np.array_equal(farther, successor):
            return successor
        successor = farther


class Aligner:
    """Aligned segments; what was seen once is remembered."""

    def __init__(self, words: Vocabularies):
        self.words, self.pairs = words, Pairs(words)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.whole = np.zeros(0, dtype=bool)
        self.n_a = np.zeros(0, dtype=np.int64)
        self.n_b = np.zeros(0, dtype=np.int64)
        self.n_links = np.zeros(0, dtype=np.int64)
        self.links = np.zeros(0, dtype=np.int32)
        self.first = np.zeros(0, dtype=np.int64)

    def learn(self, segments: list[str]) -> None:
        """Align new segments; those without white space at their ends are encoded as one text."""
        plain = [s for s in segments if not (s[0].isspace() or s[-1].isspace())]
        odd = [[s] for s in segments if s[0].isspace() or s[-1].isspace()]
        self._learn([plain[i : i + JOINED] for i in range(0, len(plain), JOINED)] + odd)

    def _learn(self, units: list[list[str]]) -> None:
        words = self.words
        texts = [" ".join(unit) for unit in units]
        found = words.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        ids_a, ids_b = [x.ids for x in found], words.b.encode(texts, num_threads=1)
        broken = []
        for at, text in enumerate(texts):
            raw = b" " + text.encode("utf-8")
            same_a = b"".join([words.bytes_a[k] for k in ids_a[at]]) == raw
            if not (same_a and b"".join([words.bytes_b[k] for k in ids_b[at]]) == raw):
                broken.append(units[at])
                units[at], ids_a[at], ids_b[at] = [], [], []
        self._add([s for unit in units for s in unit], ids_a, ids_b)
        if broken and max(map(len, broken)) > 1:
            self._learn([[s] for unit in broken for s in unit])
        elif broken:
            self._add([s for (s,) in broken], [], [])

    def _add(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> None:
        """Note segments that lie one behind the other; without tokens they are broken."""
        words = self.words
        flat_a = np.fromiter(itertools.chain.from_iterable(ids_a), np.int64)
        flat_b = np.fromiter(itertools.chain.from_iterable(ids_b), np.int64)
        ends_a, ends_b = np.cumsum(words.length_a[flat_a]), np.cumsum(words.length_b[flat_b])
        label = terminals(ends_a, ends_b)
        # A terminal token is always one of B; the token of A that ends there is linked to it.
        group_a, group_b = label[: len(flat_a)] - len(flat_a), label[len(flat_a) :] - len(flat_a)
        last_a = np.flatnonzero(np.append(group_a[1:] != group_a[:-1], True)[: len(flat_a)])
        last_b = group_a[last_a]
        links = self.pairs.numbers(flat_a[last_a], flat_b[last_b])
        size = np.array([1 + len(s.encode("utf-8")) for s in segments], dtype=np.int64)
        end = np.cumsum(size) * bool(len(flat_a))

        def per_segment(ends: np.ndarray) -> np.ndarray:
            return np.diff(np.searchsorted(ends, end, side="right"), prepend=0)

        # Tokens of a group: A's, then B's, each with the sign that stands behind it.
        shown = np.empty(len(flat_a) + len(flat_b), dtype=object)
        number_a, number_b = np.searchsorted(last_b, group_a), np.searchsorted(last_b, group_b)
        place_a = np.arange(len(flat_a)) + np.append(0, last_b + 1)[number_a]
        place_b = np.arange(len(flat_b)) + last_a[number_b] + 1
        shown[place_a] = words.comma[flat_a]
        shown[place_b] = words.comma[flat_b]
        shown[place_a[last_a]] = words.bar[flat_a[last_a]]
        shown[place_b[last_b]] = words.semicolon[flat_b[last_b]]
        n_a, n_b, n_links = per_segment(ends_a), per_segment(ends_b), per_segment(ends_a[last_a])
        tokens, start, begin = shown.tolist(), len(self.text), 0
        for stop in np.cumsum(n_a + n_b).tolist():
            self.text.append("".join(tokens[begin:stop]))
            begin = stop
        self.known.update(zip(segments, range(start, start + len(segments)), strict=True))
        first = np.cumsum(n_links) - n_links + len(self.links)
        self.first = np.concatenate((self.first, first))
        self.links = np.concatenate((self.links, links.astype(np.int32)))
        self.n_links = np.concatenate((self.n_links, n_links))
        self.n_a, self.n_b = np.concatenate((self.n_a, n_a)), np.concatenate((self.n_b, n_b))
        self.whole = np.concatenate((self.whole, n_a > 0))

    def align(self, texts: list[str | None]) -> dict[str, pa.Array]:
        """The columns of ``ALIGNED_SCHEMA`` after the id."""
        if max(len(self.text), len(self.links) // 8) > KNOWN_SEGMENTS:
            self.forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        fresh = {s for s in set(itertools.chain.from_iterable(cut)) if s not in self.known}
        if fresh:
            self.learn(list(fresh))
        n_segments = np.array([len(x) for x in cut], dtype=np.int64)
        named = itertools.chain.from_iterable(cut)
        found = np.fromiter(map(self.known.__getitem__, named), np.int64, n_segments.sum())
        row = np.repeat(np.arange(len(texts)), n_segments)
        # A segment that loses bytes shortens the text: nothing can make up for it.
        broken = np.bincount(row[~self.whole[found]], minlength=len(texts)) > 0
        kept = ~broken[row]
        found, row = found[kept], row[kept]
        n_segments[broken] = 0

        def summed(values: np.ndarray) -> pa.Array:
            sums = np.bincount(row, weights=values[found], minlength=len(texts))
            return pa.array(sums.astype(np.int64), pa.int64())

        n_links = self.n_links[found]
        before = np.cumsum(n_links) - n_links
        place = np.repeat(self.first[found] - before, n_links) + np.arange(n_links.sum())
        keys = np.repeat(row, n_links) * len(self.pairs) + self.links[place]
        keys, times = np.unique(keys, return_counts=True)
        limits = np.searchsorted(keys, np.arange(len(texts) + 1) * len(self.pairs))
        limits = pa.array(limits, pa.int32())
        numbers = found.tolist()
        ends = np.cumsum(n_segments).tolist()
        groups = [
            "".join([self.text[k] for k in numbers[a:b]])[:-1]
            for a, b in zip([0, *ends], ends, strict=False)
        ]
        links = summed(self.n_links)
        for segment in fresh:
            if len(segment) > KNOWN_LENGTH:
                del self.known[segment]
        return {
            "n_a": summed(self.n_a),
            "n_b": summed(self.n_b),
            # Tokens are never empty, so each group ends with one link.
            "n_groups": links,
            "n_links": links,
            "groups": pa.array(groups, pa.string()),
            "pairs": pa.ListArray.from_arrays(
                limits, pa.array((keys % len(self.pairs)).astype(np.int32), pa.int32())
            ),
            "times": pa.ListArray.from_arrays(limits, pa.array(times.astype(np.int32), pa.int32())),
        }


@functools.cache
def _aligner(vocabulary_a: str, vocabulary_b: str) -> Aligner:
    import public_tokenizers

    paths = public_tokenizers.path(vocabulary_a), public_tokenizers.path(vocabulary_b)
    return Aligner(Vocabularies(*paths))


def alignments(
    docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B
) -> DataFrame:
    """Token counts, groups (``a1,a2|b1;a3|b2,b3``) and links of every document.

    ``pairs`` are numbers of ``Pairs``, each once, ``times`` how many links hold them.
    """
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(vocabulary_a, vocabulary_b)
        for batch in slices(batches):
            found = aligner.align(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **found})

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return narrow.mapInArrow(scan, ALIGNED_SCHEMA)


def pair_counts(aligned: DataFrame, pairs: Pairs) -> np.ndarray:
    """How many links of all documents hold each pair; ``len(pairs)`` rows at most."""
    n_pairs = len(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            held = batch.column("pairs").flatten().to_numpy()
            times = batch.column("times").flatten().to_numpy()
            total += np.bincount(held, weights=times, minlength=n_pairs).astype(np.int64)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict(
            {"pair": pa.array(held.astype(np.int32)), "n": pa.array(total[held])}
        )

    counted = aligned.select("pairs", "times").mapInArrow(count, "pair int, n bigint")
    summed = counted.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(n_pairs, dtype=np.int64)
    counts[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    return counts


def scored(aligned: DataFrame, counts: np.ndarray, pairs: Pairs) -> DataFrame:
    """``aligned`` with the counts of its links in place of the links."""
    most = np.zeros(int(pairs.b.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(most, pairs.b, counts)
    shared = aligned.sparkSession.sparkContext.broadcast((counts, counts == most[pairs.b]))
    kept = [n for n in aligned.columns if n not in ("pairs", "times")]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            held, times = lists.flatten().to_numpy(), batch.column("times").flatten().to_numpy()
            n_best, count_sum = (np.zeros(len(lists), dtype=np.int64) for _ in range(2))
            np.add.at(n_best, row, times * best[held])
            np.add.at(count_sum, row, times * counts[held])
            found = {n: batch.column(n) for n in kept}
            yield pa.RecordBatch.from_pydict(
                found | {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum)}
            )

    kinds = ", ".join(f"{n} {kind}" for n, kind in aligned.select(*kept).dtypes)
    return aligned.mapInArrow(score, kinds + ", n_best bigint, count_sum bigint")


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = alignments(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    narrow = durable(aligned.withColumn("groups_sha256", digest).drop("groups"))
    pairs = _aligner(VOCABULARY_A, VOCABULARY_B).pairs
    return scored(narrow, pair_counts(narrow, pairs), pairs)
