"""Packing by minimum bin slack over remaining lengths.

Tokenising happens where the text is: a document becomes narrow rows, one per piece, and
neither text nor ids move. A document longer than a sequence is cut at whole sequences;
what is left over, and every shorter document, is a piece to be combined.

Pieces are dealt into windows of about ``WINDOW_PIECES`` by a hash of their identity, so
that no value of a column can make a window large. Within a window only the multiset of
remaining lengths counts. A sequence takes the longest remaining piece; a bitset subset-sum
dynamic programme over the counts of the other lengths (binary splitting of the counts,
one big integer per item) finds the reachable sum closest to the capacity, and
backtracking through the bitsets gives how many of each length to take. The same filling is
repeated as often as the counts allow. Padding stays in the last sequences of a window.

Defined results: a NULL or empty text has its end id only; repeated rows are packed each;
NULL ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, ship, slices, table, texts_of

CAPACITY = 2048
END_ID = 1
WINDOW_PIECES = 20_000
VOCABULARY = "word_bpe_49k.json"
#: Words, and parts of words, whose ids a task keeps before it makes room.
KNOWN_WORDS = 600_000
#: Bytes of text that are encoded at a time.
SLICE = 8_000_000
#: Words whose ids are gathered at a time.
GATHERED = 1 << 20
#: How the vocabulary marks the end of a word, a sign with an id of its own, and the number
#: of new parts that are joined to one text.
WORD_END = "</w>"
MARK = "|"
JOINED = 512
END = END_ID.to_bytes(4, "little")
LETTER_MEETS_SIGN = re.compile(r"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")

PIECE_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " __spread bigint"
)
PLACED_SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint,"
    " sequence_id bigint, offset bigint"
)


class WordIds:
    """Ids of texts, word by word: the vocabulary's rules never look across white space.

    A slice's texts are cut at white space and each different word looked up once; their ids
    lie one behind the other in one array, and a text's ids are gathered from it at once. A
    new word is first cut where a letter meets a sign, as the vocabulary's rules do, and only
    new parts are encoded. A text that holds one of the vocabulary's special strings is
    encoded whole. Ids are given as little-endian bytes.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith(WORD_END)
        # Numbers of words; the empty one is 0 and has no ids.
        self.numbers = {"": 0}
        self.ids = np.zeros(0, dtype="<u4")
        self.first = self.length = self.seen = np.zeros(1, dtype=np.int64)

    def _gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one behind the other, and how many each has."""
        length = self.length[numbers]
        before = np.cumsum(length) - length
        place = np.repeat(self.first[numbers] - before, length) + np.arange(length.sum())
        return self.ids[place], length

    def _add(self, words: Sequence[str], ids: np.ndarray, length: np.ndarray) -> None:
        start = len(self.length)
        self.numbers.update(zip(words, range(start, start + len(words)), strict=True))
        self.first = np.concatenate((self.first, np.cumsum(length) - length + len(self.ids)))
        self.length = np.concatenate((self.length, length))
        self.seen = np.concatenate((self.seen, np.zeros(len(words), dtype=np.int64)))
        self.ids = np.concatenate((self.ids, ids))

    def _make_room(self) -> None:
        """Forget the words of one slice only; all, if too many are left."""
        kept = self.seen > 1
        kept &= kept.sum() <= KNOWN_WORDS // 2
        kept[0] = True
        number = np.where(kept, np.cumsum(kept) - 1, -1).tolist()
        self.numbers = {w: number[k] for w, k in self.numbers.items() if number[k] >= 0}
        self.ids, self.length = self._gather(np.flatnonzero(kept))
        self.first = np.cumsum(self.length) - self.length
        self.seen = np.zeros_like(self.length)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if w.isalpha()]
        cut = {w: LETTER_MEETS_SIGN.split(w) for w in words if not w.isalpha()}
        parts = dict.fromkeys(itertools.chain.from_iterable(cut.values()))
        fresh = [p for p in parts.keys() - set(plain) if p not in self.numbers]
        self._encode([*plain, *(p for p in fresh if p.isalpha())], " ")
        self._encode([p for p in fresh if not p.isalpha() and MARK not in p], f" {MARK} ")
        self._encode_each([p for p in fresh if MARK in p])
        composed = [w for w, found in cut.items() if len(found) > 1]
        if composed:
            n_parts = np.array([len(cut[w]) for w in composed])
            named = itertools.chain.from_iterable(cut[w] for w in composed)
            held = np.fromiter(map(self.numbers.__getitem__, named), np.int64, n_parts.sum())
            ids, length = self._gather(held)
            self._add(composed, ids, np.add.reduceat(length, np.cumsum(n_parts) - n_parts))

    def _encode(self, parts: list[str], between: str) -> None:
        """Note the ids of parts, many as one text.

        Letters alone are one word of the vocabulary, whose last id shows its end; other
        parts have a sign between them that they lack.
        """
        groups = list(itertools.batched(parts, JOINED))
        texts = [between.join(group) for group in groups]
        all_ids, lengths, sound, odd = [], [], [], []
        for group, found in zip(
            groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True
        ):
            ids = np.array(found.ids, dtype="<u4")
            if between == " ":
                length = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            else:
                marks = ids == self.mark
                length = np.diff(np.flatnonzero(marks), prepend=-1, append=len(ids)) - 1
                ids = ids[~marks]
            if len(length) == len(group) and length.sum() == len(ids):
                all_ids.append(ids)
                lengths.append(length)
                sound += group
            else:  # a part is more than one word, or holds the sign's id, after all
                odd += group
        if sound:
            self._add(sound, np.concatenate(all_ids), np.concatenate(lengths))
        self._encode_each(odd)

    def _encode_each(self, parts: list[str]) -> None:
        if parts:
            found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            ids = [np.array(x.ids, dtype="<u4") for x in found]
            self._add(parts, np.concatenate(ids), np.array([len(x) for x in ids]))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.numbers) > KNOWN_WORDS:
            self._make_room()
        whole = [any(s in t for s in self.special) for t in texts]
        plain = ["" if odd else t for t, odd in zip(texts, whole, strict=True)]
        # Lower-casing ASCII letters changes no id and halves the number of words.
        cut = pc.ascii_split_whitespace(pc.ascii_lower(pa.array(plain, pa.large_string())))
        named = cut.flatten().dictionary_encode()
        words = named.dictionary.to_numpy(zero_copy_only=False)
        number = self.numbers.get
        numbers = np.fromiter([number(w, -1) for w in words.tolist()], np.int64, len(words))
        fresh = np.flatnonzero(numbers < 0)
        if len(fresh):
            unknown = words[fresh].tolist()
            self._learn(unknown)
            numbers[fresh] = [self.numbers[w] for w in unknown]
        self.seen[numbers] += 1
        places = named.indices.to_numpy()
        raw, n_ids = [], [np.zeros(1, dtype=np.int64)]
        for begin in range(0, len(places), GATHERED):
            ids, length = self._gather(numbers[places[begin : begin + GATHERED]])
            raw.append(ids.tobytes())
            n_ids.append(length)
        buffer = b"".join(raw)
        ends = 4 * np.cumsum(np.concatenate(n_ids))[cut.offsets.to_numpy()]
        out = [buffer[a:b] + END for a, b in itertools.pairwise(ends.tolist())]
        for at in np.flatnonzero(whole).tolist():
            ids = self.tokenizer.encode(texts[at], add_special_tokens=False).ids
            out[at] = np.array(ids, dtype="<u4").tobytes() + END
        return out


_coders: dict[str, WordIds] = {}


def _coder(vocabulary: str) -> WordIds:
    if vocabulary not in _coders:
        import public_tokenizers

        _coders[vocabulary] = WordIds(public_tokenizers.path(vocabulary))
    return _coders[vocabulary]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Narrow rows: document, place, length and checksum of each piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(vocabulary)
        for batch in slices(batches, most=SLICE):
            row, start, length, crc, total = [], [], [], [], []
            for at, ids in enumerate(coder.encode(texts_of(batch))):
                for begin in range(0, len(ids), 4 * capacity):
                    part = ids[begin : begin + 4 * capacity]
                    row.append(at)
                    start.append(begin // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(row, pa.int64())),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc, total)),
                    batch.column("__spread").take(pa.array(row, pa.int64())),
                ],
                names=[f.split()[0] for f in PIECE_SCHEMA.split(", ")],
            )

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        # Repeated rows differ in where they are read, so no group of them shares a window.
        F.xxhash64("doc_id", F.monotonically_increasing_id()).alias("__spread"),
    )
    return narrow.mapInArrow(cut, PIECE_SCHEMA)


def fill(counts: dict[int, int], sizes: list[int], room: int) -> dict[int, int]:
    """How many of each length to take, so that their sum is as close to ``room`` as can be.

    ``sizes`` are the lengths on hand, ascending. Counts are split into powers of two; after
    each item one big integer holds the sums that can be reached, and the way back through
    these integers gives the counts.
    """
    items: list[tuple[int, int]] = []
    reach = [1]
    mask = (1 << (room + 1)) - 1
    for size in reversed(sizes[: bisect.bisect_right(sizes, room)]):
        left, many = min(counts[size], room // size), 1
        while left > 0:
            take = min(many, left)
            items.append((size, take))
            reach.append((reach[-1] | reach[-1] << size * take) & mask)
            left -= take
            many *= 2
        if reach[-1] >> room & 1:
            break
    rest = reach[-1].bit_length() - 1
    taken: dict[int, int] = {}
    for at in range(len(items), 0, -1):
        if reach[at - 1] >> rest & 1:
            continue
        size, take = items[at - 1]
        taken[size] = taken.get(size, 0) + take
        rest -= size * take
    return taken


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fillings of sequences and how often each is used, until no piece is left."""
    left = dict(counts)
    sizes = sorted(left)
    plans = []

    def use(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            del sizes[bisect.bisect_left(sizes, size)]

    while sizes:
        longest = sizes[-1]
        use(longest, 1)
        filling = fill(left, sizes, capacity - longest)
        filling[longest] = filling.get(longest, 0) + 1
        more = {s: left.get(s, 0) + (s == longest) for s in filling}
        times = min(more[s] // n for s, n in filling.items())
        for size, n in filling.items():
            use_now = n * times - (size == longest)
            if use_now:
                use(size, use_now)
        plans.append((filling, times))
    return plans


def place(length: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of a window."""
    sequence = np.empty(len(length), dtype=np.int64)
    offset = np.zeros(len(length), dtype=np.int64)
    whole = np.flatnonzero(length == capacity)
    sequence[whole] = np.arange(len(whole))
    number = len(whole)
    order = np.argsort(length, kind="stable")
    order = order[length[order] < capacity]
    sizes, starts = np.unique(length[order], return_index=True)
    ends = np.append(starts[1:], len(order))
    queues = {int(s): order[a:b] for s, a, b in zip(sizes, starts, ends, strict=True)}
    used = dict.fromkeys(queues, 0)
    counts = {s: len(q) for s, q in queues.items()}
    for filling, times in plan(counts, capacity):
        at = 0
        for size, n in filling.items():
            taken = queues[size][used[size] : used[size] + n * times].reshape(times, n)
            used[size] += n * times
            sequence[taken] = number + np.arange(times)[:, None]
            offset[taken] = at + size * np.arange(n)[None, :]
            at += size * n
        number += times
    return sequence, offset


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece with its sequence and its offset there."""
    ship(docs.sparkSession)
    cut = durable(pieces(docs, capacity, vocabulary))
    windows = max(1, -(-cut.count() // WINDOW_PIECES))

    def fill_window(window: pa.Table) -> pa.Table:
        window = window.sort_by(
            [("doc_id", "ascending"), ("start", "ascending"), ("__spread", "ascending")]
        )
        number = window["__window"][0].as_py()
        sequence, offset = place(window["length"].to_numpy(), capacity)
        kept = window.drop_columns(["__spread", "__window"])
        return kept.append_column(
            "sequence_id", pa.array(number * (1 << 32) + sequence, pa.int64())
        ).append_column("offset", pa.array(offset, pa.int64()))

    dealt = cut.withColumn("__window", F.pmod(F.xxhash64("__spread", "start"), F.lit(windows)))
    return dealt.groupBy("__window").applyInArrow(fill_window, PLACED_SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: the packed pieces of the documents that are left."""
    return pack(docs.select("doc_id", "text"))
