"""Cross-tokenizer alignment against a brute-force version on whole texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from conftest import SF_DIR
from posture.llm import alignment

TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "a\tb\nc", "▁x", "x ▁ y", "<s> <unk> <0x41>",
    "<|endoftext|> hi", "é́ naïve ﬁ ﬂ", "a\xa0b \x00x", "日本語 テキスト", "x​ y",
    "it's John's   dog,  isn't it?", "1234567 89 0.5e-7", "\n\n\nline\n  indent\r\n",
    "word " * 300, "y" * 5000, "same text again", "same text again", "Größe straße ÄÖÜ",
    "a\x1cb \x1d c", "🙂🙃 👩‍👩‍👧 ok", "don't 'tis 'S it'll", " 　 wide line ",
]


class Whole:
    """Texts encoded whole, groups by joining overlapping tokens."""

    def __init__(self):
        self.a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}

    def tokens(self, text):
        if not text:
            return [], []
        raw = (" " + text).encode()
        a = [(k, bytes(self.byte[c] for c in self.a.id_to_token(k)))
             for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()
            b.append((k, own))
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            return [], []
        return a, b

    def groups(self, text):
        """(ids of A, ids of B) per group, and the linked pairs."""
        a, b = self.tokens(text)
        found, i, j, end_a, end_b, own_a, own_b = [], 0, 0, 0, 0, [], []
        while i < len(a) or j < len(b):
            if end_a <= end_b:
                end_a += len(a[i][1])
                own_a.append(a[i][0])
                i += 1
            else:
                end_b += len(b[j][1])
                own_b.append(b[j][0])
                j += 1
            if end_a == end_b:
                found.append((own_a, own_b))
                own_a, own_b = [], []
        return found, [(x[-1], y[-1]) for x, y in found]


def expected(rows):
    whole = Whole()
    parts = [whole.groups(text) for _, text in rows]
    counts = Counter(link for _, links in parts for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (groups, links) in zip(rows, parts, strict=True):
        shown = ";".join(
            ",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups
        )
        out.append((
            doc_id, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups),
            len(groups), len(links),
            sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(shown.encode()).hexdigest() if shown else "",
        ))
    return sorted(out, key=repr)


COLUMNS = [
    "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
]


def found_rows(spark, rows, tmp_path):
    kinds = "doc_id bigint, text string, groups string, n_a int, __pairs int"
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], kinds).repartition(3)
    path = str(tmp_path / "documents.parquet")
    frame.write.parquet(path)
    found = alignment.op13_cross_tokenizer_alignment(spark, str(tmp_path))
    return sorted((tuple(r) for r in found.select(*COLUMNS).collect()), key=repr)


def test_awkward_texts(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "a"), (7, "other text")]
    assert found_rows(spark, rows, tmp_path) == expected(rows)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = alignment.op13_cross_tokenizer_alignment(spark, SF_DIR).select(*COLUMNS)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == expected(rows)


def test_long_text(spark, tmp_path):
    long = " ".join(f"w{i} x{i % 97}, end{i % 11}." for i in range(60_000)) + " " + "z" * 9_000
    rows = [(1, long), (2, "w1 x1, end1. w2"), (3, None)]
    assert found_rows(spark, rows, tmp_path) == expected(rows)


def test_empty_table(spark, tmp_path):
    assert found_rows(spark, [], tmp_path) == []


@pytest.mark.parametrize("seed", range(20))
def test_terminals_label_components(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(1, 200))
    cuts = [np.append(np.flatnonzero(rng.random(size - 1) < p) + 1, size) for p in (0.4, 0.3)]
    label = alignment.terminals(*cuts)
    common = np.intersect1d(*cuts)
    group = np.concatenate([np.searchsorted(common, ends) for ends in cuts])
    assert len(set(zip(label.tolist(), group.tolist(), strict=True))) == len(common)
    assert len(set(label.tolist())) == len(common)


def test_pairs_bound_holds():
    words = alignment.Vocabularies(
        public_tokenizers.path(alignment.VOCABULARY_A), public_tokenizers.path(alignment.VOCABULARY_B)
    )
    pairs = alignment.Pairs(words)
    assert len(pairs) < 500_000
    a, b = pairs.keys >> 32, pairs.b
    assert all(
        words.bytes_a[x].endswith(words.bytes_b[y]) or words.bytes_b[y].endswith(words.bytes_a[x])
        for x, y in zip(a[::97].tolist(), b[::97].tolist(), strict=True)
    )
