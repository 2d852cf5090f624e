"""The training-data operators against brute force, on small and awkward tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from conftest import SF_DIR
from posture.llm import benchmark, fingerprints, language, line_dedup, packing, pages
from posture.llm import quality, queries, simhash, substrings, toxicity

DOCS = "doc_id bigint, text string, lang string, key string, id int, tag string, node string"
SPACE = r"[^\x20\x09-\x0D]+"


def some_docs(seed: int = 1, n: int = 60) -> list[tuple]:
    """Copies, near copies, shared lines and passages, NULLs, empty and repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ä", "é́", "WORD", "x\x1cy", "<|endoftext|>"]
    passage = " ".join(rng.choice(words) for _ in range(45))
    line = "  Shared LINE here\t"
    texts: list[str | None] = [None, "", "\n", " \t ", "one", "two words", "a b c", "a b c"]
    while len(texts) < n:
        kind = rng.randrange(6)
        own = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 90)))
        if kind == 0:
            texts.append(own + "\n" + line + "\n" + own[:20])
        elif kind == 1:
            texts.append(own + " " + passage + " " + own[::-1])
        elif kind == 2:
            texts.append(rng.choice(texts))
        elif kind == 3:
            texts.append((rng.choice(texts) or "") + " tail")
        elif kind == 4:
            texts.append(own.upper() + "\n\n" + own)
        else:
            texts.append(" ".join([rng.choice(words)] * 70))
    rows = [(i * 3, t, None if i % 7 == 0 else "en", "k", i, "t", "n") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, rows[5], (None, passage, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    yield connection
    connection.close()


def rows_of(frame, *order):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_matches_sql(spark, engine, name):
    frame = queries.QUERIES[name](spark, SF_DIR)
    columns = sorted(frame.columns)
    ours = rows_of(frame.select(*columns))
    reply = engine.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})")
    assert ours == sorted(reply.fetchall(), key=repr)


# --- line dedup ----------------------------------------------------------------------------


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))


def expected_lines(rows, min_docs, keep_first):
    found = defaultdict(set)
    first = {}
    for doc_id, text, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            if line_key(line):
                found[line_key(line)].add(doc_id)
                place = (doc_id is not None, doc_id or 0, pos)
                first[line_key(line)] = min(first.get(line_key(line), place), place)
    out = []
    for doc_id, text, *_ in rows:
        kept = []
        for pos, line in enumerate((text or "").split("\n")):
            key = line_key(line)
            place = (doc_id is not None, doc_id or 0, pos)
            drop = key and len(found[key]) >= min_docs
            if not drop or (keep_first and first[key] == place):
                kept.append(line)
        out.append((doc_id, "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 4])
@pytest.mark.parametrize("keep_first", [False, True])
def test_line_dedup(docs, min_docs, keep_first):
    bitmaps = line_dedup.keep_bitmaps(docs, min_docs, keep_first)
    found = line_dedup.apply_bitmaps(docs, bitmaps).select("doc_id", "__kept")
    assert rows_of(found) == expected_lines(some_docs(), min_docs, keep_first)


def test_line_dedup_of_a_line_in_every_document(spark):
    rows = [(i, f"own {i}\nthe same line\nown {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    bitmaps = line_dedup.keep_bitmaps(docs, 10, keep_first=True)
    kept = line_dedup.apply_bitmaps(docs, bitmaps)
    assert kept.filter("__kept LIKE '%same%'").select("doc_id").collect() == [(0,)]
    assert kept.filter("__n_dropped = 1").count() == 3999


def test_bitmaps_keep_lines_after_their_end():
    bitmap = line_dedup._bitmap(np.array([1, 8]), 9)
    assert line_dedup.kept_lines(bitmap, 12).tolist() == [i not in (1, 8) for i in range(12)]
    assert line_dedup.kept_lines(bitmap, 9).tolist() == [i not in (1, 8) for i in range(9)]


# --- fingerprints --------------------------------------------------------------------------


def expected_edits(rows):
    order = sorted(
        {(r[0] is not None, r[0] or 0, r[1] or "") for r in rows}
    )
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    out = []
    for doc_id, text, *_ in rows:
        text = text or ""
        q = len(text) // 4
        nxt = after[(doc_id is not None, doc_id or 0, text)][2]
        edited = text[: len(text) - q] + nxt[:q]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_fingerprints(docs):
    found = fingerprints.edited_fingerprints(docs).cache()
    short = found.select("doc_id", "n_chars", "edited_sha256")
    assert rows_of(short) == expected_edits(some_docs())
    by = {}
    for r in found.collect():
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert by.setdefault(r["doc_id"], r["fingerprint"]) == r["fingerprint"]
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1)
    texts = defaultdict(set)
    for doc_id, text, *_ in some_docs():
        texts[text or ""].add(by[doc_id])
    assert all(len(v) == 1 for v in texts.values())
    assert len({next(iter(v)) for v in texts.values()}) == len(texts)


def test_one_document_is_its_own_next(spark):
    one = spark.createDataFrame([(7, "abcd" * 40)], "doc_id bigint, text string")
    (row,) = fingerprints.edited_fingerprints(one).collect()
    assert row["near_next"] == 1.0
    assert row["edited_sha256"] == hashlib.sha256(("abcd" * 40).encode()).hexdigest()


def test_differing_paragraphs(spark):
    rows = [("a\nb\n\nc\nd", "a\nX\n\nc\nd\ne"), ("a", "a"), ("", "x\n\ny")]
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, "a string, b string")
    places = fingerprints.differing_paragraphs(
        fingerprints.paragraph_tree(F.col("a")), fingerprints.paragraph_tree(F.col("b"))
    )
    found = [[tuple(p) for p in r[0]] for r in frame.select(places).collect()]
    assert found == [[(0, 1), (1, 2)], [], [(0, 0), (1, 0)]]


# --- simhash -------------------------------------------------------------------------------


def expected_simhash(text):
    words = [w.encode() for w in re.findall(SPACE, line_key_case(text or ""))]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(
        1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)
    )


def line_key_case(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def expected_components(rows):
    prints = [(r[0], expected_simhash(r[1])) for r in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(
        ((d, f"{p:016x}", least.get(find(i))) for i, (d, p) in enumerate(prints)), key=repr
    )


def test_near_duplicates(docs):
    from pyspark.sql import functions as F

    found = simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")), "component_id"
    )
    assert rows_of(found) == expected_components(some_docs())


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"W{i % 13} b{i % 7}" for i in range(300)) + "\n x"
    whole, ranks = simhash.simhash(text), language.ranking(text).tolist()
    for piece in (1, 5, 40, 1000):
        monkeypatch.setattr(simhash, "PIECE", piece)
        monkeypatch.setattr(language, "PIECE", piece)
        assert simhash.simhash(text) == whole == expected_simhash(text)
        assert language.ranking(text).tolist() == ranks
        assert [simhash.simhash(t) for t in ("", " a", "a  b", "a b c")] == [
            expected_simhash(t) for t in ("", " a", "a  b", "a b c")
        ]


def test_native_hash_agrees(spark):
    from pyspark.sql import functions as F

    value = spark.range(1).select(F.xxhash64(F.lit("a b é"))).first()[0]
    assert value % (1 << 64) == xxhash.xxh64_intdigest("a b é".encode(), 42)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("leaf, hot", [(256, 20_000), (16, 20_000), (8, 60), (1000, 1000)])
def test_blocks_and_trees_lose_no_link(spark, seed, leaf, hot, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 64, 12, dtype=np.uint64)
    # Others agree in all but one block, so that block values are large and can be split.
    centres = np.append(centres, centres[0] ^ rng.integers(0, 1 << 16, 300, dtype=np.uint64))
    nodes = {int(c) for c in centres}
    for c in centres[:40]:
        for _ in range(30):
            bits = rng.choice(64, rng.integers(1, 6), replace=False)
            nodes.add(int(c) ^ sum(1 << int(b) for b in bits))
    nodes = np.array(sorted(nodes), dtype=np.uint64)
    near = np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= 3
    label = np.arange(len(nodes))
    while True:
        after = np.where(near, label[None, :], len(nodes)).min(axis=1)
        if (after == label).all():
            break
        label = after
    rows = [
        ((block << 16) + (int(v) >> 16 * block & 0xFFFF), i)
        for i, v in enumerate(nodes) for block in range(4)
    ]
    rows.sort()
    blocks, place = (np.array(x) for x in zip(*rows, strict=True))
    first = place[simhash.classes(blocks.astype(np.int32), nodes[place])]
    own = np.arange(len(nodes))
    while True:
        before = own.copy()
        np.minimum.at(own, place, own[first])
        np.minimum.at(own, first, own[place])
        if (own == before).all():
            break
    assert own.tolist() == label.tolist()
    # A class is told by a star: fewer links than rows, however dense it is.
    assert (first != place).sum() < len(place)


def test_links_of_a_dense_ball(spark, monkeypatch):
    """More rows than a chunk, dealt over batches, against all pairs."""
    monkeypatch.setattr(simhash, "CHUNK", 50)
    nodes = [1 << i | 1 << j for i in range(64) for j in range(i)] + [0]
    nodes = [n - (1 << 64) if n >> 63 else n for n in nodes]
    frame = spark.createDataFrame([(n,) for n in nodes], "node bigint").repartition(4)
    found = simhash.components(simhash.links(frame)).collect()
    assert {r["node"] for r in found} == set(nodes) - {min(nodes)}
    assert {r["root"] for r in found} == {min(nodes)}


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (5, 5)]
    random.Random(3).shuffle(edges)
    found = dict(
        tuple(r) for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    )
    assert found == {**dict.fromkeys(range(1, 61), 0), 200: 100}


# --- packing -------------------------------------------------------------------------------


def test_packing(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    ids = defaultdict(list)
    for doc_id, text, *_ in some_docs():
        encoded = tokenizer.encode(text or "", add_special_tokens=False).ids
        ids[doc_id].append([*encoded, 1])
    capacity = 64
    found = packing.pack(docs, capacity).collect()
    parts = defaultdict(lambda: defaultdict(int))
    sequences = defaultdict(list)
    for r in found:
        whole = ids[r["doc_id"]][0]
        piece = whole[r["start"] : r["start"] + r["length"]]
        assert len(piece) == r["length"] and r["doc_tokens"] == len(whole)
        assert zlib.crc32(np.array(piece, dtype="<u4").tobytes()) == r["ids_crc32"]
        parts[r["doc_id"]][(r["start"], r["length"])] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, times in ids.items():
        assert all(n == len(times) for n in parts[doc_id].values())
        assert sum(length for _, length in parts[doc_id]) == len(times[0])
    short = 0
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= capacity
        short += capacity - end
    assert short <= capacity * 2


@pytest.mark.parametrize("seed", range(4))
def test_filling_is_closest(seed):
    rng = random.Random(seed)
    counts = {rng.randrange(2, 40): rng.randrange(1, 4) for _ in range(5)}
    for room in (1, 7, 30, 64):
        taken = packing.fill(counts, sorted(counts), room)
        assert all(n <= counts[s] for s, n in taken.items())
        reach = {0}
        for size, n in counts.items():
            reach = {r + size * k for r in reach for k in range(n + 1)}
        assert sum(s * n for s, n in taken.items()) == max(r for r in reach if r <= room)


# --- benchmark -----------------------------------------------------------------------------

ITEMS = [
    (1, "W1 w2! w3"), (2, None), (3, "--"), (10, "a b c"), (2, "one"), (None, "two words"),
    (4, " ".join(f"w{i % 7}" for i in range(30))), (5, "w5 w6 w0"),
]


def expected_hits(rows, items, window):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line_key_case(text or ""))

    out = []
    for doc_id, text, *_ in rows:
        own = words(text)
        hit, found = set(), set()
        for item, item_text in items:
            theirs = words(item_text)
            size = min(window, len(theirs))
            for i in range(len(theirs) - size + 1 if size else 0):
                for j in range(len(own) - size + 1):
                    if own[j : j + size] == theirs[i : i + size]:
                        hit |= set(range(j, j + size))
                        found.add(item)
        found = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(own), len(hit), found))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_chars", [benchmark.BLOCK_CHARS, 20])
def test_contamination(spark, docs, monkeypatch, block_chars):
    from pyspark.sql import functions as F

    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    original = benchmark.blocks_of
    monkeypatch.setattr(benchmark, "blocks_of", lambda b: original(b, block_chars))
    found = benchmark.contamination(docs, items, 5)
    counted = found.select(
        "doc_id", "__n_words", benchmark.hit_words("__spans").alias("n"), "__items"
    )
    assert rows_of(counted) == expected_hits(some_docs(), ITEMS, 5)
    for row in found.filter(F.size("__spans") > 0).collect():
        for span in row["__spans"]:
            piece = row["text"][span["begin"] : span["end"]]
            assert len(benchmark.words_of(piece)) == span["last_word"] - span["first_word"] + 1


# --- substrings ----------------------------------------------------------------------------


def expected_repeats(rows):
    seen = {}
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    words = {k: re.findall(SPACE, k[2]) for k in order}
    gone = {k: set() for k in order}
    for k in order:
        own = words[k]
        for i in range(len(own) - 19):
            if seen.setdefault(tuple(own[i : i + 20]), (k, i)) != (k, i):
                gone[k] |= set(range(i, i + 20))
    out = []
    for doc_id, text, *_ in rows:
        k = (doc_id is not None, doc_id or 0, text or "")
        kept = [w for i, w in enumerate(words[k]) if i not in gone[k]]
        out.append((doc_id, len(words[k]), len(gone[k]), " ".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [substrings.HEAVY, 2])
@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, monkeypatch, heavy, seed):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    rows = some_docs(seed, 120)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    assert rows_of(substrings.without_repeats(docs)) == expected_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_suffix_tree_and_maximal_repeats(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 16, 12)
    regions = [[b"ab"[x : x + 1] for x in rng.integers(0, 2, k + 19)] for k in n]
    for copy in (3, 7, 8):  # whole copies, and one cut short by another word
        regions[copy], n[copy] = list(regions[2]), n[2]
    regions[8][5] = b"c"
    ids, tags = rng.permutation(12), np.zeros(12, dtype=np.int64)
    starts = rng.integers(0, 50, 12)
    ids[7], starts[7] = ids[2], starts[2]  # one document, read twice
    begins = np.cumsum([0] + [len(r) + 1 for r in regions[:-1]])
    places = {int(begins[r] + a): (r, a) for r in range(12) for a in range(n[r])}
    tree = substrings.SuffixTree(regions, np.array(list(places)))
    suffix = {x: regions[r][a:] for x, (r, a) in places.items()}

    def shared(left, right):
        both = zip(suffix[left], suffix[right], strict=False)
        return next((i for i, (x, y) in enumerate(both) if x != y), None) if left != right else 0

    ranked = tree.order.tolist()
    assert sorted(ranked) == sorted(places)
    for before, after, common in zip(ranked, ranked[1:], tree.common[1:].tolist(), strict=False):
        expected = shared(before, after)
        shorter = min(len(suffix[before]), len(suffix[after]))
        assert common == (shorter if expected is None else expected)

    first: dict = {}
    where = {x: (ids[r], starts[r] + a) for x, (r, a) in places.items()}
    for x in sorted(places, key=where.get):
        first.setdefault(tuple(suffix[x][:20]), where[x])
    expected = {places[x] for x in places if first[tuple(suffix[x][:20])] != where[x]}
    spans = substrings.maximal_repeats(regions, n, ids, tags, starts)
    assert {(r, a + k) for r, a, size in spans for k in range(size - 19)} == expected
    for r, a, size in spans:  # no span lies in the one that begins a word before
        assert not any(q == r and b == a - 1 and b + m >= a + size for q, b, m in spans)


def test_smallest_id_and_null_id(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(None, text), (-(1 << 63), "x " + text), (5, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs).collect()}
    assert found[None] == 0 and found[-(1 << 63)] == 25 and found[5] == 25


def test_a_passage_in_many_documents(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"a{i} b{i} c{i} {passage} d{i} e{i}") for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(9)
    found = {r["doc_id"]: r["n_removed"] for r in substrings.without_repeats(docs).collect()}
    assert found == {i: 60 if i else 0 for i in range(700)}


# --- pages ---------------------------------------------------------------------------------


def test_main_text():
    page = (
        "<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
        "<nav><ul><li>Home</ul></nav><div class='ad'>Buy</div><article><h1>Title</h1>"
        "<p><b>One &amp; <i>two</i><br><p>Three\n  four</p><aside>side</aside>"
        "<div id=comments><p>me too</p></div></article><footer>&copy; x</footer>"
    )
    assert pages.main_text(page, ()) == "Title\n\nOne & two\n\nThree four"
    assert pages.main_text(page, (0, 1, 2, 3, 4)) == "Title\n\nOne & two\n\nThree four"
    assert pages.main_text("", ()) == ""
    headed = (
        "<body class='with-sidebar'><main><div class='article-header'><h1>T</h1></div><p>x"
        "<select><option>o</select><div class='share'>s</div><p hidden>h</p><p>y&nbsp; z</main>"
    )
    assert pages.main_text(headed, ()) == "T\n\nx\n\ny z"
    assert pages.main_text("plain &lt; text", ()) == "plain < text"
    assert pages.main_text("<p>a longer line<p>frame<p>ccc", (1,)) == "a longer line\n\nccc"


def test_long_attributes_are_judged():
    data = f"data-x='{'x' * 600}'"
    page = f"<div {data} class='ad'>Buy</div><p>Text</p><div class=x style='color:red;{' ' * 600}display:none'>h</div>"
    assert pages.main_text(page, ()) == "Text"
    assert pages.main_text(f"<div {data} class='story'>Text</div>", ()) == "Text"


def test_shared_lines_decide_beside_and_inside_an_article():
    page = (
        "<div>Site menu</div><div>The story stands in a plain element</div>"
        "<article><p>Teaser of another page</p></article><div>All rights reserved</div>"
    )
    found = pages.main_text(page, (0, 3))
    assert found == "The story stands in a plain element\n\nTeaser of another page"
    page = "<main><p>Site line</p><p>The story of this page</p><p>It goes on</p></main><p>Foot</p>"
    assert pages.main_text(page, (0, 3)) == "The story of this page\n\nIt goes on"
    # The partner is a copy of the article: it stays, and the frame beside it goes.
    assert pages.main_text(page, (0, 1, 2, 3)) == "Site line\n\nThe story of this page\n\nIt goes on"


def test_short_story_in_a_long_frame(spark):
    frame = "".join(f"<div>Link {i} of the site, as on any page</div>" for i in range(20))
    rows = [(i, f"http://h/a/{i}", f"{frame}<p>story {i}</p><div>Rights</div>") for i in range(4)]
    # Copies of a page, equal or nearly so, are told apart by the next page that is none.
    long = "<p>a story that two pages tell, " + "as long as can be, " * 99 + "</p>"
    rows += [(10, "http://g/b/1", f"{frame}{long}<p>1 view</p>"), (11, "http://g/b/2", f"{frame}{long}<p>2 views</p>"),
             (12, "http://g/b/2/x", f"{frame}{long}<p>2 views</p>"), (13, "http://g/c", f"{frame}<p>other</p>")]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    found = {r[0]: r[1] for r in pages.extracted(table).select("page_id", "__text").collect()}
    text = long[3:-4].strip()
    assert found == {i: f"story {i}" for i in range(4)} | {
        10: f"{text}\n\n1 view", 11: f"{text}\n\n2 views", 12: f"{text}\n\n2 views", 13: "other",
    }
    page = "<main><p>Site</p><p>Shared by one neighbour</p><p>The story</p></main>"
    assert pages.main_text(page, (0, 1), (0,)) == "Shared by one neighbour\n\nThe story"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_quotation_marks_in_attributes():
    """They delimit a value only behind its equals sign."""
    assert pages.main_text("<p title=it's>Story isn't lost</p>", ()) == "Story isn't lost"
    assert pages.main_text("<p title=\"a > b\" x='<'>Kept</p>", ()) == "Kept"
    assert pages.main_text("<div class = 'menu' id=x>Gone</div><p a=b=c>Kept</p>", ()) == "Kept"
    assert pages.main_text("<p don't>Kept</p> it's \"quoted\"", ()) == "Kept\n\nit's \"quoted\""


@pytest.mark.parametrize("cells", [pages.CELLS, 12])
def test_alignment_is_longest(monkeypatch, cells):
    monkeypatch.setattr(pages, "CELLS", cells)
    rng = random.Random(5)
    for _ in range(200):
        a = [rng.randrange(5) for _ in range(rng.randrange(15))]
        b = [rng.randrange(5) for _ in range(rng.randrange(15))]
        found = pages.shared_lines(a, b)
        assert len(found) == len(set(found)) == lcs(a, b)
        rest = iter(b)
        assert all(x in rest for x in (a[i] for i in sorted(found)))


def test_page_differencing(spark):
    frame = "<p>Menu of the site</p>{}<p>All rights reserved</p>"
    rows = [
        (1, "http://h/a/1", frame.format("<p>first story, long enough to be the main part</p>")),
        (2, "http://h/a/2", frame.format("<p>second story, long enough to be the main part</p>")),
        (3, "http://other/a/2", frame.format("<p>alone</p>")),
        (4, None, None), (5, "http://h/a/3", ""), (1, "http://h/a/1", None), (None, "x", "<p>y</p>"),
    ]
    table = spark.createDataFrame(rows * 2, "page_id bigint, url string, html string")
    found = {(r[0], r[1]) for r in pages.extracted(table).select("page_id", "__text").collect()}
    assert found == {
        (1, "first story, long enough to be the main part"),
        (2, "second story, long enough to be the main part"),
        (3, "Menu of the site\n\nalone\n\nAll rights reserved"),
        (4, ""), (5, ""), (1, ""), (None, "y"),
    }
    assert pages.extracted(table).count() == 14
    assert pages.extracted(table.limit(0)).count() == 0


# --- models --------------------------------------------------------------------------------


def joined(spark, name, *columns):
    import pandas as pd

    found = queries.QUERIES[name](spark, SF_DIR).toPandas()
    kept = [pd.read_parquet(f"{SF_DIR}/{t}.parquet")[["doc_id", *c]] for t, c in columns]
    for other in kept:
        found = found.merge(other, on="doc_id")
    return found[found["held_out"]]


def test_language_on_held_out_documents(spark):
    found = joined(spark, "op6_language_id", ("documents", ["lang"]))
    assert (found["lang"] == found["lang_pred"]).mean() >= 0.97
    assert found["score"].between(0, 1).all()


def test_quality_on_held_out_documents(spark):
    found = joined(spark, "op10_quality_classifier", ("labels", ["quality"]))
    assert (found["quality"] == found["predicted"]).mean() >= 0.93
    good = found[found["quality"] == 1]
    assert (good["predicted"] == 1).mean() >= 0.97


def test_toxicity_on_held_out_documents(spark):
    found = joined(spark, "op8_toxicity", ("labels", ["quality"]), )
    import pandas as pd

    labels = pd.read_parquet(f"{SF_DIR}/labels.parquet").rename(columns={"toxic": "y"})
    found = found.merge(labels[["doc_id", "y"]], on="doc_id")
    assert (found["y"] == found["predicted"]).mean() >= 0.92
    assert (found[found["y"] == 0]["predicted"] == 0).mean() >= 0.97


def test_toxicity_fit_ends_at_its_tolerance():
    rng = np.random.default_rng(3)
    found = [sorted(set((rng.random(30) ** 3 * 400).astype(int))) for _ in range(500)]
    rows = toxicity.Rows(found, toxicity._dense(np.array([len(f) for f in found], float)), 400)
    y, weight = (rng.random(500) < 0.1).astype(float), np.ones(500)
    ridge = np.full(402, toxicity.RIDGE * 500)
    ridge[400] = 1e-9

    def length(beta):
        p = 1 / (1 + np.exp(-rows.times(beta)))
        return np.linalg.norm(rows.back(weight * (y - p)) - ridge * beta)

    assert length(toxicity.fit(rows, y, weight)) <= 1e-5 * length(np.zeros(402))


def test_toxicity_counts_marks_over_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_DOCS", 20)
    rows = [(i, f"plain words {'zorgle' if i % 50 == 0 else 'other'} n{i}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame(
        [(i, 1, int(i % 5 == 0)) for i in range(800)], "doc_id bigint, quality int, toxic int"
    )
    assert "=zorgle" in toxicity.train(docs, labels).chosen


def test_models_on_awkward_tables(spark, docs, empty):
    labels = "doc_id bigint, quality int, toxic int"
    some = spark.createDataFrame(
        [(i * 3, int(i % 4 > 0), int(i % 5 == 0)) for i in range(60)]
        + [(None, 1, 0), (3, None, None), (6, 1, 1)],
        labels,
    )
    none = spark.createDataFrame([], labels)
    for given in (some, none):
        scored = quality.score(docs, quality.learn(docs, given))
        assert scored.count() == docs.count()
        assert scored.filter("__score BETWEEN 0 AND 1").count() == docs.count()
        chain = toxicity.train(docs, given)
        judged = toxicity.score(docs, chain)
        assert judged.filter("__p_toxic BETWEEN 0 AND 1").count() == docs.count()
    assert quality.score(empty, quality.learn(empty, none)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0
    found = language.predict(docs, language.profiles(docs))
    assert found.filter("__lang IS NULL OR __score IS NULL").count() == 0
    blank = found.filter("trim(coalesce(text, '')) = ''")
    assert {r["__lang"] for r in blank.collect()} == {"und"}
    nothing = language.predict(docs, language.profiles(empty))
    assert {r["__lang"] for r in nothing.collect()} == {"und"}


def test_out_of_place_distance():
    texts = {"a": "abab abab", "b": "xyxy xyxy"}
    judge = language.Judge({k: language.ranking(v).tolist() for k, v in texts.items()})
    assert judge.predict("aba ab")[0] == "a" and judge.predict("yxy")[0] == "b"
    assert judge.predict("12 !")[0] == "und"
    assert judge.predict(texts["a"])[1] > 0.9


def test_empty_tables(spark, empty):
    assert fingerprints.edited_fingerprints(empty).count() == 0
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert packing.pack(empty).count() == 0
    assert substrings.without_repeats(empty).count() == 0
    items = spark.createDataFrame([], "item_id bigint, text string")
    assert benchmark.contamination(empty, items).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_stages_keep_the_columns(spark, docs):
    expect = {r[0] for r in expected_components(some_docs()) if r[0] == r[2] is not None}
    kept = simhash.near_dedup_stage(spark, docs, SF_DIR)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(expect)
    lines = line_dedup.line_dedup_stage(spark, docs, SF_DIR)
    assert lines.columns == docs.columns and lines.count() == docs.count()
    clean = benchmark.decontamination_stage(spark, docs, SF_DIR)
    assert clean.columns == docs.columns


def test_pipeline_step_by_step(spark):
    """Every stage against its brute-force counterpart on its own input."""
    small = SF_DIR.replace("sf0.01", "sf0.001")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = quality.quality_stage(spark, docs, small).cache()
    scores = queries.QUERIES["op10_quality_classifier"](spark, small)
    good = {r["doc_id"] for r in scores.filter("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == good
    before = [(r["doc_id"], r["text"]) for r in kept.collect()]
    lines = line_dedup.line_dedup_stage(spark, kept, small).cache()
    assert rows_of(lines.select("doc_id", "text")) == expected_lines(before, 10, False)
    before = [(r["doc_id"], r["text"]) for r in lines.collect()]
    near = simhash.near_dedup_stage(spark, lines, small).cache()
    expect = sorted(r[0] for r in expected_components(before) if r[0] == r[2])
    assert sorted(r["doc_id"] for r in near.collect()) == expect
    before = [(r["doc_id"], r["text"]) for r in near.collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = benchmark.decontamination_stage(spark, near, small).cache()
    # Documents without any word of an item cannot be hit; the rest is compared window by window.
    windows = {
        tuple(w[i : i + min(10, len(w))])
        for w in (benchmark.words_of(t or "") for _, t in items)
        for i in range(len(w) - min(10, len(w)) + 1)
        if w
    }
    sizes = {len(w) for w in windows}
    hit = {
        d
        for d, t in before
        for own in [benchmark.words_of(t or "")]
        if any(tuple(own[j : j + k]) in windows for k in sizes for j in range(len(own) - k + 1))
    }
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in before} - hit
    packed = packing.packing_stage(spark, clean, small)
    tokens = packed.groupBy("doc_id").sum("length").count()
    assert tokens == clean.count()
    assert [n for n, _ in corpus_pipeline.STAGES][-1] == "packing"


def test_stages_leave_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(80)
    names = ("__x", "__m", "__sure", "__score", "__block0", "__items", "__spans", "row", "a.b")
    odd = docs
    for i, name in enumerate(names):
        odd = odd.withColumn(name, odd["doc_id"] * 10 + i)
    for stage in (quality.quality_stage, benchmark.decontamination_stage):
        found = stage(spark, odd, SF_DIR)
        assert found.columns == odd.columns
        kept = found.collect()
        assert kept and all(
            r[n] == r["doc_id"] * 10 + i for r in kept for i, n in enumerate(names)
        )
        assert sorted(r["doc_id"] for r in kept) == sorted(
            r["doc_id"] for r in stage(spark, docs, SF_DIR).collect()
        )


def test_an_item_of_the_empty_name_and_several_blocks(spark, monkeypatch):
    texts = ["alpha beta gamma delta", "one two three four five", "red green blue white"]
    items = [("", texts[0]), (None, texts[1]), ("c", texts[2])]
    items = spark.createDataFrame(items, "item_id string, text string")
    docs = spark.createDataFrame([(i, f"x {t} y") for i, t in enumerate(texts)], "doc_id bigint, text string")
    for limit in (10, 1000):
        cut = benchmark.blocks_of
        with monkeypatch.context() as small:
            small.setattr(benchmark, "blocks_of", lambda b, limit=limit: cut(b, limit))
            found = benchmark.contamination(docs, items).select("doc_id", "__items", "__spans").collect()
        got = {r["doc_id"]: (r["__items"], len(r["__spans"])) for r in found}
        assert got == {0: ([""], 1), 1: ([], 1), 2: (["c"], 1)}
