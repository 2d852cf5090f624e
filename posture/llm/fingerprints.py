"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of them.

A text is split into sections (at blank lines), a section into paragraphs (lines), a
paragraph into pieces of ``PIECE`` code points. A piece hashes its text; a paragraph the
hashes of its pieces, a section those of its paragraphs, the root those of its sections.
Equal roots mean equal texts; where roots differ, the differing sections and paragraphs
locate the edit (``differing_paragraphs``).

The fingerprint string is ``root:sketch``. The sketch holds the ``SKETCH`` smallest
distinct piece hashes, all of them for texts of up to ``SKETCH`` pieces, so that the
likeness of two texts, the Dice coefficient of their piece sets, can be told from the
fingerprints alone: exactly for such texts, by estimate for longer ones.

Only built-in functions are used. The next document is found on ids alone: they are
partitioned by range, each partition finds its own successors, and the last row of each
partition takes the first of the next one. Only the prefix of the next text that an edit
needs is then sent to its predecessor.

Defined results: NULL texts count as empty; the order of documents is that of (id, text
hash), NULL first; repeated rows count once in this order and each gets the values of its
text; the only document is its own next; two empty texts have likeness 1, an empty and
another text 0. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from posture.llm.common import durable, same, successors, table, text_id, text_or_empty

PIECE = 32
SKETCH = 128
HEX = 8

SECTION_BREAK = "\n\n"


def paragraph_tree(text: Column) -> Column:
    """array of sections, each an array of paragraphs, each the array of its pieces' hashes."""

    def paragraph(line: Column) -> Column:
        pieces = F.regexp_extract_all(line, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
        return F.transform(pieces, _hash)

    def section(part: Column) -> Column:
        return F.transform(F.split(part, "\n"), paragraph)

    return F.transform(F.split(text, SECTION_BREAK), section)


def _hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _over(children: Column) -> Column:
    return _hash(F.concat_ws(",", children))


def paragraph_hashes(tree: Column) -> Column:
    """array of sections, each the array of its paragraphs' hashes."""
    return F.transform(tree, lambda section: F.transform(section, _over))


def root(tree: Column) -> Column:
    sections = F.transform(paragraph_hashes(tree), _over)
    return F.sha2(F.concat_ws(",", sections), 256)


def sketch(tree: Column) -> Column:
    pieces = F.transform(F.flatten(F.flatten(tree)), lambda h: F.substring(h, 1, HEX))
    return F.slice(F.array_sort(F.array_distinct(pieces)), 1, SKETCH)


def fingerprint(root_hash: Column, pieces: Column) -> Column:
    return F.concat(root_hash, F.lit(":"), F.concat_ws("", pieces))


def likeness(left: Column, right: Column) -> Column:
    """Dice coefficient of two piece sets, told from their sketches.

    A full sketch knows its set only up to its largest hash; both are compared up to the
    smaller of these.
    """

    def known(pieces: Column) -> Column:
        return F.when(F.size(pieces) >= SKETCH, F.element_at(pieces, -1))

    end = F.least(known(left), known(right))

    def seen(pieces: Column) -> Column:
        return F.size(F.filter(pieces, lambda h: end.isNull() | (h <= end)))

    union, both = seen(F.array_union(left, right)), seen(F.array_intersect(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(
        (2 * both).cast("double") / (union + both).cast("double")
    )


def differing_paragraphs(left: Column, right: Column) -> Column:
    """(section, paragraph) places at which two trees differ; equal branches are skipped."""

    def section(mine: Column, place: Column) -> Column:
        other = F.coalesce(F.get(right, place), F.array().cast("array<array<string>>"))
        longer = F.greatest(F.size(mine), F.size(other))
        places = F.when(longer > 0, F.sequence(F.lit(0), longer - 1)).otherwise(
            F.array().cast("array<int>")
        )
        unlike = F.filter(places, lambda i: ~F.get(mine, i).eqNullSafe(F.get(other, i)))
        return F.when(mine == other, F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(
            F.transform(
                unlike,
                lambda i: F.struct(place.alias("section"), i.alias("paragraph")),
            )
        )

    none = F.array().cast("array<array<string>>")
    missing = F.greatest(F.size(right) - F.size(left), F.lit(0))
    padded = F.concat(left, F.array_repeat(none, missing))
    return F.flatten(F.transform(padded, section))


def _keyed(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text_id(text).alias("text_id"),
        text.alias("text"),
    )


def next_documents(docs: DataFrame) -> DataFrame:
    """Key of each different document, its length, and the key of the next document."""
    key = ("doc_id", "text_id")
    narrow = durable(
        _keyed(docs)
        .select(*key, F.length("text").cast("bigint").alias("n_chars"))
        .dropDuplicates(list(key))
    )
    linked = successors(narrow, *key)
    # One row; after the last document comes the first.
    head = narrow.agg(F.min(F.struct(*key)).alias("head")).first()["head"] or (None, None)
    begin = F.struct(*(F.lit(v).cast("bigint").alias(k) for k, v in zip(key, head, strict=True)))
    follows = F.coalesce("next", begin)
    linked = linked.select(
        F.col("doc_id").alias("of_id"), F.col("text_id").alias("of_text_id"),
        follows["doc_id"].alias("next_id"), follows["text_id"].alias("next_text_id"),
    )
    rule = narrow["doc_id"].eqNullSafe(linked["of_id"]) & (
        narrow["text_id"] == linked["of_text_id"]
    )
    return narrow.join(linked, rule).select(*key, "n_chars", "next_id", "next_text_id")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and their likeness."""
    links = durable(next_documents(docs))
    back = links.select(
        F.col("next_id").alias("doc_id"), F.col("next_text_id").alias("text_id"),
        F.col("doc_id").alias("prev_id"), F.col("text_id").alias("prev_text_id"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("needed"),
    )
    keyed = _keyed(docs)
    giving = keyed.join(back, same(keyed, back, "doc_id", "text_id"))
    trees = giving.select(
        "prev_id", "prev_text_id",
        F.substring(keyed["text"], F.lit(1), F.col("needed")).alias("prefix"),
        sketch(paragraph_tree(keyed["text"])).alias("next_sketch"),
    )
    # Repeated rows give the same prefix.
    given = trees.groupBy("prev_id", "prev_text_id").agg(
        F.first("prefix").alias("prefix"), F.first("next_sketch").alias("next_sketch")
    )
    rule = keyed["doc_id"].eqNullSafe(given["prev_id"]) & keyed["text_id"].eqNullSafe(
        given["prev_text_id"]
    )
    length = F.length("text")
    kept = length - F.floor(length / 4).cast("int")
    both = keyed.join(given, rule).select(
        "doc_id", "text", length.cast("bigint").alias("n_chars"), "next_sketch",
        F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("prefix")).alias("edited"),
    )
    tree = both.withColumns(
        {"tree": paragraph_tree(F.col("text")), "edited_tree": paragraph_tree(F.col("edited"))}
    )
    hashed = tree.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_sketch",
        root(F.col("tree")).alias("root"), sketch(F.col("tree")).alias("own"),
        root(F.col("edited_tree")).alias("edited_root"),
        sketch(F.col("edited_tree")).alias("edited_own"),
    )
    return hashed.select(
        "doc_id", "n_chars", "edited_sha256",
        fingerprint(F.col("root"), F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_root"), F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_sketch")).alias("near_next"),
    )


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP1_SQL = rf"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n
  FROM documents),
seen AS (
  SELECT doc_id, text, n,
         coalesce(lead(text) OVER (ORDER BY doc_id),
                  first_value(text) OVER (ORDER BY doc_id)) AS next_text
  FROM base),
whole AS (
  SELECT doc_id, n, text, next_text,
         substr(text, 1, n - n // 4) || substr(next_text, 1, n // 4) AS edited
  FROM seen),
texts AS (
  SELECT doc_id, 'own' AS kind, text AS t FROM whole
  UNION ALL SELECT doc_id, 'edited', edited FROM whole
  UNION ALL SELECT doc_id, 'next', next_text FROM whole),
trees AS (
  SELECT doc_id, kind,
         list_transform(string_split(t, chr(10) || chr(10)), lambda s:
           list_transform(string_split(s, chr(10)), lambda p:
             list_transform(regexp_extract_all(p, '(?s).{{1,{PIECE}}}'), lambda x: md5(x)))) AS tree
  FROM texts),
marks AS (
  SELECT doc_id, kind,
         sha256(array_to_string(list_transform(tree, lambda s:
           md5(array_to_string(list_transform(s, lambda p: md5(array_to_string(p, ','))), ','))), ','))
           AS root,
         list_sort(list_distinct(list_transform(flatten(flatten(tree)), lambda h: h[1:{HEX}])))[1:{SKETCH}]
           AS pieces
  FROM trees),
wide AS (
  SELECT o.doc_id, o.root || ':' || array_to_string(o.pieces, '') AS fingerprint,
         e.root || ':' || array_to_string(e.pieces, '') AS edited_fingerprint,
         o.pieces AS a, e.pieces AS b, x.pieces AS c
  FROM marks o JOIN marks e ON o.doc_id = e.doc_id AND e.kind = 'edited'
  JOIN marks x ON o.doc_id = x.doc_id AND x.kind = 'next'
  WHERE o.kind = 'own'),
ends AS (
  SELECT *,
    least(CASE WHEN len(a) >= {SKETCH} THEN a[-1] END, CASE WHEN len(b) >= {SKETCH} THEN b[-1] END)
      AS end_b,
    least(CASE WHEN len(a) >= {SKETCH} THEN a[-1] END, CASE WHEN len(c) >= {SKETCH} THEN c[-1] END)
      AS end_c
  FROM wide),
counts AS (
  SELECT doc_id, fingerprint, edited_fingerprint,
    len(list_filter(list_distinct(list_concat(a, b)), lambda h: end_b IS NULL OR h <= end_b)) AS ub,
    len(list_filter(list_intersect(a, b), lambda h: end_b IS NULL OR h <= end_b)) AS ib,
    len(list_filter(list_distinct(list_concat(a, c)), lambda h: end_c IS NULL OR h <= end_c)) AS uc,
    len(list_filter(list_intersect(a, c), lambda h: end_c IS NULL OR h <= end_c)) AS ic
  FROM ends)
SELECT w.doc_id, w.n AS n_chars, sha256(w.edited) AS edited_sha256, c.fingerprint,
       c.edited_fingerprint,
       CASE WHEN ub = 0 THEN 1.0::DOUBLE ELSE (2 * ib)::DOUBLE / (ub + ib)::DOUBLE END AS near_edited,
       CASE WHEN uc = 0 THEN 1.0::DOUBLE ELSE (2 * ic)::DOUBLE / (uc + ic)::DOUBLE END AS near_next
FROM whole w JOIN counts c ON w.doc_id = c.doc_id
"""
