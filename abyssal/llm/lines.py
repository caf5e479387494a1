"""Line deduplication with DataFrame functions only.

Line hashes are range-partitioned with their documents, so that a line found everywhere
spreads over as many partitions as it needs, and sorted within by position, so the first
occurrence of a line in each document comes first. What comes out is a sparse keep
bitmap per document, not text.

A document is a (doc_id, text) pair: repeated rows count once and get the same result.
A null text or id is a value like any other; a null text is one empty line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, parts, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = " \t\n\x0b\f\r"
#: A table of frequent lines up to this many rows (20 bytes each) is broadcast.
BROADCAST_LINES = 400_000


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    bare = F.trim(line, F.lit(_SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def _identity(docs: DataFrame) -> list[Column]:
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(_text(docs)).alias("_sig")]


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int) -> tuple[DataFrame, DataFrame]:
    """All lines with a key of ``min_chars`` code points or more, as (h1, h2, _doc, _sig, pos), and
    of their hashes those found in at least ``min_docs`` documents."""
    split = docs.select(*_identity(docs), F.posexplode(F.split(_text(docs), "\n", -1)).alias("pos", "line"))
    key = line_key(F.col("line"))
    lines = stored(
        split.select("_doc", "_sig", "pos", key.alias("key")).where(F.char_length("key") >= max(1, min_chars)).select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "_doc", "_sig", "pos"),
        "lines",
    )
    runs = lines.repartitionByRange(parts(docs.sparkSession), "h1", "h2", "_doc", "_sig")
    place = F.row_number().over(Window.partitionBy("h1", "h2", "_doc", "_sig").orderBy("pos"))
    first = runs.select("h1", "h2", place.alias("place")).where(F.col("place") == 1)
    return lines, first.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") >= min_docs).select("h1", "h2")


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (_doc, _sig, keep, n_dropped) of the documents that lose lines.

    ``keep`` holds, in order, the 64-line words in which some line goes: (word, bits),
    with a bit set for each line that stays. Words that stay whole are left out.
    """
    lines, often = frequent_lines(docs, min_docs, min_chars)
    often = stored(often, "frequent-lines")
    dropped = lines.join(F.broadcast(often) if often.count() <= BROADCAST_LINES else often, ["h1", "h2"])
    words = dropped.groupBy("_doc", "_sig", F.expr("pos div 64").cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("gone"))
    return words.groupBy("_doc", "_sig").agg(
        F.array_sort(F.collect_list(F.struct("word", F.bitwise_not("gone").alias("bits")))).alias("keep"),
        F.sum(F.bit_count("gone")).cast("long").alias("n_dropped"),
    )


def dense(keep: Column) -> Column:
    """The sparse bitmap as an array of words up to its last; words left out are all ones."""
    return F.flatten(
        F.transform(
            keep,
            lambda x, i: F.concat(
                F.array_repeat(F.lit(-1).cast("bigint"), x["word"] - F.when(i == 0, F.lit(-1)).otherwise(F.get(keep, i - 1)["word"]) - 1),
                F.array(x["bits"]),
            ),
        )
    )


def marked(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (_row, n_lines, n_dropped, kept): each document as it is, and its text without the lines whose
    key is found in at least ``min_docs`` documents.

    A text that loses no line is kept as it is; one that loses all becomes empty. An
    empty table gives no rows.
    """
    marks = stored(keep_bitmaps(docs, min_docs, min_chars), "keep-bitmaps")
    all_docs = docs.select(F.struct(*docs.columns).alias("_row"), *_identity(docs), _text(docs).alias("_text"))
    joined = beside(all_docs, marks, ["_doc", "_sig"], "left", row_bytes=64 + 16 * F.size("keep")).withColumn("_words", dense(F.col("keep")))
    stays = F.filter(F.split("_text", "\n", -1), lambda line, i: _bit(i))
    return joined.select(
        "_row",
        (F.octet_length("_text") - F.octet_length(F.translate("_text", "\n", "")) + 1).cast("long").alias("n_lines"),
        F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.col("_text")).otherwise(F.array_join(stays, "\n")).alias("kept"),
    )


def _bit(i: Column) -> Column:
    """Whether line ``i`` stays: its bit is set or its word is left out."""
    word = F.get(F.col("_words"), F.shiftright(i, 6))
    return word.isNull() | (F.call_function("shiftright", word, i.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Rows (doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    out = marked(docs.select("doc_id", "text"), min_docs, min_chars)
    return out.select("_row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
