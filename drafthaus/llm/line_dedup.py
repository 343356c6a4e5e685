"""Substring dedup by line or paragraph hashing, with sentences as a finer unit."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free, give_back, in_batches, small, written

#: Where a unit ends, by its kind.  Each pattern reads a text once, whatever stands in it.
ENDS = {
    "paragraph": re.compile(r"(?<!\n)\n(?:[ \t\r]*+\n)++"),
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"(?<![.!?])[.!?]++(?=[ \t\r\f\v])|\n"),  # of a line
}
#: Documents with removed spans that may be broadcast; beyond that the texts are shuffled.
BROADCAST_DOCS = 500_000
#: A map task hands its units on when it holds so many.
BUFFER = 50_000
LAST = 2**63 - 1


def units(text: str, kind: str = "line") -> list[tuple[int, int, int, int]]:
    """(start, end, words, 128-bit digest of the normalised unit) of each unit with a word."""
    import xxhash

    out, begin = [], 0
    ends = [m.span() if kind != "sentence" or m.group() == "\n" else (m.end(), m.end()) for m in ENDS[kind].finditer(text)]
    for end, after in [*ends, (len(text), len(text))]:
        words = text[begin:end].lower().split()
        if words:
            out.append((begin, end, len(words), xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))))
        begin = after
    return out


def _units(kind: str):
    low = (1 << 64) - 1

    def run(batches):
        held: list[list[np.ndarray]] = []
        count = 0

        def sent():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[i] for h in held])) for i in range(8)], names=["doc", "key", "no", "start", "end", "words", "d1", "d2"])

        for batch in batches:
            ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                found = units(batch.column(2)[i].as_py() or "", kind)
                if not found:
                    continue
                start, end, words, digest = zip(*found)
                n = len(found)
                held.append([np.full(n, ids[i], np.int64), np.full(n, keys[i], np.int64), np.arange(n, dtype=np.int32), np.array(start, np.int32), np.array(end, np.int32), np.array(words, np.int32), np.array([d >> 64 for d in digest], np.uint64).view(np.int64), np.array([d & low for d in digest], np.uint64).view(np.int64)])
                count += n
                if count >= BUFFER:
                    yield sent()
                    held, count = [], 0
        if held:
            yield sent()
        held.clear()
        give_back()

    return run


def repeated_spans(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document that loses something: doc, key (the text's hash), spans array<struct<start, end, words>>.

    Units are lines, paragraphs (parted by blank lines) or sentences within lines, normalised to lower case and single
    spaces and named by a 128-bit digest.  Of each digest the occurrence with the smallest (id, hash of the text,
    place) is kept.  Neighbouring units that occur earlier elsewhere form a span; spans of at least min_words words
    are to be removed, so 1 means every later occurrence.  start and end are offsets (characters) in the original text.

    A digest's first place is a minimum, so that map tasks send one row per digest each, however common a unit is; its
    occurrences meet that row in a join.  The rows are written first, since Spark splits a join's large partitions only
    where both sides come straight from a shuffle.
    """
    if unit not in ENDS:
        raise ValueError(f"unit: {', '.join(ENDS)}")
    base = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    found = in_batches(base).mapInArrow(_units(unit), "doc long, key long, no int, start int, end int, words int, d1 long, d2 long")
    place = F.struct("doc", "key", "no")
    first = written(found.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select("d1", "d2", "first"))
    again = found.join(first, ["d1", "d2"]).where(place != F.col("first")).select("doc", "key", "no", "start", "end", "words").distinct()  # of rows that are alike, one stands for all
    order = Window.partitionBy("doc", "key").orderBy("no")
    runs = again.repartition("doc", "key").withColumn("run", F.col("no") - F.row_number().over(order))
    spans = runs.groupBy("doc", "key", "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("words")).where(F.col("words") >= min_words)
    return spans.groupBy("doc", "key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "words"))).alias("spans"))  # of one document


def dedup_substrings(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the repeated spans in text_col; adds removed: array<struct<start, end, words>>, in order.

    All other columns of docs are kept, whatever their names (a column named removed is replaced).  What lies between
    two removed spans stays as it is, white space included.  A null or empty text stays so, with no spans.  Rows with
    a null id rank last; rows with equal ids and texts are one document, so repeated rows all keep what the first keeps
    and come back as often.  Texts of equal ids rank by their hash.  An empty table gives none.
    """
    columns = [c for c in docs.columns if c.lower() != "removed"]
    docs = docs.select(*columns)
    doc, key, spans = free(docs, "doc", "key", "spans")
    found = written(repeated_spans(docs, unit, min_words, id_col, text_col)).toDF(doc, key, spans)
    keyed = docs.withColumns({doc: F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), key: F.xxhash64(text_col)})
    joined = keyed.join(small(found, BROADCAST_DOCS), [doc, key], "left")
    removed = F.coalesce(F.col(spans), F.array().cast("array<struct<start:bigint,end:bigint,words:bigint>>"))
    text = F.aggregate(F.reverse(F.col(spans)), F.col(text_col), lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.substring(t, s["end"].cast("int") + 1, F.length(t))))
    return joined.select(*[F.when(F.size(spans) > 0, text).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in columns], removed.alias("removed"))
