"""Line dedup: lines that many documents share stay only in the first of them.

Every line is brought to a key and hashed; distinct documents are counted per hash; lines whose count reaches the bound
are dropped but in the smallest doc_id; what stays is joined in its order. Only hashes and places are shuffled for the counts,
whole texts once, when the dropped places come back to their documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import let
from florilege.llm.common import packed

#: Documents that must share a line, and code points its key must have.
LEAST_DOCS, SHORTEST = 2, 10
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and no other letter changed; ``lower`` does it at once where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return let(F.btrim(line, F.lit(SPACE)), ascii_lower)


def digest(text: Column) -> Column:
    """128 bits of the SHA-256 of a text, as bytes."""
    return F.unhex(F.left(F.sha2(text.cast("binary"), 256), F.lit(32)))


def split_lines(docs: DataFrame) -> DataFrame:
    """Every row with its id, the digest of its text, the text without null, and the row itself as ``_row``."""
    whole = packed(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), "_row")
    return whole.withColumn("_print", digest(F.col("_text")))


def places(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, _print, place, line): the digest of the key of every line that is long enough to count."""
    hashed = F.transform(F.split("_text", "\n", -1), lambda x: let(line_key(x), lambda k: F.when(F.length(k) >= shortest, digest(k))))
    rows = split_lines(docs).select("doc_id", "_print", F.posexplode(hashed).alias("place", "line"))
    return rows.where(F.col("line").isNotNull())


def shared_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, shortest: int = SHORTEST) -> DataFrame:
    """(line, first, n_docs): lines of at least ``least_docs`` distinct documents and the smallest id among them.

    All rows without an id count as one document behind all others. A very common line is pre-aggregated per document
    and task, so no task sees all of its rows.
    """
    ids = places(docs, shortest).groupBy("line").agg(F.count_distinct("doc_id").alias("_ids"), F.min("doc_id").alias("first"), F.max(F.col("doc_id").isNull().cast("int")).alias("_none"))
    return ids.select("line", "first", (F.col("_ids") + F.col("_none")).alias("n_docs")).where(F.col("n_docs") >= least_docs)


def drop_shared(docs: DataFrame, least_docs: int = LEAST_DOCS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, kept, n_lines, n_dropped, _row) for each row of ``docs``: its text without lines that an earlier document has.

    Null and empty texts are one empty line. Rows of one id are one document and keep or lose a line together; a line
    repeated within the document that keeps it stays each time. A text that loses all lines is empty. Rows without an
    id lose what any document with an id has, and keep what only they have. An empty table gives an empty result;
    columns of any other name are carried in ``_row``.
    """
    found = places(docs, shortest).join(shared_lines(docs, least_docs, shortest), "line").where(~F.col("doc_id").eqNullSafe(F.col("first")))
    gone = found.groupBy(F.col("doc_id").alias("_id"), F.col("_print").alias("_of")).agg(F.collect_set("place").alias("_gone"))
    rows = split_lines(docs)
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_print") == F.col("_of")), "left")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
        return F.struct(F.array_join(F.transform(stay, lambda p: F.get(lines, p)), "\n").alias("kept"), F.size(lines).cast("long").alias("n_lines"))

    whole = lambda lines: F.struct(F.col("_text").alias("kept"), F.size(lines).cast("long").alias("n_lines"))
    split = F.split("_text", "\n", -1)
    done = rows.withColumn("_done", F.when(F.col("_gone").isNull(), let(split, whole)).otherwise(let(split, rest)))
    return done.select("doc_id", F.col("_done.kept").alias("kept"), F.col("_done.n_lines").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), "_row")


def without_shared_lines(docs: DataFrame, least_docs: int = LEAST_DOCS, shortest: int = SHORTEST) -> DataFrame:
    """The documents with their remaining lines as text and n_chars as its length; untouched rows come as they are."""
    done = drop_shared(docs, least_docs, shortest)
    row, cut = F.col("_row"), F.col("n_dropped") > 0
    changed = {"text": F.when(cut, F.col("kept")).otherwise(row["text"])}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(cut, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(row["n_chars"])
    return done.select(*[changed.get(c, row[c]).alias(c) for c in docs.columns])
