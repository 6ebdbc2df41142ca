"""Pages: extraction, entity scan, change detection and the submission states."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.functions.html import parse_page
from kgspark.operators.name_trie import scan_entities  # noqa: F401
from kgspark.operators.notes import short_name
from kgspark.session import spread


def extract(pages: DataFrame, keep: list[str], max_chars: Optional[int] = None) -> DataFrame:
    """Metadata, readable text, word count and content hash of raw pages.

    The whole text is kept; ``max_chars`` cuts it and says so in the text.
    """
    page = spread(pages).select(*keep, parse_page("html").alias("p")).select(*keep, "p.*")
    if max_chars:
        note = F.concat(F.substring("content", 1, max_chars), F.lit("\n\n[content truncated]"))
        page = page.withColumn("content", F.when(F.length("content") > max_chars, note).otherwise(F.col("content")))
    words = X.word_count(F.col("content"))
    return page.withColumn("word_count", words).withColumn("content_hash", F.sha2("content", 256)).withColumn(
        "sparse", F.col("word_count") < fixed.SPARSE_PAGE_WORDS)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """NEW, UPDATE, FORGET or SAME per key, by comparing content hashes."""
    a = old.select(F.col(key), F.col(digest).alias("old_hash"))
    b = new.select(F.col(key), F.col(digest).alias("new_hash"))
    change = (
        F.when(F.col("old_hash").isNull(), "NEW").when(F.col("new_hash").isNull(), "FORGET")
        .when(F.col("old_hash") != F.col("new_hash"), "UPDATE").otherwise("SAME")
    )
    return a.join(b, key, "full_outer").select(key, change.alias("change"), "old_hash", "new_hash")


def due_for_check(pages: DataFrame, limit: int) -> DataFrame:
    """The monitored pages to look at next: those never fetched first, then the longest ago."""
    return pages.filter("status = 'monitoring'").orderBy(F.col("fetched_at").asc_nulls_first(), "rid").limit(limit)


def longest_first(names: DataFrame, limit: int) -> DataFrame:
    """The longest names, in the order in which they are listed; ties by name and uri."""
    return names.orderBy(F.length("name").desc(), "name", "uri").limit(limit)


def evaluate(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Previewed submissions become evaluated or rejected; ``applied`` is false for other states.

    Of several decisions on one rid, a rejection stands.
    """
    joined = submissions.join(decisions.groupBy("rid").agg(F.min("accept").alias("accept")), "rid", "left")
    move = (F.col("status") == "previewed") & F.col("accept").isNotNull()
    status = F.when(move & F.col("accept"), "evaluated").when(move, "rejected").otherwise(F.col("status"))
    return joined.withColumn("applied", move).withColumn("status", status).drop("accept")


def ingest(submissions: DataFrame) -> DataFrame:
    """Evaluated submissions become ingested and get the path of their note."""
    safe = F.regexp_replace(F.coalesce("title", "domain"), r"[^\p{L}\p{N}_\s-]", "")
    name = short_name(X.strip(F.regexp_replace(X.strip(safe), r"\s+", " ")), F.col("rid"), 60)
    name = F.when(name == "", F.translate("domain", ".", "_")).otherwise(name)
    done = F.col("status") == "evaluated"
    return submissions.withColumn("note_path", F.when(done, F.concat(F.lit("Sources/"), name, F.lit(".md")))).withColumn(
        "status", F.when(done, "ingested").otherwise(F.col("status")))


def bad_status(submissions: DataFrame) -> DataFrame:
    return submissions.filter(~F.col("status").isin(fixed.PAGE_STATUSES))
