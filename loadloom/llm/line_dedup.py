"""Removal of lines that stand on many sites; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import drop_table, open_table, row_key, same, write_table

NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Distinct sites from which on a line is boilerplate.
SITES = 5
#: A document whose widespread lines make up more than this share of its characters is a near-duplicate of others, or a bare notice (the
#: similarity from which on texts count as near-duplicates): it doesn't count towards a line's spread. Boilerplate is removed from it like
#: from any other; pages that are navigation for most of their text still count.
MOST_SHARED = 0.8
#: Sketches have 2^LOG_K registers. Their error is under 0.1 % up to 20 sites, where they still list single hashes, and 0.065 as a standard
#: deviation beyond; estimates within NEAR (5 deviations) of the threshold are counted exactly, so others are on the right side.
LOG_K, NEAR = 8, 0.35


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """doc_id, text_key, site, position, text_chars, and two independent hashes of each line that has a word."""
    own = [F.col("doc_id"), row_key(["text"]).alias("text_key"), F.col(site).cast("string").alias("site"), F.char_length("text").alias("text_chars")]
    each = docs.select(*own, F.posexplode(F.split("text", "\n")).alias("position", "line")).filter(F.col("line").rlike(NOT_SPACE))
    return each.select("doc_id", "text_key", "site", "text_chars", "position", F.char_length("line").alias("chars"), F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def widespread(lines: DataFrame, sites: int) -> tuple[DataFrame, str]:
    """(h1, h2, sites) of the lines whose sketched spread isn't surely under ``sites``, and the table that holds them. A very common
    line is pre-aggregated into one sketch a task."""
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_K))).alias("sites")).filter(F.col("sites") >= sites * (1 - NEAR))
    path = write_table(sketched, "line-sketches")
    return open_table(lines.sparkSession, path, sketched), path


def settled(sketched: DataFrame, hits: DataFrame, sites: int) -> DataFrame:
    """(h1, h2) of the lines on at least ``sites`` distinct sites: by the sketch well above the threshold, else by exact counts of the
    occurrences ``hits``."""
    near = sketched.filter(F.col("sites") < sites * (1 + NEAR)).select("h1", "h2")
    exact = hits.join(near, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= sites)
    return sketched.filter(F.col("sites") >= sites * (1 + NEAR)).select("h1", "h2").union(exact.select("h1", "h2"))


def boilerplate_hits(docs: DataFrame, site: str, sites: int, most_shared: float) -> DataFrame:
    """The occurrences of boilerplate lines: doc_id, text_key, position, chars.

    Copies of a document on many sites would make all its lines widespread. So lines are counted twice: over all documents, and then,
    of the widespread ones, over the documents that widespread lines make up no more than ``most_shared`` of.
    """
    spark = docs.sparkSession
    lines = line_rows(docs, site)
    sketched, sketches = widespread(lines, sites)
    near = lines.join(sketched.select("h1", "h2"), ["h1", "h2"])
    path = write_table(near, "line-candidates")
    near = open_table(spark, path, near)
    shared = settled(sketched, near, sites)
    hits = near.join(shared, ["h1", "h2"])
    hits_path = write_table(hits, "line-shared")
    drop_table(spark, sketches)
    drop_table(spark, path)
    hits = open_table(spark, hits_path, hits)
    # rows that share id and text also share their counts, so they are one document here
    covered = hits.groupBy("doc_id", "text_key", "text_chars").agg(F.collect_set(F.struct("position", "chars")).alias("own"))
    chars = F.aggregate("own.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    copies = covered.filter(chars > F.col("text_chars") * most_shared).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    votes = hits.join(copies, same(F.col("doc_id"), F.col("_id")) & (F.col("text_key") == F.col("_key")), "left_anti")
    voted, votes_path = widespread(votes, sites)
    found = hits.join(settled(voted, votes, sites), ["h1", "h2"], "left_semi").select("doc_id", "text_key", "position", "chars")
    out = open_table(spark, write_table(found, "line-boilerplate"), found)
    drop_table(spark, votes_path)
    drop_table(spark, hits_path)
    return out


def without(lines: Column, positions: Column) -> Column:
    """The lines but for those at these positions, in time proportional to their number."""
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), positions)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(docs: DataFrame, site: str = "source", sites: int = SITES, most_shared: float = MOST_SHARED) -> DataFrame:
    """Each row of ``docs`` in ``doc``, its cleaned ``text``, n_lines, n_removed and removed_chars.

    A line with a word is boilerplate if it stands on at least ``sites`` distinct sites, counting documents that aren't made up of
    widespread lines for the most part (see ``boilerplate_hits``); all its occurrences go from all documents, with their line feeds.
    Null text: stays null, no lines. Null site: counts as no site. Null doc_id and repeated rows: treated like any other row.
    Empty texts and those without words: unchanged. A text of boilerplate only becomes empty. Very long texts and many lines: linear time.
    Empty table: no rows. Other columns, whatever their names, stay inside ``doc``.
    """
    hits = boilerplate_hits(docs, site, sites, most_shared)
    own = hits.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.collect_set(F.struct("position", "chars")).alias("hits"))
    own = own.select("_id", "_key", F.col("hits.position").alias("positions"), F.aggregate("hits.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("chars"))
    rows = docs.select(F.struct("*").alias("doc"))
    found = rows.join(own, same(F.col("doc.doc_id"), F.col("_id")) & same(row_key(["doc.text"]), F.col("_key")), "left")
    lines = F.split(F.coalesce("doc.text", F.lit("")), "\n")
    goes, none = F.col("chars").isNotNull(), F.lit(0).cast("long")
    n_lines = F.size(F.filter(lines, lambda x: x.rlike(NOT_SPACE))).cast("long")
    return found.select(
        "doc",
        F.when(goes, without(lines, F.col("positions"))).otherwise(F.col("doc.text")).alias("text"),
        n_lines.alias("n_lines"),
        F.when(goes, F.size("positions").cast("long")).otherwise(none).alias("n_removed"),
        F.when(goes, F.col("chars")).otherwise(none).alias("removed_chars"),
    )


def clean_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with cleaned texts, all columns and rows in place; n_chars, where there is one, follows the text. Cases as in ``dedup_lines``."""
    found = dedup_lines(docs)
    columns = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return found.select(*(columns[c].alias(c) if c in columns else F.col("doc").getField(c).alias(c) for c in docs.columns))
