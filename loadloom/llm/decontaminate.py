"""Benchmark decontamination by a prefix-filtered set join; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import ascii_lower, open_table, row_key, same, shared_table, tables, write_table

WINDOW = 13
#: A word: a run of a-z, 0-9 and characters beyond ASCII. The other characters are named one by one, since Java's regex looks these up in a
#: table, where it asks each range of a class in turn; with ranges the same words took six times as long.
WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(0x80) if not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A)) + "]+"
#: Windows whose prefix tokens are broadcast (some 300 bytes each); more of them are joined by a shuffle.
BROADCAST_WINDOWS = 200_000


def words(text: str) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """Distinct windows of the items: words, and the items that have them."""
    w = benchmark.select("item_id", words("text").alias("words"))
    n = F.size("words")
    starts = F.sequence(F.lit(1), F.greatest(n - WINDOW + 1, F.lit(1)))
    each = w.filter(n > 0).select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, WINDOW))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item_id").alias("items"))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """Each window with its prefix token. Containment of the whole window needs one token: its rarest in the documents."""
    vocabulary = windows.select(F.explode("window").alias("token")).distinct()
    side = F.broadcast(vocabulary) if windows.count() <= BROADCAST_WINDOWS else vocabulary
    seen = docs.select(F.explode(words("text")).alias("token")).join(side, "token").groupBy("token").agg(F.count("*").alias("n"))
    seen = shared_table(seen, "benchmark-rarity")
    tokens = windows.select("window", "items", F.posexplode("window").alias("offset", "token")).join(seen, "token", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset"))
    chosen = tokens.groupBy("window").agg(rarest.alias("rarest"), F.first("items").alias("items"))
    # a window with a word that no document has cannot occur
    return chosen.filter("rarest.n > 0").select("window", "items", F.col("rarest.token").alias("token"), F.col("rarest.offset").alias("offset"))


def occurrences(rows: DataFrame, prefix: DataFrame, broadcast: bool) -> DataFrame:
    """The windows found in each row, one row each, and a row with position 0 for each row of ``rows`` (row, words, ...)."""
    marked = F.concat(F.array(F.lit(None).cast("string")), "words")
    length = F.size("window")
    start = F.col("position") - F.col("offset")  # of the window in the words, from 1
    fits = (start >= 1) & (start + length - 1 <= F.size("words"))  # positional and length bounds
    holds = fits & (F.slice("words", start, length) == F.col("window"))
    if broadcast:
        each = rows.select("*", F.posexplode(marked).alias("position", "token"))
        found = each.join(F.broadcast(prefix), "token", "left").filter((F.col("position") == 0) | holds)
    else:
        # beyond the bound: only (row, position) meets the prefix tokens, and the candidates meet their words again
        rows = shared_table(rows, "document-words")
        each = rows.select("row", F.posexplode("words").alias("at", "token")).select("row", (F.col("at") + 1).alias("position"), "token")
        candidates = each.join(prefix, "token")
        found = candidates.join(rows, "row").filter(holds)
        found = found.unionByName(rows.withColumn("position", F.lit(0)), allowMissingColumns=True)
    return found.select("row", "doc_id", "text_key", "position", F.size("words").alias("n_words"), start.alias("start"), length.alias("length"), "items")


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, text_key, n_words, n_hit, items (sorted ids as strings), contaminated; one row for each row of ``docs``.

    A document word is hit if an occurrence of an item's window of 13 consecutive words (a whole item if shorter) covers it;
    a document is contaminated if at least a twentieth of its words are hit.
    Words are ordered by their count in the documents; a window is looked up by its rarest word only, placed by that word's
    offset, bounded by the text's ends, and compared word by word. Positions never leave the task that read the text unless the
    window matches, so a very common word or passage moves nothing.
    Null or empty text: no words. Null item_id: hits words and names no item. Items without words: no window. Null doc_id: stays
    null. Repeated rows: each in the result; repeated items: one window. Empty tables: no rows, or nothing hit. Other columns are ignored.
    """
    with tables(docs.sparkSession) as own:
        windows = shared_table(item_windows(benchmark), "benchmark-windows")
        few = windows.count() <= broadcast_windows
        prefix = shared_table(prefixes(windows, docs), "benchmark-prefixes")
        own.keep(own.paths[-1])
    rows = docs.select("doc_id", row_key(["text"]).alias("text_key"), words("text").alias("words"), F.monotonically_increasing_id().alias("row"))
    found = occurrences(rows, prefix, few)
    hit = F.col("position") > 0
    per_row = found.groupBy("row", "doc_id", "text_key").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set(F.when(hit, F.struct("start", "length")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set(F.when(hit, F.col("items"))))).alias("items"),
    )
    covered = F.aggregate(
        "hits",
        F.struct(F.lit(1).alias("upto"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(
            F.greatest(acc["upto"], s["start"] + s["length"]).alias("upto"),
            (acc["n"] + F.greatest(s["start"] + s["length"] - F.greatest(acc["upto"], s["start"]), F.lit(0))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    counted = per_row.select("doc_id", "text_key", "n_words", covered.alias("n_hit"), ids.alias("items"))
    return counted.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all columns; repeated rows stay repeated. Other cases as in ``contamination``."""
    with tables(docs.sparkSession) as own:
        bad = contamination(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("text_key").alias("_bad_key")).distinct()
        own.keep(path := write_table(bad, "contaminated"))
        bad = open_table(docs.sparkSession, path, bad)
    rows = docs.select(F.struct("*").alias("_row"))
    of_row = same(F.col("_row.doc_id"), F.col("_bad_id")) & same(row_key(["_row.text"]), F.col("_bad_key"))
    return rows.join(bad, of_row, "left_anti").select("_row.*")
