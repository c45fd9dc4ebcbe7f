"""SimHash near-duplicates: fingerprints, a byte-position index with count filtering, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import arrow_map, drop_table, open_table, row_key, same, tables, write_table

BYTES = 8
#: Fingerprints at most this many bits apart are linked. They differ in as many bytes at most, so at least half of the 8 agree.
MAX_BITS = 4
LEAST_SHARED = BYTES - MAX_BITS
#: Posting lists up to this length are compared in one task. Longer ones are split by each further byte position, and the members of
#: parts that are still longer are linked through midpoints; so a fingerprint meets at most 20 lists, or 70 parts, of this length.
LIST_BOUND = 4_096
SHINGLE = 4


def covering() -> list[tuple[int, ...]]:
    """Triples of byte positions such that any 4 of the 8 positions hold one: positions fall into three classes, and a triple
    lies in one class or has two in a class and one in the next."""
    classes = [(0, 1, 2), (3, 4, 5), (6, 7)]
    found = [c for c in classes if len(c) == 3]
    for i, own in enumerate(classes):
        for pair in combinations(own, 2):
            found += [tuple(sorted((*pair, other))) for other in classes[(i + 1) % 3]]
    assert all(any(set(t) <= set(four) for t in found) for four in combinations(range(BYTES), LEAST_SHARED))
    return found


def fingerprint(text: str | None) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64 (seed 42)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    digest, total, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(words) - SHINGLE + 1
    ends = ends[SHINGLE - 1 :].tolist()
    for at in range(0, n, 8192):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : min(at + 8192, n)], ends[at : at + 8192], strict=True)], dtype="<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, a key of the text, and the fingerprint as a signed long."""

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t) for t in batch.column(2).to_pylist()), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], names=["doc_id", "text_key", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", row_key(["text"]).alias("text_key"), "text"), make, f"doc_id {kind}, text_key long, print long")


def posting_keys() -> Column:
    """The index keys of a fingerprint: for each covering triple, its number and the three bytes at its positions."""
    byte = lambda p: F.shiftrightunsigned("print", 8 * p).bitwiseAND(F.lit(0xFF))
    keys = []
    for number, triple in enumerate(covering()):
        key = F.lit(number).cast("long")
        for p in triple:
            key = F.shiftleft(key, 8).bitwiseOR(byte(p))
        keys.append(key)
    return F.array(*keys)


def split_keys(key: str) -> Column:
    """The keys of a fingerprint in the parts of one of its posting lists: the list's triple and one further position, as the number of
    these four positions and the fingerprint's bytes there. Two members that share 4 bytes meet in one of the parts."""
    fours = list(combinations(range(BYTES), LEAST_SHARED))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    masks = [signed(sum(0xFF << 8 * p for p in four)) for four in fours]
    parts = [[k for k, four in enumerate(fours) if set(triple) < set(four)] for triple in covering()]
    numbers = F.element_at(F.lit(parts), F.shiftrightunsigned(key, 24).cast("int") + 1)
    return F.transform(numbers, lambda k: F.struct(k.alias("four"), F.col("print").bitwiseAND(F.element_at(F.lit(masks), k + 1)).alias("bytes")))


def linked_in(values: np.ndarray) -> list[tuple[int, int]]:
    """Star links (smallest member, member) of the components within one posting list, compared block by block.

    Pairs are filtered by the tally of positional bytes that they share, then verified by their differing bits.
    """
    values = np.sort(values.view(np.uint64))
    label = np.arange(len(values))
    for i in range(len(values) - 1):
        differ = values[i + 1 :] ^ values[i]
        shared = np.count_nonzero(differ.view(np.uint8).reshape(-1, BYTES) == 0, axis=1)
        near = np.flatnonzero(shared >= LEAST_SHARED)
        near = near[np.bitwise_count(differ[near]) <= MAX_BITS] + i + 1
        joined = np.unique(np.append(label[near], label[i]))
        if len(joined) > 1:
            label[np.isin(label, joined)] = joined[0]
    signed = values.view(np.int64)
    return [(int(signed[r]), int(signed[i])) for i, r in enumerate(label.tolist()) if r != i]


def list_links(lists: DataFrame) -> DataFrame:
    """Links (a, b) within posting lists of bounded length."""

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        members, found = batch.column(0), []
        for i in range(batch.num_rows):
            found += linked_in(members[i].values.to_numpy(zero_copy_only=False))
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return arrow_map(lists.select("prints"), compare, "a long, b long")


def midpoint_links(prints: DataFrame) -> DataFrame:
    """Links through midpoints: two fingerprints at most 4 bits apart, and no others, share one at most 2 bits from both.

    Rows grow in proportion to the fingerprints (2,081 each), whatever the size of their group.
    """
    flips = [0, *(1 << i for i in range(64)), *((1 << i) | (1 << j) for i, j in combinations(range(64), 2))]
    masks = F.array(*[F.lit(m - (1 << 64) if m >= 1 << 63 else m).cast("long") for m in flips])
    points = prints.select("print", F.explode(masks).alias("mask")).select("print", F.col("print").bitwiseXOR(F.col("mask")).alias("point"))
    stars = points.groupBy("point").agg(F.min("print").alias("a"), F.max("print").alias("most")).filter("a <> most").select("point", "a")
    return points.join(stars, "point").filter("print <> a").select("a", F.col("print").alias("b")).distinct()


def list_lengths(postings: DataFrame, name: str) -> DataFrame:
    counts = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    return open_table(postings.sparkSession, write_table(counts, name), counts)


def short_links(postings: DataFrame, counts: DataFrame, list_bound: int) -> DataFrame:
    short = postings.join(counts.filter(F.col("n") <= list_bound).select("key"), "key")
    return list_links(short.groupBy("key").agg(F.collect_list("print").alias("prints")))


def links(prints: DataFrame, list_bound: int = LIST_BOUND) -> DataFrame:
    """Links that keep all components of distinct fingerprints ``prints``; copies need none."""
    postings = prints.select(F.explode(posting_keys()).alias("key"), "print")
    counts = list_lengths(postings, "simhash-lists")
    found = short_links(postings, counts, list_bound)
    long = counts.filter(F.col("n") > list_bound).select("key")
    if not long.isEmpty():
        split = postings.join(long, "key", "left_semi").select(F.explode(split_keys("key")).alias("key"), "print").distinct()
        parts = list_lengths(split, "simhash-parts")
        found = found.union(short_links(split, parts, list_bound))
        hot = parts.filter(F.col("n") > list_bound).select("key")
        if not hot.isEmpty():
            found = found.union(midpoint_links(split.join(hot, "key", "left_semi").select("print").distinct()))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(print, root): the smallest member of each linked fingerprint's component, by alternating large and small stars."""
    spark = edges.sparkSession
    path = write_table(edges, "simhash-links")
    pairs, before = open_table(spark, path, edges), None
    while True:
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).filter("a <> b").distinct()
        new = write_table(small, "simhash-links")
        drop_table(spark, path)
        path, pairs = new, open_table(spark, new, small)
        now = pairs.agg(F.count("*"), F.countDistinct("b"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == now[1] and pairs.join(pairs.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            return pairs.select(F.col("b").alias("print"), F.col("a").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, list_bound: int = LIST_BOUND) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits), component_id (smallest doc_id reachable), first (the document its component keeps).

    Fingerprints link at 4 or fewer differing bits. An inverted index on triples of byte positions finds every pair that shares
    at least 4 of its 8 bytes; such pairs are tallied and verified inside their posting lists, which give stars, not pairs.
    Copies are merged by fingerprint before anything is indexed, so a large group of them costs nothing.
    Null or empty text: fingerprint zero, linked like any other. Very long texts: hashed whole, block by block. Null doc_id: never names a component unless all its documents lack
    one (component_id is then null). Repeated rows: each in the result, and each ``first`` if one is. Empty table: no rows.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    with tables(spark) as own:
        rows = fingerprints(docs)
        own.keep(prints := write_table(rows, "simhash-prints"))
        table = open_table(spark, prints, rows)
        least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key"))
        distinct = table.groupBy("print").agg(least.alias("least"))
        distinct = open_table(spark, write_table(distinct, "simhash-distinct"), distinct)
        members = components(links(distinct.select("print"), list_bound))
        rooted = distinct.join(members, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
        own.keep(path := write_table(rooted, "simhash-rooted"))
        rooted = open_table(spark, path, rooted)
    heads = rooted.groupBy("root").agg(F.min("least").alias("head"))
    of_print = rooted.join(heads, "root").select("print", "head")
    first = same(F.col("doc_id"), F.col("head.doc_id")) & same(F.col("text_key"), F.col("head.text_key"))
    hexed = F.lower(F.lpad(F.hex("print"), 16, "0"))
    return table.join(of_print, "print").select("doc_id", "text_key", hexed.alias("fingerprint"), F.col("head.doc_id").alias("component_id"), first.alias("first"))


def keep_first(docs: DataFrame, list_bound: int = LIST_BOUND) -> DataFrame:
    """One document of each near-duplicate group, with all columns: that of the smallest id, then the smallest hash of its text. Repeated
    rows are one document; where they differ in other columns, the one whose JSON sorts first stays. Other cases as in ``near_duplicates``."""
    spark = docs.sparkSession
    with tables(spark) as own:
        firsts = near_duplicates(docs, list_bound).filter("first").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
        own.keep(path := write_table(firsts, "simhash-first"))
        firsts = open_table(spark, path, firsts)
    kept = firsts.distinct()
    rows = docs.select(F.struct("*").alias("_row"))
    of_row = same(F.col("_row.doc_id"), F.col("_kept_id")) & same(row_key(["_row.text"]), F.col("_kept_key"))
    found = rows.join(kept, of_row)
    if firsts.count() > kept.count():
        found = found.groupBy("_kept_id", "_kept_key").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return found.select("_row.*")
