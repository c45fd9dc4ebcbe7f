"""How far the word use of sources diverges within a language: a tournament of compressed count vectors."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.llm.common import plain_words, shared_table, tables


@dataclass(frozen=True)
class Audit:
    """A term counts in a language where at least ``in_docs`` of its documents hold it; ``top`` terms are reported for each group.

    ``blocks`` (even) is the number of blocks that a language's groups are dealt to: that many less one are the rounds. ``cell_entries``
    bounds the counts that one task packs or holds: a language's terms are split into as many parts as that takes. ``held_entries`` bounds
    the counts that a task combines before it passes them on.
    """

    in_docs: int = 10
    top: int = 10
    blocks: int = 8
    cell_entries: int = 1 << 16
    held_entries: int = 1_000_000


#: Probabilities are in billionths.
UNIT = 1_000_000_000
_CELL = "lang string, shard int, host int, round int, source string, n_group long, n_lang long, v long, size int, vector binary, terms binary"
_MET = "lang string, source string, part string, item string, value long"


def term_counts(docs: DataFrame, how: Audit) -> DataFrame:
    """(lang, source, term, n, docs) as each task has combined them; a group of any size spreads over the tasks that read it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs_of) in seen.items():
                terms = list(n)
                for at in range(0, len(terms), 50_000):
                    own = terms[at : at + 50_000]
                    columns = [pa.array([x] * len(own), pa.string()) for x in (lang, source)]
                    columns += [pa.array(own, pa.binary()).cast(pa.string(), safe=False), pa.array([n[t] for t in own], pa.int64()), pa.array([docs_of[t] for t in own], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            seen.clear()

        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                words = plain_words(text.as_py())
                if words:
                    n, docs_of = seen.setdefault((lang, source), (Counter(), Counter()))
                    n.update(words)
                    docs_of.update(set(words))
            if sum(len(n) for n, _ in seen.values()) > how.held_entries:
                yield from flushed()
        yield from flushed()

    return docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, how: Audit) -> DataFrame:
    """(lang, term, source, n, lang_n, first) of the terms that count; ``first`` marks one row of each term. One shuffle, by term."""
    of_term = Window.partitionBy("lang", "term")
    summed = term_counts(docs, how).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    spread = summed.withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1).withColumns({"in_docs": F.sum("docs").over(of_term), "lang_n": F.sum("n").over(of_term)})
    return spread.filter(F.col("in_docs") >= how.in_docs).select("lang", "term", "source", "n", "lang_n", "first")


def probability(counts: np.ndarray, total: int, v: int) -> np.ndarray:
    """1 + floor(UNIT * (count + 2) / (total + 2 v)), exactly: three digits of a long division, so that no product leaves 64 bits."""
    over = np.int64(total + 2 * v)
    whole, rest = np.divmod(np.asarray(counts, dtype=np.int64) + 2, over)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, over)
        whole = whole * 1000 + digit
    return whole + 1


def divergence(p: np.ndarray | int, q: np.ndarray | int) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def packed(ids: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes(), 1)


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(vector)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8", n, 4 * n).astype(np.int64)


def meetings(blocks: int) -> list[list[tuple[int, int, int]]]:
    """For each block the meetings that it travels to: (round, host, guest). In every round each block meets one other; over all rounds
    each pair meets once, and hosts change so that all receive about as many guests."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(blocks)]
    ring = blocks - 1
    for turn in range(ring):
        pairs = [(ring, turn)] + [((turn + k) % ring, (turn - k) % ring) for k in range(1, blocks // 2)]
        for k, (a, b) in enumerate(pairs):
            host, guest = (a, b) if (turn + k) % 2 else (b, a)
            found[guest].append((turn + 1, host, guest))
    return found


def vectors(entries: DataFrame, groups: DataFrame, how: Audit) -> DataFrame:
    """The cells' rows: each group's compressed vector at its own block (round 0) and wherever that block is a guest, and the language's
    vector with the terms (round -1) at every block that has groups."""
    travels = meetings(how.blocks)

    def pack(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        lang, shard = rows["lang"][0], rows["shard"][0]
        own = {s: (n, nl, v) for s, n, nl, v, t in zip(rows["source"], rows["n_group"], rows["n_lang"], rows["v"], rows["term"], strict=True) if t is None}
        held = [(t.encode("utf-8", "surrogatepass"), s, n, ln) for t, s, n, ln in zip(rows["term"], rows["source"], rows["n"], rows["lang_n"], strict=True) if t is not None]
        terms = sorted({t for t, *_ in held})
        at = {t: k for k, t in enumerate(terms)}
        of_source: dict[str, list[tuple[int, int]]] = {s: [] for s in own}
        of_lang = np.zeros(len(terms), dtype=np.int64)
        for t, s, n, ln in held:
            of_source[s].append((at[t], n))
            of_lang[at[t]] = ln
        block = {s: zlib.crc32(s.encode("utf-8", "surrogatepass")) % how.blocks for s in own}
        homes = sorted(set(block.values()))
        _, n_lang, v = next(iter(own.values()))
        out = [(lang, shard, h, -1, None, 0, n_lang, v, len(terms), packed(np.arange(len(terms)), of_lang), b"\n".join(terms)) for h in homes]
        for s, (n_group, *_) in sorted(own.items()):
            pairs = np.array(sorted(of_source[s]), dtype=np.int64).reshape(-1, 2)
            vector = packed(pairs[:, 0], pairs[:, 1])
            for turn, host in [(0, block[s]), *((r, h) for r, h, _ in travels[block[s]] if h in homes)]:
                out.append((lang, shard, host, turn, s, n_group, n_lang, v, len(terms), vector, None))
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in _CELL.split(", ")])

    nothing = lambda *names: [F.lit(None).cast("string" if n == "term" else "long").alias(n) for n in names]
    shards = groups.select("lang", "shards").distinct()
    counts = entries.join(shards, "lang").select("lang", F.pmod(F.xxhash64("term"), "shards").cast("int").alias("shard"), "source", "term", "n", "lang_n", *nothing("n_group", "n_lang", "v"))
    present = groups.select("lang", F.explode(F.sequence(F.lit(0), (F.col("shards") - 1).cast("int"))).alias("shard"), "source", *nothing("term", "n", "lang_n"), "n_group", "n_lang", "v")
    return counts.unionByName(present).groupBy("lang", "shard").applyInArrow(pack, _CELL)


class Cell:
    """The groups of one block in one part of a language's terms, and what they find out from each vector that comes by."""

    def __init__(self, n_lang: int, v: int, size: int, vector: bytes, terms: bytes, top: int):
        self.v, self.size, self.top = v, size, top
        self.terms = terms.split(b"\n") if size else []
        self.lang_p = probability(unpacked(vector)[1], n_lang, v) if size else np.zeros(0, dtype=np.int64)
        self.residents: list[tuple[str, np.ndarray, np.ndarray, int]] = []

    def opened(self, n_group: int, vector: bytes) -> tuple[np.ndarray, np.ndarray, int]:
        """Places of the terms that the group has, their probabilities, and that of any other term."""
        ids, counts = unpacked(vector)
        if not self.size:
            return ids, counts, 0
        return ids, probability(counts, n_group, self.v), int(probability(np.zeros(1), n_group, self.v)[0])

    def settle(self, source: str, n_group: int, vector: bytes) -> Iterator[tuple[str, str, bytes, int]]:
        """A resident meets the language, then those that settled before."""
        ids, p, rest = self.opened(n_group, vector)
        over = p > self.lang_p[ids]
        values = divergence(p[over], self.lang_p[ids[over]])
        best = nsmallest(self.top, ((-int(x), self.terms[i]) for x, i in zip(values, ids[over], strict=True)))
        yield from ((source, "term", term, -x) for x, term in best)
        yield from self.meet(source, ids, p, rest)
        self.residents.append((source, ids, p, rest))

    def visit(self, source: str, n_group: int, vector: bytes) -> Iterator[tuple[str, str, bytes, int]]:
        yield from self.meet(source, *self.opened(n_group, vector))

    def meet(self, source: str, ids: np.ndarray, q: np.ndarray, rest: int) -> Iterator[tuple[str, str, bytes, int]]:
        """Both directions of each meeting, over all terms of the part, in time proportional to the terms that either has."""
        spread, there = np.full(self.size, rest, dtype=np.int64), np.zeros(self.size, dtype=bool)
        spread[ids], there[ids] = q, True
        for name, own, p, own_rest in self.residents:
            value = 0
            if self.size:
                both = there[own]
                value = int(divergence(p, spread[own]).sum()) + int(divergence(own_rest, q).sum()) - int(divergence(own_rest, spread[own[both]]).sum())
                value += (self.size - len(own) - len(ids) + int(both.sum())) * int(divergence(own_rest, rest))
            yield name, "pair", source.encode("utf-8", "surrogatepass"), value
            yield source, "pair", name.encode("utf-8", "surrogatepass"), value


def met(cells: DataFrame, how: Audit) -> DataFrame:
    """What the cells find out. A task holds one cell's residents; peers stream past them in the order of the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, here, out = None, None, []

        def rows() -> pa.RecordBatch:
            langs, sources, parts, items, values = zip(*out, strict=True)
            columns = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(parts, pa.string()), pa.array(items, pa.binary()).cast(pa.string(), safe=False), pa.array(values, pa.int64())]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "part", "item", "value"])

        for batch in batches:
            for lang, shard, host, turn, source, n_group, n_lang, v, size, vector, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if turn < 0:
                    cell, here = Cell(n_lang, v, size, vector, terms, how.top), (lang, shard, host)
                    continue
                assert (lang, shard, host) == here
                found = cell.settle(source, n_group, vector) if turn == 0 else cell.visit(source, n_group, vector)
                for x in found:
                    out.append((lang, *x))
                    if len(out) >= 50_000:
                        yield rows()
        if out:
            yield rows()

    return cells.repartition("lang", "shard", "host").sortWithinPartitions("lang", "shard", "host", "round", "source").mapInArrow(run, _MET)


def source_divergence(docs: DataFrame, how: Audit | None = None) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) group how far it diverges from each other source of its language
    (part ``pair``) and by which terms it stands out from the language (part ``term``, the first ``top``).

    Terms are runs of letters (A-Z lower-cased) and of anything beyond ASCII. With V terms that count in a language, a group's p of a term is
    1 + floor(10^9 (count + 2) / (N + 2 V)); the divergence of two p's is floor((p - q)^2 / (p + q)), summed over all V terms for a pair.
    All sums are of whole numbers, so results don't depend on how rows are dealt.

    Tasks combine counts before the one shuffle by term. Then the terms of a language are split into parts, and its groups into blocks: each
    block stays in one task, and the other blocks' compressed vectors come by in the rounds of a tournament in which each pair of blocks
    meets once, at one of the two. A meeting costs time in proportion to the terms that either group has there, and gives both directions.
    Local heaps keep a group's first terms of a part; the parts' sums and heaps are then brought together.
    Null text, lang or source: ''. Null doc_id: as any row; repeated rows: each is a document. A language without terms that count: pairs of
    value 0. A single source: no pairs. Ties: by item, in the order of bytes. Very long texts: whole. Empty table: no rows. Other columns
    are ignored.
    """
    how = how or Audit()
    rows = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    with tables(docs.sparkSession) as own:
        kept = shared_table(kept_counts(rows, how), "divergence-counts")
        langs = kept.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.count_if("first").alias("v"), F.ceil(F.count("*") / how.cell_entries).alias("shards"))
        sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
        groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n_group", "n_lang", "v"]).fillna(1, ["shards"])
        groups = shared_table(groups, "divergence-groups")
        found = shared_table(met(vectors(kept, groups, how), how), "divergence-met")
        own.keep(own.paths[-1])
    each = found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return each.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= how.top))
