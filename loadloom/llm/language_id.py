"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import arrow_map, plain_words


@dataclass(frozen=True)
class Trees:
    """A context is up to ``order`` bytes (4 at most), none from before the space that starts its word.

    A byte stays in a context's node if the two make up at least ``rarest`` of the language's bytes: so each order has at most
    1 / ``rarest`` of them, however large the corpus is. Documents whose crc32(doc_id) leaves ``teaches_not`` modulo ``folds`` teach nothing.
    ``held_words`` bounds the words that a task combines before it passes counts on; ``cached_words`` those whose lengths a worker keeps.
    """

    order: int = 4
    rarest: float = 2.0**-16
    folds: int = 3
    teaches_not: int = 1
    held_words: int = 300_000
    cached_words: int = 300_000


UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: Code lengths are whole numbers of 2^-20 bits, so that sums don't depend on the order of words.
BIT = 1 << 20


def held_out(doc_id: Column, how: Trees) -> Column:
    """Null ids: not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % how.folds == how.teaches_not, F.lit(False))


def steps(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte of each word and of the space that ends it, as a number: the last ``order`` bytes of its context (zeros before the
    space that starts the word) and then itself; and the index of its word."""
    if not words:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = np.frombuffer(b" " + b" ".join(words) + b" ", dtype=np.uint8).astype(np.int64)
    sizes = np.fromiter((len(w) + 1 for w in words), dtype=np.int64, count=len(words))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])  # of each word's space; its coded bytes follow
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(1, len(text))
    depth = at - np.repeat(starts, sizes)  # bytes of context there are
    code = text[1:].copy()
    for k in range(1, order + 1):
        code |= np.where(depth >= k, text[np.maximum(at - k, 0)], 0) << (8 * k)
    return code, word


def counted(docs: DataFrame, how: Trees) -> DataFrame:
    """(lang, code, n): how often each byte follows each longest context, over all documents that teach."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                code, word = steps(list(words), how.order)
                times = np.fromiter(words.values(), dtype=np.int64, count=len(words))[word]
                found, which = np.unique(code, return_inverse=True)
                n = np.zeros(len(found), dtype=np.int64)
                np.add.at(n, which, times)
                for at in range(0, len(found), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found[part]), pa.string()), pa.array(found[part]), pa.array(n[part])], names=["lang", "code", "n"])
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                seen.setdefault(lang, Counter()).update(plain_words(text.as_py()))
            if sum(map(len, seen.values())) > how.held_words:
                yield from flushed()
        yield from flushed()

    teaching = docs.filter(~held_out(F.col("doc_id"), how) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return teaching.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def nodes(docs: DataFrame, how: Trees) -> DataFrame:
    """(lang, order, code, n) of all orders, of what is frequent enough to stay: at most 1 / ``rarest`` rows an order and language."""
    full = counted(docs, how)
    orders = F.explode(F.sequence(F.lit(0), F.lit(how.order))).alias("order")
    each = full.select("lang", "code", "n", orders).withColumn("code", F.col("code").bitwiseAND(F.expr("shiftleft(1L, 8 * (order + 1)) - 1")))
    deep = (F.col("order") == 0) | (F.expr("shiftright(code, 8 * order)") > 0)  # the context has as many bytes
    each = each.filter(deep).groupBy("lang", "order", "code").agg(F.sum("n").alias("n"))
    totals = each.filter(F.col("order") == 0).groupBy("lang").agg(F.sum("n").alias("total"))
    return each.join(totals, "lang").filter(F.col("n") >= F.col("total") * how.rarest).select("lang", "order", "code", "n")


class Tree:
    """Frozen statistics of a language as sorted arrays for each order: what a byte costs in its context, what leaving the context costs.

    Escapes follow method C: a context seen n times with d distinct bytes keeps n / (n + d) for them and leaves with d / (n + d). Bytes that
    a left context knows are excluded from all shorter ones; as counts are frozen and a shorter context knows all that a longer one
    does, that only changes a shorter context's n and d, so each cost stands in a table.
    """

    def __init__(self, codes: list[np.ndarray], counts: list[np.ndarray]):
        self.codes, self.first, self.later, self.contexts, self.leave, self.leave_later = [], [], [], [], [], []
        below: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        sums: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, (code, n) in enumerate(zip(codes, counts, strict=True)):
            context, start = np.unique(code >> 8, return_index=True)
            n_all = np.add.reduceat(n, start) if len(n) else n
            d_all = np.diff(np.append(start, len(code)))
            sums.append((context, n_all, d_all))
            self.codes.append(code)
            self.contexts.append(context)
            own = np.searchsorted(context, code >> 8)
            self.first.append(self.bits(n, n_all[own] + d_all[own]))
            self.leave.append(self.bits(d_all, n_all + d_all))
            if k:  # what the next shorter context gives after this one was left
                lower_code, lower_n = codes[k - 1], counts[k - 1]
                at = np.searchsorted(lower_code, code & ((1 << (8 * k)) - 1))
                gone = np.add.reduceat(lower_n[at], start) if len(n) else n
                low = np.searchsorted(sums[k - 1][0], context & ((1 << (8 * (k - 1))) - 1))
                rest, more = sums[k - 1][1][low] - gone, sums[k - 1][2][low] - d_all
                below = (rest, more, rest + more)
                self.later.append(np.log2(np.maximum(below[2], 1)))
                self.leave_later.append(np.where(more > 0, self.bits(np.maximum(more, 1), np.maximum(below[2], 1)), 0.0))
        self.counts = [np.log2(np.maximum(n, 1)) for n in counts]
        self.end = float(np.log2(256 - (sums[0][2][0] if len(sums[0][2]) else 0) or 1))

    @staticmethod
    def bits(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return np.log2(np.maximum(whole, 1)) - np.log2(np.maximum(part, 1))

    def lengths(self, steps_of: np.ndarray) -> np.ndarray:
        """Bits of each coded byte: from its longest known context down."""
        out, waiting = np.zeros(len(steps_of)), np.arange(len(steps_of))
        left = np.full(len(steps_of), -1)  # index, in the order above, of the context that was left last
        for k in range(len(self.codes) - 1, -1, -1):
            if not len(waiting) or not len(self.contexts[k]):
                continue
            code = steps_of[waiting] & ((1 << (8 * (k + 1))) - 1)
            context = code >> 8
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            known = self.contexts[k][at] == context  # nothing has seen the context: on to the shorter one, at no cost
            sym = np.minimum(np.searchsorted(self.codes[k], code), len(self.codes[k]) - 1)
            hit = known & (self.codes[k][sym] == code)
            came = left[waiting]
            fresh = came < 0
            if k < len(self.later):
                after = np.maximum(came, 0)
                paid = np.where(fresh, self.first[k][sym], self.later[k][after] - self.counts[k][sym]) if len(self.later[k]) else self.first[k][sym]
                fee = np.where(fresh, self.leave[k][at], self.leave_later[k][after]) if len(self.later[k]) else self.leave[k][at]
            else:
                paid, fee = self.first[k][sym], self.leave[k][at]
            out[waiting] += np.where(hit, paid, np.where(known, fee, 0.0))
            left[waiting] = np.where(known, at, left[waiting])
            waiting = waiting[~hit]
        out[waiting] += self.end
        return out


class Model:
    """The trees of all languages. ``lengths(words)`` gives each word's code length in each language."""

    def __init__(self, rows: pa.Table, order: int):
        self.langs = sorted(set(rows["lang"].to_pylist()))
        which = np.array([self.langs.index(x) for x in rows["lang"].to_pylist()], dtype=np.int64)
        orders, codes, counts = (np.asarray(rows[c].to_numpy(), dtype=np.int64) for c in ("order", "code", "n"))
        self.order, self.trees = order, []
        for j in range(len(self.langs)):
            own = [(which == j) & (orders == k) for k in range(order + 1)]
            own = [np.flatnonzero(x)[np.argsort(codes[x], kind="stable")] for x in own]
            self.trees.append(Tree([codes[x] for x in own], [counts[x] for x in own]))

    def lengths(self, words: list[bytes]) -> np.ndarray:
        code, word = steps(words, self.order)
        out = np.zeros((len(words), len(self.trees)), dtype=np.int64)
        for j, tree in enumerate(self.trees):
            np.add.at(out[:, j], word, np.rint(tree.lengths(code) * BIT).astype(np.int64))
        return out


class Scorer:
    """A worker's model with the lengths of the words that it has met."""

    def __init__(self, model: Model, cached: int):
        self.model, self.cached = model, cached
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((0, len(model.trees)), dtype=np.int64)

    def learn(self, texts: list[Counter]) -> None:
        if len(self.place) > self.cached:
            self.place, self.table = {}, self.table[:0]
        new = list({w for words in texts for w in words if w not in self.place})
        if new:
            self.table = np.concatenate([self.table, *(self.model.lengths(new[a : a + 20_000]) for a in range(0, len(new), 20_000))])
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))

    def score(self, words: Counter) -> np.ndarray:
        at = np.fromiter(map(self.place.__getitem__, words), dtype=np.int64, count=len(words))
        return np.fromiter(words.values(), dtype=np.int64, count=len(words)) @ self.table[at]


_scorers: dict[str, Scorer] = {}


def scorer(key: str, trees: list, how: Trees) -> Scorer:
    """One for each worker and model."""
    if key not in _scorers:
        _scorers.clear()
        lang, *rest = trees
        rows = pa.table([pa.array(lang, pa.string()), *map(pa.array, rest)], names=["lang", "order", "code", "n"])
        _scorers[key] = Scorer(Model(rows, how.order), how.cached_words)
    return _scorers[key]


def identify(docs: DataFrame, how: Trees | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (the whole text's code length in the predicted language, null without one).

    A language's model is a tree of byte contexts of every length up to ``order``, with counts over all documents that teach, thinned to the
    frequent nodes and frozen. A text is the sequence of its words (runs of letters, A-Z lower-cased, and of bytes beyond ASCII), each coded
    byte by byte, its ending space included, from the space before it on: so equal words cost the same, and a text's length is the sum
    over its words, exactly and in any order. The shortest code wins, ties by name; the score is its share of all languages' 2^-length.
    Only the thinned trees are brought to the driver and sent to the tasks: at most (order + 1) / ``rarest`` nodes of 12 bytes a language.
    Counts are combined in the tasks before the one shuffle by language and context. Only texts are scored: no lang, source or id.
    Null text, and texts without a letter: ``und``, score 0. Null doc_id: not held out; teaches. Null lang: teaches nothing. Repeated rows:
    each teaches and is scored. Very long texts: whole. No document that teaches: ``und`` for all. Empty table: no rows. Other columns are ignored.
    """
    how = how or Trees()
    spark = docs.sparkSession
    rows = nodes(docs, how).toArrow()
    kept = spark.sparkContext.broadcast([rows[c].to_pylist() if c == "lang" else rows[c].to_numpy() for c in ("lang", "order", "code", "n")])
    key = uuid.uuid4().hex

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = scorer(key, kept.value, how)
        langs = own.model.langs
        texts = batch.column(2).to_pylist()
        words = [Counter(plain_words(t.encode("utf-8", "surrogatepass"))) if t and langs and _LETTER.search(t) else Counter() for t in texts]
        own.learn(words)
        names, scores, bits = [], [], []
        for w in words:
            if not w:
                names.append(UNKNOWN), scores.append(0.0), bits.append(None)
                continue
            found = own.score(w)
            best = int(np.argmin(found))
            names.append(langs[best]), bits.append(int(found[best]) / BIT)
            scores.append(float(1 / np.exp2(np.maximum((found[best] - found) / BIT, -1000.0)).sum()))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", held_out(F.col("doc_id"), how).alias("held_out"), "text"), score, f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double")
