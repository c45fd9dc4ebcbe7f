"""Alignment of two tokenizers' tokens, by a transducer over the bytes that one is ahead of the other."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm.bpe import byte_symbols
from loadloom.llm.common import arrow_map, open_table, shared_table, tables, write_table

#: Distinct id pairs whose counts are broadcast (16 bytes each); more are joined to the documents' pairs by a shuffle.
BROADCAST_PAIRS = 4_000_000
#: Units of text that a worker remembers, and the longest of them in characters.
UNITS, UNIT_CHARS = 600_000, 48
#: Transitions, and bytes of residuals, that a worker remembers.
TRANSITIONS = 1_000_000
#: Distinct pairs that a task combines before it passes their counts on.
HELD_PAIRS = 2_000_000
_SHIFT = 32


#: A piece of text in both tokenizers: numbers of A tokens, B tokens, groups and links, the groups as text, its distinct linked id pairs
#: (A id shifted left, with the B id) and how many links each has, both as 64-bit numbers in bytes. Plain tuples of plain values, since
#: a worker holds many and the garbage collector needn't visit those.
Aligned = tuple[int, int, int, int, str, bytes, bytes]
_ones: dict[int, bytes] = {}


class Transducer:
    """State: which side lags, and by which bytes; state 0: neither does, and side A moves. A token of the side that lags stays inside those
    bytes, ends with them (the group closes: state 0) or goes beyond (the sides change). What a token does to a state depends on nothing
    else, so ``known[state][token]`` keeps the state that follows; bytes are compared when a transition is met first."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes]):
        self.of, self.sizes = (a_bytes, b_bytes), list(map(len, a_bytes))
        self.begin()

    def begin(self) -> None:
        self.lags, self.ahead, self.known, self.number, self.size = [0], [b""], [{}], {(0, b""): 0}, 0

    def bound(self) -> None:
        """Between alignments: start anew when much is kept."""
        if self.size > TRANSITIONS:
            self.begin()

    def follow(self, state: int, token: int) -> int:
        """Work out a transition and keep it."""
        lags, ahead, own = self.lags[state], self.ahead[state], self.of[self.lags[state]][token]
        if not (ahead.startswith(own) or own.startswith(ahead)) or not own:
            raise ValueError("the tokenizers' bytes differ")
        found = (lags, ahead[len(own) :]) if len(own) < len(ahead) else (1 - lags, own[len(ahead) :])
        found = found if found[1] else (0, b"")
        number = self.number.get(found)
        if number is None:
            number = self.number[found] = len(self.lags)
            self.lags.append(found[0])
            self.ahead.append(found[1])
            self.known.append({})
            self.size += len(found[1])
        self.known[state][token] = number
        self.size += 1
        return number

    def align(self, a: list[int], b: list[int], i: int, j: int, left: int) -> tuple[Aligned, int, int]:
        """Align the next ``left`` bytes, from tokens i of A and j of B on, and say where their tokens end. Both sides must spell the same
        bytes there. A long group's ids are counted before they are paired, so it costs its distinct pairs, not all its links."""
        known, lags, sizes, begun, j_begun = self.known, self.lags, self.sizes, i, j
        first = known[0]
        keys, shown, many, n_many = [], [], None, 0
        while left > 0:
            from_i, from_j = i, j
            x = a[i]
            i += 1
            left -= sizes[x]
            state = first.get(x) or self.follow(0, x)
            y = b[j]
            j += 1
            following = known[state].get(y)
            state = self.follow(state, y) if following is None else following
            if not state:
                shown.append(f"{x}|{y}")
                keys.append(x << _SHIFT | y)
                continue
            while state:
                if lags[state]:
                    token = b[j]
                    j += 1
                else:
                    token = a[i]
                    i += 1
                    left -= sizes[token]
                following = known[state].get(token)
                state = self.follow(state, token) if following is None else following
            run_a, run_b = a[from_i:i], b[from_j:j]
            shown.append(f"{','.join(map(str, run_a))}|{','.join(map(str, run_b))}")
            if len(run_a) * len(run_b) <= 16:
                keys += [x << _SHIFT | y for x in run_a for y in run_b]
                continue
            many, of_b = many or {}, Counter(run_b).items()
            n_many += len(run_a) * len(run_b)
            for x, n in Counter(run_a).items():
                for y, m in of_b:
                    many[x << _SHIFT | y] = many.get(x << _SHIFT | y, 0) + n * m
        n_links = len(keys) + n_many
        if many is None and len(set(keys)) == len(keys):
            times = _ones.get(len(keys)) or _ones.setdefault(len(keys), array("q", [1] * len(keys)).tobytes())
        else:
            many = many or {}
            for key in keys:
                many[key] = many.get(key, 0) + 1
            keys, times = many.keys(), array("q", many.values()).tobytes()
        return (i - begun, j - j_begun, len(shown), n_links, ";".join(shown), array("q", keys).tobytes(), times), i, j


def of_text(pairs: list[bytes], times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A text's distinct linked pairs, in order, and their links, from those of its units."""
    keys, n = (np.frombuffer(b"".join(x), dtype=np.int64) for x in (pairs, times))
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    start = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[start], np.add.reduceat(n, start)


class Aligner:
    """Both tokenizers and the transducer of a worker.

    A single space or line feed between characters that aren't white space ends a token on both sides: pre-tokens of A never go from such
    a character into white space, and no piece of B holds a space or line feed after another character (checked when the file is read;
    where one does, texts are aligned whole). So texts are cut there into units, and a unit's alignment is remembered.
    """

    TOGETHER = 4096  # units that are encoded at a time
    REGULAR = re.compile(r" ?\S+")
    CUT = re.compile(r"(?<=\S) (?=\S)|(?<=\S)\n(?=\S)")
    SPACED = re.compile(r"[^\S \n]|  |\n\n| \n|\n ")

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: k for k, c in enumerate(byte_symbols())}
        spelt = [b""] * self.a.get_vocab_size()
        for piece, i in self.a.get_vocab(with_added_tokens=False).items():
            spelt[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        shown = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.spelt = (spelt, shown)
        self.transducer = Transducer(spelt, shown)
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)
        self.units: dict[str, Aligned | None] = {}
        self.before: dict[str, Aligned | None] = {}

    def spells(self, spoken: bytes, a: list[int], b: list[int]) -> bool:
        return all(b"".join(map(side.__getitem__, ids)) == spoken for side, ids in zip(self.spelt, (a, b), strict=True))

    def align(self, spoken: str, a: list[int], b: list[int]) -> Aligned | None:
        """None if a side doesn't spell ``spoken``."""
        raw = spoken.encode("utf-8", "surrogatepass")
        self.transducer.bound()
        return self.transducer.align(a, b, 0, 0, len(raw))[0] if self.spells(raw, a, b) else None

    def whole(self, text: str) -> Aligned | None:
        return self.align(" " + text, self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text))

    def cut(self, text: str) -> list[str]:
        """Units of space + text: words with the space before them, line feeds, words that follow a line feed."""
        if self.SPACED.search(text) is None and text[0] not in " \n" and text[-1] not in " \n":
            lines = text.split("\n")
            out = []
            for k, line in enumerate(lines):
                words = line.split(" ")
                out += [" " + words[0]] if k == 0 else ["\n", words[0]]
                out += [" " + w for w in words[1:]]
            return out
        spaced = " " + text
        out, at = [], 0
        for m in self.CUT.finditer(spaced):
            out.append(spaced[at : m.start()])
            at = m.start()
            if m[0] == "\n":
                out.append("\n")
                at += 1
        return [*out, spaced[at:]]

    def alone(self, unit: str) -> Aligned | None:
        """The library puts a space before what it is given: it is the unit's own, or is followed by a line feed and both are taken away."""
        a = self.a.encode(unit, add_special_tokens=False).ids
        if unit[0] == " ":
            return self.align(unit, a, self.b.encode(unit[1:]))
        b = self.b.encode("\n" + unit)
        return self.align(unit, a, b[2:]) if [self.spelt[1][i] for i in b[:2]] == [b" ", b"\n"] else None

    def together(self, units: list[str]) -> list[Aligned | None]:
        """Regular units are encoded as one text, in which each is a unit again, those without a space behind a line feed."""
        parts = [" x"]  # so that the text starts with a space
        for u in units:
            parts += [u] if u[0] == " " else ["\n", u]
        spoken = "".join(parts)
        a, b = self.a.encode_batch_fast([spoken], add_special_tokens=False)[0].ids, self.b.encode(spoken[1:])
        if not self.spells(spoken.encode("utf-8", "surrogatepass"), a, b):
            return [self.alone(u) for u in units]
        self.transducer.bound()
        out, i, j, align = [], 0, 0, self.transducer.align
        for part in parts:
            found, i, j = align(a, b, i, j, len(part) if part.isascii() else len(part.encode("utf-8", "surrogatepass")))
            if part != "\n":
                out.append(found)
        return out[1:]

    def learn(self, units: set[str]) -> dict[str, Aligned | None]:
        """Alignments of units that aren't remembered; short ones are from now on."""
        found: dict[str, Aligned | None] = {}
        regular = []
        for u in units:
            if self.REGULAR.fullmatch(u):
                regular.append(u)
            else:
                found[u] = self.alone(u)
        for at in range(0, len(regular), self.TOGETHER):
            part = regular[at : at + self.TOGETHER]
            found.update(zip(part, self.together(part), strict=True))
        self.units.update((u, x) for u, x in found.items() if len(u) <= UNIT_CHARS)
        return found

    def texts(self, texts: list[str | None]) -> Iterator[list[Aligned]]:
        """Each text's units in order; none for texts without tokens. Units that were met lately are remembered: when there are many, those
        that were not met since the last time this happened are forgotten."""
        if len(self.units) > UNITS // 2:
            self.units, self.before = {}, self.units
        cuts = [self.cut(t) if t and self.cuts else [] for t in texts]
        each = [list(map(self.units.get, units)) for units in cuts]
        gaps = [[k for k, x in enumerate(found) if x is None] if None in found else () for found in each]
        missing = {units[k] for units, gap in zip(cuts, gaps, strict=True) for k in gap}
        met = {u: x for u in missing if (x := self.before.get(u)) is not None}
        self.units.update(met)
        met |= self.learn(missing.difference(met))
        for text, units, found, gap in zip(texts, cuts, each, gaps, strict=True):
            for k in gap:
                found[k] = met[units[k]]
            if text and (not units or None in found):  # as a whole the two may still spell the same
                whole = self.whole(text)
                yield [whole] if whole else []
            else:
                yield found


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each worker and pair of vocabularies."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def packed(pairs: np.ndarray, times: np.ndarray) -> bytes:
    return zlib.compress(np.diff(pairs, prepend=0).tobytes() + times.tobytes(), 1)


def unpacked(links: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(links), dtype=np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


_OWN = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_rows(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a row's numbers and digest, and its distinct linked pairs with their links, packed."""

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for units in aligner(a_path, b_path).texts(batch.column(1).to_pylist()):
            *numbers, shown, pairs, times = zip(*units, strict=True) if units else [()] * 7
            sha = hashlib.sha256(";".join(shown).encode()).hexdigest() if units else ""
            rows.append((*map(sum, numbers), sha, packed(*of_text(pairs, times))))
        kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *_OWN, "groups_sha256", "links"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), tell, f"doc_id {kind}, {', '.join(f'{x} long' for x in _OWN)}, groups_sha256 string, links binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): the number of rows that hold an id pair linked. Tasks combine counts before the one shuffle by pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys = 0, []

        def flushed() -> Iterator[pa.RecordBatch]:
            pairs, n = np.unique(np.concatenate(keys), return_counts=True)
            for at in range(0, len(pairs), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[at : at + 100_000]), pa.array(n[at : at + 100_000].astype(np.int64))], names=["pair", "n"])

        for batch in batches:
            for links in batch.column(0):
                keys.append(unpacked(links.as_py())[0])
                held += len(keys[-1])
                if held > HELD_PAIRS:
                    yield from flushed()
                    held, keys = 0, []
        if keys:
            yield from flushed()

    return rows.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Weights:
    """Corpus-wide counts of id pairs, and which are their A id's highest."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        order = np.argsort(pairs, kind="stable")
        self.pairs, self.n = pairs[order], n[order]
        a = self.pairs >> _SHIFT
        start = np.flatnonzero(np.diff(a, prepend=-1))
        most = np.maximum.reduceat(self.n, start) if len(start) else self.n
        self.best = self.n == np.repeat(most, np.diff(np.append(start, len(a))))

    def sums(self, links: bytes) -> tuple[int, int]:
        pairs, times = unpacked(links)
        at = np.searchsorted(self.pairs, pairs)
        return int(times[self.best[at]].sum()), int(times @ self.n[at])


_weights: dict[str, Weights] = {}


def align_tokens(docs: DataFrame, a_path: str, b_path: str, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row for each row of ``docs``: how the tokens of a
    byte-level vocabulary A (a ``tokenizers`` file) and a vocabulary of pieces B (a ``sentencepiece`` file) lie against each other.

    Byte offsets at which tokens of both end cut them into groups; all A and B tokens of a group are linked. A pair's count is the number of
    rows that hold it linked; ``n_best`` counts the links whose pair has its A id's highest count, ``count_sum`` adds the counts up.
    Texts are aligned once; their distinct pairs are written packed, with the rows. Pairs are counted from those, combined in each task. Up to
    ``broadcast_pairs`` distinct pairs (a count, checked) are sent to the tasks that sum up; beyond that rows and pairs meet in a shuffle on
    the pair, where a row gives each distinct pair once.
    A special token's string inside a text is plain text. Null or empty text, and texts that the two spell differently: no tokens, zeros and ''.
    Null doc_id: stays null. Repeated rows: each counts as a document. Very long texts: whole; a long group costs its distinct
    pairs. Empty table: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    with tables(spark) as own:
        aligned_to = aligned_rows(docs, a_path, b_path)
        own.keep(path := write_table(aligned_to, "alignment-rows"))
        rows = open_table(spark, path, aligned_to)
        counts = shared_table(pair_counts(rows), "alignment-pairs")
        many = counts.count() > broadcast_pairs
        if many:
            own.keep(own.paths[-1])
        else:
            held = counts.toArrow()
    if many:
        return beyond(rows, counts)
    sent, key = spark.sparkContext.broadcast((held["pair"].to_numpy(), held["n"].to_numpy())), uuid.uuid4().hex

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _weights:
            _weights.clear()
            _weights[key] = Weights(*sent.value)
        sums = [_weights[key].sums(x.as_py()) for x in batch.column("links")]
        columns = [batch.column(x) for x in ("doc_id", *_OWN)] + [pa.array([x[k] for x in sums], pa.int64()) for k in (0, 1)] + [batch.column("groups_sha256")]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *_OWN, "n_best", "count_sum", "groups_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(rows, tell, f"doc_id {kind}, {', '.join(f'{x} long' for x in (*_OWN, 'n_best', 'count_sum'))}, groups_sha256 string")


def beyond(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The sums where the counts are too many to be sent."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, links in zip(batch.column(0), batch.column(1), strict=True):
                pairs, times = unpacked(links.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([row.as_py()] * len(pairs), pa.int64()), pa.array(pairs), pa.array(times)], names=["row", "pair", "times"])

    a = F.shiftright("pair", _SHIFT)
    with tables(rows.sparkSession) as own:
        named = shared_table(rows.withColumn("row", F.monotonically_increasing_id()), "alignment-named")
        own.keep(own.paths[-1])
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    weighed = counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    links = named.select("row", "links").mapInArrow(spread, "row long, pair long, times long").join(weighed, "pair").groupBy("row")
    sums = links.agg(F.coalesce(F.sum(F.when(F.col("best"), F.col("times"))), F.lit(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    return named.join(sums, "row", "left").fillna(0, ["n_best", "count_sum"]).select("doc_id", *_OWN, "n_best", "count_sum", "groups_sha256")
