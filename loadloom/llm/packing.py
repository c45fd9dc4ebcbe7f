"""Packing of documents into fixed-length sequences along a space-filling curve."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadloom.llm.bpe import IdEncoder
from loadloom.llm.common import arrow_map, open_table, shared_table, write_table

#: Dimensions that document vectors are projected to, and bits of the curve in each.
DIMENSIONS, BITS = 3, 10
#: Narrow rows that one task sorts and sums (some 30 bytes each); there are at least as many tasks as shuffle partitions.
ROWS_A_PART = 1_000_000
_encoders: dict[str, tuple[IdEncoder, np.ndarray]] = {}


def encoder(path: str) -> tuple[IdEncoder, np.ndarray]:
    """A worker's encoder, and for each id the signs that its hash adds to the projected vector."""
    if path not in _encoders:
        e = IdEncoder(path)
        ids = np.arange(e.lib.get_vocab_size(), dtype=np.uint64)
        mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        signs = [((mixed >> np.uint64(32 + d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(DIMENSIONS)]
        _encoders[path] = (e, np.stack(signs, axis=1))
    return _encoders[path]


def cells(vectors: np.ndarray) -> np.ndarray:
    """Grid cells, 0 to 2^BITS - 1 in each dimension, of vectors with entries in -1 to 1 (most lie near 0)."""
    squashed = 0.5 + np.arctan(vectors * 8) / np.pi
    return np.clip((squashed * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)


def hilbert_key(grid: np.ndarray) -> np.ndarray:
    """Position along the Hilbert curve of each row of ``grid``: undo the curve's rotations from the highest bit down."""
    x = grid.T.copy()
    n = len(x)
    top = 1 << (BITS - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for d in range(n):
            swap = np.where(x[d] & bit, 0, (x[0] ^ x[d]) & low)
            flip = np.where(x[d] & bit, low, 0)
            x[0] ^= flip ^ swap
            x[d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[d] ^= x[d - 1]
    last = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        last ^= np.where(x[n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= last
    key = np.zeros_like(x[0])
    for b in range(BITS - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[d] >> b) & 1)
    return key


def boundaries(total: int, size: int) -> list[int]:
    """Where the sequences after the last full one start: the rest is cut at powers of two, so nothing is padded."""
    at, left = total - total % size, total % size
    found = []
    while left:
        found.append(at)
        part = 1 << (left.bit_length() - 1)
        at, left = at + part, left - part
    return found


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the Hilbert key of the document's hashed vector, its number of tokens and its packed ids."""

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        e, signs = encoder(tokenizer)
        end = e.packed([end_id])
        packed = [p + end for p in e.encode([t or "" for t in batch.column(1).to_pylist()])]
        vectors = np.zeros((len(packed), DIMENSIONS))
        for i, p in enumerate(packed):
            ids = np.frombuffer(p, dtype=f"<u{e.width}")
            counts = np.bincount(ids, minlength=0) if len(ids) > 4096 else None
            v = counts @ signs[: len(counts)] if counts is not None else signs[ids].sum(axis=0)
            vectors[i] = v / len(ids)
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(hilbert_key(cells(vectors)), pa.int64()),
                pa.array([len(p) // e.width for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
            ],
            names=["doc_id", "curve", "doc_tokens", "ids"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), encode, f"doc_id {kind}, curve long, doc_tokens long, ids binary")


def curve_pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 2) -> DataFrame:
    """Pack all documents into sequences of ``size`` tokens; one row for each piece.

    Columns: doc_id, start (the document's ids before the piece), length, ids_crc32 (of the ids as little-endian unsigned
    32-bit numbers), doc_tokens, sequence_id, offset (in the sequence), ids (the piece's ids, int array).
    Documents follow one another in the order of their key on a Hilbert curve through their hashed, projected token vectors;
    sequences are cut from that order, so only the last tokens are left over, and those fill sequences of powers of two.

    The ids are written once. Only narrow rows are sorted: range partitions (ties on the curve split by row number, so a hot
    key spreads), a running sum in each, and the sums of the partitions, a row for each million documents.
    Vocabularies that aren't made of words are encoded whole by the library. Very long texts: cut into as many pieces as they need.
    Null text: as empty, so the end id alone. Null doc_id: packed like any other. Repeated rows: packed each. Empty table: no rows.
    """
    spark = docs.sparkSession
    rows = tokenized(docs, tokenizer, end_id).withColumn("row", F.monotonically_increasing_id())
    table = open_table(spark, write_table(rows, "packed-ids"), rows)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table.count() // ROWS_A_PART))
    ordered = table.select("row", "curve", "doc_tokens").repartitionByRange(parts, "curve", "row").withColumn("part", F.spark_partition_id())
    ordered = shared_table(ordered, "packed-order")
    sums = ordered.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))  # a row for each partition
    bases = sums.select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("base"))
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    within = Window.partitionBy("part").orderBy("curve", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        ordered.withColumn("upto", F.sum("doc_tokens").over(within))
        .join(F.broadcast(bases), "part")
        .select("row", (F.col("base") + F.col("upto") - F.col("doc_tokens")).alias("at"))
    )
    return cut(table.join(placed, "row").select("doc_id", "doc_tokens", "ids", "at"), total, size)


def cut(placed: DataFrame, total: int, size: int) -> DataFrame:
    """Pieces of documents whose first token stands at ``at`` of ``total``."""
    tail = boundaries(total, size)
    full = total - total % size

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(7)]
        took, ids_of = [], []
        for i, (n, packed, at) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
            ids = np.frombuffer(packed, dtype=f"<u{len(packed) // n}").astype("<u4")
            begun = at
            while begun < at + n:
                if begun < full:
                    sequence, first = divmod(begun, size)
                    first, end = begun - first, (sequence + 1) * size
                else:
                    k = sum(b <= begun for b in tail) - 1
                    sequence, first = full // size + k, tail[k]
                    end = tail[k + 1] if k + 1 < len(tail) else total
                end = min(end, at + n)
                piece = ids[begun - at : end - at]
                took.append(i)
                ids_of.append(piece.astype(np.int32))
                for column, value in zip(out, (begun - at, end - begun, zlib.crc32(piece.tobytes()), n, sequence, begun - first), strict=False):
                    column.append(value)
                begun = end
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        arrays = [batch.column(0).take(pa.array(took, pa.int64())), *(pa.array(c, pa.int64()) for c in out[:6])]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(ids_of, pa.list_(pa.int32()))], names=names)

    kind = placed.schema["doc_id"].dataType.simpleString()
    longs = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return arrow_map(placed, pieces, f"doc_id {kind}, {longs}, ids array<int>")
