"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from loadloom.llm.bpe import MergeCounter
from loadloom.llm.common import arrow_map

_counters: dict[str, MergeCounter] = {}


def counter(path: str) -> MergeCounter:
    """One counter for each worker and vocabulary."""
    if path not in _counters:
        _counters[path] = MergeCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Tokens of each whole text: doc_id, n_bytes, n_tokens, over_limit; one row for each row of ``docs``.

    The count of a pre-token is its initial symbols minus its merges, found by popping the lowest-rank adjacent pair from a
    heap over a linked list; no ids are made. Special strings in a text count one each, as the library's default has it.
    No shuffle: each row is counted where it is read, and a worker's word cache is bounded.
    Null text: as empty, 0 bytes and 0 tokens. Null doc_id: stays null. Repeated rows: counted each. Empty table: no rows.
    Other columns are ignored.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(tokenizer)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tokens = [c.count(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
