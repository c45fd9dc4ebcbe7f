"""Secret scans with structural confirmation."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from loadloom.llm import spans as S
from loadloom.llm.common import arrow_map

CONFIRMED_KINDS = ("pem", "jwt", "der", "ssh")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(docs: DataFrame) -> DataFrame:
    """Secrets of each whole text: doc_id, base and all_spans (arrays of kind, start, end), n_assign, n_access, n_hex, base_sha256, spans.

    Base patterns give assign, access and hex spans. Candidates in base64 or hex are then decoded, and reported as pem, jwt,
    der or ssh only where a private key's encoding, its nested lengths or a signed token's header parse. One pass, no shuffle.
    Null text: empty, so no spans. Null doc_id: stays null. Repeated rows: scanned each. Very long texts: linear time, but for a base64
    run of many lines that each claim to start an OpenSSH key. Empty table: no rows. Other columns are ignored.
    """

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, full = [], []
        for text in batch.column(1).to_pylist():
            found = S.secrets(text) if text else []
            base.append(found)
            full.append(S.in_order(found + S.confirmed(text, found), S.SECRET_KINDS + CONFIRMED_KINDS) if text else [])
        as_rows = lambda all_spans: pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in all_spans], pa.list_(_SPAN))
        counts = [pa.array([sum(s[0] == kind for s in found) for found in base], pa.int64()) for kind in S.SECRET_KINDS]
        columns = [batch.column(0), as_rows(base), as_rows(full), *counts, pa.array(map(S.digest, base), pa.string()), pa.array(map(S.joined, full), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "all_spans", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = "array<struct<kind:string,start:bigint,end:bigint>>"
    return arrow_map(docs.select("doc_id", "text"), scan, f"doc_id {kind}, base {rows}, all_spans {rows}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
