"""The pipeline's stages against brute force, each on what its predecessor kept, and the whole run."""

import collections
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from test_contract import awkward, empty, lower  # noqa: F401
from test_methods import estimated, votes_of
from tokenizers import Tokenizer

import corpus_pipeline as P

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def good(rows):
    from loadloom.llm.quality_rules import BELIEF, GOOD, START

    judged = [votes_of(r["text"] or "") for r in rows]
    fair = [k for k, (_, failed) in enumerate(judged) if not failed]
    if not fair:
        return []
    quality = estimated([judged[k][0] for k in fair], START, GOOD, BELIEF)
    return [rows[k] for k, q in zip(fair, quality, strict=True) if q >= 0.5]


def cleaned(rows):
    from loadloom.llm.line_dedup import MOST_SHARED, SITES

    def spread(among, only=None):
        found = collections.defaultdict(set)
        for r in among:
            for x in (r["text"] or "").split("\n"):
                if re.search(r"[^\x20\x09-\x0D]", x) and (only is None or x in only):
                    found[x] |= {r["source"]} - {None}
        return {x for x, s in found.items() if len(s) >= SITES}

    shared = spread(rows)
    gone = spread([r for r in rows if sum(len(x) for x in (r["text"] or "").split("\n") if x in shared) <= MOST_SHARED * len(r["text"] or "")], shared)
    out = []
    for r in rows:
        text = r["text"] and "\n".join(x for x in r["text"].split("\n") if x not in gone)
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def print_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def one_of_each(rows):
    """All ids are distinct in the tables that this runs on."""
    prints = [print_of(r["text"]) for r in rows]
    distinct = np.array(sorted(set(prints)), dtype=np.uint64)
    label = {int(p): int(p) for p in distinct}
    near = {int(p): distinct[np.bitwise_count(distinct ^ p) <= 4].tolist() for p in distinct}
    changed = True
    while changed:
        changed = False
        for p, others in near.items():
            m = min(label[o] for o in others)
            if m < label[p]:
                label[p], changed = m, True
    least = {}
    for r, p in zip(rows, prints, strict=True):
        least[label[p]] = min(r["doc_id"], least.get(label[p], r["doc_id"]))
    return [r for r in rows if r["doc_id"] in set(least.values())]


def uncontaminated(rows, items):
    windows = set()
    for _, t in items:
        w = re.findall(WORDS, lower(t))
        windows |= {tuple(w[at : at + 13]) for at in range(max(1, len(w) - 12))} if w else set()
    out = []
    for r in rows:
        w = re.findall(WORDS, lower(r["text"]))
        hit = {k for n in {len(x) for x in windows} for at in range(len(w) - n + 1) if tuple(w[at : at + n]) in windows for k in range(at, at + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out.append(r)
    return out


def key(r):
    return tuple(sorted((k, repr(v)) for k, v in r.items()))


def as_rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages_and_run_against_brute_force(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{medium}/benchmark.parquet").select("item_id", "text").collect()]
    steps = [good, cleaned, one_of_each, lambda rows: uncontaminated(rows, items)]
    rows = as_rows(docs)
    for (name, stage), step in zip(P.STAGES, steps, strict=False):
        found = stage(spark, docs, medium)
        assert found.columns == docs.columns
        rows = step(rows)
        got = as_rows(found)
        assert collections.Counter(map(key, got)) == collections.Counter(map(key, rows)), name
        docs = spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for r in rows:
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    pieces = collections.defaultdict(list)
    for p in P.run(spark, medium).collect():
        pieces[p["doc_id"]].append((p["start"], p["ids"]))
    got = collections.Counter()
    for d, found in pieces.items():
        ids = [i for _, part in sorted(found) for i in part]
        got[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert got == want


@pytest.mark.parametrize("k", range(4))
def test_stages_on_awkward_rows(spark, awkward, k):  # noqa: F811
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    found = P.STAGES[k][1](spark, docs, awkward)
    assert found.columns == docs.columns
    rows, got = as_rows(docs), as_rows(found)
    if k == 0:
        want = good(rows)
    elif k == 1:
        want = cleaned(rows)
    elif k == 3:
        want = uncontaminated(rows, [tuple(r) for r in spark.read.parquet(f"{awkward}/benchmark.parquet").collect()])
    else:
        assert {print_of(r["text"]) for r in got} <= {print_of(r["text"]) for r in rows}
        assert len(got) == len({print_of(r["text"]) for r in got}) and sum(r["text"] == "same text here for copies" for r in got) == 1
        return
    assert collections.Counter(map(key, got)) == collections.Counter(map(key, want))


def test_run_keeps_no_tables_of_earlier_stages(spark, awkward):  # noqa: F811
    from loadloom.llm import common

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with common.tables(spark) as own:
        assert P.run(spark, awkward).count() > 0
        left = set(os.listdir(folder)) - before
        assert left and all(x.startswith(("pipeline-decontamination", "packed")) for x in left)
        assert {x.rsplit("/", 1)[1] for x in own.paths} == left
    assert set(os.listdir(folder)) == before


def test_run_of_empty_tables(spark, empty):  # noqa: F811
    assert P.run(spark, empty).count() == 0
