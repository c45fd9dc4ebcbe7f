"""Operators 11 to 13 against brute force, and text operators side by side in threads of one session."""

import collections
import hashlib
import math
import os
import random
import re
import threading
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_contract import awkward, docs_of, empty, folder, rows_of  # noqa: F401
from tokenizers import Tokenizer

from loadloom.llm import alignment, common, divergence, language_id
from loadloom.llm import queries as Q

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def audited(rows, in_docs=10, top=10):
    """(lang, source, part, item, value, rank) of (lang, source, text)."""
    rows = [(a or "", b or "", terms_of(t)) for a, b, t in rows]
    held = collections.Counter((lang, w) for lang, _, words in rows for w in set(words))
    want = []
    for lang in {r[0] for r in rows}:
        kept = sorted(w for (x, w), n in held.items() if x == lang and n >= in_docs)
        v, sources = len(kept), sorted({s for x, s, _ in rows if x == lang})
        counts = {s: collections.Counter(w for x, y, words in rows if (x, y) == (lang, s) for w in words) for s in sources}
        whole = collections.Counter(w for x, _, words in rows if x == lang for w in words)

        def p_of(c, kept=kept, v=v):
            total = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (total + 2 * v) for w in kept}

        p, q = {s: p_of(c) for s, c in counts.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode(), o) for o in sources if o != s)
            own = sorted((-f(p[s][w], q[w]), w.encode(), w) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            for part, found in (("pair", pairs), ("term", own)):
                want += [(lang, s, part, name, -value, k + 1) for k, (value, _, name) in enumerate(found)]
    return collections.Counter(want)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_op11(spark, folder):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text").collect()]
    assert rows_of(Q.op11_source_divergence(spark, folder), *COLUMNS) == audited(rows)


@pytest.mark.parametrize("how", [divergence.Audit(in_docs=1, blocks=2), divergence.Audit(in_docs=2, top=3, cell_entries=8, held_entries=5), divergence.Audit(in_docs=3, blocks=16)])
def test_op11_parts_blocks_and_odd_terms(spark, awkward, how):  # noqa: F811
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    rows = [tuple(r) for r in docs.select("lang", "source", "text").collect()]
    extra = [(f"l{k % 2}", f"s{k % 7}", f"tie{k % 3} tie{k % 5} é{k % 4}") for k in range(60)] + [("quiet", "a", "1 2"), ("quiet", "b", None), ("alone", None, "word word")]
    docs = docs.select("lang", "source", "text").union(spark.createDataFrame(extra, "lang string, source string, text string"))
    assert rows_of(divergence.source_divergence(docs, how), *COLUMNS) == audited(rows + extra, how.in_docs, how.top)


def test_op11_each_pair_of_blocks_meets_once():
    for blocks in (2, 4, 8, 16):
        meetings = [(turn, frozenset((host, guest))) for guest, own in enumerate(divergence.meetings(blocks)) for turn, host, guest2 in own if guest2 == guest]
        assert len({m for _, m in meetings}) == len(meetings) == blocks * (blocks - 1) // 2
        for turn in range(1, blocks):
            busy = [b for t, m in meetings if t == turn for b in m]
            assert sorted(busy) == list(range(blocks))


def test_op11_probabilities_are_exact_beyond_64_bits():
    counts = [0, 1, 7, 10**12, 3 * 10**14]
    total, v = sum(counts) + 12345, 987
    assert divergence.probability(np.array(counts), total, v).tolist() == [1 + 10**9 * (c + 2) // (total + 2 * v) for c in counts]


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALIGN = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def groups_of(text, tools):
    """(A ids, B ids) of each group, by the byte offsets of both libraries' tokens."""
    a_tool, b_tool, a_bytes, b_bytes = tools
    if not text:
        return []
    a, b = a_tool.encode(" " + text, add_special_tokens=False).ids, b_tool.encode(text)
    want = (" " + text).encode()
    if b"".join(a_bytes(i) for i in a) != want or b"".join(b_bytes(i) for i in b) != want:
        return []
    ends = lambda ids, of: list(np.cumsum([len(of(i)) for i in ids]))
    of_a, of_b = ends(a, a_bytes), ends(b, b_bytes)
    cuts = sorted(set(of_a) & set(of_b))
    found = [([], []) for _ in cuts]
    for side, (ids, at) in enumerate(((a, of_a), (b, of_b))):
        for i, k in zip(ids, np.searchsorted(np.array(cuts), np.array(at)).tolist(), strict=True):
            found[k][side].append(i)
    return found


@pytest.fixture(scope="session")
def tools():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    a_bytes = lambda i: bytes(letters[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    return a, b, a_bytes, b_bytes


def aligned_brute(docs, tools):
    each = [(i, groups_of(t, tools)) for i, t in docs]
    links = [collections.Counter() for _ in each]
    for own, (_, groups) in zip(links, each, strict=True):
        for a, b in groups:
            of_b = collections.Counter(b).items()
            for x, n in collections.Counter(a).items():
                for y, m in of_b:
                    own[x, y] += n * m
    counts = collections.Counter(p for own in links for p in own)
    most = collections.defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    want = collections.Counter()
    for (i, groups), own in zip(each, links, strict=True):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        n_best = sum(n for (x, y), n in own.items() if counts[x, y] == most[x])
        row = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(own.values()), n_best, sum(n * counts[p] for p, n in own.items()))
        want[i, *row, hashlib.sha256(shown.encode()).hexdigest() if groups else ""] += 1
    return want


ODD = [" lead", "trail ", "a  b   c", "x\ny", "\nx", "x\n", "x\n\n  y", "a▁b c", "tab\there　wide\xa0nbsp", "don't they're I'LL", "<|endoftext|></s>x", "\x00 \x1f", "日本語テキスト", "é ́x", "😀😀 😀", "aaaa" * 300, "word-" * 50, "ok ▁ fine", "a \n b", "\r\nq\r\n", "x 1 22 333 4444 ", "  ", "\n", "é\nè ê", "İſK", "x y", "a\x85b"]


def test_op12(spark, folder, tools):  # noqa: F811
    assert rows_of(Q.op12_token_alignment(spark, folder), *ALIGN) == aligned_brute(docs_of(spark, folder), tools)


def test_op12_odd_texts_by_either_way(spark, tools, monkeypatch):
    rng = random.Random(7)
    docs = list(enumerate([*ODD, *ODD[:3], None, "", *("".join(rng.choice(["a", "B", " ", "\n", "é", "1", ".", "'s", "  ", "語", "\t"]) for _ in range(rng.randrange(1, 60))) for _ in range(300))]))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = aligned_brute(docs, tools)
    assert rows_of(alignment.align_tokens(df, A, B), *ALIGN) == want
    assert rows_of(alignment.align_tokens(df, A, B, broadcast_pairs=0), *ALIGN) == want


def test_op12_transducer_on_made_up_tokens():
    rng = random.Random(3)
    for _ in range(300):
        text = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30)))
        sides = []
        for _ in range(2):
            cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(8)))})
            sides.append([text[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)])
        vocabulary = sorted({t for side in sides for t in side})
        a, b = ([vocabulary.index(t) for t in side] for side in sides)
        found, i, j = alignment.Transducer(vocabulary, vocabulary).align(a, b, 0, 0, len(text))
        ends = [set(np.cumsum([len(t) for t in side]).tolist()) for side in sides]
        assert (i, j) == (len(a), len(b)) and found[:3] == (len(a), len(b), len(ends[0] & ends[1]))
        runs = [[x.split(",") for x in g.split("|")] for g in found[4].split(";")]
        assert [int(x) for g in runs for x in g[0]] == a and [int(x) for g in runs for x in g[1]] == b
        assert found[3] == sum(len(x) * len(y) for x, y in runs) == sum(np.frombuffer(found[6], dtype=np.int64))


def test_op12_long_group_costs_its_distinct_pairs():
    t = alignment.Transducer([b"aa", b"a"], [b"a", b"aa"])
    n = 200_000  # A: aa ... aa, B: a aa ... aa a; no inner end is common
    found, *_ = t.align([0] * n, [0, *[1] * (n - 1), 0], 0, 0, 2 * n)
    assert found[:4] == (n, n + 1, 1, n * (n + 1)) and len(found[5]) == 16


def ppm_lengths(teach, order, rarest):
    """A function from a word to its code length, by dictionaries and recursion."""
    n = collections.Counter()
    for text in teach:
        for word in terms_of(text):
            raw = b" " + word.encode() + b" "
            for at in range(1, len(raw)):
                for k in range(min(at, order) + 1):
                    n[raw[at - k : at], raw[at : at + 1]] += 1
    total = sum(c for (s, _), c in n.items() if not s)
    kept = {key: c for key, c in n.items() if c >= total * rarest}
    at_context = collections.defaultdict(dict)
    for (s, x), c in kept.items():
        at_context[s][x] = c

    def bits(context, x, out):
        if context is None:
            return math.log2(256 - len(out))
        shorter = context[1:] if context else None
        if context not in at_context:
            return bits(shorter, x, out)
        own = {y: c for y, c in at_context[context].items() if y not in out}
        if not own:
            return bits(shorter, x, out)
        if x in own:
            return -math.log2(own[x] / (sum(own.values()) + len(own)))
        return -math.log2(len(own) / (sum(own.values()) + len(own))) + bits(shorter, x, out | set(own))

    def of_word(word):
        raw = b" " + word.encode() + b" "
        return sum(bits(raw[max(0, at - order) : at], raw[at : at + 1], frozenset()) for at in range(1, len(raw)))

    return of_word


def identified(rows, order=4, rarest=2.0**-16):
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    langs = sorted({lang for i, t, lang in rows if lang is not None and t and terms_of(t) and not out(i)})
    models = {x: ppm_lengths([t for i, t, lang in rows if lang == x and t and not out(i)], order, rarest) for x in langs}
    known = {x: {} for x in langs}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t) or not langs:
            yield i, out(i), "und", 0.0
            continue
        cost = {}
        for x in langs:
            cost[x] = sum(n * known[x].setdefault(w, models[x](w)) if w not in known[x] else n * known[x][w] for w, n in collections.Counter(terms_of(t)).items())
        best = min(langs, key=lambda x: (round(cost[x], 3), x))
        yield i, out(i), best, 1 / sum(2 ** max(cost[best] - cost[x], -1000) for x in langs)


def test_op13(spark, folder):  # noqa: F811
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
    got = sorted((tuple(r) for r in Q.op13_language_id(spark, folder).collect()), key=str)
    want = sorted(identified(rows), key=str)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3] for r in got], [r[3] for r in want], atol=1e-4)


@pytest.mark.parametrize("order,rarest", [(1, 0.001), (3, 0.01), (4, 0.0)])
def test_op13_code_lengths(spark, order, rarest):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 60")
    how = language_id.Trees(order=order, rarest=rarest)
    model = language_id.Model(language_id.nodes(docs, how).toArrow(), order)
    taught = docs.filter(~language_id.held_out(F.col("doc_id"), how)).select("lang", "text").collect()
    words = sorted({w.encode() for r in taught for w in terms_of(r[1])[:40]} | {b"zzzz", "œuf語".encode(), b"q"})
    got = model.lengths(words) / language_id.BIT
    for j, lang in enumerate(model.langs):
        of_word = ppm_lengths([t for x, t in taught if x == lang], order, rarest)
        assert np.allclose(got[:, j], [of_word(w.decode()) for w in words], atol=1e-3)


def test_op13_tree_is_bounded_and_codes_are_complete(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    how = language_id.Trees(rarest=0.001)
    found = language_id.nodes(docs, how)
    assert found.groupBy("lang", "order").count().agg(F.max("count")).first()[0] <= 1000
    tree = language_id.Model(found.toArrow(), how.order).trees[0]
    for context in (b"    ", b"\0\0\0 ", b"\0 th", b"tion", b"qqqq"):
        base = int.from_bytes(context, "big") << 8
        assert abs(np.exp2(-tree.lengths(np.arange(256) + base)).sum() - 1) < 1e-9


def test_op13_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    found = Q.op13_language_id(spark, medium).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = found.agg(F.count("*"), F.count_if(F.col("lang") == F.col("lang_pred"))).first()
    assert n > 300 and right >= 0.99 * n


def test_operators_side_by_side_in_threads(spark, small):
    """Each operator drops its own tables only, and nothing is left once the rows are read inside a scope."""
    names = ["op1_decontaminate", "op3_sanitise", "op4_simhash", "op8_line_dedup", "op11_source_divergence", "pipeline"]
    alone = {n: rows_of(Q.queries()[n](spark, small), "*") for n in names if n != "pipeline"}
    folder_of = common.shared_dir(spark).removeprefix("file://")
    for _ in range(2):
        before, got, failed = set(os.listdir(folder_of)), {}, []

        def run(name, got=got, failed=failed):
            try:
                with common.tables(spark):
                    found = Q.queries()[name](spark, small)
                    got[name] = found.count() if name == "pipeline" else rows_of(found, "*")
            except Exception as reason:  # told by the assertion below
                failed.append((name, reason))

        threads = [threading.Thread(target=run, args=(n,)) for n in names]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert not failed
        assert got.pop("pipeline") > 0 and got == alone
        assert set(os.listdir(folder_of)) == before
