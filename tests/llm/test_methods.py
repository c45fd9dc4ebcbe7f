"""The dealt methods themselves against brute force, beyond what the queries' columns show."""

import base64
import collections
import json
import math
import random
import re
import time

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from loadloom.llm import queries as Q
from loadloom.llm import spans as S


# 1, decontamination

RANGES = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_op1_words_are_those_of_the_contract(spark):
    from loadloom.llm.decontaminate import words

    around = [*range(0x300), *range(0x2000, 0x2070), 0x3042, 0xD7FF, 0xE000, 0xFEFF, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF]
    texts = [f"{c}a{c}{c}9b {c}" for c in map(chr, around)] + ["".join(map(chr, around)), "", "^-]\\[ x^y-z]\\[\\x41"]
    got = spark.createDataFrame(enumerate(texts), "k int, text string").select("k", words("text")).collect()
    assert dict(map(tuple, got)) == {k: re.findall(RANGES, re.sub("[A-Z]", lambda m: m[0].lower(), t)) for k, t in enumerate(texts)}


def test_op1_words_cost_less_than_by_ranges(spark):
    from loadloom.llm.common import ascii_lower
    from loadloom.llm.decontaminate import words

    texts = spark.range(0, 1600, 1, 4).select(F.repeat(F.concat("id", F.lit(": Some plain words, as texts have them; ")), 120).alias("text"))
    plain = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(RANGES), F.lit(0))

    def seconds(found):
        began = time.time()
        n = texts.agg(F.sum(F.size(found))).first()[0]
        return time.time() - began, n

    ours, theirs = (min(seconds(f) for _ in range(4)) for f in (words("text"), plain))
    assert ours[1] == theirs[1] > 10**6 and ours[0] < 0.6 * theirs[0], (ours, theirs)


# 5, quality rules


def votes_of(text):
    """The rules, counted word by word."""
    from loadloom.llm.quality_rules import RULES

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = len(words), sum(map(len, words))
    triples = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeats = len({k for i in range(n - 2) if triples[words[i], words[i + 1], words[i + 2]] > 1 for k in (i, i + 1, i + 2)})
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b: a / b if b else None
    measured = {
        "symbols": share(sum(c in "#*$%&|<>" for c in text), n), "repeats": share(repeats, n), "lines": share(len(lines) - len(set(lines)), len(lines)),
        "capitals": share(sum("A" <= c <= "Z" for c in text), chars), "mark_runs": share(len(regex.findall(r"([^\p{L}\p{N}\x20\x09-\x0D])\1\1+", text)), n), "letterless": share(sum(not regex.search(r"\p{L}", w) for w in words), n), "distinct": None if not n else 1 - len(set(words)) / n,
        "word_length": None if not n else abs(chars / n - 6),
    }
    vote = lambda r: 0 if measured[r.name] is None else 1 if measured[r.name] <= r.good else -1 if measured[r.name] >= r.bad else 0
    return tuple(vote(r) for r in RULES), n < 50 or 100 * repeats > 50 * n


def estimated(votes, start, good, belief, steps=60):
    """Posteriors by expectation-maximisation over single texts (rows) with numpy."""
    v = np.array(votes)
    n, m = v.shape
    weight = belief * n + 1
    prior, chance = good, {c: np.tile(start[c], (m, 1)) for c in (True, False)}
    post = lambda: 1 / (1 + np.exp(-(math.log(prior / (1 - prior)) + sum(np.log(chance[True][j][v[:, j] + 1] / chance[False][j][v[:, j] + 1]) for j in range(m)))))
    for _ in range(steps):
        p = post()
        of = {True: p, False: 1 - p}
        prior = (weight * good + p.sum()) / (weight + n)
        for c in chance:
            seen = np.array([[weight * start[c][k] + of[c][v[:, j] == k - 1].sum() for k in range(3)] for j in range(m)])
            chance[c] = seen / seen.sum(axis=1, keepdims=True)
    return post()


def test_op5_verdicts_are_those_of_em_over_single_texts(spark, medium):
    from loadloom.llm.quality_rules import BELIEF, GOOD, START

    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    judged = {d: votes_of(t) for d, t in texts.items()}
    fair = [d for d, (_, failed) in judged.items() if not failed]
    quality = dict(zip(fair, estimated([judged[d][0] for d in fair], START, GOOD, BELIEF), strict=True))
    for r in Q.op5_quality_rules(spark, medium).collect():
        assert r["base_failed"] == judged[r["doc_id"]][1]
        if not r["base_failed"]:
            assert abs(r["quality"] - quality[r["doc_id"]]) < 1e-5
            assert r["kept"] == (quality[r["doc_id"]] >= 0.5) or abs(quality[r["doc_id"]] - 0.5) < 1e-5
        else:
            assert not r["kept"]


def test_op5_white_space_costs_linear_time(spark, tmp_path):
    texts = ["a" + " " * 1_000_000 + "x", " \t\n" * 400_000, "w " * 500_000]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    found = {r["doc_id"]: r["n_words"] for r in Q.op5_quality_rules(spark, str(tmp_path)).collect()}
    assert found == {0: 2, 1: 0, 2: 500_000} and time.time() - began < 60


# 8, line dedup


def test_op8_passages_with_a_hot_source_and_copies(spark):
    """Passages of over 50 words in documents of 6 sites, a third of all rows on one site; copies of a document on as many sites stay whole."""
    from loadloom.llm.line_dedup import clean_lines

    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=7)) for _ in range(n))
    passage, notice, story = words(60), "All rights reserved here.", "\n".join(words(40) for _ in range(8))
    rows = [(k, f"{words(80)}\n{passage}\n{words(30)}", "hot" if k % 3 == 0 else f"s{k % 7}") for k in range(18)]
    rows += [(100 + k, f"{words(60)}\n{notice}", f"s{k}") for k in range(6)]
    rows += [(200, f"tiny page\n{notice}", "s1"), (201, notice, "s2")]
    near = lambda k: story.replace(story.split("\n")[k % 8], words(40))
    rows += [(300 + k, story if k % 2 else near(k), f"s{k}") for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r["text"] for r in clean_lines(docs).collect()}
    for d, t, _ in rows:
        assert got[d] == (t if d >= 300 else "\n".join(x for x in t.split("\n") if x not in (passage, notice)))


# 9, secret scans


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")) + body


def number(rng, size):
    return der(0x02, b"\x01" + rng.randbytes(size - 1))


def wire(*parts):
    return b"".join(len(p).to_bytes(4, "big") + p for p in parts)


def encodings(rng):
    """(name, bytes, whether a private key)"""
    version, rsa = der(0x02, b"\0"), der(0x30, der(0x06, bytes.fromhex("2a864886f70d010101")), der(0x05))
    pkcs1 = der(0x30, version, *(number(rng, n) for n in (128, 3, 128, 64, 64, 64, 64, 64)))
    ed = der(0x30, version, der(0x30, der(0x06, bytes.fromhex("2b6570"))), der(0x04, der(0x04, rng.randbytes(32))))
    pkcs8 = der(0x30, version, rsa, der(0x04, pkcs1))
    ec = der(0x30, der(0x02, b"\1"), der(0x04, rng.randbytes(32)), der(0xA0, der(0x06, bytes.fromhex("2a8648ce3d030107"))))
    sealed = der(0x30, der(0x30, der(0x06, bytes.fromhex("2a864886f70d01050d")), der(0x30, der(0x04, rng.randbytes(16)))), der(0x04, rng.randbytes(160)))
    public = der(0x30, rsa, der(0x03, b"\0" + der(0x30, number(rng, 128), number(rng, 3))))
    certificate = der(0x30, der(0x30, der(0xA0, der(0x02, b"\2")), number(rng, 9), rsa, public), rsa, der(0x03, b"\0" + rng.randbytes(128)))
    signature = der(0x30, number(rng, 32), number(rng, 32))
    half = wire(b"ssh-ed25519", rng.randbytes(32))
    openssh = b"openssh-key-v1\0" + wire(b"none", b"none", b"") + (1).to_bytes(4, "big") + wire(half, rng.randbytes(136))
    yes = {"pkcs1": pkcs1, "pkcs8": pkcs8, "ed": ed, "ec": ec, "sealed": sealed, "openssh": openssh}
    no = {"public": public, "certificate": certificate, "signature": signature, "ssh public": half, "noise": rng.randbytes(90), "cut": pkcs8[:-1], "long": pkcs8 + b"\0", "ssh cut": openssh[:-2]}
    return [(k, v, True) for k, v in yes.items()] + [(k, v, False) for k, v in no.items()]


def armour(label, data, headers=""):
    text = base64.b64encode(data).decode()
    return f"-----BEGIN {label}-----\n{headers}" + "\n".join(text[i : i + 64] for i in range(0, len(text), 64)) + f"\n-----END {label}-----"


@pytest.mark.parametrize("seed", range(6))
def test_op9_confirms_private_keys_in_all_forms_and_nothing_else(seed):
    rng = random.Random(seed)
    around = lambda x: f"Some words before, {x} and after it.\n"
    for name, data, private in encodings(rng):
        kind = "ssh" if "ssh" in name else "der"
        plain = base64.b64encode(data).decode()
        wrapped = "\n".join(plain[i : i + 64] for i in range(0, len(plain), 64))
        forms = [(plain, kind), (plain.rstrip("="), kind), (plain.replace("+", "-").replace("/", "_"), kind), (wrapped, kind), (wrapped.replace("\n", "\\n"), kind), (data.hex(), kind), (data.hex().upper(), kind)]
        pem = armour("PRIVATE KEY", data)
        forms += [(pem, "pem"), (pem.replace("\n", "\r\n"), "pem"), (pem.replace("\n", "\\n"), "pem")]
        for form, want in forms:
            text = around(form)
            got = S.confirmed(text, S.secrets(text))
            at = text.index(form)
            if private:
                assert [(k, a, b) for k, a, b in got if want == "pem" or text[a:b].rstrip("=") == form.rstrip("=")] == got and len(got) == 1, (name, form)
                assert got[0][0] == want and got[0][1] == at and got[0][2] in (at + len(form), at + len(form.rstrip("="))), (name, form)
            else:
                assert got == [], (name, form)
        for label in ("CERTIFICATE", "PUBLIC KEY"):
            assert S.confirmed(around(armour(label, data)), []) == []


def test_op9_tokens_and_encrypted_blocks():
    rng = random.Random(1)
    part = lambda x: base64.urlsafe_b64encode(x if isinstance(x, bytes) else json.dumps(x).encode()).decode().rstrip("=")
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': 'someone'})}.{part(rng.randbytes(32))}"
    text = f"Authorization: Bearer {token}, and more"
    assert ("jwt", text.index("eyJ"), text.index(",")) in S.confirmed(text, [])
    for bad in (f"{part({'typ': 'JWT'})}.{part({'a': 1})}.abcd", f"{part({'alg': 'HS256'})}.{part(b'no json at all')}.abcd", f"{part({'alg': 'HS256'})}."):
        assert S.confirmed(bad, []) == []
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011223344556677\n\n"
    sealed = armour("RSA PRIVATE KEY", rng.randbytes(160), headers)
    assert S.confirmed(f"x\n{sealed}\ny", []) == [("pem", 2, 2 + len(sealed))]
    assert S.confirmed(armour("RSA PRIVATE KEY", rng.randbytes(160)), []) == []
    assert S.confirmed("-----BEGIN PRIVATE KEY-----\n" * 500 + "MII", []) == []


def test_op9_long_texts_take_linear_time():
    began = time.time()
    text = "\n".join(["M" + "IICXgIBAAKBgQC7"[:15] * 4] * 20_000) + " " + "30820" * 40_001 + " eyJ" * 50_000 + " " + "A" * 300_000
    S.confirmed(text, S.secrets(text))
    assert time.time() - began < 30


def test_op9_query_reports_added_spans(spark, tmp_path):
    rng = random.Random(2)
    key = armour("PRIVATE KEY", dict((k, v) for k, v, _ in encodings(rng))["ed"])
    spark.createDataFrame([(1, f"see\n{key}"), (2, "nothing"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in Q.op9_secret_scan(spark, str(tmp_path)).collect()}
    assert got == {1: f"pem:4:{4 + len(key)}", 2: "", 3: ""}


# 3, personal data


def test_op3_many_entities_take_linear_time(spark, tmp_path):
    text = " ".join(f"mail user{k}@host{k}.org about words" for k in range(10_000))
    spark.createDataFrame([(1, text), (2, text[:2000])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    began = time.time()
    got = {r["doc_id"]: r["n_email"] for r in Q.op3_sanitise(spark, str(tmp_path)).collect()}
    assert got[1] == 10_000 and time.time() - began < 60


def test_op3_marks_planted_owners_and_nothing_by_chance(spark, tmp_path):
    """Texts of independent words, half of them with an address of their own: at one domain, at two hundred, at one for each; and an owner's
    project, named wherever the owner is."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(4000)]
    for name, domain in (("one", lambda k: "mail.org"), ("many", lambda k: f"d{k % 200}.org"), ("own", lambda k: f"d{k}.org")):
        texts = [" ".join(rng.choices(vocabulary, k=60)) + (f" u{'abcdefghij'[k % 10]}{k}x{'klmnop'[k // 10 % 6]}@{domain(k)}" if k % 2 else "") for k in range(2000)]
        texts += [" ".join(rng.choices(vocabulary, k=40)) + f" Zephyrine wrote to jane.roe{k}@{'mail' if k % 2 else 'post'}.net " + " ".join(rng.choices(vocabulary, k=20)) for k in range(6)]
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = {r["doc_id"]: [x for x in r["spans"].split(",") if x.startswith(("remove", "generalise"))] for r in Q.op3_sanitise(spark, f"{tmp_path}/{name}").collect()}
        for k in range(2000, 2006):
            at = texts[k].index("Zephyrine")
            assert f"remove:{at}:{at + 9}" in found[k]
        assert sum(len(found[k]) for k in range(2000)) <= 3


def test_op3_adds_spans_on_the_tables_as_brute_force_does(spark, medium):
    """Strengths of all pairs of a term and an entity, or group of them, from sets of whole documents; with some planted ones."""
    from loadloom.llm import pii

    rule = pii.GROUPED
    table = spark.read.parquet(f"{medium}/documents.parquet")
    planted = [(10**6 + k, f"Zephyrine and others of wobbleton wrote to jane{k}@{x}.example.org today" + " and the of" * k) for k in range(12) for x in ["abc"[k % 3]]]
    table = table.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    texts = [(r["doc_id"], r["text"] or "") for r in table.collect()]
    found = {d: S.personal(t) for d, t in texts}
    held, near, seen = collections.defaultdict(set), collections.defaultdict(set), collections.defaultdict(set)
    places = {}
    for d, t in texts:
        for w in set(re.split(r"[^\W\d_]+", t) and [m[0].lower() for m in re.finditer(r"[^\W\d_]+", t)]):
            seen[w].add(d)
        if not found[d]:
            continue
        places[d] = [m for m in re.finditer(r"[^\W\d_]{%d,}" % rule.min_letters, t) if not any(a < m.end() and m.start() < b for _, a, b in found[d])]
        for m in places[d]:
            near[m[0].lower()].add(d)
        for k, a, b in found[d]:
            for e in pii.entity_keys(k, t[a:b], rule.groups):
                held[e].add(d)
    n, want = len(texts), {}
    strong = collections.defaultdict(dict)
    judged = [e for e, docs in held.items() if len(docs) >= rule.support]
    least = math.log(max(len(judged), 1) * max(len(near), 1) / rule.chance)
    for e in judged:
        docs = held[e]
        if len(docs) == n:
            continue
        for w in {m[0].lower() for d in docs for m in places[d]}:
            both = len(docs & near[w])
            if both >= rule.support:
                n_t, base = max(len(seen[w]), len(near[w])), len(docs) / n
                strength = math.log(n * both / (n_t * len(docs))) / math.log(n / len(docs))
                share = both / n_t
                evidence = n_t * (share * math.log(share / base) + (0 if share == 1 else (1 - share) * math.log((1 - share) / (1 - base))))
                if strength >= rule.generalise and evidence >= least:
                    strong[w][e] = strength
    for d, t in texts:
        own = {e for k, a, b in found[d] for e in pii.entity_keys(k, t[a:b], rule.groups)}
        added = set()
        for m in places.get(d, ()):
            told = [s for e, s in strong.get(m[0].lower(), {}).items() if e in own]
            if told:
                added.add(f"{'remove' if max(told) >= rule.remove else 'generalise'}:{m.start()}:{m.end()}")
        want[d] = added | {f"{k}:{a}:{b}" for k, a, b in found[d]}
    got = {r["doc_id"]: set(r["spans"].split(",")) - {""} for r in pii.sanitise(table, rule).collect()}
    assert got == want and sum(x.startswith(("remove", "generalise")) for s in want.values() for x in s) > 0


def test_op3_redact():
    from loadloom.llm.pii import redact

    text = "Dear Zephyrine, write to ann@x.org about Gateway soon"
    at = lambda x: (text.index(x), text.index(x) + len(x))
    spans = [("remove", *at("Zephyrine")), ("email", *at("ann@x.org")), ("generalise", *at("Gateway"))]
    assert redact(text, spans) == "Dear , write to <email> about <word-short> soon"
    assert redact(None, spans) is None and redact(text, []) == text
    assert redact("abcdef", [("email", 0, 4), ("ip", 2, 6)]) == "<email>ef"


# 4, near-duplicates


def test_op4_keeps_a_stated_row_of_rows_that_share_id_and_text(spark):
    from loadloom.llm.simhash import keep_first

    rows = [(1, "one two three four five", "b"), (1, "one two three four five", "a"), (2, "one two three four five", "c"), (3, "quite another text with other words in it", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string, source string")
        assert sorted(map(tuple, keep_first(docs).collect())) == [rows[1], rows[3]]


# 6, quality classifier


def test_op6_fit_minimises_the_pairwise_loss():
    """The loss of the preference pairs by plain gradient descent on the same pairs."""
    from loadloom.llm.quality_model import N_FEATURES, Ranking, fit

    rng = np.random.default_rng(4)
    x = rng.random((120, N_FEATURES))
    y = (x[:, 3] + 0.5 * x[:, 7] + 0.2 * rng.normal(size=120) > 0.8).astype(int)
    how = Ranking(pairs=2000, ridge=5.0, steps=40)
    model = fit(x, y, how)
    z = (x - x.mean(axis=0)) / (x.std(axis=0) + 0.02)
    pick = np.random.default_rng(how.seed)
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = z[pick.choice(good, how.pairs)] - z[pick.choice(poor, how.pairs)]
    w = np.zeros(N_FEATURES)
    for _ in range(6000):
        w += 2e-4 * (d.T @ (1 / (1 + np.exp(d @ w))) - how.ridge * w)
    assert np.allclose(model.weights, w, atol=2e-3)
    strengths = np.sort(model.strength(x))
    assert (strengths < model.cut).sum() == len(poor)


def test_op6_is_the_same_in_any_order_of_rows(spark, medium):
    from loadloom.llm.quality_model import rank_quality

    docs, labels = (spark.read.parquet(f"{medium}/{t}.parquet") for t in ("documents", "labels"))
    twice = docs.union(docs)
    a, b = ({r["doc_id"]: r["score"] for r in rank_quality(x, labels).collect()} for x in (twice, twice.repartition(7, F.col("text"))))
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-12 for d in a)


# 10, packing


def test_op10_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    from loadloom.llm.bpe import IdEncoder

    path = public_tokenizers.path("byte_bpe_50k.json")
    e, lib = IdEncoder(path), Tokenizer.from_file(path)
    texts = ["Two  words\nand Upper", "", "déjà <|endoftext|> vu"]
    assert not e.by_words and [np.frombuffer(p, f"<u{e.width}").tolist() for p in e.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
