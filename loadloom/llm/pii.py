"""Personal data: base patterns, and terms that disclose a protected entity by their information content."""

from __future__ import annotations

import re
from dataclasses import dataclass
from hashlib import blake2b
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadloom.llm import spans as S
from loadloom.llm.common import arrow_map, open_table, tables, write_table


@dataclass(frozen=True)
class Disclosure:
    """Terms are runs of at least ``min_letters`` letters, anywhere in a document that holds an entity.

    An entity is an exact value and, by ``groups``, what values have in common: the ``owner`` (letters of an email's local part) and the
    ``domain`` (of an email; the first three parts of an ip). Single values are mostly too rare to be judged.

    A term t discloses an entity e by PMI(t, e) / IC(e), 1 where t stands in no document without e. From ``generalise`` on it is
    generalised, from ``remove`` on removed. Pairs seen in fewer than ``support`` documents are no evidence; nor are those that chance
    may have made: if the n_t documents of t were drawn from all n at random, the chance that a share a of them or more holds e, which
    n_e documents hold, is at most exp(-n_t KL(a, n_e / n)) (Chernoff), and over all pairs of an entity and a term that were looked at it
    has to stay under ``chance``. An entity in every document is disclosed by nothing.
    ``broadcast_terms`` bounds what is broadcast; beyond it the terms are joined by a shuffle.
    """

    min_letters: int = 4
    groups: tuple[str, ...] = ()
    support: int = 3
    generalise: float = 0.85
    remove: float = 0.999
    chance: float = 0.05
    broadcast_terms: int = 500_000


#: The rule of the registered query.
GROUPED = Disclosure(groups=("owner", "domain"))

_SPAN = "struct<kind:string,start:bigint,end:bigint>"
_TERM = "struct<term:string,start:bigint,end:bigint>"


def entity_key(kind: str, value: str) -> int:
    plain = value.lower() if kind in ("email", "ip") else re.sub(r"[^0-9]", "", value)
    return int.from_bytes(blake2b(f"{kind}:{plain}".encode(), digest_size=8).digest(), "little", signed=True)


def entity_keys(kind: str, value: str, groups: tuple[str, ...]) -> list[int]:
    """The value itself, then the groups that it is in."""
    host = value.rpartition("@")[2] if kind == "email" else value.rpartition(".")[0]
    owner = re.sub(r"[^a-z]", "", value.rpartition("@")[0].lower()) if kind == "email" else ""
    shared = {"owner": owner, "domain": host.lower() if kind in ("email", "ip") else ""}
    named = [f"{g}:{kind}:{shared[g]}" for g in groups if shared[g]]
    return [entity_key(kind, value), *(int.from_bytes(blake2b(x.encode(), digest_size=8).digest(), "little", signed=True) for x in named)]


def found_rows(docs: DataFrame, rule: Disclosure) -> DataFrame:
    """Base spans of each whole text, its entities, and all terms of a text that has any."""
    words = re.compile(r"[^\W\d_]{%d,}" % rule.min_letters)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, entities, terms = [], [], []
        for text in batch.column(1).to_pylist():
            found = S.personal(text) if text else []
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            entities.append(list({x for k, a, b in found for x in entity_keys(k, text[a:b], rule.groups)}))
            here, rest = [], sorted((a, b) for _, a, b in found)
            at = reached = 0
            for m in words.finditer(text) if found else ():
                start, end = m.span()
                while at < len(rest) and rest[at][0] < end:
                    reached = max(reached, rest[at][1])
                    at += 1
                if start >= reached:  # no base span over it
                    here.append({"term": m[0].lower(), "start": start, "end": end})
            terms.append(here)
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        named = pa.list_(pa.struct([("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        out = [batch.column(0), pa.array(base, spans), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, named)]
        return pa.RecordBatch.from_arrays(out, names=["doc_id", "base", "entities", "terms"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return arrow_map(docs.select("doc_id", "text"), scan, f"doc_id {kind}, base array<{_SPAN}>, entities array<bigint>, terms array<{_TERM}>")


def side(few: DataFrame, rule: Disclosure) -> DataFrame:
    """Broadcast up to a bound."""
    return F.broadcast(few) if few.count() <= rule.broadcast_terms else few


def disclosing_pairs(docs: DataFrame, rows: DataFrame, n_docs: int, rule: Disclosure) -> DataFrame:
    """(entity, term, strength) of pairs over the threshold. ``rows``: those with entities, of found_rows.

    Terms and entities count once a document. Document counts of the terms come from all documents; of the entities and pairs from
    the rows that hold them. An entity in fewer than ``support`` documents has no pair in as many, so it forms none.
    """
    n = F.lit(float(n_docs))
    spark, words = docs.sparkSession, F.array_distinct("terms.term")
    counts = rows.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity")).filter(F.col("n_entity") >= rule.support)
    counts = open_table(spark, write_table(counts, "pii-entities"), counts)
    held = rows.select(F.explode("entities").alias("entity"), words.alias("words")).join(side(counts, rule), "entity")
    pairs = held.select("entity", "n_entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("n_both"), F.max("n_entity").alias("n_entity"))
    together = pairs.filter(F.col("n_both") >= rule.support)
    near = rows.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("n_near"))
    near = open_table(spark, write_table(near, "pii-near"), near)
    looked_at = max(counts.count(), 1) * max(near.count(), 1)
    content = F.log(n / F.col("n_entity"))
    strength = lambda n_term: F.log(n * F.col("n_both") / (n_term * F.col("n_entity"))) / content
    # a term stands in at least as many documents as near entities, so a pair that is too weak by that count is too weak
    possible = together.join(near, "term").filter((content > 0) & (strength(F.col("n_near")) >= rule.generalise))
    possible = open_table(spark, write_table(possible, "pii-pairs"), possible)
    terms = possible.select("term").distinct()
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")))
    in_docs = docs.select(words.alias("term")).join(side(terms, rule), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_seen"))
    counted = possible.join(in_docs, "term", "left")
    n_term = F.greatest(F.coalesce("n_seen", F.lit(0)), "n_near")
    share, base = F.col("n_both") / n_term, F.col("n_entity") / n
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    evidence = n_term * (share * F.log(share / base) + rest)
    least = log(looked_at / rule.chance)
    return counted.filter((evidence >= least) & (strength(n_term) >= rule.generalise)).select("entity", "term", strength(n_term).alias("strength"))


def sanitise(docs: DataFrame, rule: Disclosure | None = None) -> DataFrame:
    """Personal data in each whole text: doc_id, base and all_spans (arrays of kind, start, end), counts, base_sha256, spans.

    Base kinds are email, ip, card and phone. The method adds spans of kind ``generalise`` or ``remove``: terms of a
    document that the corpus shows to disclose a protected entity in it (see Disclosure). ``redact`` applies the spans to texts.
    Null text: empty. Null doc_id: stays null. Repeated rows: each counts as a document. Empty table: no rows. Other columns are ignored.
    """
    rule = rule or Disclosure()
    spark = docs.sparkSession
    with tables(spark) as own:
        rows = found_rows(docs, rule).withColumn("row", F.monotonically_increasing_id())
        own.keep(path := write_table(rows, "pii-rows"))
        table = open_table(spark, path, rows)
        held = table.filter(F.size("entities") > 0)
        strong = disclosing_pairs(docs, held, table.count(), rule)
        strong = strong.groupBy("term").agg(F.collect_list(F.struct("entity", "strength")).alias("who"))
        own.keep(path := write_table(strong, "pii-terms"))
        strong = open_table(spark, path, strong)
    # every occurrence of a term in the documents that hold an entity it discloses
    by = F.filter("who", lambda x: F.array_contains("entities", x.entity))
    each = held.select("row", "entities", F.inline("terms")).join(side(strong, rule), "term").select("row", "start", "end", by.alias("by"))
    kind = F.when(F.exists("by", lambda x: x.strength >= rule.remove), "remove").otherwise("generalise")
    hits = each.filter(F.size("by") > 0).select("row", F.struct(kind.alias("kind"), "start", "end").alias("span"))
    added = hits.groupBy("row").agg(F.collect_set("span").alias("added"))
    return told(table.join(added, "row", "left").select("doc_id", "base", "added"))


def told(rows: DataFrame) -> DataFrame:
    """Order the spans and put them as strings."""

    def tell(batch: pa.RecordBatch) -> pa.RecordBatch:
        as_spans = lambda column: [[(s["kind"], s["start"], s["end"]) for s in x or []] for x in column.to_pylist()]
        base, added = as_spans(batch.column(1)), as_spans(batch.column(2))
        full = [S.in_order(b + one_each(a), (*S.PERSONAL_KINDS, "generalise", "remove")) for b, a in zip(base, added, strict=True)]
        struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        counts = [pa.array([sum(s[0] == k for s in found) for found in base], pa.int64()) for k in S.PERSONAL_KINDS]
        spans = pa.array([[{"kind": k, "start": x, "end": y} for k, x, y in f] for f in full], struct)
        columns = [batch.column(0), batch.column(1), spans, *counts, pa.array(map(S.digest, base), pa.string()), pa.array(map(S.joined, full), pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "base", "all_spans", *(f"n_{k}" for k in S.PERSONAL_KINDS), "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in S.PERSONAL_KINDS)
    return arrow_map(rows, tell, f"doc_id {kind}, base array<{_SPAN}>, all_spans array<{_SPAN}>, {counts}, base_sha256 string, spans string")


def one_each(spans: list[S.Span]) -> list[S.Span]:
    """A term near several entities is removed if any of them asks for it, else generalised."""
    kept: dict[tuple[int, int], str] = {}
    for k, a, b in spans:
        kept[a, b] = max(k, kept.get((a, b), ""))  # "remove" sorts after "generalise"
    return [(k, a, b) for (a, b), k in kept.items()]


def redact(text: str | None, spans: list[S.Span]) -> str | None:
    """The text with entities named by kind, terms generalised to their length class, and removed terms left out.

    Of overlapping spans the first stands, of those that start together the longest. Null stays null; without spans the text is as it was.
    """
    if text is None:
        return None
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < at:
            continue
        shown = "" if kind == "remove" else f"<word-{'short' if b - a < 8 else 'long'}>" if kind == "generalise" else f"<{kind}>"
        out += [text[at:a], shown]
        at = b
    return "".join([*out, text[at:]])
