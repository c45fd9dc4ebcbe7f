"""Quality rules under weak supervision; DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loadloom.llm.common import open_table, write_table

WORD = r"[^\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Three or more of the same mark, and words without a letter.
MARK_RUN = r"([^\p{L}\p{N}\x20\x09-\x0D])\1\1+"
LETTERLESS = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"


@dataclass(frozen=True)
class Rule:
    """Votes +1 (good) where the measure is at most ``good``, -1 where it is at least ``bad``, else abstains."""

    name: str
    measure: str
    good: float
    bad: float

    def vote(self) -> Column:
        m = F.expr(self.measure)
        return F.when(m <= self.good, 1).when(m >= self.bad, -1).otherwise(0).cast("byte").alias(f"vote_{self.name}")


#: Measures per word or character, so that no rule depends on a text's length; each of a trait of its own, since the estimation takes
#: the rules' votes on texts of one class as independent.
RULES = (
    Rule("symbols", "try_divide(n_symbols, n_words)", 0.02, 0.1),
    Rule("repeats", "try_divide(n_repeat_words, n_words)", 0.2, 0.4),
    Rule("lines", "try_divide(n_dup_lines, n_lines)", 0.1, 0.3),
    Rule("capitals", "try_divide(n_capitals, word_chars)", 0.1, 0.25),
    Rule("mark_runs", "try_divide(n_mark_runs, n_words)", 0.03, 0.15),
    Rule("letterless", "try_divide(n_letterless, n_words)", 0.08, 0.2),
    Rule("distinct", "1 - try_divide(n_distinct, n_words)", 0.8, 0.92),
    Rule("word_length", "abs(try_divide(word_chars, n_words) - 6)", 3, 5),
)


def features(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns ``keep`` of each row, its counts and its votes. One pass, no shuffle, time linear in the text."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(*keep, text.alias("_text"))
    kept = base.columns[:-1]
    base = base.withColumns({"_words": F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))})
    n = F.size("_words")
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(NOT_SPACE))
    triples = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.slice("_words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    )
    counted = base.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.regexp_count("_text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("_text", F.lit(MARK_RUN)).cast("long").alias("n_mark_runs"),
        F.regexp_count("_text", F.lit(LETTERLESS)).cast("long").alias("n_letterless"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct"),
        lines.alias("_lines"),
        triples.alias("_triples"),
    )
    counted = counted.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_capitals", "n_mark_runs", "n_letterless", "n_distinct",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("_triples").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.select("*", failed.alias("base_failed"), *(r.vote() for r in RULES)).fillna(0, [f"vote_{r.name}" for r in RULES])


def repeated_words(triples: str) -> Column:
    """Words that lie in a 3-word window found twice or more: sort the windows' hashes with their places, keep those equal to a
    neighbour, and add up what each place covers beyond the one before it."""
    whole = F.size(F.array_distinct(triples)) == F.size(triples)
    placed = F.sort_array(F.transform(triples, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    counted = F.element_at(F.transform(F.array(placed), covered_by_twins), 1)  # an array of one, so that it is sorted once
    return F.when(whole, F.lit(0).cast("long")).otherwise(counted)


def covered_by_twins(placed: Column) -> Column:
    n = F.size(placed)
    again = F.filter(
        placed,
        lambda x, k: ((k + 1 < n) & (F.get(placed, k + 1)["h"] == x["h"])) | ((k > 0) & (F.get(placed, k - 1)["h"] == x["h"])),
    )
    return F.aggregate(
        F.sort_array(F.transform(again, lambda x: x["i"])),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(p - acc["last"], F.lit(3))).alias("n")),
        lambda acc: acc["n"],
    )


VOTES = (-1, 0, 1)
#: How a rule votes on good and poor texts (-1, 0, +1) before any data: most poor texts have one defect or two, so the absence of
#: another says little. Then the share of good texts, and the share of all texts that these beliefs weigh.
START = {True: (0.03, 0.07, 0.9), False: (0.3, 0.1, 0.6)}
GOOD, BELIEF = 0.8, 0.02


def fit(patterns: list[tuple[tuple[int, ...], int]], steps: int = 60, belief: float = BELIEF) -> tuple[float, list[dict[int, float]]]:
    """Log odds of a good text before any vote, and what each rule's vote adds to them.

    Expectation-maximisation over vote patterns and their counts. A rule's accuracies, how often it votes for, against or not at all
    on good and on poor texts, are estimated apart for each class, so a rule that says little about the class adds little. The starting
    belief weighs as much as a fixed share of the texts at every size, which keeps the classes from trading places.
    """
    m = len(RULES) if not patterns else len(patterns[0][0])
    total = sum(n for _, n in patterns)
    prior, chance = GOOD, {c: [dict(zip(VOTES, START[c], strict=True)) for _ in range(m)] for c in START}
    for _ in range(steps if total else 0):
        weight = belief * total + 1
        seen = {c: [{v: weight * p for v, p in zip(VOTES, START[c], strict=True)} for _ in range(m)] for c in START}
        of_class = {True: weight * GOOD, False: weight * (1 - GOOD)}
        odds = added(prior, chance)
        for votes, n in patterns:
            p = posterior(odds, votes)
            for c, share in ((True, p), (False, 1 - p)):
                of_class[c] += n * share
                for j, v in enumerate(votes):
                    seen[c][j][v] += n * share
        prior = of_class[True] / sum(of_class.values())
        chance = {c: [{v: x / sum(rule.values()) for v, x in rule.items()} for rule in seen[c]] for c in seen}
    return added(prior, chance)


def added(prior: float, chance: dict[bool, list[dict[int, float]]]) -> tuple[float, list[dict[int, float]]]:
    rules = [{v: math.log(good[v] / poor[v]) for v in VOTES} for good, poor in zip(chance[True], chance[False], strict=True)]
    return math.log(prior / (1 - prior)), rules


def posterior(odds: tuple[float, list[dict[int, float]]], votes: tuple[int, ...]) -> float:
    total = odds[0] + sum(rule[v] for rule, v in zip(odds[1], votes, strict=True))
    return 1 / (1 + math.exp(-total)) if total > -700 else 0.0


def verdicts(table: DataFrame, least: float = 0.5) -> DataFrame:
    """Adds quality (posterior probability) and kept to a table with votes. Only vote patterns, at most 3^rules, are collected."""
    names = [f"vote_{r.name}" for r in RULES]
    patterns = [(tuple(row[:-1]), row[-1]) for row in table.filter("not base_failed").groupBy(*names).count().collect()]
    start, rules = fit(sorted(patterns))
    odds = F.lit(start)
    for name, rule in zip(names, rules, strict=True):
        odds = odds + F.when(F.col(name) < 0, rule[-1]).when(F.col(name) > 0, rule[1]).otherwise(rule[0])
    quality = 1 / (1 + F.exp(-odds))
    return table.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (quality >= least))


def judged(docs: DataFrame, *keep: Column) -> DataFrame:
    """The columns ``keep`` of each row of ``docs`` (the whole row, as ``doc``, if none are named), with counts, votes, base_failed,
    quality and kept. Names of kept columns must not be those of counts or votes; a struct of the row can't clash.

    What is kept is written once with the votes; the accuracies are estimated from the counts of all vote patterns, and the posterior
    replaces the demand that every rule pass. A text fails outright if it has under 50 words, or if over half of its words repeat.
    Null or empty text: no words, so base_failed. Null doc_id: stays null. Repeated rows: judged alike, all in the result.
    Very long texts, and long runs of white space, cost time in proportion to their length. Empty table: no rows.
    Other columns, whatever their names, stay inside ``doc``.
    """
    rows = features(docs, *(keep or [F.struct("*").alias("doc")]))
    return verdicts(open_table(docs.sparkSession, write_table(rows, "quality-votes"), rows))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judged`` keeps, with their columns as they were; nulls and repeated rows as there."""
    return judged(docs).filter("kept").select("doc.*")
