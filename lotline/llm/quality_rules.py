"""Quality by weak supervision: rules vote or abstain, EM weighs them.

Each rule looks at a measure or two of a text and votes good (1) or bad (-1), or abstains (0).
Failing one rule rejects nothing: the hidden class of each document and the accuracy of each rule's cast
votes are estimated together by expectation-maximisation over the votes of all documents, and a
document is kept if its posterior chance of being good is at least one half. An abstention says
nothing about the class, since each rule knows one kind of junk only.

The texts are reduced to patterns of votes map-side: at most 3 ** len(RULES) rows with
their counts, however many documents there are. Each EM step is one aggregate over these
rows. Everything is built-in expressions; no Python sees a row.

Null and empty texts have no words and fail the base test. Repeated rows count as often as
they occur. Rules abstain on texts too short for their measure.
Thousands of words without the end of a sentence are junk, however varied they are. A document without votes has chance one half and is
kept. In an empty table, or where a rule never votes, its start accuracy holds. Columns of the input, whatever their names, are untouched: measures live in the
columns ``MEASURES``, beside the struct ``row``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import WHITE_CHARS, cut_lineage, packed, text_of, white_words

WINDOW = 5
BASE_LEAST_WORDS = 10
BASE_MOST_REPEATED = 20  # percent of words in repeated windows
EM_STEPS = 25
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
            "n_distinct_words", "n_upper", "n_shouts", "n_ends")
Measures = dict[str, Column]


def _line_has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(WHITE_CHARS)) != ""


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a run of ``window`` words that occurs at least twice in the text.

    Windows are compared by 64-bit hash. The sort and the union of the covered stretches
    run only for texts in which some window repeats.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - window)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(found: Column) -> Column:
        ordered = F.array_sort(F.arrays_zip(found.alias("h"), starts.alias("at")))

        def repeats(rows: Column) -> Column:
            last = F.size(rows) - 1
            same = F.filter(F.sequence(F.lit(0), last), lambda i: (
                (i > 0) & (F.get(rows, i - 1)["h"] == F.get(rows, i)["h"])
                | (i < last) & (F.get(rows, i + 1)["h"] == F.get(rows, i)["h"])))
            return F.array_sort(F.transform(same, lambda i: F.get(rows, i)["at"]))

        return F.aggregate(
            _let(ordered, repeats), F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
            lambda a, at: F.struct(at.alias("last"), (a["n"] + F.least(F.lit(window), at - a["last"])).alias("n")),
            lambda a: a["n"])

    def counted(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), 0).otherwise(covered(found))

    return F.when(n < window, 0).otherwise(_let(hashes, counted)).cast("bigint")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """``row`` (all input columns) and the measures of the text.

    The measures come out of a generator, which no filter on them or on what follows from them can
    be moved below: each is worked out once per text, whatever is asked of it.
    """
    text = F.col("text_")
    words = F.col("words_")
    lines = F.filter(F.split(text, "\n", -1), _line_has_word)
    base = docs.select(packed(docs).alias("row"), text_of("text").alias("text_"))
    base = base.withColumn("words_", white_words(text)).withColumn("lines_", lines)
    n_lines = F.size("lines_").cast("bigint")
    return base.select("row", F.inline(F.array(F.struct(
        F.size(words).cast("bigint").alias("n_words"),
        F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        n_lines.alias("n_lines"),
        (n_lines - F.size(F.array_distinct("lines_"))).cast("bigint").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("bigint").alias("n_upper"),
        F.regexp_count(text, F.lit(r"[!?]{2,}")).cast("bigint").alias("n_shouts"),
        F.regexp_count(text, F.lit(r"[.?!:](?=[\x20\x09-\x0D]|$)")).cast("bigint").alias("n_ends")))))


def measures() -> Measures:
    """The measures as columns of ``measured``. They are plain columns and not a struct, so that the
    optimizer doesn't work one out anew for every rule that looks at it."""
    return {name: F.col(name) for name in MEASURES}


def _per(m: Measures, measure: str, of: str = "n_words") -> Column:
    return m[measure] / F.greatest(m[of], F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Casts ``vote`` (1 good, -1 bad) where ``holds``, and abstains elsewhere and on fewer words than ``least_words``."""

    name: str
    vote: int
    holds: Callable[[Measures], Column]
    least_words: int = 10

    def cast(self, m: Measures) -> Column:
        holds = (m["n_words"] >= self.least_words) & self.holds(m)
        return F.when(holds, self.vote).otherwise(0).cast("int")


RULES = (
    Rule("symbols", -1, lambda m: _per(m, "n_symbols") > 0.25),
    Rule("capitals", -1, lambda m: _per(m, "n_upper", "word_chars") > 0.35),
    Rule("shouts", -1, lambda m: _per(m, "n_shouts") > 0.15),
    Rule("repeats", -1, lambda m: _per(m, "n_repeat_words") > 0.15),
    Rule("lines", -1, lambda m: _per(m, "n_dup_lines", "n_lines") > 0.25),
    Rule("sameness", -1, lambda m: _per(m, "n_distinct_words") < 0.15, 30),
    Rule("endless", -1, lambda m: m["n_words"] / (m["n_ends"] + 1) > 60, 60),
    Rule("word_length", -1, lambda m: F.abs(_per(m, "word_chars") - 6.5) > 4.5),
    Rule("prose", 1, lambda m: (_per(m, "n_symbols") < 0.1) & (_per(m, "n_upper", "word_chars") < 0.15)
         & (_per(m, "n_shouts") < 0.02) & (m["n_words"] / (m["n_ends"] + 1) < 40)),
    Rule("varied", 1, lambda m: (_per(m, "n_distinct_words") > 0.25) & (_per(m, "n_repeat_words") < 0.02)
         & (_per(m, "n_symbols") < 0.1) & (_per(m, "n_shouts") < 0.02)),
)
START_ACCURACY = 0.95
PRIOR_WEIGHT = 0.2
LEAST_ACCURACY, MOST_ACCURACY = 0.55, 0.99


@dataclass(frozen=True)
class Model:
    """Per rule, the chance that its vote, when cast, is right. Without votes either class is as likely."""

    accuracies: tuple[float, ...]

    def posterior_good(self, votes: Column) -> Column:
        odds = F.lit(0.0)
        for j, accuracy in enumerate(self.accuracies):
            odds = odds + F.get(votes, F.lit(j)) * F.lit(math.log(accuracy / (1 - accuracy)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))


def votes_of(m: Measures, rules=RULES) -> Column:
    return F.array(*[rule.cast(m) for rule in rules])


def fit(votes: DataFrame, rules=RULES, steps: int = EM_STEPS) -> Model:
    """EM over the counts of vote patterns (column ``votes``), in small aggregates, until
    nothing changes, or ``steps`` of them.

    A rule's accuracy is the mean chance that its cast votes are right, drawn towards
    ``START_ACCURACY`` by ``PRIOR_WEIGHT`` of its votes and kept within the bounds; so a rule that
    no other rule ever meets keeps its start, one that others bear out gains and one that they contradict
    loses. Rounding to ten digits hides in which order partial sums met.
    """
    patterns = cut_lineage(votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
                           .repartition(1).sortWithinPartitions("votes"))
    model = Model((START_ACCURACY,) * len(rules))
    for _ in range(steps):
        good = model.posterior_good(F.col("votes"))
        sums = []
        for j, rule in enumerate(rules):
            cast = F.get("votes", F.lit(j)) != 0
            right = good if rule.vote > 0 else F.lit(1.0) - good
            sums += [F.coalesce(F.sum(F.when(cast, F.col("n") * right)), F.lit(0.0)).alias(f"right{j}"),
                     F.coalesce(F.sum(F.when(cast, F.col("n"))), F.lit(0)).alias(f"all{j}")]
        got = patterns.agg(*sums).first()
        accuracies = []
        for j in range(len(rules)):
            cast, right = got[f"all{j}"], got[f"right{j}"]
            mean = (right + PRIOR_WEIGHT * cast * START_ACCURACY) / (cast * (1 + PRIOR_WEIGHT)) if cast else START_ACCURACY
            accuracies.append(round(min(MOST_ACCURACY, max(LEAST_ACCURACY, mean)), 10))
        before, model = model, Model(tuple(accuracies))
        if model == before:
            break
    return model


def base_failed(m: Measures) -> Column:
    return ((m["n_words"] < BASE_LEAST_WORDS)
            | (m["n_repeat_words"] * 100 > m["n_words"] * BASE_MOST_REPEATED))


def judged(rows: DataFrame, model: Model, rules=RULES) -> DataFrame:
    """Adds base_failed, quality (posterior chance of being good) and kept to measured rows."""
    m = measures()
    failed, quality = base_failed(m), model.posterior_good(votes_of(m, rules))
    return rows.select("*", failed.alias("base_failed"), quality.alias("quality"),
                       (~failed & (quality >= 0.5)).alias("kept"))


def quality_rows(docs: DataFrame, rules=RULES) -> DataFrame:
    """row, measures, base_failed, quality and kept of every document.

    Two passes over the texts: one for the patterns of votes, one for the verdicts. Nothing but pattern
    counts is shuffled.
    """
    rows = measured(docs)
    model = fit(rows.select(votes_of(measures(), rules).alias("votes")), rules)
    return judged(rows, model, rules)


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return quality_rows(docs, rules).where("kept").select("row.*")
