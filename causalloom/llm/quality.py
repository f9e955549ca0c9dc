"""Quality rules that vote or abstain, combined by a label model (weak supervision)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize

SPACES = r"[ \x09-\x0D]+"
MIN_WORDS = 50

#: Rules: name, vote (-1 bad, 1 good), and when it votes; else it abstains. The two good ones
#: abstain where a measure that a clear bad rule reads is out of range; "echoes" and "brief"
#: are hints that may well be wrong, and the fitted accuracies say by how much.
RULES: list[tuple[str, int, str]] = [
    ("symbols", -1, "n_symbols >= 0.10 * n_words"),
    ("loud", -1, "n_upper >= 0.40 * word_chars OR n_shouts >= 0.20 * n_words"),
    ("repetitive", -1, "n_repeat_words >= 0.45 * n_words OR (n_lines >= 4 AND n_dup_lines >= 0.40 * n_lines)"),
    ("word_length", -1, "word_chars >= 15 * n_words OR word_chars < 2 * n_words"),
    ("echoes", -1, "n_repeat_words >= 0.10 * n_words"),
    ("brief", -1, "n_words < 100"),
    ("calm", 1, "n_symbols < 0.05 * n_words AND n_upper < 0.20 * word_chars AND n_shouts < 0.05 * n_words AND n_repeat_words < 0.45 * n_words AND (n_lines < 4 OR n_dup_lines < 0.40 * n_lines) AND word_chars < 15 * n_words AND word_chars >= 2 * n_words"),
    ("varied", 1, "n_words >= 200 AND n_symbols < 0.05 * n_words AND n_repeat_words < 0.10 * n_words AND n_dup_lines < 0.20 * n_lines"),
]
NAMES = [f"v_{r[0]}" for r in RULES]
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts"]

#: The label model: rounds, the accuracy that a rule starts from, how many votes of that accuracy
#: stand beside its own (few: the data decide), and the least posterior that keeps.
ROUNDS, PRIOR_ACCURACY, PRIOR_VOTES, KEEP_AT = 30, 0.9, 20.0, 0.5
#: No rule is taken to be worse than chance (one that looks so has no say) or to be never wrong.
LEAST_ACCURACY, MOST_ACCURACY = 0.5, 0.999


def _only(text: Column, chars: str) -> Column:
    """Number of the characters of a class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _repeated_words(words: Column) -> Column:
    """Words inside a 3-word window that stands twice or more in the text."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(starts, i + 1) - p), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def same(a: Column, b: Column) -> Column:
        return F.coalesce(a["g"] == b["g"], F.lit(False))

    def repeated(s: Column) -> Column:
        hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        return let(F.sort_array(F.transform(hit, lambda x: x["p"])), covered)

    def by_windows(grams: Column) -> Column:
        pairs = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p")))
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(let(F.sort_array(pairs), repeated))

    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0)))
    return let(F.transform(starts, lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2))), by_windows)


#: Column that holds a document's measures beside its own columns.
HELD = "__quality_measures"


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measures of every whole text as a struct HELD; no shuffle, no Python."""
    base = docs.withColumn("__quality_text", F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    text, words, lines = F.col("__quality_text"), F.col("__quality_words"), F.col("__quality_lines")
    split = base.withColumns({
        "__quality_words": F.array_remove(F.split(text, SPACES), ""),
        "__quality_lines": F.filter(F.split(text, "\n"), lambda x: F.regexp_replace(x, SPACES, "") != ""),
    })
    measures = F.struct(
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        _only(text, "#*$%&|<>").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _repeated_words(words).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        _only(text, r"\p{Lu}").alias("n_upper"),
        _only(text, "!").alias("n_shouts"),
    )
    return split.select(*[F.col(f"`{c}`") for c in docs.columns], measures.alias(HELD))


def _votes() -> list[Column]:
    """One column a rule: its vote, or 0 where it abstains. Texts without words get no vote."""
    return [F.when(F.expr(f"({when}) AND n_words > 0"), vote).otherwise(0).cast("int").alias(f"v_{name}") for name, vote, when in RULES]


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> list[float]:
    """Each rule's accuracy, by expectation-maximisation over vote patterns and their counts.

    The true label is hidden. A rule that votes is right with its accuracy, independently
    of the others; abstaining says nothing. Good and bad are held equally likely before
    any vote: most documents are good, and a balance learned from them would let that
    outvote a rule which alone sees one kind of junk (a test shows it). For the same reason
    accuracies stay between LEAST_ACCURACY and MOST_ACCURACY. Beside a rule's own votes
    stand PRIOR_VOTES only. The sums run over patterns in sorted order, so equal counts
    give equal results.
    """
    patterns = sorted(patterns)
    k = len(patterns[0][0]) if patterns else 0
    accuracy = [PRIOR_ACCURACY] * k
    for _ in range(rounds):
        post = [posterior(v, accuracy) for v, _ in patterns]
        for j in range(k):
            votes = right = 0.0
            for (v, n), p in zip(patterns, post, strict=True):
                if v[j]:
                    votes += n
                    right += n * (p if v[j] > 0 else 1 - p)
            accuracy[j] = min(max((right + PRIOR_ACCURACY * PRIOR_VOTES) / (votes + PRIOR_VOTES), LEAST_ACCURACY), MOST_ACCURACY)
    return accuracy


def posterior(votes: tuple[int, ...], accuracy: list[float]) -> float:
    """Probability that a document with these votes is good."""
    return 1 / (1 + math.exp(-sum(v * math.log(a / (1 - a)) for v, a in zip(votes, accuracy, strict=True))))


def label_model(measures: DataFrame) -> list[float]:
    """Fit the model to the votes of all rows; at most 2^rules pattern counts reach the driver."""
    counts = measures.select(*_votes()).groupBy(*NAMES).agg(F.count("*").alias("n")).collect()
    return fit([(tuple(int(r[c]) for c in NAMES), r["n"]) for r in counts])


def _posterior(accuracy: list[float]) -> Column:
    odds = F.lit(0.0)
    for vote, a in zip(_votes(), accuracy, strict=True):
        odds = odds + vote * math.log(a / (1 - a))
    return 1 / (1 + F.exp(-odds))


def _failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its measures, base_failed, kept, quality (posterior) and votes.

    Words are runs of other characters than space and \\x09-\\x0D. The base test fails
    under 50 words, or when over half of the words stand in repeated 3-word windows.
    The rules' votes are counted over all documents by pattern (at most 2^rules rows,
    whatever the input), the label model is fitted to these counts, and a document is
    kept if it passes the base test and its posterior is KEEP_AT at least.

    Null texts count as texts without words: all measures 0, base_failed, not kept.
    Repeated rows count and appear as often as they come; null ids stay null; other
    columns of docs never enter. An empty table gives an empty result.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = materialize(measured(own).select("doc_id", f"{HELD}.*"), "quality")
    accuracy = label_model(rows)
    rows = rows.withColumns({"base_failed": _failed(), "quality": _posterior(accuracy) if accuracy else F.lit(0.0)})
    return rows.select(
        "doc_id", *FEATURES[:5], "base_failed", (~F.col("base_failed") & (F.col("quality") >= KEEP_AT)).alias("kept"), "quality", *_votes(),
    )


def filter_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that score() keeps, with the columns of docs unchanged.

    docs is written once beside its measures, so the costly measures are taken once
    and texts are never shuffled. Nulls, empty texts and repeats are as in score().
    """
    rows = materialize(measured(docs, text_col), "quality")
    measures = rows.select(f"{HELD}.*")
    accuracy = label_model(measures)
    if not accuracy:
        return rows.drop(HELD)
    verdict = ~_failed() & (_posterior(accuracy) >= KEEP_AT)
    # Own columns step aside under other names while the measures' names are in use.
    renamed = rows.select(*[F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(docs.columns)], f"{HELD}.*")
    return renamed.where(verdict).select(*[F.col(f"__own_{i}").alias(c) for i, c in enumerate(docs.columns)])
