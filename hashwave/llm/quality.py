"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated.

Each rule votes good (1), bad (-1) or abstains (0). A document is taken to have a hidden quality;
given it, the votes are independent. Expectation-maximisation over the counts of the distinct vote
patterns gives the share of good documents and, for each rule, how often it votes good on good
and bad on bad documents when it votes. The posterior probability replaces "all rules must pass";
no rate is taken to be nearer to 0 or 1 than ``BOUND``, so that one rule does not overrule all others
because the rows are many.
Everything on the rows is a column expression; the driver sees only the pattern counts, at most
three to the power of the number of rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hashwave.llm.common import WORD, text_or_empty

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_lines", "n_ended_lines", "n_letters", "n_upper", "n_written"]
#: The least and, taken from 1, the greatest estimated rate.
BOUND = 0.05
_SCRATCH = ["_q_words", "_q_hashes", "_q_windows", "_q_lines"]


def _kept_chars(text: Column, others: str) -> Column:
    """Characters left once every run of other ones is removed."""
    return F.length(F.regexp_replace(text, others, "")).cast("long")


def with_features(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that the rules look at, over each whole text; columns of these names are replaced.

    A null or empty text has no words and all counts 0. Rows are independent: no shuffle, and
    repeated rows get equal counts. Repeated windows are found by sorting a text's windows with
    their places, and only where their hashes show that there are any.
    """
    body, words, windows = text_or_empty(text), F.col("_q_words"), F.col("_q_windows")
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashed = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    places = F.sequence(F.lit(0), F.size(words) - 3)
    with_word = F.filter(F.split(body, "\n"), lambda line: line.rlike(WORD))
    same = lambda i, j: F.get(windows, i)["w"] == F.get(windows, j)["w"]
    repeated = F.filter(
        F.sequence(F.lit(0), F.size(windows) - 1),
        lambda i: F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)),
    )
    covered = F.flatten(
        F.transform(repeated, lambda i: (lambda p: F.array(p, p + 1, p + 2))(F.get(windows, i)["p"]))
    )
    return (
        df.withColumn("_q_words", F.regexp_extract_all(body, F.lit(WORD), F.lit(0)))
        .withColumn("_q_lines", with_word)
        .withColumn("_q_hashes", F.when(F.size(words) > 3, F.transform(places, hashed)))
        .withColumn(
            "_q_windows",
            F.when(
                F.size(F.array_distinct("_q_hashes")) < F.size("_q_hashes"),
                F.sort_array(F.transform(places, lambda i: F.struct(window(i).alias("w"), i.alias("p")))),
            ),
        )
        .withColumns(
            {
                "n_words": F.size(words).cast("long"),
                "word_chars": F.length(F.array_join(words, "")).cast("long"),
                "n_symbols": _kept_chars(body, r"[^#*$%&|<>]+"),
                "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
                "n_repeat_words": F.when(windows.isNull(), F.lit(0))
                .otherwise(F.size(F.array_distinct(covered)))
                .cast("long"),
                "n_lines": F.size("_q_lines").cast("long"),
                "n_ended_lines": F.size(
                    F.filter("_q_lines", lambda line: line.rlike(r"[.!?:;\"][\x20\x09-\x0D]*$"))
                ).cast("long"),
                "n_letters": _kept_chars(body, r"[^\p{L}]+"),
                "n_upper": _kept_chars(body, r"[^\p{Lu}]+"),
                # With the marks that many scripts write vowels with, and figures.
                "n_written": _kept_chars(body, r"[^\p{L}\p{M}\p{N}]+"),
            }
        )
        .drop(*_SCRATCH)
    )


def base_failed(least_words: int = 50, most_repeated: int = 50) -> Column:
    """Too short, or too much of it in repeated windows (percent)."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def rules() -> dict[str, tuple[Column, Column]]:
    """For each rule, when it votes bad and when it votes good; it abstains in between."""
    c = F.col
    return {
        "symbols": (10 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "letters": (100 * c("n_written") < 90 * c("word_chars"), 100 * c("n_written") >= 94 * c("word_chars")),
        "capitals": (10 * c("n_upper") > 3 * c("n_letters"), 10 * c("n_upper") <= c("n_letters")),
        "lines": (10 * c("n_dup_lines") > 3 * c("n_lines"), c("n_dup_lines") == 0),
        "windows": (10 * c("n_repeat_words") > 3 * c("n_words"), 10 * c("n_repeat_words") <= c("n_words")),
        "lengths": (
            (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 10 * c("n_words")),
            c("word_chars").between(4 * c("n_words"), 6.5 * c("n_words")),
        ),
        "endings": (10 * c("n_ended_lines") < c("n_lines"), 2 * c("n_ended_lines") >= c("n_lines")),
    }


def votes() -> list[Column]:
    """Each rule's vote; a text without words gets none."""
    some = F.col("n_words") > 0
    return [F.when(some & bad, -1).when(some & good, 1).otherwise(0) for bad, good in rules().values()]


@dataclass(frozen=True)
class QualityModel:
    """The share of good documents, and each rule's rate of right votes on good and on bad ones."""

    good: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self) -> Column:
        """Of a row's votes, as a sum of constants chosen by the votes."""
        total = F.lit(math.log(self.good) - math.log(1 - self.good))
        for vote, g, b in zip(votes(), self.on_good, self.on_bad):
            total = total + F.when(vote == 1, math.log(g) - math.log(1 - b)).when(
                vote == -1, math.log(1 - g) - math.log(b)
            ).otherwise(0.0)
        return total

    def posterior(self) -> Column:
        return 1 / (1 + F.exp(-self.log_odds()))


def fit(features: DataFrame, rounds: int = 50) -> QualityModel:
    """Estimates the model from all rows' votes; rows without any vote carry no information.

    The first guess is that a document is the worse the more rules object to it. Counts are
    smoothed by one each way, so an empty table gives even odds and rates of one half.
    """
    # Bounded by 3 ** rules rows, whatever the size of the table.
    counted = features.groupBy(F.array(*votes()).alias("pattern")).count().collect()
    return estimate({tuple(row["pattern"]): row["count"] for row in counted}, rounds)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 50) -> QualityModel:
    """Expectation-maximisation over counted vote patterns; every share and rate is held within ``BOUND``."""
    rows = sorted(patterns.items())
    n_rules = len(rules())
    good = [1 / (1 + 2 * sum(v < 0 for v in pattern)) for pattern, _ in rows]
    model = QualityModel(0.5, (0.5,) * n_rules, (0.5,) * n_rules)
    for _ in range(rounds):
        all_good = sum(g * n for g, (_, n) in zip(good, rows))
        all_rows = sum(n for _, n in rows)
        on_good, on_bad = [], []
        for j in range(n_rules):
            cast = [(g, n, p[j]) for g, (p, n) in zip(good, rows) if p[j]]
            on_good.append(
                _bounded((1 + sum(g * n for g, n, v in cast if v > 0)) / (2 + sum(g * n for g, n, _ in cast)))
            )
            on_bad.append(
                _bounded((1 + sum((1 - g) * n for g, n, v in cast if v < 0)) / (2 + sum((1 - g) * n for g, n, _ in cast)))
            )
        model = QualityModel(_bounded((all_good + 1) / (all_rows + 2)), tuple(on_good), tuple(on_bad))
        good = [_posterior(model, pattern) for pattern, _ in rows]
    return model


def _bounded(rate: float) -> float:
    return min(1 - BOUND, max(BOUND, rate))


def _posterior(model: QualityModel, pattern: tuple[int, ...]) -> float:
    odds = math.log(model.good) - math.log(1 - model.good)
    for v, g, b in zip(pattern, model.on_good, model.on_bad):
        if v:
            odds += math.log(g) - math.log(1 - b) if v > 0 else math.log(1 - g) - math.log(b)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def kept(model: QualityModel, least: float = 0.5) -> Column:
    """Not failed outright, and more likely good than ``least``."""
    return ~base_failed() & (model.posterior() >= least)


def keep_good(df: DataFrame, features: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of good quality with their own columns; the model is fitted on ``features``.

    The features are computed again beside the text instead of being joined to it: that costs
    arithmetic, but neither a shuffle of the texts nor a key. Clashing columns pass unharmed.
    """
    model = fit(features)
    # The text is copied aside, and the row held in a struct, so no column of the input is touched.
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"), F.col(text).alias("_q_text"))
    # The verdict is a generated row: a filter on it stays above the features, while one on the verdict's
    # expression would be pushed down and repeat all of them for each time that it uses them.
    judged = with_features(held, "_q_text").select("_row", F.explode(F.array(kept(model, least))).alias("_kept"))
    return judged.where("_kept").select("_row.*")
