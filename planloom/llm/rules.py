"""Quality rules: a decision list learned from labelled documents by sequential covering.

Rules are conjunctions of thresholds on statistics of the text, such as `symbols_per_word > 0.4 and n_words > 12`. Each is grown
on part of the sample, condition by condition, then pruned on the rest, and accepted if it is precise there; the documents it covers are taken
out and the next rule is grown. The list becomes an ordered conditional expression of Spark.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.statistics import COUNTS, NAMES, RATIOS, described, described_documents, labelled_sample

# Labelled documents learned from, at most.
SAMPLE = 20_000
# Thresholds tried for each statistic, at quantiles.
CUTS = 256
CONDITIONS = 6
RULES = 12
# Rules grown, accepted or not.
ATTEMPTS = 40
# The share of low-quality documents among those that an accepted rule covers, at least, and the fewest that it must cover.
PRECISION = 0.98
SUPPORT = 5


@dataclass(frozen=True)
class Condition:
    name: str
    above: bool
    threshold: float

    def holds(self, features: np.ndarray) -> np.ndarray:
        values = features[:, NAMES.index(self.name)]
        return values > self.threshold if self.above else values <= self.threshold

    def column(self) -> Column:
        return F.col(self.name) > self.threshold if self.above else F.col(self.name) <= self.threshold

    def __str__(self) -> str:
        return f"{self.name} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, features: np.ndarray) -> np.ndarray:
    holds = np.ones(len(features), dtype=bool)
    for condition in rule:
        holds &= condition.holds(features)
    return holds


def learned_rules(features: np.ndarray, labels: np.ndarray) -> list[Rule]:
    """Rules that reject documents of label 0, in order; none where the sample has a single label.

    The poor documents that a rule covers are taken out before the next one is grown, whether the rule was
    accepted or not.
    """
    order = np.random.default_rng(5).permutation(len(labels))
    grow, prune = order[len(order) // 3 :], order[: len(order) // 3]
    bad, rules = labels == 0, []
    left = np.ones(len(labels), dtype=bool)
    for _ in range(ATTEMPTS):
        growing, pruning = grow[left[grow]], prune[left[prune]]
        if len(rules) == RULES or bad[growing].sum() < SUPPORT or bad[growing].all():
            break
        rule = _pruned(_grown(features[growing], bad[growing]), features[pruning], bad[pruning])
        hits = covered(rule, features) & left
        if not (hits & bad).any():
            break
        if hits.sum() >= SUPPORT and _precision(hits[pruning], bad[pruning]) >= PRECISION and bad[hits].mean() >= PRECISION:
            rules.append(rule)
            left &= ~hits
        else:
            left &= ~(hits & bad)
    return rules


def _precision(hits: np.ndarray, bad: np.ndarray) -> float:
    return bad[hits].mean() if hits.any() else 0.0


def _grown(features: np.ndarray, bad: np.ndarray) -> Rule:
    """Adds the condition of the highest information gain until no good document is covered or nothing is gained."""
    rule: list[Condition] = []
    for _ in range(CONDITIONS):
        share = bad.mean()
        if share in (0.0, 1.0):
            break
        best, best_gain = None, 1e-9
        # Ratios first: where a ratio and a count are worth the same, the ratio is kept, as it holds for texts of any length.
        for name in RATIOS + COUNTS:
            values = features[:, NAMES.index(name)]
            cuts = np.unique(np.quantile(values, np.linspace(0, 1, CUTS + 2)[1:-1]))
            places = np.searchsorted(cuts, values, side="left")
            good_at = np.bincount(places[~bad], minlength=len(cuts) + 1)
            bad_at = np.bincount(places[bad], minlength=len(cuts) + 1)
            for above in (False, True):
                # Covered by `values <= cut` or `values > cut`, for each cut at once.
                hit_bad = bad_at[::-1].cumsum()[::-1][1:] if above else bad_at.cumsum()[:-1]
                hit_good = good_at[::-1].cumsum()[::-1][1:] if above else good_at.cumsum()[:-1]
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = hit_bad * (np.log2(hit_bad / (hit_bad + hit_good)) - np.log2(share))
                gain = np.nan_to_num(gain, nan=-1.0, neginf=-1.0)
                if gain.size and gain.max() > best_gain:
                    at = int(gain.argmax())
                    # Half way to the next value, so that the threshold isn't one document's own.
                    beyond = values[values > cuts[at]]
                    threshold = (cuts[at] + beyond.min()) / 2 if beyond.size else cuts[at]
                    best, best_gain = Condition(name, above, float(threshold)), gain.max()
        if best is None:
            break
        hits = best.holds(features)
        rule.append(best)
        features, bad = features[hits], bad[hits]
    return tuple(rule)


def _pruned(rule: Rule, features: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that is precise on documents it wasn't grown on; all of it if none is."""
    for size in range(1, len(rule)):
        if _precision(covered(rule[:size], features), bad) >= PRECISION:
            return rule[:size]
    return rule


def first_rule(rules: list[Rule]) -> Column:
    """The number of the first rule that covers a row, from 1; 0 for none."""
    number = F.lit(0)
    for place, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        number = F.when(holds, place).otherwise(number)
    return number


def _base_failed() -> Column:
    return F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule for each row of `docs`.

    `docs` has doc_id and text, `labels` doc_id and quality (1 good, 0 poor); other columns are ignored. base_failed: fewer
    than 10 words, or more than a fifth of the words repeated. kept: neither base_failed nor covered by a learned
    rule; `rule` is the number of the first rule that covers the document, 0 for none. Rules are learned from those of at most SAMPLE
    labelled documents outside the held-out third that the base passes. Without usable labels there are no rules and the base decides alone.

    Null and empty texts have no words and fail. Repeated rows and null doc_ids are rows as any other.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rules = quality_rules(docs, labels)
    rows = described(docs, "doc_id").withColumn("rule", first_rule(rules))
    return rows.select(
        "doc_id",
        *(F.col(name).cast("long").alias(name) for name in COUNTS),
        _base_failed().alias("base_failed"),
        (~_base_failed() & (F.col("rule") == 0)).alias("kept"),
        "rule",
    )


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judged` keeps, with all their columns. No shuffle: rows are judged where they are read."""
    rules = quality_rules(docs, labels)
    return described_documents(docs).withColumn("rule", first_rule(rules)).where(~_base_failed() & (F.col("rule") == 0)).select("doc.*")


def quality_rules(docs: DataFrame, labels: DataFrame) -> list[Rule]:
    """The decision list for `judged`."""
    features, quality = labelled_sample(docs, labels, "quality", SAMPLE)
    words, repeated = (features[:, NAMES.index(name)] for name in ("n_words", "n_repeat_words"))
    # What the base rejects needs no rule.
    passed = (words >= 10) & (100 * repeated <= 20 * words)
    return learned_rules(features[passed], quality[passed])
