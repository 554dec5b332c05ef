"""Operator 6, quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document's statistics. Expectation-maximisation over the vote patterns
estimates how good and bad documents vote under each rule, and the posterior probability of quality decides instead of an
all-must-pass filter. Only counts of patterns reach the driver: at most 3 ** rules rows, whatever the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.llm.stats import document_stats
from lettermill.staging import staged


@dataclass(frozen=True)
class Rule:
    """Votes good where ``value <= good`` and bad where ``value > bad`` (the other way round if ``high_is_good``)."""

    name: str
    value: Column
    good: float
    bad: float
    high_is_good: bool = False

    def vote(self) -> Column:
        v = self.value
        yes, no = (v >= self.good, v < self.bad) if self.high_is_good else (v <= self.good, v > self.bad)
        return F.when(yes, 1).when(no, -1).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def default_rules() -> list[Rule]:
    return [
        Rule("symbols", _share("n_symbols", "n_words"), 0.02, 0.1),
        Rule("repeat_words", _share("n_repeat_words", "n_words"), 0.1, 0.3),
        Rule("dup_lines", _share("n_dup_lines", "n_lines"), 0.1, 0.3),
        Rule("upper_case", _share("n_upper", "n_letters"), 0.1, 0.4),
        Rule("letters", _share("n_letters", "word_chars"), 0.9, 0.75, high_is_good=True),
        Rule("exclaims", _share("n_exclaims", "n_words"), 0.05, 0.3),
        Rule("word_length", F.abs(_share("word_chars", "n_words") - 6), 3.0, 6.0),
        Rule("pipes", _share("n_pipes", "n_words"), 0.01, 0.1),
    ]


@dataclass(frozen=True)
class VoteModel:
    """Log odds of good against bad: of the prior, and of each rule's votes (bad, abstained, good)."""

    prior: float
    votes: list[list[float]]

    def posterior(self, columns: list[str]) -> Column:
        odds = F.lit(self.prior)
        for c, (bad, none, good) in zip(columns, self.votes):
            odds = odds + F.when(F.col(c) == 1, good).when(F.col(c) == -1, bad).otherwise(none)
        return 1 / (1 + F.exp(-odds))


def fit_votes(patterns: np.ndarray, counts: np.ndarray, *, prior: float = 0.85, weight: float = 20.0, rounds: int = 200) -> VoteModel:
    """EM for two classes with a vote distribution a rule and class.

    ``weight`` pseudo-documents a class hold each rule to its direction (bad documents are voted bad more often), so the classes
    cannot change places; with no documents the model is that prior.
    """
    n_rules = patterns.shape[1]
    start = np.log(np.array([[0.4, 0.2, 0.4], [0.02, 0.13, 0.85]]))  # votes bad, none, good of bad and good documents
    theta = np.repeat(start[:, None, :], n_rules, axis=1)
    share = prior
    hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=-1).astype(float)
    for _ in range(rounds if len(counts) else 0):
        odds = np.log(share / (1 - share)) + np.einsum("prv,rv->p", hot, theta[1] - theta[0])
        good = 1 / (1 + np.exp(-odds))
        held = np.stack([counts * (1 - good), counts * good])
        share = float(np.clip((held[1].sum() + prior * weight) / (counts.sum() + weight), 0.02, 0.98))
        seen = np.einsum("cp,prv->crv", held, hot) + weight * np.exp(start)[:, None, :]
        new = np.log(seen / seen.sum(axis=2, keepdims=True))
        if np.abs(new - theta).max() < 1e-9:
            break
        theta = new
    return VoteModel(float(np.log(share / (1 - share))), (theta[1] - theta[0]).tolist())


def quality_rules(docs: DataFrame, *, rules: list[Rule] | None = None, min_words: int = 50, max_repeat_percent: int = 50, threshold: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, quality (posterior probability), kept; a row for each row.

    ``base_failed`` documents (too few words, or too large a share of repeated words) are never kept; the others are where the
    posterior reaches ``threshold``. A null text counts as empty and fails the base. Null and repeated doc_ids each give a
    row; a repeated row votes as often as it occurs. Only doc_id and text are read. No rows give no rows.
    """
    rules = rules or default_rules()
    names = [f"vote_{r.name}" for r in rules]
    stats = staged(document_stats(docs), "stats")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    voted = stats.withColumns({n: r.vote() for n, r in zip(names, rules)} | {"base_failed": failed})
    rows = voted.filter("n_words > 0").groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** rules rows
    patterns = np.array([[r[n] for n in names] for r in rows]).reshape(len(rows), len(names))
    model = fit_votes(patterns, np.array([r["n"] for r in rows], float))
    scored = voted.withColumn("quality", model.posterior(names))
    kept = ~F.col("base_failed") & (F.col("quality") >= threshold)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", kept.alias("kept"))
