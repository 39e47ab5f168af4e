"""Whole scorings: the tables that a run's records come to, each a composition of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armwise.functions.stats import jaccard, retention
from armwise.functions.text import canonical_gold, mapped_labels
from armwise.operators import metrics as M
from armwise.operators import resample as R
from armwise.operators.pairing import keep_last, paired_with_reference


def score_labels(records: DataFrame, labels: DataFrame, entity: str = "example_id", arm: str = "condition", raw: str = "raw", gold: str = "gold", seq: str = "seq") -> DataFrame:
    """Closed-vocabulary answers of every arm: n, unmapped, correct, accuracies. The last record of an (example, arm) counts."""
    last = keep_last(records, [entity, arm], [seq]).withColumn("_key", F.concat_ws("::", entity, arm))
    pred = mapped_labels(last, labels, "_key", F.col(raw))
    return M.label_accuracy(last.join(pred, "_key").withColumn("gold", canonical_gold(F.col(gold))), arm=arm)


def score_terms(records: DataFrame, entity: str, arm: str, reference: str, terms: str, n_draws: int = 200) -> DataFrame:
    """Term sets of each arm against the reference arm: change counts, and mean Jaccard with a bootstrap interval over entities."""
    pairs = paired_with_reference(records, entity, arm, reference, [terms])
    change = M.set_change(pairs, [arm], f"ref_{terms}", terms)
    rows = pairs.select(arm, entity, jaccard(F.col(f"ref_{terms}"), F.col(terms)).alias("_j"), retention(F.col(f"ref_{terms}"), F.col(terms)).alias("_k"))
    ci = R.interval(R.bootstrap_mean(rows, [arm], "_j", [entity], n_draws), [arm], "mean", n_draws)
    kept = rows.groupBy(arm).agg(F.avg("_k").alias("mean_retention"))
    return change.join(ci, arm).join(kept, arm)


def score_changes(answers: DataFrame, entity: str, arm: str, reference: str, pred: str, gold: str, cluster: str, n_draws: int = 200) -> DataFrame:
    """Answer changes of each arm: transitions with Wilson bounds, and a cluster bootstrap of the change rate."""
    pairs = paired_with_reference(answers, entity, arm, reference, [pred, gold, cluster])
    moved = M.transitions(pairs, [arm], f"ref_{pred}", pred, gold)
    hits = pairs.select(arm, cluster, (~F.col(pred).eqNullSafe(F.col(f"ref_{pred}"))).alias("_h"))
    return moved.join(R.interval(R.cluster_bootstrap(hits, [arm], cluster, "_h", n_draws), [arm], "rate", n_draws), arm)


def score_conflicts(pairs: DataFrame, by: Sequence[str], pred: str, text_answer: str, input_answer: str, gate: str) -> DataFrame:
    """Conflicts between text and input that pass the gate (a null gate does not): whom the answers follow."""
    return M.donor_following(pairs.where(F.coalesce(gate, F.lit(False))), by, pred, text_answer, input_answer)


def follow_class(margin: str, eps: float = 0.0, strict: bool = True):
    """input, text or ambiguous by the sign of a margin. strict: beyond eps either way; else |margin| < eps is ambiguous and 0 is text."""
    m = F.col(margin)
    if strict:
        return F.when(m > eps, "input").when(m < -eps, "text").otherwise("ambiguous")
    return F.when(F.abs(m) < eps, "ambiguous").when(m > 0, "input").otherwise("text")
