"""Class scores: softmax, argmax and the prediction record.

The functions on arrays suit one row per text. For many rows per text there is
the same arithmetic over one column per class, as SQL text: it compiles into
the surrounding stage, where array functions with lambdas are interpreted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(scores: Column) -> Column:
    """Softmax over an array of doubles, shifted by its maximum so exp cannot overflow."""
    weights = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
    return F.transform(weights, lambda w: w / total)


def argmax(scores: Column) -> Column:
    """0-based index of the largest score; the lowest index wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def score_map(probabilities: Column, labels: Sequence[str]) -> Column:
    """Label -> probability, rounded to four places."""
    names = F.array(*(F.lit(label) for label in labels))
    return F.map_from_arrays(names, F.transform(probabilities, lambda p: F.round(p, 4)))


def argmax_sql(scores: Sequence[str]) -> str:
    """Like ``argmax``, over one column per class."""
    best = f"greatest({', '.join(scores)})"
    cases = " ".join(f"WHEN {score} = {best} THEN {i}" for i, score in enumerate(scores))
    return f"CASE {cases} END"


def confidence_sql(scores: Sequence[str]) -> str:
    """Softmax share of the largest score, over one column per class."""
    best = f"greatest({', '.join(scores)})"
    return "1D / (" + " + ".join(f"exp({score} - {best})" for score in scores) + ")"
