"""Small array expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

IGNORE = -100  # fixed value: label that no metric and no loss counts


def argmax(logits: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def fsum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def logsumexp(logits: Column) -> Column:
    top = F.array_max(logits)
    return top + F.log(fsum(F.transform(logits, lambda x: F.exp(x - top))))


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log-likelihood of one 0-based class; null for the ignore label."""
    return F.when(label != IGNORE, logsumexp(logits) - F.get(logits, label))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``.

    A column named inside a lambda is computed again for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
