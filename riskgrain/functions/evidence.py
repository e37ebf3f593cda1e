"""Expressions for weight of evidence, information value and impurity."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .columns import ratio

INF = float("inf")


def evidence(pos: Column, neg: Column, tot_pos: Column, tot_neg: Column) -> tuple[Column, Column]:
    """``(woe, iv)`` of a group from its counts and the overall totals.

    No negatives gives +inf, no positives -inf, and either gives iv = +inf.
    """
    pd = ratio(pos, tot_pos)
    nd = ratio(neg, tot_neg)
    mixed = (pos > 0) & (neg > 0)
    log_odds = F.ln(F.when(mixed, ratio(pd, nd)))
    woe = F.when(neg == 0, F.lit(INF)).when(pos == 0, F.lit(-INF)).otherwise(log_odds)
    iv = F.when(mixed, (pd - nd) * log_odds).otherwise(F.lit(INF))
    return woe, iv


def entropy2(pos: Column, neg: Column) -> Column:
    """Two-class entropy in nats."""
    n = pos + neg

    def term(k: Column) -> Column:
        p = ratio(k, n)
        return F.when(k > 0, -p * F.ln(F.when(k > 0, p))).otherwise(F.lit(0.0))

    return term(pos) + term(neg)


def gini2(pos: Column, neg: Column) -> Column:
    """Two-class Gini impurity."""
    n = pos + neg
    p = ratio(pos, n)
    q = ratio(neg, n)
    return p * (1 - p) + q * (1 - q)
