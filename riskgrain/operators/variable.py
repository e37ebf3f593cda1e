"""One variable, or many at once, from breakpoints to evidence table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from .binning import assign_bins, bin_categorical
from .edges import Edges, breakpoints, explicit
from .response import bin_values, information_value, plot_series, pretty, with_ends, woe_table


class VariableAnalysis:
    """Binning and evidence of one variable against a response."""

    def __init__(self, df: DataFrame, var: str, kind: str = "n", label: str = "label", pos=1, neg=0, bad=1,
                 smoothing: str = "never"):
        if kind not in ("n", "numerical", "c", "categorical"):
            raise ValueError("kind must be numerical or categorical")
        self.df = df.select(var, label)
        self.var, self.label = var, label
        self.numeric = kind in ("n", "numerical")
        self.codes = {"pos": pos, "neg": neg, "bad": bad, "smoothing": smoothing}
        self.edges: Edges | None = None
        self.groups: Mapping[str, Sequence[str]] | None = None

    def find_breakpoints(self, method: str = "even_width", **options) -> Edges:
        """Search breakpoints of a numeric variable."""
        self.edges = breakpoints(self.df, self.var, self.label, method, **options)
        return self.edges

    def set_breakpoints(self, points: Sequence[float]) -> DataFrame:
        self.edges = explicit(points)
        return self.stats()

    def set_groups(self, groups: Mapping[str, Sequence[str]]) -> DataFrame:
        self.groups = groups
        return self.stats()

    def stats(self) -> DataFrame:
        """Evidence table, one row per bin."""
        if not self.numeric:
            binned = bin_categorical(self.df, self.var, self.groups)
            return woe_table(binned, self.label, "bin", kind="c", **self.codes)
        if self.edges is None:
            self.find_breakpoints()
        binned = assign_bins(self.df, self.var, self.edges)
        return with_ends(woe_table(binned, self.label, "bin_id", **self.codes), self.edges)

    def iv(self) -> DataFrame:
        return information_value(self.stats())

    def pretty(self) -> DataFrame:
        return pretty(self.stats())

    def plot_series(self) -> DataFrame:
        return plot_series(self.stats())


def analyse_features(
    df: DataFrame, edges: dict[str, Edges], label: str, *, pos=1, neg=0, bad=1, smoothing: str = "auto"
) -> DataFrame:
    """Evidence tables of many numeric features with one scan and one shuffle."""
    long = bin_values(df, edges, label)
    return woe_table(long, "y", "bin", pos=pos, neg=neg, bad=bad, smoothing=smoothing, by=["feature"])


def feature_iv(table: DataFrame) -> DataFrame:
    """Features by information value, largest first."""
    return information_value(table, ["feature"]).orderBy(F.col("iv_finite").desc(), "feature")
