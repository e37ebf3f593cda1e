"""Response tables: counts, rates, weight of evidence and information value per bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import MISSING, evidence, number, percent_text, ratio
from .edges import Edges

INF = float("inf")
LOWEST_SORT = -9999999.0  # sort position of a group whose WOE is -inf
# Headers and their columns: fixed display names.
PRETTY_NAMES = {
    "count": "Count", "tot_distr": "Total Distr", "negative": "Goods", "neg_distr": "Distr Goods",
    "positive": "Bads", "pos_distr": "Distr Bad", "bad_rate": "Bad Rate", "woe": "WOE", "iv": "IV",
}
# Display names of a grouped response table: fixed texts.
GROUP_NAMES = {"sum": "总人数", "p": "坏客户", "n": "好客户", "pr": "坏账率", "nr": "好账率", "overall_pr": "总坏账率"}
SMOOTHING = ("auto", "always", "never")


def with_totals(
    groups: DataFrame, totals: dict[str, Column], by: Sequence[str] = (), few: bool = False
) -> DataFrame:
    """Attach aggregates of ``groups`` to each of its rows.

    ``few`` says that each ``by`` value has few groups, as numeric bins are: a
    window over them is enough.  Otherwise the totals are a scalar subquery over
    the already grouped rows, or joined on ``by``; the exchange below is shared.
    """
    if few:
        whole = W.partitionBy(*by)
        return groups.select("*", *[c.over(whole).alias(n) for n, c in totals.items()])
    if not by:
        pack = F.struct(*[c.alias(n) for n, c in totals.items()]).alias("t")
        packed = groups.select("*", groups.agg(pack).scalar().alias("_t"))
        return packed.select(*groups.columns, *[F.col(f"_t.{n}").alias(n) for n in totals])
    sums = groups.groupBy(*by).agg(*[c.alias(n) for n, c in totals.items()])
    return groups.join(sums, list(by))


def _with_evidence(groups: DataFrame, smoothing: str) -> DataFrame:
    if smoothing == "always":
        add = F.lit(1)
    elif smoothing == "never":
        add = F.lit(0)
    elif smoothing == "auto":
        add = F.when(F.col("_single"), F.lit(1)).otherwise(F.lit(0))
    else:
        raise ValueError(f"smoothing must be one of {SMOOTHING}")
    woe, iv = evidence(
        F.col("positive") + add, F.col("negative") + add, F.col("tot_positive"), F.col("tot_negative")
    )
    return groups.select(
        "*",
        ratio(F.col("count"), F.col("tot_positive") + F.col("tot_negative")).alias("tot_distr"),
        ratio(F.col("positive"), F.col("tot_positive")).alias("pos_distr"),
        ratio(F.col("negative"), F.col("tot_negative")).alias("neg_distr"),
        ratio(F.col("_bad"), F.col("count")).alias("bad_rate"),
        woe.alias("woe"),
        iv.alias("iv"),
    )


def _counters(label: str, pos, neg, bad) -> list[Column]:
    y = F.col(label)
    nothing = F.count(y) == 0
    one_kind = (F.count(y) == F.count("*")) & (F.min(y) == F.max(y))
    return [
        F.count("*").alias("count"),
        F.count_if(y == F.lit(pos)).alias("positive"),
        F.count_if(y == F.lit(neg)).alias("negative"),
        F.count_if(y == F.lit(bad)).alias("_bad"),
        F.coalesce(nothing | one_kind, F.lit(False)).alias("_single"),
    ]


def woe_table(
    df: DataFrame,
    label: str,
    bin_col: str,
    *,
    kind: str = "n",
    pos=1,
    neg=0,
    bad=1,
    smoothing: str = "auto",
    by: Sequence[str] = (),
    ordered: bool = True,
) -> DataFrame:
    """Evidence table with one row per bin.

    ``kind='n'`` takes integer bins with -1 or null as missing and orders by
    them; ``kind='c'`` takes text bins, missing first, then by WOE.  The totals
    are positives plus negatives, while a bin's count includes other labels.
    ``iv_total`` is infinite once a bin has a single class; ``iv_finite`` sums
    the finite parts.
    """
    if kind in ("n", "numerical"):
        group = F.coalesce(F.col(bin_col).cast("int"), F.lit(-1))
    elif kind in ("c", "categorical"):
        group = F.coalesce(F.col(bin_col).cast("string"), F.lit(MISSING))
    else:
        raise ValueError("kind must be numerical or categorical")
    by = list(by)
    groups = df.groupBy(*by, group.alias("bin")).agg(*_counters(label, pos, neg, bad))
    totals = {"tot_positive": F.sum("positive"), "tot_negative": F.sum("negative")}
    few = kind in ("n", "numerical")
    scored = _with_evidence(with_totals(groups, totals, by, few), smoothing)
    finite = F.sum(F.when(F.col("iv") < INF, F.col("iv")).otherwise(F.lit(0.0)))
    result = with_totals(scored, {"iv_total": F.sum("iv"), "iv_finite": finite}, by, few)
    columns = [
        *by, "bin", "count", "tot_distr", "negative", "neg_distr", "positive", "pos_distr",
        "bad_rate", "woe", "iv", "iv_total", "iv_finite",
    ]
    if not ordered:
        return result.select(*columns)
    if kind in ("n", "numerical"):
        return result.orderBy(*by, "bin").select(*columns)
    place = F.when(F.col("bin") == MISSING, F.lit(-INF)).when(F.col("woe") == -INF, F.lit(LOWEST_SORT)).otherwise(F.col("woe"))
    return result.orderBy(*by, place, "bin").select(*columns)


def information_value(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The IV of an evidence table as its own frame."""
    return table.groupBy(*by).agg(F.max("iv_total").alias("iv_total"), F.max("iv_finite").alias("iv_finite"))


def group_woe(
    df: DataFrame, label: str, tot_pos: int, tot_neg: int, *, pos=1, neg=0, bad=1, smoothing: str = "auto",
    by: Sequence[str] = (),
) -> DataFrame:
    """Evidence of a group against given totals; one row, or one per ``by``."""
    groups = df.groupBy(*by).agg(*_counters(label, pos, neg, bad))
    groups = groups.withColumns({"tot_positive": F.lit(tot_pos), "tot_negative": F.lit(tot_neg)})
    return _with_evidence(groups, smoothing).select(
        *by, "count", "tot_distr", "positive", "pos_distr", "negative", "neg_distr", "bad_rate", "woe", "iv"
    )


def with_ends(table: DataFrame, edges: Edges, bin_col: str = "bin") -> DataFrame:
    """Add the numeric ends of each bin, looked up after aggregation."""
    lo, hi = edges.ends_of(F.col(bin_col))
    return table.withColumns({"lo": lo, "hi": hi})


def with_empty_bins(table: DataFrame, edges: Edges) -> DataFrame:
    """Add a zero row with null rates for each bin that no row fell into."""
    frame = edges.frame(table).select(F.col("bin_id").alias("bin"))
    return (
        frame.join(table, "bin", "full_outer")
        .fillna(0, ["count", "positive", "negative"])
        .select(*table.columns)
        .orderBy("bin")
    )


def pretty(table: DataFrame) -> DataFrame:
    """Display form: percentages as text, WOE times 100, headers in words."""
    percents = ["tot_distr", "neg_distr", "pos_distr", "bad_rate"]
    shown = table.withColumns(
        {c: percent_text(F.col(c)) for c in percents} | {"woe": F.round(F.col("woe") * 100, 3)}
    )
    name = F.col("bin").cast("string")
    shown = shown.withColumn("bin", F.when(name.isin(MISSING, "-1"), F.lit("Missing")).otherwise(name))
    return shown.withColumnsRenamed(PRETTY_NAMES)


def plot_series(table: DataFrame) -> DataFrame:
    """The series a WOE chart shows."""
    return table.select(
        "bin", (F.col("woe") * 100).alias("woe_pct"), (F.col("bad_rate") * 100).alias("bad_rate_pct"), "count"
    )


def smoothed_woe(
    df: DataFrame, response: str, bin_col: str, smooth: float = 1.0, null_name: str = "nan", by: Sequence[str] = ()
) -> DataFrame:
    """WOE and IV with ``smooth`` added to each count and twice to the totals.

    Rows without a response are dropped; a null bin counts as a bin of its own.
    ``response`` is boolean or 0/1.
    """
    by = list(by)
    y = F.col(response).cast("int")
    name = F.coalesce(F.col(bin_col).cast("string"), F.lit(null_name))
    groups = (
        df.where(y.isNotNull())
        .groupBy(*by, name.alias("bin"))
        .agg(F.sum(y).alias("positive"), F.sum(1 - y).alias("negative"))
    )
    return smoothed_groups(groups, smooth, by)


def smoothed_groups(groups: DataFrame, smooth: float = 1.0, by: Sequence[str] = (), few: bool = False) -> DataFrame:
    """The same from counts ``positive`` and ``negative`` per bin."""
    joined = with_totals(groups, {"_tp": F.sum("positive"), "_tn": F.sum("negative")}, by, few)
    woe, iv = evidence(
        F.col("positive") + F.lit(smooth), F.col("negative") + F.lit(smooth),
        F.col("_tp") + F.lit(2.0 * smooth), F.col("_tn") + F.lit(2.0 * smooth),
    )
    scored = joined.select(*groups.columns, woe.alias("woe"), iv.alias("iv"))
    return with_totals(scored, {"iv_total": F.sum("iv")}, by, few)


def iv_from_groups(
    groups: DataFrame, p: str = "p", n: str = "n", smooth: bool = True, by: Sequence[str] = ()
) -> DataFrame:
    """IV of an already grouped table; smoothing adds 1 per bin to counts and totals."""
    add = 1 if smooth else 0
    counts = groups.select(*by, (F.col(p) + add).alias("_p"), (F.col(n) + add).alias("_n"))
    joined = with_totals(counts, {"_tp": F.sum("_p"), "_tn": F.sum("_n")}, by)
    _, iv = evidence(F.col("_p"), F.col("_n"), F.col("_tp"), F.col("_tn"))
    return joined.select(*by, iv.alias("_iv")).groupBy(*by).agg(F.sum("_iv").alias("iv"))


def _rates(groups: DataFrame, by: Sequence[str], few: bool = False) -> DataFrame:
    joined = with_totals(groups, {"_p": F.sum("p"), "_s": F.sum("sum")}, by, few)
    return joined.withColumns(
        {
            "pr": ratio(F.col("p"), F.col("sum")),
            "nr": ratio(F.col("n"), F.col("sum")),
            "overall_pr": ratio(F.col("_p"), F.col("_s")),
        }
    ).drop("_p", "_s")


def interval_response(df: DataFrame, y: str, edges: Edges, bin_col: str = "bin_id") -> DataFrame:
    """Counts and rates per interval, ordered by lower end with missing first."""
    groups = df.groupBy(F.col(bin_col).alias("bin")).agg(
        F.count("*").alias("sum"), F.sum(y).alias("p"), F.sum(1 - F.col(y)).alias("n")
    )
    lo, hi = edges.ends_of(F.col("bin"))
    table = _rates(groups, (), few=True).withColumns({"min": lo, "max": hi})
    return table.select("bin", "min", "max", "sum", "p", "n", "pr", "nr", "overall_pr").orderBy(
        F.col("min").asc_nulls_first()
    )


def category_response(
    df: DataFrame, category: str, label: str, missing: str = MISSING, by: Sequence[str] = ()
) -> DataFrame:
    """Counts and rates per category: missing first, then by rate."""
    name = F.coalesce(F.col(category).cast("string"), F.lit(missing))
    groups = df.groupBy(*by, name.alias("category")).agg(
        F.count("*").alias("sum"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")
    )
    table = _rates(groups, by).select(*by, "category", "sum", "p", "n", "pr", "nr", "overall_pr")
    return table.orderBy(*by, (F.col("category") == missing).desc(), "pr", "category")


def category_profiles(df: DataFrame, features: Sequence[str], label: str, missing: str = MISSING) -> DataFrame:
    """Response table of several categorical features from one shuffle."""
    names = [F.coalesce(F.col(f).cast("string"), F.lit(missing)).alias(f) for f in features]
    rows = df.select(F.col(label).alias("_y"), *names).unpivot("_y", list(features), "feature", "value")
    return category_response(rows, "value", "_y", missing, by=["feature"])


def display_names(table: DataFrame) -> DataFrame:
    """Rename a grouped response table to its display headers."""
    return table.withColumnsRenamed(GROUP_NAMES)


def class_measures(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Entropy in nats and Gini impurity of a column's values, nulls dropped."""
    by = list(by)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("k"))
    joined = with_totals(sizes, {"total": F.sum("k")}, by)
    p = F.col("k") / F.col("total")
    return joined.groupBy(*by).agg(F.sum(-p * F.ln(p)).alias("entropy"), F.sum(p * (1 - p)).alias("gini"))


def bin_values(df: DataFrame, edges: dict[str, Edges], label: str) -> DataFrame:
    """Long form ``(feature, bin, y)`` of several numeric features, binned before it is unpivoted."""
    binned = df.select(F.col(label).alias("y"), *[e.bin_of(number(f)).alias(f) for f, e in edges.items()])
    return binned.unpivot("y", list(edges), "feature", "bin")
