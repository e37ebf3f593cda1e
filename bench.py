"""Headline queries, timed warm; prints one JSON line.

BENCH_SF_DIR  data folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query, the median counts (default 3)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from riskgrain.functions import flag  # noqa: E402
from riskgrain.operators.binning import bin_numeric, even_buckets, monotone_bins  # noqa: E402
from riskgrain.operators.calendar import daily_cumulative  # noqa: E402
from riskgrain.operators.evaluate import auc, evaluation, ks  # noqa: E402
from riskgrain.operators.keywords import keyword_iv  # noqa: E402
from riskgrain.operators.profile import box_summary, histograms  # noqa: E402
from riskgrain.operators.response import woe_table, with_ends  # noqa: E402
from riskgrain.operators.sampling import stratified_folds  # noqa: E402
from riskgrain.operators.streaks import streaks  # noqa: E402
from riskgrain.operators.tree import grow_tree  # noqa: E402
from riskgrain.session import build_session, release, table  # noqa: E402
from riskgrain.workloads.text import STUDY_WORDS  # noqa: E402


def returns(spark, sf):
    return table(spark, sf, "lineitem").withColumn("y", flag("l_returnflag", "R"))


def woe_10_bins(spark, sf):
    binned, edges = bin_numeric(returns(spark, sf), "l_extendedprice", 10, "even_depth", edge="inf")
    return with_ends(woe_table(binned, "y", "bin_id"), edges)


def ks_20(spark, sf):
    return ks(returns(spark, sf), "y", "l_extendedprice")


def auc_exact(spark, sf):
    return auc(returns(spark, sf), "y", "l_extendedprice")


def auc_and_ks(spark, sf):
    return evaluation(returns(spark, sf), "y", "l_extendedprice")


def tree_depth_3(spark, sf):
    features = ["l_quantity", "l_discount", "l_tax", "l_extendedprice"]
    return grow_tree(returns(spark, sf), features, "y", "iv", max_depth=3, min_split_size=0.01)


def daily(spark, sf):
    return daily_cumulative(table(spark, sf, "orders"), "o_orderdate")


def user_streaks(spark, sf):
    return streaks(table(spark, sf, "events"), "user_id", "ts", F.col("event_type").isin("view", "click"))


def keyword_iv_50(spark, sf):
    docs = table(spark, sf, "documents").withColumn("y", flag("lang", "fr"))
    return keyword_iv(docs, STUDY_WORDS, "y", text="text")


def ntile_10(spark, sf):
    orders = even_buckets(table(spark, sf, "orders"), "o_totalprice", "o_orderkey", 10)
    return orders.groupBy("bucket").agg(F.count("*").alias("n"))


def folds_10(spark, sf):
    folded = stratified_folds(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", 10)
    return folded.groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n"))


def monotone(spark, sf):
    return monotone_bins(returns(spark, sf), "l_extendedprice", "y")[1]


def boxes(spark, sf):
    return box_summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"], "l_returnflag")


def value_histograms(spark, sf):
    return histograms(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_extendedprice"])


HEADLINE = {
    f.__name__: f
    for f in (
        woe_10_bins, ks_20, auc_exact, auc_and_ks, tree_depth_3, daily, user_streaks, keyword_iv_50, ntile_10, folds_10,
        monotone, boxes, value_histograms,
    )
}


# as many rows as distinct values, which a user would write out and not collect
WRITTEN = {"value_histograms"}


def finish(df, name: str) -> None:
    if name in WRITTEN:
        df.write.format("noop").mode("overwrite").save()
    else:
        df.collect()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name, run in HEADLINE.items():
        finish(run(spark, sf), name)
        times = []
        for _ in range(runs):
            started = time.perf_counter()
            finish(run(spark, sf), name)
            times.append(time.perf_counter() - started)
        seconds[name] = round(statistics.median(times), 4)
    release(spark)
    print(json.dumps({
        "metric": "headline queries, sum of warm medians", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(sf)), "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
