"""Quality rules by cross-document line frequency, with DataFrame functions only.

Every non-blank line is normalised (white space stripped and collapsed, A-Z lower-cased)
and hashed; the distinct documents of its host that hold it are counted.  Lines on more than
``max_docs`` documents and more than ``max_share`` of the host's documents are boilerplate.  A
document is rejected if it fails a base rule (fewer than ten words, or more than a
fifth of its words in repeated five-word windows) or if, without boilerplate lines,
less than ``min_left`` of its words or fewer than ten words are left.

A share alone would loosen with the host: where 1 % of a host is more than ``always`` documents, a line on more than
``always`` of them is boilerplate too.

Defined cases: a null text has no words and is rejected; a null host is a host of its own; every row is a document
of its own, also where ids are missing or shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialise
from .line_dedup import ascii_lower, bound

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
ALWAYS = 1_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Words inside ``n``-word windows found twice or more, the first included.

    Windows are hashed; only texts with an equal pair sort theirs.  Starts of
    repeated windows, in order, cover ``min(n, distance to the next)`` words each.
    """
    def grams(w):
        return F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda k: F.xxhash64(
            *[F.get(w, k + (d - 1)) for d in range(n)]))

    def covered(sorted_):
        def same(x, k):
            return F.coalesce(F.get(sorted_, k)["h"] == x["h"], F.lit(False))

        again = F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return bound(F.sort_array(F.transform(again, lambda x: x["i"])), lambda starts: F.aggregate(
            F.transform(starts, lambda s, k: F.least(F.lit(n), F.coalesce(F.get(starts, k + 1) - s, F.lit(n)))),
            F.lit(0), lambda a, b: a + b))

    def count(g):
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(
            bound(F.sort_array(F.transform(g, lambda h, k: F.struct(h.alias("h"), k.alias("i")))), covered))

    return F.when(F.size(words) < n + 1, F.lit(0)).otherwise(bound(grams(words), count))


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def base_rules(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)``, one row per row."""
    return _rules(docs.select(F.col(id).alias("_id"), F.col(text).alias("_text"))).withColumnRenamed("_id", id)


def _rules(texts: DataFrame) -> DataFrame:
    """The columns of ``texts`` but ``_text``, with the base rules."""
    whole = F.coalesce(F.col("_text"), F.lit(""))
    counted = texts.withColumn("_words", words_of(F.col("_text"))).select(
        *[c for c in texts.columns if c != "_text"], F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length(whole) - F.length(F.regexp_replace(whole, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        bound(_lines(F.col("_text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_words")).cast("long").alias("n_repeat_words"))
    return counted.withColumn("base_failed", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words"))


def _frequent(rows: DataFrame, max_docs: int, max_share: float, always: int) -> DataFrame:
    """``(host, line)`` of rows ``(host, lines)``."""
    hosts = rows.groupBy("host").agg(F.count("*").alias("docs"))
    counts = rows.select("host", F.explode(F.array_distinct("lines.line")).alias("line")).groupBy("host", "line").agg(
        F.count("*").alias("n")).where(F.col("n") > max_docs)
    joined = counts.alias("c").join(hosts.alias("h"), F.expr("c.host <=> h.host"))
    return joined.where((F.col("n") > max_share * F.col("docs")) | (F.col("n") > always)).select("c.host", "line")


def frequent_lines(
    docs: DataFrame, text: str = "text", host: str = "source", max_docs: int = 10, max_share: float = 0.01,
    always: int = ALWAYS,
) -> DataFrame:
    """``(host, line)``: hashes of the boilerplate lines."""
    return _frequent(docs.select(F.col(host).alias("host"), _hashed_lines(F.col(text)).alias("lines")), max_docs, max_share, always)


def _hashed_lines(text: Column) -> Column:
    """``(line, n)``: hash and words of each line."""
    return F.transform(_lines(text), lambda line: bound(words_of(line), lambda words: F.struct(
        F.xxhash64(ascii_lower(F.array_join(words, " "))).alias("line"), F.size(words).alias("n"))))


def quality_rules(
    docs: DataFrame, id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 10, max_share: float = 0.01,
    min_left: float = 0.3, always: int = ALWAYS,
) -> DataFrame:
    """Base rules with ``n_lost`` (words of boilerplate lines) and ``kept``, one row per row."""
    # each text is split and hashed once; the rows get numbers that last, as ids may be missing or shared
    rows = materialise(_rules(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("_id"), F.col(host).alias("host"),
        _hashed_lines(F.col(text)).alias("lines"), F.col(text).alias("_text"))), "lines")
    frequent = _frequent(rows, max_docs, max_share, always).alias("f")
    lines = rows.select("row", "host", F.inline("lines")).alias("l")
    lost = lines.join(frequent, F.expr("l.line = f.line AND l.host <=> f.host")).groupBy("row").agg(F.sum("n").alias("n_lost"))
    joined = rows.drop("host", "lines").join(lost, "row", "left").withColumn("n_lost", F.coalesce("n_lost", F.lit(0)))
    left = F.col("n_words") - F.col("n_lost")
    return joined.withColumn("kept", ~F.col("base_failed") & (left >= 10) & (left >= min_left * F.col("n_words"))).drop(
        "row").withColumnRenamed("_id", id)
