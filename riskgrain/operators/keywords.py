"""Keyword presence and its relation to a response.

Statistics need only the pairs that are present: what is absent follows from the
totals.  Texts are matched as they are read and only hits leave the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import ratio
from ..session import literal
from .components import component_variance
from .keyword_index import present_words, word_counts
from .response import smoothed_groups

#: Up to so many words a text is searched for each; more are looked up in an index.
FEW_WORDS = 100
#: Up to so many columns the covariance matrix is formed.
FEW_COLUMNS = 256


def _column_names(words: Sequence[str], prefix: str) -> list[str]:
    return [f"{prefix}{w}" for w in words]


def presence_matrix(
    df: DataFrame, key: str, text: str, words: Sequence[str], prefix: str = "", label: str | None = None
) -> DataFrame:
    """Key, one 0/1 column per word (substring match), and the label last."""
    t = F.coalesce(F.col(text), F.lit(""))
    hits = [F.contains(t, F.lit(w)).cast("int").alias(c) for w, c in zip(words, _column_names(words, prefix))]
    return df.select(key, *hits, *([label] if label else []))


def join_response(matrix: DataFrame, response: DataFrame, key: str) -> DataFrame:
    """Attach the response by key; rows without one keep null."""
    return matrix.join(response, key, "left")


def matrix_to_pairs(df: DataFrame, words: Sequence[str], keep: Sequence[str] = (), prefix: str = "") -> DataFrame:
    """Only the present (row, word) pairs of a 0/1 matrix, with the kept columns."""
    present = F.array_compact(
        F.array(*[F.when(F.col(f"`{c}`") == 1, F.lit(w)) for w, c in zip(words, _column_names(words, prefix))])
    )
    return df.select(*keep, F.explode(present).alias("keyword"))


def text_to_pairs(df: DataFrame, text: str, words: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The present (row, word) pairs of a text column."""
    if len(words) > FEW_WORDS:
        listed = literal(df.sparkSession, list(enumerate(words)), "_word int, keyword string")
        found = present_words(df, text, words, keep, out="_present").select(*keep, F.explode("_present").alias("_word"))
        return found.join(listed, "_word").select(*keep, "keyword")
    present = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(text), w))
    return df.select(*keep, F.explode(present).alias("keyword"))


def presence_lists(df: DataFrame, key: str, text: str, words: Sequence[str], label: str | None = None) -> DataFrame:
    """Key, label and ``present``, the positions in ``words`` of those in the text: the matrix row by row, for any number of words."""
    return present_words(df, text, words, [key, *([label] if label else [])])


def _word_list(df: DataFrame, words: Sequence[str]) -> DataFrame:
    return literal(df.sparkSession, [(w, i) for i, w in enumerate(words)], "keyword string, position int")


def _present_counts(
    pairs: DataFrame, rows: DataFrame, words: Sequence[str], y: str, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Per word: rows and positives with it, and the same for the whole table."""
    extra = extra or {}
    counts = pairs.groupBy("keyword").agg(
        F.count("*").alias("present"), F.sum(y).alias("present_pos"), *[c.alias(n) for n, c in extra.items()]
    )
    whole = rows.agg(
        F.struct(F.count("*").alias("rows"), F.coalesce(F.sum(y), F.lit(0)).alias("pos")).alias("t")
    ).scalar()
    fill = {c: F.coalesce(c, F.lit(0)) for c in ("present", "present_pos", *extra)}
    # the word list comes with the call; the result has one row per word
    return _word_list(rows, words).join(counts, "keyword", "left").withColumns(fill).withColumn("t", whole)


def keyword_appearance(
    df: DataFrame, fields: Sequence[str], words: Sequence[str], label: str = "label", prefix: str = "", text: str | None = None,
) -> DataFrame:
    """Per keyword: response rate when present and when absent, and hits per text field.

    ``df`` holds the 0/1 column of each word, or the words are looked up in ``text``
    when given.  A field counts the rows where the word is marked present and also
    occurs in the field's text.  A rate without rows is null.
    """
    if text is not None:
        return _appearance_in_text(df, fields, words, label, text)
    bad = F.coalesce(F.col(label) == 1, F.lit(False)).cast("int")
    entries = F.array_compact(
        F.array(
            *[
                F.when(
                    F.coalesce(F.col(f"`{c}`") != 0, F.lit(True)),
                    F.struct(
                        F.lit(w).alias("keyword"),
                        F.coalesce(F.col(f"`{c}`") == 1, F.lit(False)).alias("has"),
                        *[F.coalesce(F.contains(F.col(f), F.lit(w)), F.lit(False)).alias(f) for f in fields],
                    ),
                )
                for w, c in zip(words, _column_names(words, prefix))
            ]
        )
    )
    rows = df.withColumn("_bad", bad)
    pairs = rows.select("_bad", F.explode(entries).alias("e")).select("_bad", "e.*")
    hits = {
        "_has": F.count_if("has"), "_has_bad": F.sum(F.when(F.col("has"), F.col("_bad"))),
        **{f: F.count_if(F.col("has") & F.col(f)) for f in fields},
    }
    return _appearance(_present_counts(pairs, rows, words, "_bad", hits), fields)


def _appearance_in_text(df: DataFrame, fields: Sequence[str], words: Sequence[str], label: str, text: str) -> DataFrame:
    rows = df.withColumn("_bad", F.coalesce(F.col(label) == 1, F.lit(False)).cast("int"))
    counts = word_counts(rows, text, fields, "_bad", words).withColumnsRenamed(
        {"marked": "present_pos", **{f"f{k}": f for k, f in enumerate(fields)}})
    whole = rows.agg(F.struct(F.count("*").alias("rows"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("pos")).alias("t")).scalar()
    fill = {c: F.coalesce(c, F.lit(0)) for c in ("present", "present_pos", *fields)}
    listed = _word_list(rows, words).join(counts, "position", "left").withColumns(fill).withColumn("t", whole)
    return _appearance(listed.withColumns({"_has": F.col("present"), "_has_bad": F.col("present_pos")}), fields)


def _appearance(counts: DataFrame, fields: Sequence[str]) -> DataFrame:
    lacks = F.col("t.rows") - F.col("present")
    return counts.select(
        "position", "keyword",
        ratio(F.col("_has_bad"), F.col("_has")).alias("present_bad_rate"),
        ratio(F.col("t.pos") - F.col("present_pos"), lacks).alias("absent_bad_rate"),
        *fields,
    ).orderBy("position")


def _iv_per_word(counts: DataFrame, smooth: float) -> DataFrame:
    present = F.struct(
        F.lit("1").alias("bin"), F.col("present_pos").alias("positive"),
        (F.col("present") - F.col("present_pos")).alias("negative"),
    )
    absent = F.struct(
        F.lit("0").alias("bin"), (F.col("t.pos") - F.col("present_pos")).alias("positive"),
        (F.col("t.rows") - F.col("present") - F.col("t.pos") + F.col("present_pos")).alias("negative"),
    )
    bins = counts.select("position", "keyword", F.explode(F.array(present, absent)).alias("b")).select(
        "position", "keyword", "b.*"
    )
    # a bin that no row falls into is not part of the table
    bins = bins.where("positive + negative > 0")
    table = smoothed_groups(bins, smooth, by=["position", "keyword"], few=True)
    return table.groupBy("position", "keyword").agg(F.max("iv_total").alias("iv")).orderBy("position")


def keyword_iv(
    df: DataFrame, words: Sequence[str], response: str, text: str | None = None, prefix: str = "", smooth: float = 1.0
) -> DataFrame:
    """Smoothed information value of every keyword's presence, in one job.

    Reads the 0/1 columns of the words, or matches ``text`` directly when given.
    Rows without a response are dropped.
    """
    rows = df.where(F.col(response).isNotNull()).withColumn("_y", F.col(response).cast("int"))
    if text is None:
        pairs = matrix_to_pairs(rows, words, ["_y"], prefix)
    else:
        pairs = text_to_pairs(rows, text, words, ["_y"])
    return _iv_per_word(_present_counts(pairs, rows, words, "_y"), smooth)


def principal_variance(df: DataFrame, columns: Sequence[str] | str, k: int) -> DataFrame:
    """Explained-variance ratio per principal component.

    ``columns`` is a list of numeric columns or one array column.  Many columns
    are taken without their covariance matrix, see ``components``.
    """
    if not isinstance(columns, str) and len(columns) > FEW_COLUMNS:
        rows = df.select(F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("x"))
        return component_variance(rows, "x", k)
    if isinstance(columns, str):
        from pyspark.ml.functions import array_to_vector

        vectors = df.select(array_to_vector(F.col(columns).cast("array<double>")).alias("x"))
    else:
        vectors = VectorAssembler(inputCols=list(columns), outputCol="x").transform(df).select("x")
    model = PCA(k=k, inputCol="x", outputCol="z").fit(vectors)
    rows = [(i + 1, float(v)) for i, v in enumerate(model.explainedVariance.toArray())]
    return literal(df.sparkSession, rows, "component int, variance_ratio double")
