"""The file set of a keyword study: texts, keys, 0/1 matrix and responses in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import key_date
from ..operators.keywords import join_response
from .delimited import GB18030, UTF8, name_columns, read_delimited, read_lines, zip_rows


def read_names(spark: SparkSession, path: str, sep: str = ",", charset: str | None = None) -> list[str]:
    """The names listed on the first line of a small file; empty entries are skipped."""
    if charset is None:
        charset = UTF8 if read_lines(spark, path, "ISO-8859-1").where(~F.is_valid_utf8(F.encode("line", "ISO-8859-1").cast("string"))).isEmpty() else GB18030
    first = read_lines(spark, path, charset).first()
    return [n.strip() for n in (first["line"] if first else "").split(sep) if n.strip()]


def keyword_study(
    spark: SparkSession, folder: str, key_name: str, text_names: Sequence[str] | None = None, charset: str = GB18030
) -> dict[str, DataFrame]:
    """Read a study's files into keyed tables.

    ``cols.txt`` names the text columns, ``input.txt`` holds the texts,
    ``loan_number.txt`` the keys, ``keyword.txt`` and ``output.txt`` the words
    and their 0/1 marks, ``respond.txt`` the labels.  Returns ``input`` (with a
    ``date`` taken from the key), ``output``, ``response`` and ``model_data``.
    """
    def columns(n: int, kind: str) -> str:
        return ", ".join(f"c{i} {kind}" for i in range(n))

    names = list(text_names or read_names(spark, f"{folder}/cols.txt"))
    names = [n for n in names if n != key_name]
    words = read_names(spark, f"{folder}/keyword.txt", " ", charset)
    keys = read_delimited(spark, f"{folder}/loan_number.txt", f"`{key_name}` string", header=False, charset=charset)

    texts = read_delimited(
        spark, f"{folder}/input.txt", columns(len(names), "string"), sep="\t", header=False, charset=charset
    )
    texts = name_columns(zip_rows(texts, keys), names, key_name).withColumn("date", key_date(F.col(f"`{key_name}`")))
    marks = read_delimited(
        spark, f"{folder}/output.txt", columns(len(words), "int"), sep=" ", header=False, charset=charset
    )
    marks = name_columns(zip_rows(marks, keys), words, key_name)
    labels = read_delimited(spark, f"{folder}/respond.txt", "label int", header=False, charset=charset)
    labels = zip_rows(labels, keys)
    ordered = [marks.select(key_name, *words), labels.select(key_name, "label")]
    return {
        "input": texts, "output": ordered[0], "response": ordered[1],
        "model_data": join_response(ordered[0], ordered[1], key_name),
    }
