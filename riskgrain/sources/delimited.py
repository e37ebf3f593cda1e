"""Delimited text in any charset: reading, writing, naming columns, row alignment, transcoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from ..session import delete, scratch_path
from .wide import wide, wide_lines

JAVA_CHARSETS = "spark.sql.legacy.javaCharsets"
REPLACEMENT = "�"
UTF8 = "UTF-8"
GB18030 = "GB18030"
# Charsets the CSV source takes without the Java charset switch: fixed names.
BUILT_IN_CHARSETS = {"US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16", "UTF-32"}


def allow_charset(spark: SparkSession, charset: str) -> str:
    """Let the CSV source use a charset of the Java runtime."""
    if charset.upper() not in BUILT_IN_CHARSETS:
        spark.conf.set(JAVA_CHARSETS, "true")
    return charset


def read_delimited(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", header: bool = True,
    charset: str = UTF8, **options,
) -> DataFrame:
    """Read with an explicit schema; key columns stay text when declared so."""
    reader = spark.read.schema(schema).options(
        sep=sep, header=header, encoding=allow_charset(spark, charset), **options
    )
    return reader.csv(path)


def garbled(df: DataFrame) -> Column:
    """True for rows where some text holds the replacement character of a failed decode."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    test = F.lit(False)
    for t in texts:
        test = test | F.coalesce(F.contains(F.col(t), F.lit(REPLACEMENT)), F.lit(False))
    return test


def read_with_fallback(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", header: bool = True,
    charsets: Sequence[str] = (UTF8, GB18030), **options,
) -> tuple[DataFrame, str]:
    """Read with the first charset that decodes every row, and say which it was.

    UTF-8 is tested on the bytes of all lines, so a replacement character that
    stands in the text is no sign of a failed decode.  In other charsets bad
    bytes turn into that character, which one scan per rejected charset looks for.
    """
    for charset in charsets[:-1]:
        df = read_delimited(spark, path, schema, sep, header, charset, **options)
        if charset.upper() in ("UTF-8", "UTF8"):
            bad = spark.read.option("lineSep", "\n").text(path).where(~F.is_valid_utf8("value"))
        else:
            bad = df.where(garbled(df))
        if bad.isEmpty():
            return df, charset
    last = charsets[-1]
    return read_delimited(spark, path, schema, sep, header, last, **options), last


def name_columns(df: DataFrame, names: Sequence[str], key_name: str | None = None) -> DataFrame:
    """Name the columns of a headerless table; a missing key name goes to the end."""
    names = list(names)
    if key_name is not None and key_name not in names:
        names.append(key_name)
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def write_delimited(
    df: DataFrame, path: str, charset: str = UTF8, key: str | None = None, sep: str = ",", mode: str = "error",
    header: bool = True,
) -> None:
    """Write text files, key column first."""
    if key is not None:
        df = df.select(key, *[c for c in df.columns if c != key])
    allow_charset(df.sparkSession, charset)
    df.write.mode(mode).options(sep=sep, header=header, encoding=charset).csv(path)


def with_row_number(df: DataFrame, out: str = "row") -> DataFrame:
    """0-based position of each row in its files, in path order.

    ``df`` must come straight from a file source.  Positions are counted inside
    each block of a file and shifted by the blocks before it, so no task handles
    more than one block and re-running a task cannot change them.
    """
    located = df.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    blocks = located.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    # one row per file block
    before = W.orderBy("_file", "_start").rowsBetween(W.unboundedPreceding, -1)
    shifts = blocks.select("_file", "_start", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = W.partitionBy("_file", "_start").orderBy("_seq")
    numbered = located.withColumn("_pos", F.row_number().over(inside) - 1)
    return numbered.join(shifts, ["_file", "_start"]).select(
        *df.columns, (F.col("_shift") + F.col("_pos")).cast("bigint").alias(out)
    )


def zip_rows(*tables: DataFrame) -> DataFrame:
    """Put tables side by side by row position.  All must have the same number of rows."""
    counts = {t.count() for t in tables}
    if len(counts) > 1:
        raise ValueError(f"tables differ in length: {sorted(counts)}")
    joined = with_row_number(tables[0], "_row")
    for t in tables[1:]:
        joined = joined.join(with_row_number(t, "_row"), "_row")
    return joined.drop("_row")


def default_target(path: str, charset: str) -> str:
    """``<stem>-<charset>.<extension>`` next to the source."""
    folder, slash, name = path.rstrip("/").rpartition("/")
    stem, dot, extension = name.rpartition(".")
    renamed = f"{stem}-{charset}.{extension}" if dot else f"{name}-{charset}"
    return f"{folder}{slash}{renamed}"


def transcode(
    spark: SparkSession, source: str | list[str], source_charset: str, target: str | None, target_charset: str, mode: str = "error",
) -> str:
    """Rewrite the lines of a text data set, or of a list of its files, in another charset; returns the target path.

    Files are split at line feeds before decoding, which is safe for UTF-8,
    GB18030 and every single-byte charset, where no other character contains
    that byte.  UTF-16 and UTF-32 files are read in blocks as well, see ``wide``;
    as targets without a byte order they are written big-endian,
    without a mark.  Lines keep their text, blank ones included.
    """
    for charset in (source_charset, target_charset):
        allow_charset(spark, charset)
    if target is None:
        if not isinstance(source, str):
            raise ValueError("a list of files needs a target")
        target = default_target(source, target_charset)
    if wide(source_charset):
        lines = wide_lines(spark, source, source_charset)
    else:
        raw = spark.read.option("lineSep", "\n").text(source).select(F.col("value").cast("binary").alias("value"))
        lines = raw.select(F.decode("value", source_charset).alias("value"))
    if target_charset.upper() in ("UTF-16", "UTF-32"):
        target_charset = allow_charset(spark, f"{target_charset}BE")
    # the text sink writes a string's bytes as they are
    lines.select(F.encode("value", target_charset).cast("string").alias("value")).write.mode(mode).options(
        lineSep="\n", encoding=target_charset).text(target)
    return target


def file_lots(spark: SparkSession, path: str, lots: int) -> list[list[str]]:
    """The files of a text data set in at most ``lots`` lots of about equal size, in path order; a file is never divided."""
    jvm, hadoop_conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    files = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in sorted(spark.read.text(path).inputFiles())]
    sizes = [f.getFileSystem(hadoop_conf).getFileStatus(f).getLen() for f in files]
    out: dict[int, list[str]] = {}
    before, total = 0, max(1, sum(sizes))
    for f, size in zip(files, sizes):
        # a file belongs where its middle lies
        out.setdefault((2 * before + size) * lots // (2 * total), []).append(f.toString())
        before += size
    return list(out.values())


def transcode_chain(
    spark: SparkSession, source: str, charsets: Sequence[str], target: str, lots: int = 8, keep_source: bool = True,
) -> str:
    """Rewrite the lines of a text data set from the first of the charsets to the next and so on to the last; returns the target path.

    Lot by lot of its files goes the whole way, and what a step has read is
    deleted when the step is over: beside source and target the disk holds two
    charsets' files of one lot.  With ``keep_source`` off the source is used
    up in the same way.
    """
    # a data set without files still gets a target
    for lot, files in enumerate(file_lots(spark, source, lots) or [[source]]):
        for step, (old, new) in enumerate(zip(charsets, charsets[1:]), 1):
            last = step == len(charsets) - 1
            path = target if last else scratch_path(spark, f"lines-{new}")
            transcode(spark, files, old, path, new, "append" if last and lot else "error")
            if step > 1 or not keep_source:
                delete(spark, files)
            files = [path]
    return target


def read_lines(spark: SparkSession, path: str, charset: str = UTF8) -> DataFrame:
    """Whole lines of a text data set as column ``line``."""
    allow_charset(spark, charset)
    raw = spark.read.option("lineSep", "\n").text(path)
    return raw.select(F.decode(F.col("value").cast("binary"), charset).alias("line"))
