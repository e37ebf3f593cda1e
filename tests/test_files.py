"""Sources, sinks and scratch space."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskgrain import session
from riskgrain.session import literal, scratch_path
from riskgrain.sources import delimited, keyword_files, runs, wide
from riskgrain.workloads import files


def test_blank_lines_survive_transcoding(spark):
    path = scratch_path(spark, "lines") + ".txt"
    lines = ["贷款", "", "  ", 'a,"b"', "\ttab", "é"]
    literal(spark, [(t,) for t in lines], "value string").coalesce(1).write.text(path)
    target = delimited.transcode(spark, path, "UTF-8", None, "GB18030")
    assert target.endswith("-GB18030.txt")
    assert [r[0] for r in delimited.read_lines(spark, target, "GB18030").collect()] == lines
    raw = spark.read.format("binaryFile").load(target).where("length > 0").first()["content"]
    assert bytes(raw).startswith(bytes.fromhex("B4FB"))


@pytest.mark.parametrize("charset", ["UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"])
def test_wide_charsets_round_trip(spark, tmp_path, charset):
    lines = ["first", "", "\u0a0a \u010a second", "客户 \U0001f600", ""]
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n", encoding="utf-8")
    middle = delimited.transcode(spark, f"{tmp_path}/in.txt", "UTF-8", f"{tmp_path}/wide", charset)
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "wide").glob("part-*")))
    assert raw.decode(charset if charset.endswith("E") else charset + "BE") == "\n".join(lines) + "\n"
    final = delimited.transcode(spark, middle, charset, f"{tmp_path}/out", "UTF-8")
    assert sorted(r["line"] for r in delimited.read_lines(spark, final).collect()) == sorted(lines)


def test_default_target():
    assert delimited.default_target("/a/b.c/d.txt", "utf-8") == "/a/b.c/d-utf-8.txt"
    assert delimited.default_target("d", "utf-8") == "d-utf-8"


def test_rows_zip_across_files(spark):
    left, right = scratch_path(spark, "left"), scratch_path(spark, "right")
    df = spark.range(1000).repartition(5)
    df = session.materialise(df)
    df.select("id").write.csv(left)
    df.select((F.col("id") * 7).alias("x")).write.csv(right)
    a = delimited.read_delimited(spark, left, "id bigint", header=False)
    b = delimited.read_delimited(spark, right, "x bigint", header=False)
    zipped = delimited.zip_rows(a, b)
    assert zipped.count() == 1000 and zipped.where("x <> id * 7").count() == 0
    with pytest.raises(ValueError):
        delimited.zip_rows(a, b.limit(3))


def test_row_numbers_over_file_blocks(spark):
    path = scratch_path(spark, "numbered")
    spark.range(20000).coalesce(1).write.csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = delimited.with_row_number(delimited.read_delimited(spark, path, "id bigint", header=False))
        assert df.where("id <> row").count() == 0 and df.count() == 20000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_names_in_either_charset(spark):
    for charset in ("UTF-8", "GB18030"):
        path = scratch_path(spark, "names")
        delimited.allow_charset(spark, charset)
        line = literal(spark, [("语言,来源, ,x",)], "v string")
        line.select(F.encode("v", charset).cast("string").alias("value")).write.text(path)
        assert keyword_files.read_names(spark, path) == ["语言", "来源", "x"]


def test_run_ids_count_up(spark):
    path = scratch_path(spark, "results")
    df = literal(spark, [(1,)], "x int")
    assert [runs.save_results(df, path, n) for n in ("lr", "rf", "lr", "lr", "rf")] == ["lr", "rf", "lr1", "lr2", "rf1"]


def test_run_log_rejects_unknown_fields(spark):
    with pytest.raises(ValueError):
        runs.append_run(spark, scratch_path(spark, "log"), colour="red")


def test_scratch_follows_the_checkpoint_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) == configured.rstrip("/") if configured else session.shared_dir(spark)


def test_column_names_must_fit(spark):
    df = literal(spark, [(1, 2)], "a int, b int")
    assert delimited.name_columns(df, ["x"], "key").columns == ["x", "key"]
    with pytest.raises(ValueError):
        delimited.name_columns(df, ["x"])


@pytest.mark.parametrize("charset, end", [("UTF-16", ""), ("UTF-16LE", "\n"), ("UTF-16BE", "\n"), ("UTF-32", "\n"), ("UTF-32LE", "")])
def test_wide_files_are_read_in_blocks(spark, tmp_path, charset, end):
    """Blocks that end anywhere, in characters that hold a byte 0A and in lines longer than a block; one file a block."""
    rng = random.Random(21)
    letters = ["a", "ਊ", "Ċ", "਀", "\n", "\U0001f60a", "﻿", "客"]
    lines = "".join(rng.choices(letters, [9, 3, 3, 3, 2, 1, 1, 2], k=2000)).split("\n") + ["ਊĊ" * 400, "", "x"]
    for name, text in (("a.txt", "\n".join(lines)), ("b.txt", "믯䆿" + "\n".join(lines)), ("c.txt", "\n"), ("d.txt", "")):
        (tmp_path / name).write_bytes((text + (end if text else "")).encode(charset))
    want = lines + ["믯䆿" + lines[0], *lines[1:]] + ["", *([""] if end else [])]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        whole = [r[0] for r in wide.wide_lines(spark, str(tmp_path), charset).collect()]
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(whole) == sorted(want)
    assert [r[0] for r in wide.wide_lines(spark, str(tmp_path / "a.txt"), charset).collect()] == lines


def test_chain_of_charsets_keeps_one_lot_at_a_time(spark, tmp_path, monkeypatch):
    """All lines go the whole way, while of what lies between only a lot is on the disk; the source stays unless it may be used up."""
    lines = [f"{k} 客户 \u0a0a \u010a" if k % 5 else "" for k in range(20_000)]
    source = tmp_path / "in put.txt"
    literal(spark, [(x,) for x in lines], "value string").repartition(16).write.text(str(source))
    size = sum(f.stat().st_size for f in source.glob("part-*"))
    lots = delimited.file_lots(spark, str(source), 4)
    assert len(lots) == 4 and sorted(f for lot in lots for f in lot) == sorted(f"file:{f}" for f in source.glob("part-*"))
    held, plain = [], delimited.transcode

    def watched(spark, *args):
        path = plain(spark, *args)
        between = [p for p in session._written[spark.sparkContext.applicationId] if "/lines-UTF-" in p]
        held.append(sum(f.stat().st_size for p in between for f in Path(p.removeprefix("file:")).glob("part-*")))
        return path

    monkeypatch.setattr(delimited, "transcode", watched)
    for keep in (True, False):
        final = delimited.transcode_chain(
            spark, str(source), ["UTF-8", "UTF-16LE", "UTF-32", "UTF-8"], f"{tmp_path}/out-{keep}", lots=4, keep_source=keep)
        assert sorted(r["line"] for r in delimited.read_lines(spark, final).collect()) == sorted(lines)
        assert bool(list(source.glob("part-*"))) == keep
    assert len(held) == 24 and size / 4 < max(held) < 2 * size
    with pytest.raises(ValueError):
        plain(spark, [final], "UTF-8", None, "UTF-16")


def test_chain_of_charsets_without_rows(spark, tmp_path):
    spark.range(0).selectExpr("string(id) AS value").write.text(f"{tmp_path}/none.txt")
    final = delimited.transcode_chain(spark, f"{tmp_path}/none.txt", ["UTF-8", "UTF-16LE", "UTF-8"], f"{tmp_path}/out")
    assert delimited.read_lines(spark, final).count() == 0


def test_wide_query_needs_little_disk(spark, tmp_path, monkeypatch):
    """The query's files take about twice the room of the texts at most; all four charsets' files together take eight times as much."""
    texts = spark.range(0, 8_000, 1, 16).selectExpr("id AS doc_id", "concat('line ', id % 100, '\n', repeat(string(id % 10), 500)) AS text")
    texts.write.parquet(f"{tmp_path}/documents.parquet")
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    top = Path(session.shared_dir(spark).removeprefix("file:")) / "riskgrain"
    seen, plain = [], delimited.transcode

    def held():
        return sum(f.stat().st_size for f in top.glob("*lines*/part-*"))

    def watched(*args):
        path = plain(*args)
        seen.append(held())
        return path

    before = held()
    for module in (delimited, files):
        monkeypatch.setattr(module, "transcode", watched)
    found = files.transcoded_wide(spark, str(tmp_path))
    assert found.count() == 110 and found.agg(F.sum("n")).first()[0] == 16_000
    assert size < max(seen) - before < 2.6 * size
