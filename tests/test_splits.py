"""Line numbers, records and stored tables over files that are read in many splits."""

import contextlib
import csv
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidemark import sizes
from tidemark.operators import cohort
from tidemark.sources import posts, sinks, splits, tables


@contextlib.contextmanager
def small_splits(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_line_numbers_of_unequal_files(spark, tmp_path):
    """Every line of every file, also behind bad and empty lines and without a last line break."""
    pick, want = random.Random(1), {}
    for name, lines in (("a", 4000), ("b", 1), ("c", 900), ("d", 0)):
        text = []
        for k in range(lines):
            bad = pick.random() < 0.1
            if not bad:
                want[f"{name}{k}"] = k + 1
            text.append("" if bad else json.dumps({"author": f"{name}{k}", "body": "x" * pick.randint(0, 300)}))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{name}.json").write_text("\n".join(text))
    with small_splits(spark, 20_000):
        got = posts.read_posts(spark, [str(tmp_path / "in")], partitions=5, positions=True, line_numbers=str(tmp_path)).cache()
        assert got.select("pos.file", "pos.block").distinct().count() > 20
    assert dict(got.select("author", "line_number").collect()) == want
    by_place = [row.author for row in got.orderBy("pos").collect()]
    assert by_place == sorted(want, key=lambda name: (name[0], want[name]))


def test_cut_by_line_number(spark, tmp_path):
    """The cut goes by the line, although the posts of the file run backwards in time."""
    (tmp_path / "in").mkdir()
    for author in "uv":
        rows = [{"author": author, "subreddit": "L" if k == 700 else "x", "created_utc": 9000 - k, "body": "y" * 80} for k in range(2000)]
        (tmp_path / "in" / f"{author}_comments.json").write_text("".join(json.dumps(row) + "\n" for row in rows))
    with small_splits(spark, 10_000):
        numbered = posts.read_posts(spark, [str(tmp_path / "in")], line_numbers=str(tmp_path))
        kept = cohort.cut_by_position(numbered, ["L"], position="line_number").collect()
    assert sorted((row.author, row.line_number) for row in kept) == [(a, k) for a in "uv" for k in range(1, 701)]


def odd_csv(seed, count, end):
    """Rows of five fields; the last one holds quotes, commas and line breaks."""
    pick = random.Random(seed)
    parts = ["a", "é", ",", '""', end, end * 2, " ", "x" * 40]
    rows = []
    for k in range(count):
        text = "".join(pick.choices(parts, k=pick.randint(1, 12)))
        rows.append(f'{k},2020-01-01 00:00:00,u,l,"<{text}>"' if pick.random() < 0.7 else f"{k},2020-01-01 00:00:00,u,l,plain{k}")
    return end.join([*rows, ""])


@pytest.mark.parametrize("size", [400, 10_000_000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_splits(spark, tmp_path, size, end):
    """The rows that Python's reader finds, and Spark's with multiLine."""
    source, want = tmp_path / "in", []
    source.mkdir()
    for name, count in (("a", 150), ("b", 1), ("c", 40)):
        (source / f"{name}.csv").write_bytes(odd_csv(count, count, end).encode())
        with open(source / f"{name}.csv", newline="") as file:
            want += [(row[0], row[4].replace("\r\n", "\n")) for row in csv.reader(file)]
    rows = lambda df: sorted((row.number, row.text.replace("\r\n", "\n")) for row in df.collect())
    with small_splits(spark, size):
        got = tables.read_dated_posts(spark, str(source), multi_line=True, folder=str(tmp_path))
        assert rows(got) == sorted(want)
        blocks = splits.scanned_lines(spark, [str(source)], str(tmp_path)).select("file", "block").distinct().count()
        assert blocks == 3 if size > 1000 else blocks > 10
    assert rows(tables.read_dated_posts(spark, str(source), multi_line=True)) == sorted(want)


def test_one_record_over_many_splits(spark, tmp_path):
    text = "line\n" * 3000
    (tmp_path / "d.csv").write_text(f'1,2020-01-01,u,l,"{text}"\n2,2020-01-01,v,l,"say ""hi"""\n')
    with small_splits(spark, 500):
        got = tables.read_dated_posts(spark, str(tmp_path / "d.csv"), multi_line=True, folder=str(tmp_path))
        rows = {row.number: row.text for row in got.collect()}
    assert rows == {"1": text, "2": 'say "hi"'}


def test_stored_tables_know_their_input(spark, tmp_path):
    """Changing, adding or removing a file builds anew; changing none reads."""
    source, built = tmp_path / "in", []
    source.mkdir()

    def write(name, text, time):
        (source / name).write_text(text)
        os.utime(source / name, (time, time))

    def size():
        def build():
            built.append(1)
            return spark.read.text(str(source))

        return tables.materialize(spark, str(tmp_path / "t"), build, tables.input_tag(spark, [str(source)])).count()

    write("a.txt", "1\n2\n", 1000)
    write("b.txt", "3\n", 1000)
    assert [size(), size()] == [3, 3] and len(built) == 1
    write("b.txt", "4\n", 2000)  # same length, another time
    assert size() == 3 and len(built) == 2
    write("c.txt", "5\n", 1000)
    assert size() == 4 and len(built) == 3
    (source / "c.txt").unlink()
    assert size() == 3 and len(built) == 3  # as before: the table of then
    assert tables.input_tag(spark, [str(source)], "*.none") == tables.input_tag(spark, [str(source)], "*.other")


def authored(spark, names, body="x"):
    return spark.createDataFrame([(name, "comments", f"{body}{k}") for k, name in enumerate(names)], "author string, data_type string, body string")


def test_a_repeated_append_counts_once(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    read = lambda: sorted(r.body for r in posts.read_posts(spark, sinks.author_json_paths(spark, path), pattern="*.json").collect())
    assert sinks.author_json_paths(spark, path) == []
    for _ in range(2):
        sinks.write_author_json(authored(spark, "abc"), path, batch="one/1")
    assert read() == ["x0", "x1", "x2"]

    class Ended(Exception):
        pass

    def end(*_):
        raise Ended

    # The rows are there, but the run ends before they are listed.
    with monkeypatch.context() as broken:
        broken.setattr(sinks, "inline_table", end)
        with pytest.raises(Ended):
            sinks.write_author_json(authored(spark, "de", "y"), path, batch="two")
    assert read() == ["x0", "x1", "x2"]
    sinks.write_author_json(authored(spark, "de", "y"), path, batch="two")
    sinks.write_author_json(authored(spark, "de", "y"), path, batch="two")
    assert read() == ["x0", "x1", "x2", "y0", "y1"]


def files_of(path):
    return {bucket.name: sorted(f.name for f in bucket.glob("*.parquet")) for bucket in path.glob("author_bucket=*")}


def test_authors_are_replaced_in_their_buckets(spark, tmp_path):
    path, work = tmp_path / "cohort", str(tmp_path / "work")
    names = [f"u{k}" for k in range(60)] * 3
    sinks.replace_authors(authored(spark, names), str(path), work, 8)
    before = files_of(path)
    sinks.replace_authors(authored(spark, ["u7", "new"], "y"), str(path), work, 8)
    after, stored = files_of(path), spark.read.parquet(str(path))
    changed = {name for name in after if after[name] != before.get(name)}
    assert 1 <= len(changed) <= 2 and len(before) > 4
    rows = {row.author: [] for row in stored.collect()}
    for row in stored.collect():
        rows[row.author].append(row.body)
    assert rows.pop("u7") == ["y0"] and rows.pop("new") == ["y1"]
    assert len(rows) == 59 and all(len(found) == 3 for found in rows.values())
    assert stored.groupBy("author").agg(F.countDistinct("author_bucket").alias("n")).where("n > 1").count() == 0
    sinks.replace_authors(authored(spark, ["u7", "new"], "y"), str(path), work, 8)
    assert spark.read.parquet(str(path)).count() == 59 * 3 + 2


def test_nested_columns_count_for_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(sizes, "BROADCAST_BYTES", 10_000)
    rows = spark.range(10).select(F.struct(F.repeat(F.lit("x"), 5000).alias("text")).alias("held"))
    assert not sizes.fits_broadcast(rows)
    assert sizes.fits_broadcast(rows.select(F.struct(F.lit("x").alias("text")).alias("held")))
