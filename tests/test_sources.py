import gzip
import json

import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.operators import activity, cohort
from tidemark.sources import lists, posts, sinks, tables

GOOD = [{"author": "a", "body": "x", "created_utc": 5, "extra": {"k": [1]}}, {"author": None}, {}, {"author": "[deleted]"}]


def dump(path, records, bad=(), tail=""):
    text = "".join(json.dumps(r) + "\n" for r in records) + "".join(b + "\n" for b in bad) + tail
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def test_tolerant_scan(spark, tmp_path):
    path = dump(tmp_path / "RC_1.json", GOOD, ["{bad", ""], tail='{"author": "last"}')
    got = posts.read_posts(spark, [str(path)], keep_raw=True)
    assert sorted(str(r.author) for r in got.collect()) == ["None", "None", "[deleted]", "a", "last"]
    first = got.where("author = 'a'").first()
    assert (first.body, first.selftext, first.created_utc, first.data_type) == ("x", None, 5, "comments")
    assert json.loads(first.raw) == GOOD[0]
    assert sorted(r.author for r in activity.distinct_authors(got).collect()) == ["a", "last"]


def test_a_field_of_another_type_is_no_bad_line(spark, tmp_path):
    records = [{"author": "a", "created_utc": "7"}, {"author": "b", "created_utc": 8.0}, {"author": 5, "body": {"k": 1}}]
    got = {r.author: r for r in posts.read_posts(spark, [str(dump(tmp_path / "x.json", records))]).collect()}
    assert (got["a"].created_utc, got["b"].created_utc) == (7, 8)
    assert got["5"].body == '{"k":1}' and got["5"].created_utc is None


def test_strict_scan(spark, tmp_path):
    good = dump(tmp_path / "good.json", GOOD)
    assert posts.read_posts(spark, [str(good)], "strict").count() == 4
    bad = dump(tmp_path / "bad.json", GOOD, ["{bad"])
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        posts.read_posts(spark, [str(bad)], "strict").collect()


def test_folders_and_file_columns(spark, tmp_path):
    dump(tmp_path / "comments" / "RC_2020.json", [{"author": "c"}])
    dump(tmp_path / "submissions" / "deep" / "RS_2020.json", [{"author": "s"}])
    dump(tmp_path / "submissions" / "notes.txt", [{"author": "no"}])
    folders = [str(tmp_path / "comments"), str(tmp_path / "submissions")]
    got = posts.read_posts(spark, folders, pattern="*.json", partitions=3)
    with_folder = got.select("author", "data_type", posts.folder_of_file(F.col("file")))
    assert sorted(tuple(r) for r in with_folder.collect()) == [("c", "comments", "comments"), ("s", "submissions", "deep")]


def test_author_of_file(spark):
    names = spark.createDataFrame([("a_b_comments.json",), ("c_submissions.json",)], "n string")
    assert [r[0] for r in names.select(posts.author_of_file(F.col("n"))).collect()] == ["a_b", "c"]


def test_compressed_scans(spark, tmp_path):
    lines = "".join(json.dumps({"author": f"u{i}", "body": "é" * (i % 50)}) + "\n" for i in range(2000)).encode()
    (tmp_path / "RS_a.zst").write_bytes(zstandard.ZstdCompressor().compress(lines))
    (tmp_path / "RC_b.json.gz").write_bytes(gzip.compress(lines))
    got = posts.read_posts(spark, [str(tmp_path)], partitions=4)
    assert dict(got.groupBy("data_type").count().collect()) == {"submissions": 2000, "comments": 2000}


def test_positions_follow_the_file(spark, tmp_path):
    for name in ("u_comments.json", "v_comments.json"):
        dump(tmp_path / name, [{"author": name[0], "id": f"{i}", "body": "x" * (i % 90)} for i in range(3000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = posts.read_posts(spark, [str(tmp_path)], partitions=5, positions=True)
        assert got.select("pos.block").distinct().count() > 5
        tables.materialize(spark, str(tmp_path / "stored"), lambda: got)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    stored = spark.read.parquet(str(tmp_path / "stored"))
    for author in "uv":
        order = [int(r.id) for r in stored.where(F.col("author") == author).orderBy("pos").collect()]
        assert order == list(range(3000))
    listed = stored.withColumn("subreddit", F.when(F.col("id").isin("700", "2900"), "L").otherwise("x"))
    assert dict(cohort.cut_by_position(listed, ["L"]).groupBy("author").count().collect()) == {"u": 700, "v": 700}


def test_positions_order_lines_over_files(spark, tmp_path):
    """A post in an earlier, smaller file stands before the listed one, whatever Spark reads first."""
    dump(tmp_path / "a_RC.json", [{"author": "u", "subreddit": "plain", "id": "1"}])
    rest = [{"author": "u", "subreddit": "plain", "id": f"{i}", "body": "x" * 500} for i in (3, 4, 5)]
    dump(tmp_path / "b_RC.json", [{"author": "u", "subreddit": "L", "id": "2"}, *rest])
    tables.materialize(spark, str(tmp_path / "stored"), lambda: posts.read_posts(spark, [str(tmp_path)], positions=True))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    assert [r.id for r in stored.orderBy("pos").collect()] == ["1", "2", "3", "4", "5"]
    assert [r.id for r in cohort.cut_by_priority(stored, ["L"]).collect()] == ["1"]


def test_equal_posts_have_different_keys(spark, tmp_path):
    path = dump(tmp_path / "RC_1.json", [{"author": "u", "body": "same"}] * 2)
    found = posts.with_post_id(posts.read_posts(spark, [str(path)], positions=True))
    assert found.select("post_id").distinct().count() == 2


def test_epoch_time(spark):
    df = spark.createDataFrame([(86_400,)], "created_utc long")
    assert str(posts.with_time(df).select(F.col("created_utc").cast("string")).first()[0]) == "1970-01-02 00:00:00"


def test_lists(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("a\n b \n\nc\na\n")
    (tmp_path / "commas.txt").write_text("a, b ,c,a,")
    for name, separator in (("lines.txt", "\n"), ("commas.txt", ",")):
        got = lists.read_names(spark, str(tmp_path / name), separator)
        assert sorted(r.author for r in got.collect()) == ["a", "b", "c"]
    (tmp_path / "communities.txt").write_text("Y\nX\n\nZ\nX\n")
    got = {r.community: r.priority for r in lists.read_priorities(spark, str(tmp_path / "communities.txt")).collect()}
    assert got == {"Y": 1, "X": 2, "Z": 4}


def test_list_sinks(spark, tmp_path):
    names = spark.createDataFrame([(f"u{i}",) for i in range(40)], "author string").repartition(3)
    for separator in ("\n", ","):
        path = str(tmp_path / f"names{ord(separator)}")
        sinks.write_names(names, path, separator)
        assert lists.read_names(spark, path, separator).count() == 40


def test_headerless_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_text('1,2017-08-01 10:00:00,u,l,"a, ""b""\nc"\n2,2017-08-03,u,l,x\n3,2017-08-03 01:00:00,v,l,y\n')
    got = tables.read_dated_posts(spark, str(tmp_path / "d.csv"), multi_line=True)
    assert got.orderBy("number").first().text == 'a, "b"\nc'
    per_day = activity.new_users(got).select(F.col("first").cast("date").cast("string"), "n").collect()
    assert [tuple(r) for r in per_day] == [("2017-08-01", 1), ("2017-08-03", 1)]
    assert activity.new_users(got, grain=None).count() == 2
    event = F.to_timestamp(F.lit("2017-08-12"))
    assert activity.event_window(got, event, 10).count() == 2


def test_token_lines(spark, tmp_path):
    (tmp_path / "t.csv").write_text('one two\n""\nthree\n')
    assert sorted(r.token for r in tables.read_token_lines(spark, str(tmp_path / "t.csv")).collect()) == ["one two", "three"]


def test_materialize_builds_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.materialize(spark, str(tmp_path / "t"), build).count() == 3
    assert built == [1]
    # Other parameters are another table.
    for n in (20, 50, 20):
        assert tables.materialize(spark, str(tmp_path / "t"), lambda n=n: spark.range(n), "tag", n).count() == n
    # A build that broke off: some files are there, the success marker is not.
    half = tmp_path / "half"
    spark.range(2).write.parquet(str(half))
    (half / "_SUCCESS").unlink()
    assert tables.materialize(spark, str(half), build).count() == 3


def test_author_sink(spark, tmp_path):
    rows = [(f"u{i % 5}", "comments" if i % 2 else "submissions", f"t{i}", json.dumps({"i": i})) for i in range(40)]
    df = spark.createDataFrame(rows, "author string, data_type string, body string, raw string")
    path = str(tmp_path / "authors")
    for _ in range(2):
        sinks.write_author_json(df.drop("raw"), path, buckets=4)
    back = spark.read.json(path)
    assert back.count() == 80
    assert back.groupBy("author").agg(F.countDistinct("author_bucket").alias("n")).where("n > 1").count() == 0
    sinks.write_author_json(df, str(tmp_path / "raw"), buckets=4, raw="raw")
    assert sorted(r.i for r in spark.read.json(str(tmp_path / "raw")).collect()) == list(range(40))


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x, "y"', {"joy": 0.5}, [1.0])], "w string, t string, m map<string,double>, v array<float>")
    sinks.write_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first()
    assert (back.t, json.loads(back.m), json.loads(back.v)) == ('x, "y"', {"joy": 0.5}, [1.0])


def test_dataset_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("u", [1.0, 2.0], 1), ("v", [3.0, 4.0], 0)], "author string, embedding array<float>, label int")
    assert sinks.write_dataset(df, str(tmp_path / "d")).count() == 2
    stored = tables.read_embedding_dataset(spark, str(tmp_path / "d")).orderBy("author").first()
    assert list(stored.features) == [1.0, 2.0]
    uneven = df.withColumn("embedding", F.when(F.col("label") == 1, F.col("embedding")).otherwise(F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ValueError, match="1 to 2"):
        sinks.write_dataset(uneven, str(tmp_path / "e"))


def test_cohort_and_report_sinks_replace(spark, tmp_path):
    for n in (3, 2):
        sinks.write_cohort(spark.range(n), str(tmp_path / "cohort"))
        sinks.write_report(spark.range(1).withColumn("accuracy", F.lit(n)), str(tmp_path / "report"))
    assert spark.read.parquet(str(tmp_path / "cohort")).count() == 2
    assert spark.read.json(str(tmp_path / "report")).first().accuracy == 2


def test_post_id(spark, tmp_path):
    records = [{"id": "t1", "author": "a"}, {"author": "a", "body": "x"}, {"author": "a", "body": "y"}]
    got = posts.with_post_id(posts.read_posts(spark, [str(dump(tmp_path / "p.json", records))])).collect()
    keys = {r.post_id for r in got}
    assert len(keys) == 3 and "t1" in keys


def test_missing_fields(spark):
    full = posts.with_all_fields(spark.createDataFrame([("x",)], "body string"))
    assert tuple(full.first()) == ("x", None, None)
