"""Files, logs, caches, chunk streams and versioned tables."""

import hashlib

from pyspark.sql import types as T

from vitrine.operators import reports
from vitrine.sources import files, json_files, tables


def test_listing(spark, tmp_path):
    for name, body in (("a/x.JPG", b"x" * 70_000), ("a/b/y.mp4", b"y"), ("a/z.txt", b"z"), ("c.gif", b"g")):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    got = {r.file_path: r for r in files.listed(spark, [str(tmp_path), str(tmp_path / "a")]).collect()}
    x = got[str(tmp_path / "a/x.JPG")]
    assert (x.parent_folder, x.file_size, x.file_hash) == ("a", 70_000, hashlib.sha256(b"x" * 65536).hexdigest())
    assert len(got) == 3
    made = {r.thumbnail_path for r in files.thumbnails(spark.createDataFrame([("p",), ("q",)], "file_path string"), lambda p: p == "p", "/t/").collect()}
    assert made == {"", "/t/" + hashlib.sha256(b"p").hexdigest() + ".jpg"}


def test_logs(spark, tmp_path):
    p = tmp_path / "log.txt"
    p.write_text("\n".join([files.log_line("INFO", "one", "2024-01-01 00:00:00"), files.log_line("ERROR", "two", "2024-01-01 00:00:01"), "goes on", ""]))
    lines = files.log_lines(spark, str(p))
    got = reports.parsed_log(lines).orderBy("line_no").collect()
    assert [(r.level, r.message) for r in got][:3] == [("INFO", "one"), ("ERROR", "two"), (None, "goes on")]
    assert tuple(reports.log_tail(lines).first())[:2] == (3, 1)
    assert reports.log_filter(lines, "TWO", ["ERROR"]).count() == 1
    files.append_log(spark, str(tmp_path / "more"), ["x"])
    assert spark.read.text(str(tmp_path / "more")).count() == 1


def test_cache(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.LongType())])
    path = str(tmp_path / "cache")
    assert json_files.load_cache(spark, path, schema).count() == 0
    json_files.save_cache(spark.createDataFrame([("a", 1)], schema), path)
    assert json_files.load_cache(spark, path, schema).first().n == 1
    json_files.clear_cache(spark, path, schema)
    assert json_files.load_cache(spark, path, schema).count() == 0


def test_chunks(spark):
    lines = ['{"status":"pulling"}', "", '{"total":200,"completed":50}', "{broken", '{"completed":500}', '{"error":"lost"}', '{"status":"late"}']
    df = spark.createDataFrame([("m", i, x) for i, x in enumerate(lines)], "stream string, line_no long, value string")
    got = [tuple(r)[2:] for r in json_files.decoded_chunks(df).orderBy("line_no").collect()]
    assert got == [("pulling", 0, 0, 0.0, False, None), ("pulling", 50, 200, 25.0, False, None), ("pulling", 500, 200, 100.0, False, None), ("error", 500, 200, 0.0, True, "lost")]


def test_store_reads_while_it_writes(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.write("t", spark.range(3).toDF("id"))
    store.write("t", store.read("t").where("id > 0"))
    assert store.read("t").count() == 2


def test_agreement(spark):
    rows = spark.createDataFrame([("c", "i", 1, True, ["a", "b"]), ("c", "i", 2, True, ["b", "c"]), ("c", "j", 1, True, ["a"]), ("c", "j", 2, False, ["z"])], "cond string, image string, rep int, parse_ok boolean, tags array<string>")
    r = reports.agreement(rows).first()
    assert (r.vocabulary, r.mean_jaccard) == (3, 0.333333)


def test_log_stream(spark, tmp_path):
    folder = str(tmp_path / "log")
    stamp = "2024-01-01 00:00:00"
    files.append_log(spark, folder, [files.log_line("INFO", "one", stamp), files.log_line("ERROR", "two", stamp)])

    stream = reports.log_filter(files.log_stream(spark, folder), "", ["ERROR"])
    query = stream.writeStream.format("memory").queryName("log_tail").start()
    try:
        query.processAllAvailable()
        files.append_log(spark, folder, [files.log_line("ERROR", "three", stamp)])
        query.processAllAvailable()
        assert sorted(r.value.rsplit(" ", 1)[1] for r in spark.table("log_tail").collect()) == ["three", "two"]
    finally:
        query.stop()
