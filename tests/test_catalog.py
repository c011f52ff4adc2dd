import zipfile
from datetime import datetime, timezone

from pyspark.sql import functions as F

from quire.functions import names as N
from quire.operators import catalog as C
from quire.sources import corpus
from quire.streaming import arrivals


def values(spark, fn, items):
    df = spark.createDataFrame(list(enumerate(items)), "i int, s string")
    return [r.v for r in df.select("i", fn(F.col("s")).alias("v")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, N.sanitize_filename, [
        "a/b/c.pdf", "", "..", "x\\y\x01.txt", "/", "dir/", "a" * 300 + ".docx", "é.pdf"]) == [
        "c.pdf", "document.pdf", "document.pdf", "xy.txt", "document.pdf", "dir",
        "doc_" + "a" * 32 + ".docx", "é.pdf"]
    assert values(spark, N.extension, ["a.tar.gz", ".bashrc", "noext", "a."]) == ["gz", "", "", ""]
    assert values(spark, N.is_doc_id, ["ab-_9", "", "a b", "x" * 65]) == [True, False, False, False]


def test_urls(spark):
    assert values(spark, N.url_filename, [
        "http://h/a/report.pdf", "http://h/report.pdf?x=1", "http://h/r?name=a.doc", "http://h/"]) == [
        "report.pdf", "remote_document.pdf", "name=a.doc", "remote_document.pdf"]
    assert values(spark, N.disposition_filename, [
        'attachment; filename="a b.pdf"; size=3', "inline", "x; filename=''"]) == ["a b.pdf", None, None]
    safe = {
        "http://example.org/x": True, "https://user@example.org:8443": True, "ftp://example.org": False,
        "http://localhost/": False, "http://a.internal": False, "http://10.1.2.3": False,
        "http://172.15.0.1": True, "http://172.16.0.1": False, "http://172.31.9.9": False,
        "http://172.32.0.1": True, "http://192.168.0.1": False, "http://192.169.0.1": True,
        "http://169.254.1.1": False, "http://127.0.0.1:80/": False, "http://224.0.0.1": False,
        "http://223.1.1.1": True, "http://0.0.0.0": False, "http://[::1]/": False,
        "http://[fc00::1]": False, "http://[fe80::1]": False, "http://[::ffff:10.0.0.1]": False,
        "http://[2001:db8::1]/": True, "http://[ff02::1]": False, "nothing": False,
        "http://2130706433/x": False, "http://127.1/": False, "http://0x7f000001/": False,
        "http://0177.0.0.1": False, "http://8.8.8.8": True, "http://134744072": True,
        "http://010.1": True, "http://0x0a.1": False, "http://256.1.1.1": False,
        "http://1.2.3.4.5": False, "http://host.09": False, "http://a.127": False,
        "http://0": False, "http://localhost.": False, "http://[1::2::3]": False,
        "http://[::8.8.8.8]": True, "http://[::FFFF:7f00:1]": False, "http://[1:2]": False,
        "http://[2a00::1%25eth0]": False, "http://[fec0::1]": True, "http://3com.org": True,
    }
    got = values(spark, N.url_is_safe, list(safe))
    assert dict(zip(safe, got)) == safe


def test_permissions_and_paths(spark):
    assert values(spark, N.may_download, [
        "read-only", "download", "read-only,download", "no-download", None]) == [
        False, True, True, False, True]
    assert values(spark, N.is_traversal, ["a/../b", "a/b"]) == [True, False]
    assert values(spark, N.strip_root, ["//a/b", "\\x"]) == ["a/b", "x"]
    assert values(spark, N.redacted_name, ["a.PDF", "b.docx"]) == ["redacted_a.PDF", "redacted_b.docx.pdf"]
    assert values(spark, lambda c: N.converted_name(c, F.lit(True)), ["d/a.b.docx", ".rc"]) == [
        "a.b_converted.pdf", ".rc_converted.pdf"]


def test_catalog_first_copy_latest_name(spark):
    files = spark.createDataFrame(
        [("k1", "a.txt", "same", 1), ("k2", "b.txt", "same", 2), ("k3", "a.pdf", "same", 3),
         ("k4", "c.txt", "other", 4)], "key string, filename string, content string, arrival int")
    got = {(r.ext, r.stored_key): (r.filename, r.copies) for r in C.catalog(files, "key").collect()}
    assert got == {("txt", "k1"): ("b.txt", 2), ("pdf", "k3"): ("a.pdf", 1), ("txt", "k4"): ("c.txt", 1)}


def test_routing(spark):
    df = spark.createDataFrame([("a.DOCX",), ("b.mp4",), ("c.xyz",), ("d",)], "filename string")
    got = {r.filename: r.family for r in C.route(df).collect()}
    assert got == {"a.DOCX": "office", "b.mp4": "video", "c.xyz": "text", "d": "text"}


def test_retention_and_lookup(spark):
    at = lambda s: datetime.fromtimestamp(s, timezone.utc)
    rows = [("d1.pdf", 100), ("d1.meta", 100), ("d1.xfdf", 900), ("d2.pdf", 0), ("d2.meta", 500),
            ("d2.docx.rendition.pdf", 10), ("x.tmp", 10), ("y.tmp", 900)]
    files = spark.createDataFrame([(n, at(s)) for n, s in rows], "name string, mtime timestamp")
    gone = C.expired(files, F.timestamp_seconds(F.lit(1001)), 900)
    assert {r.name for r in gone.collect()} == {"d1.pdf", "d1.meta", "d1.xfdf", "d2.docx.rendition.pdf",
                                                "x.tmp"}
    assert {r.name for r in C.survivors(files, gone).collect()} == {"d2.pdf", "d2.meta", "y.tmp"}
    ids = spark.createDataFrame([("d2",), ("bad id",)], "doc_id string")
    assert [r.name for r in C.lookup(files, ids).collect()] == ["d2.pdf"]


def test_page_geometry(spark):
    rows = [(1, 1, None, None, None), (1, 2, [0.0, 0.0, 612.0, 792.0], [10.0, 10.0, 5.0, 400.0], 90),
            (1, 3, None, [0.0, 0.0, 100.0], 270)]
    df = spark.createDataFrame(rows, "doc_id int, page_number int, media_box array<double>, "
                                     "crop_box array<double>, rotate int")
    got = {r.page_number: (r.width, r.height, r.rotation) for r in C.page_geometry(df).collect()}
    assert got == {1: (595.0, 842.0, 0), 2: (390.0, 5.0, 90), 3: (842.0, 595.0, 270)}


def test_file_corpus_with_sidecars(spark, tmp_path):
    root = tmp_path / "store"
    (root / "sub").mkdir(parents=True)
    (root / "a.pdf").write_bytes(b"%PDF")
    (root / "a.xfdf").write_text("<xfdf/>")
    (root / "sub" / "b.bin").write_bytes(b"x" * 50)
    (root / "sub" / "doc9.meta").write_text("../my file.txt\ntxt")
    files = corpus.read_files(spark, str(root)).where(~F.col("path").endswith(".meta"))
    got = {r.filename: (r.ext, r.mime_type, r.xfdf) for r in corpus.attach_sidecars(files).collect()}
    assert got == {"a.pdf": ("pdf", "application/pdf", "<xfdf/>"),
                   "b.bin": ("bin", "application/octet-stream", None)}
    assert {r.filename: (r.reason, r.content is None) for r in corpus.checked(files, 10).collect()
            } == {"a.pdf": (None, False), "a.xfdf": (None, False), "b.bin": ("too_large", True)}
    kept, rest = corpus.split_by_size(files, 10)
    assert kept.count() == 2 and [r.filename for r in rest.collect()] == ["b.bin"]
    meta = corpus.read_meta(spark, str(root)).collect()[0]
    assert (meta.doc_id, meta.filename, meta.ext) == ("doc9", "my file.txt", "txt")
    got = spark.range(1).select(corpus.sidecar_path(F.lit("/s/a.pdf"), "s3").alias("s"),
                                corpus.sidecar_path(F.lit("/s/a.pdf")).alias("f")).collect()[0]
    assert got.s == "/s/a.pdf.xfdf" and got.f == "/s/a.xfdf"


def test_annotation_save_replaces_only_its_documents(spark, tmp_path):
    path = str(tmp_path / "ann")
    first = spark.range(2000).selectExpr("id AS doc_id", "1 AS v")
    corpus.save_annotations(first, first, path, 1)
    for _ in range(2):  # a repeated batch replaces itself
        again = spark.createDataFrame([(7, 2), (7, 3)], "doc_id long, v int")
        corpus.save_annotations(spark.createDataFrame([(7,), (9,)], "doc_id long"), again, path, 2)
    want = {(i, 1) for i in range(2000) if i not in (7, 9)} | {(7, 2), (7, 3)}
    got = corpus.read_annotations(spark, path)
    assert {(r.doc_id, r.v) for r in got.collect()} == want and got.count() == 2000
    corpus.compact_annotations(spark, path, path + "-new", 2)
    assert {(r.doc_id, r.v) for r in corpus.read_annotations(spark, path + "-new").collect()} == want


def test_annotation_save_stopped_between_writes(spark, tmp_path, monkeypatch):
    """A save that stops after its rows, before its mark, has changed nothing; done again it counts."""
    path = str(tmp_path / "ann")
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, v string")
    corpus.save_annotations(first, first, path, 1)
    second = spark.createDataFrame([(1, "new")], "doc_id long, v string")
    broken = spark.createDataFrame([(1,)], "doc_id long").select(
        F.when(F.raise_error(F.lit("stop")).isNull(), F.col("doc_id")).alias("doc_id"))
    try:
        corpus.save_annotations(broken, second, path, 2)
        raise AssertionError("did not stop")
    except Exception as e:
        assert "stop" in str(e)
    read = lambda: {(r.doc_id, r.v) for r in corpus.read_annotations(spark, path).collect()}
    assert read() == {(1, "a"), (2, "b")}
    corpus.save_annotations(second, second, path, 2)
    assert read() == {(1, "new"), (2, "b")}


def test_versions_and_mapping(spark, tmp_path):
    path = str(tmp_path / "v")
    for no in (1, 2):
        corpus.append_versions(spark.createDataFrame([("d", no, f"v{no}")],
                                                     "doc_id string, version int, name string"), path)
    assert corpus.latest_versions(spark.read.parquet(path)).collect()[0].name == "v2"
    m = spark.range(1).select(corpus.parse_mapping(corpus.mapping_json(
        F.lit("s3"), F.lit("b/k"), F.create_map(F.lit("x"), F.lit("1")))).alias("m")).collect()[0].m
    assert (m.connector, m.resource_id, m.extra_params) == ("s3", "b/k", {"x": "1"})


def test_arrivals_keep_one_copy(spark, tmp_path):
    land = tmp_path / "land"
    land.mkdir()
    for name, body in (("a.txt", "one"), ("b.txt", "one"), ("c.txt", "two")):
        (land / name).write_text(body)
    out = str(tmp_path / "cat")
    files = arrivals.landing(spark, str(land), per_trigger=1)
    arrivals.maintain_catalog(files, out, str(tmp_path / "log")).awaitTermination()
    got = arrivals.read_catalog(spark, out).collect()
    assert sorted(r.copies for r in got) == [1, 2]
    stream = arrivals.distinct_contents(arrivals.landing(spark, str(land)))
    q = stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_telemetry_csv(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("timestamp,elapsed_s,active_nodes,total_cpu_percent,total_rss_mb,max_hwm_mb,"
                 "total_threads,total_fds,tcp_established,tcp_time_wait\n10:00:00,1,2,50.5,27.3,28.7,49,9,3,1\n")
    row = corpus.read_telemetry(spark, str(f)).collect()[0]
    assert row.total_cpu_percent == 50.5 and row.tcp_time_wait == 1
