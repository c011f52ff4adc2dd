"""Catalog queries over documents, pages, orders, part and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import names as N, text as X
from quire.operators import catalog as C, textlayer
from quire.plans.durable import fresh_folder
from quire.sources import corpus, rawfiles
from quire.sources.tables import spread, table

# extensions given to documents by number, to exercise routing
EXTS = ["pdf", "txt", "DOCX", "xlsx", "eml", "dxf", "dcm", "mp4", "mp3", "png", "svg", "md",
        "heic", "xyz", "tar.gz", "odt"]
_EXT_SQL = "[" + ", ".join(f"'{e}'" for e in EXTS) + "]"


def _files(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTS]),
                       (F.col("doc_id") % len(EXTS) + 1).cast("int"))
    name = F.concat("source", F.lit("/up\\load/"), "lang", F.lit("\t_"),
                    F.col("doc_id") % 50, F.lit("."), ext)
    return d.select("doc_id", F.col("doc_id").alias("arrival"), name.alias("filename"),
                    F.col("text").alias("content"))


def catalog_ids(spark, sf):
    return C.identify(_files(spark, sf)).select(
        "doc_id", "content_id", "clean_name", "ext",
        N.is_doc_id(F.col("content_id")).alias("id_ok"),
        N.is_doc_id(F.col("clean_name")).alias("name_ok"))


def catalog_dedup(spark, sf):
    return C.catalog(_files(spark, sf), "doc_id").drop("first_seen", "last_seen")


def catalog_merged(spark, sf):
    """Catalogs of every source's files, merged into one."""
    files = _files(spark, sf)
    parts = [C.catalog(files.where(F.col("filename").startswith("src1")), "doc_id"),
             C.catalog(files.where(~F.col("filename").startswith("src1")), "doc_id")]
    return C.merged(parts[0].unionByName(parts[1])).drop("first_seen", "last_seen")


def catalog_formats(spark, sf):
    routed = C.route(_files(spark, sf).withColumn("n_bytes", F.octet_length("content")))
    engine = N.office_engine(F.col("ext"), F.col("n_bytes") * 4000,
                             N.has_complex_wrapping(F.col("content")))
    return routed.select(
        "doc_id", "ext", "family", "is_video", "is_audio", "mime_read", "mime_metadata",
        "mime_download", F.when(F.col("family") == "office", engine).alias("office_engine"))


def _stored(spark, sf):
    """File listing of stored documents with sidecars, derived from orders."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    doc = F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 16)
    suffixes = F.array(*[F.lit(s) for s in (".pdf", ".meta", ".xfdf", ".connector",
                                            ".docx.rendition.pdf", ".tmp")])
    return o.select("o_orderkey", doc.alias("id"), "o_orderdate", "o_orderstatus").select(
        "o_orderkey", "id", F.posexplode(suffixes).alias("n", "suffix"), "o_orderdate").select(
        F.concat("id", "suffix").alias("name"),
        (F.col("o_orderdate") + F.make_dt_interval(F.col("n"))).alias("mtime"), "o_orderkey")


def catalog_lookup(spark, sf):
    ids = table(spark, sf, "customer").select(
        F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 1, 16).alias("doc_id"))
    return C.lookup(_stored(spark, sf), ids).select("doc_id", "name")


NOW = "1997-06-01 00:00:00"
TTL = 400 * 86400


def catalog_expired(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    return C.expired(_stored(spark, sf), now, TTL).select("doc_id", "name", "mtime")


def catalog_survivors(spark, sf):
    files = _stored(spark, sf)
    gone = C.expired(files, F.lit(NOW).cast("timestamp"), TTL)
    return C.survivors(files, gone).select("name")


def catalog_cascade(spark, sf):
    """Annotation rows (one per order) whose document survives."""
    files = _stored(spark, sf)
    gone = C.expired(files, F.lit(NOW).cast("timestamp"), TTL)
    child = files.where(F.col("name").endswith(".xfdf")).select(
        C.file_stem(F.col("name")).alias("doc_id"), "o_orderkey")
    return C.cascade(child, gone.where(F.col("name").endswith(".meta"))).select(
        "doc_id", "o_orderkey")


def _page_boxes(spark, sf):
    p = textlayer.pages(table(spark, sf, "documents").select("doc_id", "text"))
    d, n = F.col("doc_id"), F.col("page_number")
    media = F.array(F.lit(0.0), F.lit(10.0), (600 + d % 50).cast("double"), (900 - n).cast("double"))
    crop = F.array((d % 30).cast("double"), F.lit(20.0), F.lit(5.0), (700 + n).cast("double"))
    return p.select("doc_id", "page_number", F.when(d % 3 == 0, crop).alias("crop_box"),
                    F.when(d % 2 == 0, media).alias("media_box"),
                    F.when(d % 5 < 4, (d % 4 * 90).cast("int")).alias("rotate"))


def page_geometry(spark, sf):
    return C.page_geometry(_page_boxes(spark, sf)).select(
        "doc_id", F.col("page_number").cast("bigint").alias("page_number"), "width", "height",
        F.col("rotation").cast("bigint").alias("rotation"))


def document_rollup(spark, sf):
    rolled = C.roll_up(C.page_geometry(_page_boxes(spark, sf)))
    return rolled.select(
        "doc_id", "page_count",
        F.array_join(F.transform("pages", lambda p: F.concat_ws(
            ":", p["page_number"], F.round(p["width"]).cast("bigint"),
            F.round(p["height"]).cast("bigint"), p["rotation"])), ",").alias("pages"))


def url_filenames(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    header = F.concat(F.lit("attachment; filename=\""), "page_id", F.lit(".pdf\"; size="), "page_id")
    return p.select(
        "page_id", N.url_filename(F.col("url")).alias("from_url"),
        N.disposition_filename(F.when(F.col("page_id") % 2 == 0, header)
                               .otherwise(F.lit("inline"))).alias("from_header"))


def _spelled(k):
    """An address as one number, in hexadecimal, octal and with fewer parts."""
    v = k * 16777259 % 4294967296
    byte = [F.floor(v / 256 ** i) % 256 for i in (3, 2, 1, 0)]
    octal = F.concat_ws(".", *[F.concat(F.lit("0"), F.conv(b.cast("string"), 10, 8)) for b in byte])
    forms = [v.cast("string"), F.concat(F.lit("0x"), F.lower(F.hex(v))), octal,
             F.concat_ws(".", byte[0], v % 16777216),
             F.concat_ws(".", byte[0], F.concat(F.lit("0X"), F.hex(byte[1])), v % 65536)]
    return F.concat(F.lit("http://"), F.element_at(F.array(*forms), (k % 5 + 1).cast("int")),
                    F.lit("/x"))


def _ipv6(k):
    tail = F.lower(F.hex(k % 65536))
    four = F.concat_ws(".", k * 7 % 256, k * 13 % 256, k % 251, F.lit(9))
    forms = [F.concat(F.lit("::ffff:"), four), F.concat(F.lit("fd00::"), tail),
             F.concat(F.lit("2001:DB8::"), tail, F.lit(":1")), F.concat(F.lit("fe80::1:"), tail),
             F.lit("::1"), F.concat(F.lit("ff02:0:0:0:0:0:0:"), tail), F.concat(F.lit("::"), four),
             F.concat(F.lit("2a00:1:2:3:4:5:6:"), tail), F.concat(F.lit("1::2::"), tail)]
    return F.concat(F.lit("https://["), F.element_at(F.array(*forms), (k % 9 + 1).cast("int")),
                    F.lit("]:443/"))


def url_safety(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    k = F.col("page_id")
    literal = F.concat(F.lit("http://"), k % 256, F.lit("."), k * 7 % 256, F.lit("."),
                       k * 13 % 256, F.lit("."), k % 11, F.lit(":8080/x"))
    local = F.concat(F.lit("https://h"), k,
                     F.element_at(F.array(F.lit(".internal"), F.lit(".local/a"), F.lit(".org")),
                                  (k % 3 + 1).cast("int")))
    return p.select("page_id", N.url_host(F.col("url")).alias("host"),
                    N.url_is_safe(F.col("url")).alias("url_ok"),
                    N.url_is_safe(literal).alias("literal_ok"),
                    N.url_is_safe(local).alias("local_ok"),
                    N.url_is_safe(_spelled(k)).alias("spelled_ok"),
                    N.url_is_safe(_ipv6(k)).alias("ipv6_ok"))


def path_checks(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    path = F.regexp_replace("url", "^https?:/", "")
    path = F.when(F.col("page_id") % 4 == 0, F.concat(path, F.lit("/../x"))).otherwise(path)
    bucket, key = corpus.bucket_and_key(path)
    return p.select("page_id", N.is_traversal(path).alias("traversal"),
                    N.strip_root(path).alias("relative"), bucket.alias("bucket"), key.alias("key"),
                    corpus.sidecar_path(path).alias("sidecar"),
                    corpus.sidecar_path(path, "s3").alias("s3_sidecar"),
                    corpus.version_path(path, F.lit("v2.pdf")).alias("version"))


PERMS = ["read-only", "download", "read-only,download", "no-download", "read-only,no-download", None]
_PERM_SQL = "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in PERMS) + "]"


def download_permissions(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    perms = F.element_at(F.array(*[F.lit(p) for p in PERMS]),
                         (F.col("event_id") % len(PERMS) + 1).cast("int"))
    return e.select("event_type", perms.alias("permissions")).groupBy(
        "event_type", N.may_download(F.col("permissions")).alias("allowed")).agg(
        F.count("*").alias("requests"))


def request_caps(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    kinds = F.array(*[F.lit(k) for k in C.CAPS])
    req = o.select(
        F.col("o_orderkey").alias("request_id"),
        F.element_at(kinds, (F.col("o_orderkey") % len(C.CAPS) + 1).cast("int")).alias("kind"),
        (F.floor(F.col("o_totalprice") / 7) % 60000).alias("amount"))
    return C.caps_violations(req).groupBy("reason").agg(F.count("*").alias("rejected"))


def corpus_profile(spark, sf):
    files = _files(spark, sf).withColumn("n_bytes", F.octet_length("content").cast("bigint"))
    pages = X.page_count(X.line_count(X.raw_lines(F.col("content")))).cast("bigint")
    return C.profile(C.route(files.withColumn("page_count", pages)))


def corpus_files(spark, sf):
    """Documents written as files, a third with sidecars and a fifth with a new version, and read
    back in byte ranges; files above a limit are listed without being opened."""
    d = table(spark, sf, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    root = fresh_folder(spark, "files")
    path = F.concat(F.lit("in/"), F.col("doc_id") % 10, F.lit("/"), "doc_id", F.lit(".txt"))
    rawfiles.save_files(d.select(path.alias("path"), "content"), root)
    corpus.save_sidecars(d.where("doc_id % 3 = 0").select(
        path.alias("path"), F.concat(F.lit("<xfdf>"), "doc_id").alias("xfdf")), root)
    corpus.save_versions(d.where("doc_id % 5 = 0").select(
        path.alias("path"), F.concat("doc_id", F.lit("-2.txt")).alias("filename"),
        F.concat(F.lit("2 ").cast("binary"), "content").alias("content")), root)
    ranges, rejects = rawfiles.split_by_size(spark, root, 20_000, 4096)
    read = rawfiles.whole_files(ranges).select(
        "path", "size", "n_ranges", F.sha2("content", 256).alias("sha256"),
        F.lit(None).cast("string").alias("reason"))
    return read.unionByName(rejects.drop("modified"), allowMissingColumns=True)


def store_notes(spark, sf):
    """Files of a store with the text of their sidecars, all read from files."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.encode("text", "utf-8").alias("content"))
    root = fresh_folder(spark, "store")
    path = F.concat("lang", F.lit("/"), "doc_id", F.lit(".pdf"))
    rawfiles.save_files(d.select(path.alias("path"), "content"), root)
    corpus.save_sidecars(d.where("doc_id % 4 = 0").select(
        path.alias("path"), F.concat(F.lit("<xfdf>"), "lang").alias("xfdf")), root)
    # the same sidecars saved again replace the files
    corpus.save_sidecars(d.where("doc_id % 8 = 0").select(
        path.alias("path"), F.concat(F.lit("<xfdf>"), "doc_id").alias("xfdf")), root)
    notes = rawfiles.whole_files(rawfiles.read_ranges(spark, root).where(
        F.col("path").endswith(".xfdf"))).select("path", "content")
    files = rawfiles.list_files(spark, root).where(~F.col("path").endswith(".xfdf"))
    return corpus.attach_sidecars(files.select("path", "size", F.lit(None).cast("binary").alias(
        "content")).unionByName(notes, allowMissingColumns=True))


def sidecar_notes(spark, sf):
    """Documents of a store joined with their annotation sidecars, every third has one."""
    d = table(spark, sf, "documents").select("doc_id", "lang", "text")
    name = F.concat(F.lit("/store/"), "lang", F.lit("/"), "doc_id", F.lit(".pdf"))
    files = d.select(name.alias("path"), F.encode("text", "utf-8").alias("content")).unionAll(
        d.where("doc_id % 3 = 0").select(
            corpus.sidecar_path(name), F.encode(F.concat(F.lit("<xfdf>"), "lang"), "utf-8")))
    return corpus.attach_sidecars(files)


def annotation_save(spark, sf):
    """All documents saved, a third saved again, some of them without annotations."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), "event_id")
    path = fresh_folder(spark, "annotations")
    corpus.save_annotations(e, e.withColumn("version", F.lit(1)), path, 1)
    again = e.where("doc_id % 3 = 0")
    corpus.save_annotations(
        again, again.where("doc_id % 2 = 0 and event_id % 2 = 0").withColumn("version", F.lit(2)),
        path, 2)
    return corpus.read_annotations(spark, path)


def connector_mappings(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    json = corpus.mapping_json(
        F.when(F.col("o_orderkey") % 2 == 0, "s3").otherwise(F.lit("filesystem")),
        F.concat(F.lit("bucket"), F.col("o_custkey") % 10, F.lit("/doc\""), "o_orderkey"),
        F.create_map(F.lit("status"), "o_orderstatus"))
    m = corpus.parse_mapping(F.col("json"))
    return o.select("o_orderkey", json.alias("json")).select(
        "o_orderkey", m["connector"].alias("connector"), m["resource_id"].alias("resource_id"),
        m["extra_params"]["status"].alias("status"))


def catalog_sidecars(spark, sf):
    """Catalog sidecar texts written and read back."""
    d = C.identify(_files(spark, sf))
    meta = d.select(F.concat(F.lit("/store/"), "content_id", F.lit(".meta")).alias("path"),
                    corpus.meta_text(F.col("clean_name"), F.col("ext")).alias("value"))
    return corpus.parse_meta(meta).distinct()


def document_versions(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.struct("o_orderdate", "o_orderkey").alias("version"),
        "o_orderkey")
    return corpus.latest_versions(o).select("doc_id", F.col("o_orderkey").alias("latest"))


QUERIES = {f.__name__: f for f in (
    catalog_ids, catalog_dedup, catalog_merged, catalog_formats, catalog_lookup, catalog_expired,
    catalog_survivors, catalog_cascade, page_geometry, document_rollup, url_filenames, url_safety,
    path_checks, download_permissions, request_caps, corpus_profile, corpus_files, store_notes,
    sidecar_notes,
    annotation_save,
    connector_mappings, catalog_sidecars, document_versions)}

FILES = rf"""
files AS (
  SELECT doc_id, text AS content, {_EXT_SQL}[doc_id % {len(EXTS)} + 1] AS e,
         lang || '_' || (doc_id % 50) || '.' || {_EXT_SQL}[doc_id % {len(EXTS)} + 1] AS clean_name,
         substr(sha256(text), 1, 16) AS content_id FROM documents),
ided AS (
  SELECT *, regexp_extract(clean_name, '[.]([^.]*)$', 1) AS ext FROM files)
"""


def _family_case(col="lower(ext)"):
    whens = " ".join(f"WHEN {col} IN ({', '.join(repr(e) for e in exts)}) THEN '{fam}'"
                     for fam, exts in N.FAMILIES.items())
    return f"(CASE {whens} ELSE 'text' END)"


def _mime_case(mapping, default, col="lower(ext)"):
    whens = " ".join(f"WHEN {col} = '{e}' THEN '{m}'" for e, m in mapping.items())
    return f"(CASE {whens} ELSE {default} END)"


STORED = """
stored AS (
  SELECT substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) AS id, o_orderkey, o_orderdate, n,
         substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16) ||
         ['.pdf', '.meta', '.xfdf', '.connector', '.docx.rendition.pdf', '.tmp'][n + 1] AS name,
         o_orderdate + to_days(CAST(n AS INT)) AS mtime
  FROM orders, (SELECT unnest(range(6)) AS n)),
old AS (SELECT *, floor(epoch(TIMESTAMP '%s' - mtime)) > %d AS is_old FROM stored),
dead AS (SELECT DISTINCT id FROM old WHERE n = 1 AND is_old),
gone AS (
  SELECT old.* FROM old LEFT JOIN dead ON dead.id = old.id
  WHERE dead.id IS NOT NULL OR (is_old AND n IN (4, 5)))
""" % (NOW, TTL)

BOXES = """
pg AS (
  SELECT doc_id, unnest(range(1, 1 + greatest(1, CAST(ceil((len(string_split_regex(text, '\\r?\\n'))
    - CAST(text = '' OR regexp_matches(text, '\\n$') AS INT)) / 48.0) AS BIGINT)))) AS page_number
  FROM documents),
ext AS (
  SELECT doc_id, page_number,
    CAST(CASE WHEN doc_id % 3 = 0 THEN abs(5 - doc_id % 30) WHEN doc_id % 2 = 0 THEN 600 + doc_id % 50
         ELSE 595 END AS DOUBLE) AS w,
    CAST(CASE WHEN doc_id % 3 = 0 THEN 700 + page_number - 20
         WHEN doc_id % 2 = 0 THEN 900 - page_number - 10 ELSE 842 END AS DOUBLE) AS h,
    CASE WHEN doc_id % 5 < 4 THEN doc_id % 4 * 90 ELSE 0 END AS rotation FROM pg),
geo AS (
  SELECT doc_id, page_number, CASE WHEN rotation IN (90, 270) THEN h ELSE w END AS width,
         CASE WHEN rotation IN (90, 270) THEN w ELSE h END AS height, rotation FROM ext)
"""

_AFTER_Q = "split_part(url, '?', len(string_split(url, '?')))"
_LAST = f"string_split({_AFTER_Q}, '/')[-1]"

SQL = {
    "corpus_files": """
WITH f AS (
  SELECT 'in/' || doc_id % 10 || '/' || doc_id || '.txt' AS path, encode(text) AS content FROM documents
  UNION ALL SELECT 'in/' || doc_id % 10 || '/' || doc_id || '.xfdf', encode('<xfdf>' || doc_id)
  FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT 'in/' || doc_id % 10 || '/' || doc_id || '-2.txt',
                   encode('2 ' || text) FROM documents WHERE doc_id % 5 = 0),
s AS (SELECT *, octet_length(content) AS size FROM f)
SELECT path, size, CASE WHEN size <= 20000 THEN greatest(1, CAST(ceil(size / 4096) AS BIGINT)) END
         AS n_ranges,
       CASE WHEN size <= 20000 THEN sha256(content) END AS sha256,
       CASE WHEN size > 20000 THEN 'too_large' END AS reason FROM s""",
    "store_notes": """
SELECT lang || '/' || doc_id || '.pdf' AS path, CAST(strlen(text) AS BIGINT) AS size,
       CASE WHEN doc_id % 8 = 0 THEN '<xfdf>' || doc_id WHEN doc_id % 4 = 0 THEN '<xfdf>' || lang END
         AS xfdf FROM documents""",
    "sidecar_notes": """
SELECT '/store/' || lang || '/' || doc_id || '.pdf' AS path,
       CASE WHEN doc_id % 3 = 0 THEN '<xfdf>' || lang END AS xfdf FROM documents""",
    "annotation_save": """
SELECT user_id AS doc_id, event_id, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END AS version
FROM events WHERE user_id % 3 <> 0 OR (user_id % 2 = 0 AND event_id % 2 = 0)""",
    "catalog_ids": f"""WITH {FILES}
SELECT doc_id, content_id, clean_name, ext, true AS id_ok, false AS name_ok FROM ided""",
    "catalog_dedup": f"""WITH {FILES}
SELECT content_id, ext, min(doc_id) AS stored_key, arg_max(clean_name, doc_id) AS filename,
       count(*) AS copies, CAST(min(strlen(content)) AS BIGINT) AS n_bytes
FROM ided GROUP BY 1, 2""",
    "catalog_formats": f"""WITH {FILES}
SELECT doc_id, lower(ext) AS ext, {_family_case()} AS family,
  {_family_case()} = 'video' AS is_video, {_family_case()} = 'audio' AS is_audio,
  {_mime_case(N.MIME_READ, "'application/octet-stream'")} AS mime_read,
  {_mime_case({**N.MIME_METADATA, "png": "image/png"}, "'application/pdf'")} AS mime_metadata,
  {_mime_case(N.MIME_DOWNLOAD, "'application/octet-stream'")} AS mime_download,
  CASE WHEN {_family_case()} = 'office' THEN CASE WHEN lower(ext) IN ('docx', 'xlsx', 'pptx')
    AND strlen(content) * 4000 < 5242880
    AND NOT (lower(ext) = 'docx' AND regexp_matches(content, 'wrapTight|wrapPolygon|wrapSquare|wrapThrough'))
    THEN 'fast' ELSE 'high_fidelity' END END AS office_engine FROM ided""",
    "catalog_lookup": f"""WITH {STORED}
SELECT id AS doc_id, name FROM stored WHERE n IN (0, 5)
  AND id IN (SELECT substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 16) FROM customer)""",
    "catalog_expired": f"WITH {STORED} SELECT id AS doc_id, name, mtime FROM gone",
    "catalog_survivors": f"""WITH {STORED}
SELECT name FROM stored WHERE name NOT IN (SELECT name FROM gone)""",
    "catalog_cascade": f"""WITH {STORED}
SELECT id AS doc_id, o_orderkey FROM stored WHERE n = 2
  AND id NOT IN (SELECT id FROM gone WHERE n = 1)""",
    "page_geometry": f"WITH {BOXES} SELECT doc_id, page_number, width, height, rotation FROM geo",
    "document_rollup": f"""WITH {BOXES}
SELECT doc_id, count(*) AS page_count, string_agg(page_number || ':' || CAST(width AS BIGINT) || ':'
  || CAST(height AS BIGINT) || ':' || rotation, ',' ORDER BY page_number) AS pages
FROM geo GROUP BY 1""",
    "url_filenames": f"""
SELECT page_id, CASE WHEN contains({_LAST}, '.') THEN {_LAST} ELSE 'remote_document.pdf' END AS from_url,
       CASE WHEN page_id % 2 = 0 THEN page_id || '.pdf' END AS from_header FROM pages""",
    "url_safety": """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#:]*)', 1) AS host,
  page_id % 256 AS a, page_id * 7 % 256 AS b, page_id * 16777259 % 4294967296 AS v,
  page_id * 7 % 256 AS c, page_id * 13 % 256 AS d FROM pages)
SELECT page_id, host, host <> '' AND host <> 'localhost'
         AND NOT regexp_matches(host, '[.](localhost|local|internal)$') AS url_ok,
  NOT (a IN (0, 10, 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
       OR (a = 192 AND b = 168) OR a >= 224) AS literal_ok,
  page_id % 3 = 2 AS local_ok,
  NOT (v >> 24 IN (0, 10, 127) OR v >> 16 = 43518 OR v >> 20 = 2753 OR v >> 16 = 49320
       OR v >> 24 >= 224) AS spelled_ok,
  CASE WHEN page_id % 9 IN (2, 7) THEN true
       WHEN page_id % 9 IN (0, 6) THEN NOT (c IN (0, 10, 127) OR (c = 169 AND d = 254)
         OR (c = 172 AND d BETWEEN 16 AND 31) OR (c = 192 AND d = 168) OR c >= 224)
       ELSE false END AS ipv6_ok FROM p""",
    "path_checks": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^https?:/', '')
             || CASE WHEN page_id % 4 = 0 THEN '/../x' ELSE '' END AS path FROM pages),
c AS (SELECT *, regexp_replace(path, '^[/]+', '') AS rel FROM p)
SELECT page_id, contains(path, '..') AS traversal, rel AS relative,
  CASE WHEN contains(rel, '/') THEN split_part(rel, '/', 1) END AS bucket,
  CASE WHEN contains(rel, '/') THEN regexp_replace(rel, '^[^/]*/', '') END AS key,
  regexp_replace(path, '([^/])[.][^./]*$', '\1') || '.xfdf' AS sidecar,
  path || '.xfdf' AS s3_sidecar,
  CASE WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN 'v2.pdf'
       ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) || '/v2.pdf' END AS version FROM c""",
    "download_permissions": f"""
WITH p AS (SELECT event_type, {_PERM_SQL}[event_id % {len(PERMS)} + 1] AS perms FROM events)
SELECT event_type, NOT coalesce(contains(perms, 'no-download')
    OR (contains(perms, 'read-only') AND NOT contains(perms, 'download')), false) AS allowed,
  count(*) AS requests FROM p GROUP BY 1, 2""",
    "request_caps": """
WITH r AS (SELECT o_orderkey, ['page', 'annotations', 'redactions', 'sources', 'actions',
    'query_bytes', 'form_values'][o_orderkey % 7 + 1] AS kind,
    [1, 0, 0, 1, 0, 0, 0][o_orderkey % 7 + 1] AS lo,
    [50000, 10000, 2000, 50, 5000, 500, 1000][o_orderkey % 7 + 1] AS hi,
    CAST(floor(o_totalprice / 7) AS BIGINT) % 60000 AS amount FROM orders)
SELECT CASE WHEN amount < lo THEN kind || '_below_' || lo ELSE kind || '_above_' || hi END AS reason,
  count(*) AS rejected FROM r WHERE amount < lo OR amount > hi GROUP BY 1""",
    "corpus_profile": f"""WITH {FILES},
f AS (SELECT {_family_case()} AS family, lower(ext) AS ext, strlen(content) AS n_bytes,
  greatest(1, CAST(ceil((len(string_split_regex(content, '\\r?\\n'))
    - CAST(content = '' OR regexp_matches(content, '\\n$') AS INT)) / 48.0) AS BIGINT)) AS pages FROM ided)
SELECT family, ext, count(*) AS documents, CAST(sum(n_bytes) AS BIGINT) AS bytes,
  CAST(sum(pages) AS BIGINT) AS pages FROM f GROUP BY ROLLUP (family, ext)""",
    "connector_mappings": """
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 's3' ELSE 'filesystem' END AS connector,
  'bucket' || (o_custkey % 10) || '/doc"' || o_orderkey AS resource_id,
  o_orderstatus AS status FROM orders""",
    "catalog_sidecars": f"""WITH {FILES}
SELECT DISTINCT content_id AS doc_id, clean_name AS filename, ext FROM ided""",
    "document_versions": """
SELECT o_custkey AS doc_id, o_orderkey AS latest FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
}

SQL["catalog_merged"] = SQL["catalog_dedup"]
