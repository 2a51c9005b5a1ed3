"""Web archives: writing captures as WARC records, and reading archives back to one nested row per capture.

A capture is a response (or a revisit, when an equal payload is archived already) with the request and the metadata records
that name it in ``WARC-Concurrent-To``. Archives are gzip files of records, written and read by Spark's text source, so any
file system that Spark reaches will do and no file is ever held whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from .tables import fixed_bitmap, stored

# Fixed values of the format.
VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = T.StructType([T.StructField(c, T.StringType()) for c in (
    "record_type", "record_id", "concurrent_to", "refers_to", "target_uri", "date", "payload_digest", "http_head")]
    + [T.StructField("payload", T.BinaryType())])


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each 40 bits are ten hexadecimal or eight base-32 digits."""
    h = F.sha1(payload)
    part = [F.lpad(F.conv(F.substring(h, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*part), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _uuid(*key: Column) -> Column:
    h = F.md5(F.concat_ws("\x1f", *[F.coalesce(k.cast("string"), F.lit("\x1e")) for k in key]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(">"))


def _record(kind: str, rid: Column, head: list[Column], block: Column) -> Column:
    """One record without its closing blank lines. ``head``: further header lines, null ones are left out."""
    size = F.octet_length(block).cast("string")
    lines = F.concat_ws("\r\n", F.lit(f"WARC-Type: {kind}"), F.concat(F.lit("WARC-Record-ID: "), rid), *head, F.concat(F.lit("Content-Length: "), size))
    return F.concat(F.lit(VERSION), lines, F.lit(END), block)


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value))


def captures_of(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with digest and the archive's decisions: is_revisit, own id and refers_to id.

    Null html is an empty payload. Of equal payloads of at least ``min_bytes`` bytes the row with the largest (page_id, url) is the
    response, of repeated rows one of them; the others revisit it. Only pages whose digest occurs more than once, found through a
    bitmap of fixed size, are brought together.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    base = (pages.select("page_id", F.regexp_replace(F.regexp_replace(F.col("url").cast("string"), "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
            .withColumn("digest", base32_sha1(F.col("html").cast("binary"))).withColumn("check", F.xxhash64("html")))
    key = ["digest", "check"]
    # stored, as it is read twice: the payloads are digested once for it
    shared = stored(base.where(F.octet_length("html") >= min_bytes).groupBy(*key)
                    .agg(F.max(F.struct("page_id", "url")).alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated")
    bits = fixed_bitmap(shared.select(F.col("check").alias("h")))
    flags = base.sparkSession.createDataFrame([(i, int(w)) for i, w in enumerate(bits.words.tolist()) if w], "__at long, __word long")
    slot = F.pmod(F.col("check"), F.lit(bits.BITS))
    marked = (base.withColumn("__slot", slot).join(F.broadcast(flags), F.shiftright("__slot", 6) == F.col("__at"), "left")   # at most 131,072 rows
              .withColumn("__maybe", F.coalesce(F.expr("shiftrightunsigned(__word, cast(__slot & 63 as int)) & 1") == 1, F.lit(False))).drop("__slot", "__at", "__word"))
    single = marked.where("not __maybe").select("page_id", "url", "html", *key, F.lit(0).alias("nth"), F.lit(None).cast(shared.schema["keep"].dataType).alias("keep"))
    # equal rows are numbered; they differ in nothing, so it does not matter which has which number
    nth = F.row_number().over(Window.partitionBy(*key, "page_id", "url").orderBy("check")) - 1
    joined = (marked.where("__maybe").join(shared, key, "left").withColumn("nth", nth).select("page_id", "url", "html", *key, "nth", "keep"))
    keeper = F.col("page_id").eqNullSafe(F.col("keep.page_id")) & F.col("url").eqNullSafe(F.col("keep.url")) & (F.col("nth") == 0)
    ids = [F.col("digest"), F.col("check")]
    return (single.unionByName(joined)
            .withColumn("is_revisit", F.col("keep").isNotNull() & ~keeper & (F.octet_length("html") >= min_bytes))
            .withColumn("record_id", _uuid(F.lit("capture"), F.col("page_id"), F.col("url"), *ids, F.col("nth")))
            .withColumn("refers_to", F.when(F.col("is_revisit"), _uuid(F.lit("capture"), F.col("keep.page_id"), F.col("keep.url"), *ids, F.lit(0))))
            .drop("keep", "check", "nth"))


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", per_file: int = 20_000) -> None:
    """Write three records for each page to gzip archives under ``path``: request, response or revisit, metadata."""
    c = captures_of(pages, min_bytes)
    uri, own, when = _line("WARC-Target-URI", F.col("url")), F.col("record_id"), F.lit(f"WARC-Date: {date}")
    with_it = F.concat(F.lit("WARC-Concurrent-To: "), own)
    digest = F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"))
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.lit(""))
    asked = F.concat(F.lit("GET "), F.coalesce("url", F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit(END))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    main = F.when(F.col("is_revisit"), _record("revisit", own, [when, uri, digest, F.lit(f"WARC-Profile: {REVISIT_PROFILE}"), _line("WARC-Refers-To", F.col("refers_to")),
                                                               F.lit("Content-Type: application/http; msgtype=response")], http)
                  ).otherwise(_record("response", own, [when, uri, digest, F.lit("Content-Type: application/http; msgtype=response")], F.concat(http, F.col("html"))))
    request = _record("request", _uuid(F.lit("request"), own), [when, uri, with_it, F.lit("Content-Type: application/http; msgtype=request")], asked)
    meta = _record("metadata", _uuid(F.lit("metadata"), own), [when, uri, with_it, F.lit("Content-Type: application/warc-fields")],
                   F.concat(F.lit("page_id: "), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\r\n")))
    rows = c.select(F.concat(request, F.lit(END), main, F.lit(END), meta).alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def parse_record(record: bytes) -> tuple | None:
    """The fields of RECORD from one record after its version line; None when it is cut short."""
    at = record.find(b"\r\n\r\n")
    if at < 0:
        return None
    head = {}
    for line in record[:at].split(b"\r\n"):
        name, _, value = line.partition(b":")
        head[name.strip().lower()] = value.strip().decode("utf-8", "replace")
    size = int(head.get(b"content-length", "0"))
    block = record[at + 4:at + 4 + size]
    if len(block) < size:
        return None
    http, payload = None, block
    if head.get(b"content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        cut = len(block) if cut < 0 else cut + 4
        http, payload = block[:cut].decode("utf-8", "replace"), block[cut:]
    digest = head.get(b"warc-payload-digest")
    return (head.get(b"warc-type"), head.get(b"warc-record-id"), head.get(b"warc-concurrent-to"), head.get(b"warc-refers-to"),
            head.get(b"warc-target-uri"), head.get(b"warc-date"), digest.removeprefix("sha1:") if digest else None, http, payload)


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The records (RECORD) of the gzip archives under ``path``, of the given types.

    Spark streams each archive cut at version lines; where a block contains such a line, the stretches are joined again
    until the record has its Content-Length. A gzip file is read in order by one task, however many records it has.
    """
    raw = spark.read.option("lineSep", VERSION).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("value"))

    def run(batches):
        kept, size, open_ = [], 0, b""
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if f.name == "payload" else pa.string()) for k, f in enumerate(RECORD)], names=RECORD.names)
        for b in batches:
            for v in b.column(0):
                piece = v.as_py()
                if not piece and not open_:
                    continue
                open_ = piece if not open_ else open_ + VERSION.encode() + piece
                got = parse_record(open_)
                if got is None:
                    continue
                open_ = b""
                if kinds is None or got[0] in kinds:
                    kept.append(got)
                    size += len(got[8]) + 500
                if size > 4 << 20:
                    yield out(kept)
                    kept, size = [], 0
        if open_:
            raise ValueError("an archive ends within a record")
        if kept:
            yield out(kept)

    return raw.mapInArrow(run, RECORD)


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: capture_id, response (response or revisit record, null for a capture without one),
    requests and metadata (records that name it in WARC-Concurrent-To, by record id).

    The archives are read once. Records meet by the capture they name and are sorted, the response first; it gets the small ones
    beside it. Records whose capture is not in the archive still give a row. Responses that share an id are a row each.
    """
    records = read_records(spark, path, ("response", "revisit", "request", "metadata"))
    main = F.col("record_type").isin("response", "revisit")
    capture = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    by = Window.partitionBy("capture_id", "lone").orderBy("after")
    every = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def beside(kind: str) -> Column:
        small = F.struct("record_id", "target_uri", "date", "http_head", "payload")
        got = F.sort_array(F.collect_list(F.when(F.col("kind") == kind, small)).over(every))
        return F.when(F.size(got) > 0, got)

    # columns of their own, so that both windows share one shuffle and one sort; without an id nothing belongs together, but small records of one type
    rows = (records.withColumn("capture_id", capture).withColumn("kind", F.when(main, F.lit("response")).otherwise(F.col("record_type")))
            .withColumn("lone", F.when(F.col("capture_id").isNull(), F.col("kind"))).withColumn("after", F.col("kind") != "response")
            .withColumn("requests", beside("request")).withColumn("metadata", beside("metadata")).withColumn("nth", F.row_number().over(by)))
    response = F.when(F.col("kind") == "response", F.struct(*[f"`{c}`" for c in RECORD.names]))
    return rows.where("kind = 'response' or nth = 1").select("capture_id", response.alias("response"), "requests", "metadata")
