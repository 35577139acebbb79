"""Operator 7: content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; exact record headers are stored apart with that key, and records are
rebuilt by joining the two. Of the records with equal payloads the one with the largest page_id is a response, the
others are revisits that refer to it. Equality is verified: a row whose digest is shared is compared with the stored
bytes, and would get a store entry of its own if they differed.

Edge cases: null html counts as empty; rows that repeat the largest page_id of a payload are all responses (the payload
is still stored once); a null page_id is smaller than any other; a null url leaves the target line out, and line breaks
in a url are percent-encoded; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, sized, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value: base32 of RFC 4648
CRLF = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: 160 bits as 8 groups of 20 bits, 4 letters each."""
    digest = F.sha1(data)
    letters = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def headers(date: str) -> Column:
    """The exact header block of a record, up to and with the empty line."""
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    parts = [
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", page("page_id")),
        _line("WARC-Date", F.lit(date)),
        F.coalesce(_line("WARC-Target-URI", url), F.lit("")),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        F.when(revisit, _line("WARC-Refers-To", page("refers_to"))).otherwise(""),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("Content-Length", F.col("bytes").cast("string")),
        F.lit(CRLF),
    ]
    return F.encode(reduce(lambda a, b: F.concat(a, b), parts), "UTF-8")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write ``path``/payloads (store key, bytes) and ``path``/headers (page_id, store key, header bytes)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("top"))
    shared = written(shared.where("n > 1").select("key", "top"), "shared").withColumn("many", F.lit(True))
    n_shared = shared.count()
    tagged = rows.join(sized(shared, n_shared), "key", "left")
    lead = F.col("page_id").eqNullSafe(F.col("top"))
    alone = tagged.where("many is null")
    stored = tagged.where(F.col("many") & lead).groupBy("key").agg(F.first("payload").alias("stored"))
    stored = written(stored, "stored")
    again = tagged.where(F.col("many")).join(sized(stored), "key")
    same = F.col("payload") == F.col("stored")
    again = again.withColumn("own", F.when(same, F.col("key")).otherwise(F.concat_ws(":", "key", "page_id")))
    odd = again.where("own <> key").select(F.col("own").alias("key"), "payload")
    alone_store = alone.where(F.col("bytes") >= least_bytes).select("key", "payload")
    small = alone.where(F.col("bytes") < least_bytes).groupBy("key").agg(F.first("payload").alias("payload"))
    store = alone_store.unionByName(small).unionByName(stored.withColumnRenamed("stored", "payload")).unionByName(odd)
    store.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/payloads")
    first = F.lit("response")
    kind = F.when(same & ~lead, F.lit("revisit")).otherwise(first)
    heads = alone.withColumn("own", F.col("key")).withColumn("record_type", first).withColumn("refers_to", F.lit(None).cast("long"))
    others = again.withColumn("record_type", kind).withColumn("refers_to", F.when(kind == "revisit", F.col("top")))
    cols = ["page_id", "url", F.col("own").alias("key"), "record_type", "refers_to", base32_sha1(F.col("payload")).alias("digest"), "bytes"]
    both = heads.select(*cols).unionByName(others.select(*cols))
    both.select("page_id", "key", headers(date).alias("header")).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark, path: str) -> DataFrame:
    """page_id, header and payload of every record, by joining headers to the stored payloads."""
    heads = spark.read.schema("page_id long, key string, header binary").parquet(f"{path}/headers")
    store = spark.read.schema("key string, payload binary").parquet(f"{path}/payloads")
    return heads.join(store, "key").select("page_id", "header", "payload")


def records(read: DataFrame) -> DataFrame:
    """``read`` with the exact bytes of each record."""
    return read.withColumn("record", F.concat("header", "payload", F.encode(F.lit(CRLF + CRLF), "UTF-8")))


def archive_digest(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write the archive of ``pages``, read it back, and describe each record from what was read.

    A record whose payload does not match the digest and length in its header fails the query.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "archive")
    write_archive(pages, path, **how)
    head = F.decode("header", "UTF-8")
    field = lambda name, value: F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1)
    read = read_archive(spark, path).select(
        "page_id",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        field("WARC-Type", "([a-z]+)").alias("record_type"),
        F.nullif(field("WARC-Refers-To", "<urn:page:(-?[0-9]+)>"), F.lit("")).cast("long").alias("refers_to"),
        field("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("said"),
        field("Content-Length", "([0-9]+)").cast("long").alias("said_bytes"),
    )
    sound = (F.col("said") == F.col("payload_digest")) & (F.col("said_bytes") == F.col("payload_bytes"))
    checked = F.when(sound, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a stored payload does not match its header")).cast("string"))
    return read.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")
