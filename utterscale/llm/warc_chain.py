"""WARC archives, and reading them back by boundary-chain verification.

Archives are cut at every occurrence of the magic line, also inside payloads. Each cut is a
candidate record; its header gives the offset of its successor. Pointer jumping from the
start of every file keeps the candidates that are reachable, so a magic line inside a
payload, even a whole fake record, is rejected.

Defined cases: null html is an empty payload; line breaks in a URL are percent-encoded; a
null page id is written as ``null`` and is never referred to; rows that repeat the smallest
page id of a payload are responses too; an empty table gives no rows; extra columns are
ignored. Everything is DataFrame functions.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterscale.llm.common import written

MAGIC = "WARC/1.0\r\n"
BREAK = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
RECORDS_PER_FILE = 1000


def base32_sha1(text: Column) -> Column:
    """Upper-case base32 of the SHA-1: four times ten hex digits are eight base32 digits."""
    digest = F.sha1(text.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _records(pages: DataFrame, min_bytes: int) -> DataFrame:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), html.alias("html"),
                        base32_sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    # only digests of several pages: without copies no page moves
    first = written(rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
                    .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
                    .where("n > 1 AND first_id IS NOT NULL").drop("n"), "payloads")
    return rows.join(first, ["digest", "bytes"], "left").withColumn(
        "revisit", F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per page; pages with the payload of another page revisit the smallest id."""
    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    def urn(page_id: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))

    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    length = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("bytes")) + len(HTTP)
    record = F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(F.col("revisit"), F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")),
            line("WARC-Refers-To", urn(F.col("first_id"))))).otherwise(""),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")), F.lit("\r\n" + HTTP),
        F.when(F.col("revisit"), "").otherwise(F.col("html")))
    (_records(pages, min_bytes).select(record.alias("value")).write
     .option("lineSep", BREAK).option("maxRecordsPerFile", records_per_file).text(path))


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, row, value``: the text between magic lines, in file order by (block, row)."""
    return (spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", True).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"), "value"))


def _parsed(value: Column) -> list[Column]:
    head = F.substring_index(value, BREAK, 1)
    rest = F.substring(value, F.length(head) + 5, F.greatest(F.length(value) - F.length(head) - 8, F.lit(0)))
    payload = F.substring(rest, F.length(F.substring_index(rest, BREAK, 1)) + 5, F.length(rest))

    def field(name: str, what: str) -> Column:
        found = F.regexp_extract(head, f"(?:^|\r\n){name}: {what}(?:\r\n|$)", 1)
        return F.when(found != "", found)

    size = F.octet_length(head) + 8 + len(MAGIC) + field("Content-Length", "([0-9]{1,15})").cast("long")
    return [F.octet_length(value).cast("long").alias("length"),
            F.when(F.instr(value, BREAK) > 0, size).alias("size"),
            field("WARC-Type", "([a-z]+)").alias("record_type"),
            field("WARC-Record-ID", "<urn:page:([^>]*)>").alias("page"),
            field("WARC-Refers-To", "<urn:page:([^>]*)>").alias("refers"),
            field("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("declared_digest"),
            field("X-Payload-Length", "([0-9]{1,15})").cast("long").alias("declared_bytes"),
            F.octet_length(payload).cast("long").alias("payload_bytes"), base32_sha1(payload).alias("digest")]


def _located(cuts: DataFrame) -> DataFrame:
    """Adds ``at``, the offset of the magic line before each cut; what comes before the first
    magic line has none. Offsets are summed inside scan blocks, then over a file's blocks."""
    step = F.col("length") + len(MAGIC)
    earlier = W.unboundedPreceding, -1
    sizes = cuts.groupBy("file", "block").agg(F.sum(step).alias("_size"))
    bases = sizes.select("file", "block", F.coalesce(
        F.sum("_size").over(W.partitionBy("file").orderBy("block").rowsBetween(*earlier)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(step).over(W.partitionBy("file", "block").orderBy("row").rowsBetween(*earlier)), F.lit(0))
    return (cuts.withColumn("_in", inside).join(bases, ["file", "block"])
            .withColumn("at", F.col("_in") + F.col("_base") - len(MAGIC)).where("at >= 0")
            .drop("_in", "_base", "block", "row"))


def reachable(candidates: DataFrame) -> DataFrame:
    """``file, at`` of the records on the chain from the start of each file.

    ``candidates``: ``file, at, next``. After round k the first 2^k records of every chain
    are known; each round is written to the shared folder, so lineage stays short.
    """
    most = candidates.groupBy("file").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    known = candidates.where("at = 0").select("file", "at")
    jump = candidates.where("next IS NOT NULL").select("file", "at", "next")
    for _ in range(ceil(log2(most + 1)) if most else 0):
        known = written(known.union(known.join(jump, ["file", "at"]).select("file", "next")).distinct(), "chain")
        further = jump.select("file", F.col("at").alias("next"), F.col("next").alias("after"))
        jump = written(jump.join(further, ["file", "next"]).select("file", "at", F.col("after").alias("next")), "jump")
    return known


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``page, record_type, refers, payload_bytes, digest, declared_digest, declared_bytes``
    of every true record; sizes and digests are those of the payload found.

    A record that holds magic lines is put together from its cuts in a second pass over the
    files concerned. Runs jobs when called.
    """
    cuts = _cuts(spark, path)
    found = written(cuts.select("file", "block", "row", *_parsed(F.col("value"))), "cuts")
    located = written(_located(found).withColumn("next", F.col("at") + F.col("size")), "located")
    chain = reachable(located.select("file", "at", "next"))
    true = written(located.join(chain, ["file", "at"], "left_semi"), "records")
    fields = ["page", "record_type", "refers", "payload_bytes", "digest", "declared_digest", "declared_bytes"]
    broken = true.where(F.col("size") != F.col("length") + len(MAGIC)).select("file", "at", "next")
    whole = true.where(F.col("size") == F.col("length") + len(MAGIC)).select(*fields)
    if broken.isEmpty():
        return whole
    texts = _located(cuts.join(broken.select("file").distinct(), "file", "left_semi")
                     .withColumn("length", F.octet_length("value").cast("long")))
    # the record a cut belongs to is the last true one before it
    before = W.partitionBy("file").orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    owned = (texts.join(true.select("file", "at", F.col("next").alias("end")), ["file", "at"], "left")
             .select("file", "at", "value", F.last(F.when(F.col("end").isNotNull(), F.col("at")), True).over(before).alias("owner")))
    owners = broken.select("file", F.col("at").alias("owner"), F.col("next").alias("end"))
    joined = (owned.join(owners, ["file", "owner"]).where(F.col("at") < F.col("end")).groupBy("file", "owner")
              .agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
              .select(F.array_join(F.transform("parts", lambda p: p["value"]), MAGIC).alias("value")))
    return whole.unionByName(joined.select(*_parsed(F.col("value"))).select(*fields))


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the pages to archives below ``path``, read them back: ``page_id, payload_bytes,
    payload_digest, record_type, refers_to, digest_ok``. Revisits carry the declared figures."""
    write_archives(pages, path, min_bytes)
    rows = read_archives(pages.sparkSession, path)
    kind = pages.schema["page_id"].dataType
    revisit = F.col("record_type") == "revisit"
    return rows.select(
        F.when(F.col("page") != "null", F.col("page")).cast(kind).alias("page_id"),
        F.when(revisit, F.col("declared_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", F.col("refers").cast(kind).alias("refers_to"),
        (revisit | (F.col("digest") == F.col("declared_digest"))).alias("digest_ok"))
