"""WARC archives: a writer with revisits, and a reader that verifies the chain of boundaries.

Writing. Payloads of MIN_REVISIT bytes or more that are equal (SHA-256 and length) are stored
once, in the response record of the largest page_id; the others become revisit records that
refer to it and keep only their HTTP header, whose Content-Length still tells the payload's
length. Smaller payloads are always responses. Rows that tie for the largest page_id are all
responses. Null html is an empty payload; a null page_id or url is written as an empty one.
Files are made by Spark's own committed writer, gzipped, a bounded number of records each. Hashes
that occur twice or more are marked in a bitmap of fixed size, so that only payloads that may have
an equal are sent to where they meet it.

Reading. Tasks cut files at every record magic, wherever it stands, so a file needs no index
and an uncompressed one can be split. Each piece whose header is whole is a candidate: it tells
its own offset and, by Content-Length, its successor's. Magic inside payloads makes candidates
too. Pointer jumping from offset 0 of each file doubles the known part of the chain per round
and keeps only the candidates that are reached; a record's bytes are the pieces from its offset
up to its successor's. Records whose length runs past the end of their file are dropped with
what follows them, as nothing after them is verified. Offsets and owners are found split by split,
with one row for each split between them, so a large file is never one task's. A record of more
bytes than a value of Spark can hold (2 GB) has a null block.

Tables without rows make archives without records, which read as none. Pages' columns are taken by
name, and others left out, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.llm.common import forget, shared_dir, stored

MAGIC, VERSION, MIN_REVISIT, RECORDS_PER_FILE, CELLS = "WARC/", "1.1", 1000, 2000, 1 << 18
MOST_BYTES = (1 << 31) - 64
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))


def _bytes(c: Column) -> Column:
    return F.octet_length(c).cast("long")


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """A row (page_id, record) for each page: the whole record with the blank lines that end it."""
    p = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).alias("payload"))
    p = p.withColumn("n", _bytes(F.col("payload")))
    p = p.withColumn("h", F.when(F.col("n") >= MIN_REVISIT, F.xxhash64("payload")))
    p = p.withColumn("cell", F.pmod(F.shiftrightunsigned("h", 6), F.lit(CELLS)))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    met = p.where("h is not null").groupBy("h", "cell").agg(F.count("*").alias("copies")).where("copies > 1")
    marks = stored(met.groupBy("cell").agg(F.bit_or(bit).alias("bits")))  # CELLS rows at most
    p = p.join(F.broadcast(marks), "cell", "left").withColumn("maybe", F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False)))
    alone = p.where(~F.col("maybe")).withColumn("first", F.lit(None).cast(p.schema["page_id"].dataType))
    shared = p.where("maybe").withColumn("same", F.concat_ws(":", F.sha2("payload", 256), "n"))
    first = shared.groupBy("same").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).where("copies > 1").select("same", "first")
    p = alone.unionByName(shared.join(first, "same", "left").select(*alone.columns)).withColumn("again", F.coalesce(F.col("page_id") < F.col("first"), F.col("page_id").isNull() & F.col("first").isNotNull()))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, "payload"))
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit(f"{MAGIC}{VERSION}\r\n"),
        line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1("payload"))),
        F.when(F.col("again"), F.concat(line("WARC-Refers-To", _id(F.col("first"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", _bytes(block).cast("string")),
        F.lit("\r\n"),
    )
    return p.select("page_id", F.concat(head, block, F.lit("\r\n\r\n")).alias("record"))


def write_warc(recs: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the column record as archives. The writer's line end stands for each record's last byte."""
    lines = recs.select(F.expr("substring(record, 1, char_length(record) - 1)").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): what stands between two magics, with its offset in the file, magic excluded."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), F.col("value"))
    return raw.withColumn("n", _bytes(F.col("value")))


def candidates(cut: DataFrame) -> DataFrame:
    """Pieces with a whole header, as (file, at, next, ...) with offsets of the magic.

    Offsets are sums of the lengths before: within a split pieces stand in reading order, and
    splits follow each other by their start. Only lengths and headers go through the window.
    """
    whole = F.sum(F.col("n") + len(MAGIC))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("file", "block").agg(whole.alias("total")).select("file", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("start"))
    order = Window.partitionBy("file", "block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    head = F.substring_index("value", "\r\n\r\n", 1)
    rows = cut.select("file", "block", "i", "n", head.alias("head"))
    rows = rows.withColumn("head", F.when((_bytes(F.col("head")) < F.col("n")) & F.col("head").rlike(r"\A1\.[01]\r\n"), F.col("head")))
    rows = rows.join(starts, ["file", "block"])
    rows = rows.withColumn("at", F.col("start") + F.coalesce(whole.over(order), F.lit(0)) - len(MAGIC)).drop("start")
    field = lambda name: F.regexp_extract(F.col("head"), rf"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1)
    length = F.expr("try_cast(length as long)")
    rows = rows.withColumn("length", field("Content-Length"))
    rows = rows.withColumn("header_bytes", len(MAGIC) + _bytes(F.col("head")) + 4)
    rows = rows.withColumn("next", F.when(length >= 0, F.expr("try_add(at + header_bytes + 4, try_cast(length as long))")))
    return rows.select("file", "block", "i", "n", "at", "header_bytes", length.alias("length"), "next", field("WARC-Type").alias("type"), field("WARC-Record-ID").alias("id"), field("WARC-Refers-To").alias("refers_to"), field("WARC-Payload-Digest").alias("digest"))


def reachable(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from offset 0 of each file.

    A candidate points to its successor; each round all that are reached reach what they point
    to, and all pointers double. So a file of n records takes log2(n) rounds. Rounds are written
    to shared storage.
    """
    spark = found.sparkSession
    end = found.join(sizes, "file").where("next <= size").select("file", "at", F.col("next").alias("to"))
    path = shared_dir(spark)
    nodes = stored(end.withColumn("reached", F.col("at") == 0), path)
    while True:
        known = nodes.where("reached").select("file", F.col("to").alias("at")).distinct().withColumn("hit", F.lit(True))
        jump = nodes.select("file", F.col("at").alias("to"), F.col("to").alias("beyond"))
        moved = nodes.join(jump, ["file", "to"], "left").join(known, ["file", "at"], "left")
        moved = moved.select("file", "at", F.col("beyond").alias("to"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached"))
        more = shared_dir(spark)
        nodes = stored(moved, more)
        forget(spark, path)
        path = more
        if nodes.where("to is not null").isEmpty():
            return nodes.where("reached").select("file", "at")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, type, id, refers_to, digest, block) of each verified record; block is binary.

    A record that is one piece is cut out of it; only those with magic inside are put together
    from theirs, grouped by record.
    """
    # kept once: ids of rows hold the partition, which another scan may number otherwise
    kept = stored(pieces(spark, path))
    cut = kept.select("file", F.col("block").alias("split"), "i", "value")
    found = stored(candidates(kept).withColumnRenamed("block", "split"))
    sizes = found.groupBy("file").agg(F.max(F.col("at") + len(MAGIC) + F.col("n")).alias("size"))
    chain = reachable(found.where("next is not null"), sizes).withColumn("on_chain", F.lit(True))
    # every piece belongs to the last record of the chain that starts at or before it
    marked = stored(found.join(chain, ["file", "at"], "left"))
    reached = F.when(F.col("on_chain"), F.col("at"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    carried = marked.groupBy("file", "split").agg(F.max(reached).alias("last")).select("file", "split", F.max("last").over(before).alias("carried"))
    order = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.coalesce(F.last(reached, ignorenulls=True).over(order), F.col("carried"))
    owned = stored(marked.join(carried, ["file", "split"]).withColumn("owner", owner).where("owner is not null").drop("carried"))
    told = ["header_bytes", "length", "type", "id", "refers_to", "digest"]
    heads = owned.where("on_chain").withColumn("alone", F.col("next") <= F.col("at") + len(MAGIC) + F.col("n"))
    fits = F.col("header_bytes") + F.col("length") <= MOST_BYTES
    block = lambda whole: F.when(fits, F.substring(whole, F.col("header_bytes").cast("int") + 1, F.col("length").cast("int"))).alias("block")
    full = F.concat(F.encode(F.lit(MAGIC), "utf-8"), F.col("value").cast("binary"))
    one = heads.where("alone").select("file", "split", "i", "at", *told).join(cut, ["file", "split", "i"]).select("file", "at", *told[2:], block(full))
    several = heads.where("not alone").select("file", "at", "next", *told)
    parts = owned.select("file", F.col("at").alias("piece"), F.col("owner").alias("at"), "split", "i").join(several, ["file", "at"]).where("piece < next")
    parts = stored(parts.where(fits)).join(cut, ["file", "split", "i"])
    bytes_of = F.array_sort(F.collect_list(F.struct("piece", full.alias("b"))))
    joined = parts.groupBy("file", "at", *told).agg(bytes_of.alias("all"))
    joined = joined.select("file", "at", *told, F.aggregate("all", F.lit(b""), lambda a, x: F.concat(a, x["b"])).alias("whole"))
    large = several.where(~fits).select("file", "at", *told[2:], F.lit(None).cast("binary").alias("block"))
    return one.unionByName(joined.select("file", "at", *told[2:], block(F.col("whole")))).unionByName(large)


def payloads(recs: DataFrame) -> DataFrame:
    """Records with the payload behind the HTTP header, and the length that this header tells."""
    head = F.substring_index(F.col("block").cast("string"), "\r\n\r\n", 1)
    out = recs.withColumn("http_bytes", F.octet_length(head) + 4).withColumn("told_bytes", F.expr("try_cast(regexp_extract(substring_index(cast(block as string), '\\r\\n\\r\\n', 1), '(?i)Content-Length:[ ]*([0-9]+)', 1) as long)"))
    return out.withColumn("payload", F.when(F.col("type") == "response", F.expr("substring(block, http_bytes + 1)")))
