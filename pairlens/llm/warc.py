"""WARC fixity: Merkle trees over records and offset ranges, compared between replicas.

A record's leaf is the SHA-256 of its bytes. Nodes hash their children in order of
offset: ranges of RANGE bytes of a file, larger ranges of FANOUT of these each up
to LEVELS, the file, buckets of files, and the replica's root. An audit compares
the roots and then descends: at each level only the children of nodes that differ
are joined, so that equal parts are never looked at below their common node. It
ends with the records that are corrupt, missing or extra.

Groups are bounded: a range holds the records that begin in it, a larger range
FANOUT ranges; files are dealt by their hashed names to buckets, these to larger
buckets, FILES to one, in as many levels as the number of files takes.

Records are hashed where they are scanned; what is placed in files, put in trees and
compared is narrow: ids, lengths and digests. Equal records of one page are one row
with a count until they get their offsets.

Null payloads are empty ones; pages without an id are filed by the digest of their
record, one file for each of its first NULL_DIGITS digits. A file that would hold more
than ``file_records`` records, as where many pages share an id, is cut by further digits
of the records' digests. Pages with one id are in order of digest, and repeated pages
are records of their own. Of records at one place of a replica repeated ones count once,
others are told apart by their digests. Empty replicas have no
root and everything in the other is missing or extra. Records of any length are
hashed whole. Only the named columns are read, so that others may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._support import lasting, scope, staged

RANGE = 1 << 16
FANOUT = 16
LEVELS = 3
#: Hex digits of a file name's hash that tell a level of buckets from the one above, and files of a bucket on the average, at most.
DIGITS = 2
FILES = 256
NULL_DIGITS = 4
FILE_RECORDS = 256
#: Where the digits begin by which crowded files are cut, and how many there can be.
CUT_AT, DEPTH = 9, 12
#: Of the damaged replica: one record in so many is gone, one in so many has changed bytes.
MISSING = 211
CORRUPT = 97


def record(target: Column, kind: str, payload: Column) -> Column:
    """The bytes of a WARC resource record as text; nulls are empty."""
    body = F.coalesce(payload.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(target.cast("string"), F.lit("")),
        F.lit(f"\r\nContent-Type: {kind}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _hashed(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """id, record, length, hash, typo (the hash with the fault of ``damaged``) of each page."""
    rows = pages.select(F.col(id_col).alias("id"), record(F.col(url_col), "text/html", F.col(html_col)).alias("record"))
    return rows.select("id", "record", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("hash"), F.sha2(_with_typo(F.col("record")), 256).alias("typo"))


def placed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """file, offset, length, hash, typo, id: where pages lie as records of files of ``file_records`` consecutive ids, in order of id."""
    name = F.concat(F.lit("part-"), F.coalesce(F.floor(F.col("id") / file_records).cast("string"), F.concat(F.lit("none-"), F.substring("hash", 1, NULL_DIGITS))))
    once = _hashed(pages, id_col, url_col, html_col).drop("record").withColumn("base", name).groupBy("base", "id", "length", "hash", "typo").agg(F.count(F.lit(1)).alias("n"))
    once = staged(once, "records")
    full = once.groupBy("base").agg(F.sum("n").alias("m")).filter(F.col("m") > file_records)
    digits = sum((F.col("m") > file_records * 16**d).cast("int") for d in range(DEPTH))
    rows = once.join(staged(full, "full"), "base", "left")
    cut = F.when(F.col("m").isNotNull(), F.concat(F.lit("-"), F.substr(F.col("hash"), F.lit(CUT_AT), digits))).otherwise("")
    rows = rows.withColumn("file", F.concat("base", cut, F.lit(".warc")))
    before = Window.partitionBy("file").orderBy("id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)).cast("long")
    rows = rows.withColumn("start", start).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("file", (F.col("start") + F.col("i") * F.col("length")).alias("offset"), "length", "hash", "typo", "id")


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_records: int = FILE_RECORDS) -> DataFrame:
    """file, offset, length, record: the records of ``placed`` with their bytes."""
    where = placed(pages, id_col, url_col, html_col, file_records).withColumnRenamed("id", "_id").drop("typo")
    bytes_of = _hashed(pages, id_col, url_col, html_col).select("id", "hash", "record").dropDuplicates(["id", "hash"])
    joined = where.join(bytes_of.withColumnRenamed("hash", "_hash"), F.col("_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("_hash")))
    return joined.select("file", "offset", "length", "record")


def leaves(records: DataFrame) -> DataFrame:
    """file, offset, length, hash of each record of (file, offset, length, and its record or hash)."""
    digest = F.col("hash") if "hash" in records.columns else F.sha2(F.coalesce(F.col("record").cast("binary"), F.lit(b"")), 256)
    return records.select("file", "offset", "length", digest.alias("hash")).distinct()


def _digest(order: str) -> Column:
    return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "hash"))), lambda c: F.concat_ws(":", c[order].cast("string"), c["hash"])), "\n"), 256).alias("hash")


def bucket_levels(files: int) -> int:
    """Levels of buckets above the files, so that the lowest buckets hold FILES files on the average, at most."""
    levels = 1
    while files > FILES * 16 ** (DIGITS * levels):
        levels += 1
    return levels


def tree(leaf: DataFrame, depth: int = 1) -> list[DataFrame]:
    """Levels from the root down: root, ``depth`` levels of buckets, files, ranges from large to small, records.

    Each has its key columns, which start with its parent's, and ``hash``.
    """
    keys = [f"r{i}" for i in range(LEVELS, 0, -1)]
    buckets = [f"b{i}" for i in range(1, depth + 1)]
    name = F.sha2(F.col("file"), 256)
    now = leaf.select(*(F.substring(name, 1, DIGITS * i).alias(f"b{i}") for i in range(1, depth + 1)), "file", *(F.floor(F.col("offset") / (RANGE * FANOUT ** (i - 1))).alias(f"r{i}") for i in range(LEVELS, 0, -1)), "offset", "length", "hash")
    levels = [now]
    path = [*buckets, "file", *keys, "offset"]
    while len(path) > 1:
        child = path.pop()
        if child == "offset":
            # a record's length is part of what its range commits to
            now = now.withColumn("hash", F.concat_ws("/", F.col("length").cast("string"), "hash"))
        now = now.groupBy(*path).agg(_digest(child))
        if child == "offset":
            now = staged(now, "ranges")
        levels.append(now)
    root = now.groupBy(F.lit(0).alias("root")).agg(_digest("b1"))
    return [root, *reversed(levels)]


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, offset, status (corrupt, missing or extra in ``right``), left_hash, right_hash of the records that differ."""
    leaf = [staged(leaves(x), "leaves") for x in (left, right)]
    depth = bucket_levels(max(x.agg(F.count_distinct("file")).first()[0] for x in leaf))
    a, b = (tree(x, depth) for x in leaf)
    roots = a[0].select("hash").union(b[0].select("hash")).collect()
    open_nodes: DataFrame | None = None
    for x, y in zip(a[1:], b[1:], strict=True):
        keys = [c for c in x.columns if c not in ("hash", "length")]
        if open_nodes is not None:
            parent = open_nodes.columns
            x, y = x.join(open_nodes, parent, "left_semi"), y.join(open_nodes, parent, "left_semi")
        last = keys[-1] == "offset"
        if last:  # records at one place are told apart by their hash
            x, y = (d.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_set("hash")), "+").alias("hash")) for d in (x, y))
        both = x.select(*keys, F.col("hash").alias("left_hash")).join(y.select(*keys, F.col("hash").alias("right_hash")), keys, "full_outer")
        differ = both.filter(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        if len(roots) == 2 and roots[0] == roots[1]:
            differ = differ.filter("false")
        if last:
            status = F.when(F.col("right_hash").isNull(), "missing").when(F.col("left_hash").isNull(), "extra").otherwise("corrupt")
            return differ.select("file", "offset", status.alias("status"), "left_hash", "right_hash")
        open_nodes = staged(differ.select(*keys), "differ")
    raise AssertionError("a tree ends with its records")


def _with_typo(record: Column) -> Column:
    return F.concat(F.substring(record, 1, 8), F.lit("\r\nWARC-Typo"), F.substr(record, F.lit(20)))


def damaged(records: DataFrame) -> DataFrame:
    """A replica of ``placed`` records with known faults: some have bytes changed, some are gone, decided by the record's place."""
    place = F.conv(F.substring(F.sha2(F.concat_ws(":", "file", F.col("offset").cast("string")), 256), 1, 8), 16, 10).cast("long")
    return records.filter(place % MISSING != 7).withColumn("hash", F.when(place % CORRUPT == 3, F.col("typo")).otherwise(F.col("hash")))


def op4_warc(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records in two replicas, one damaged, and where the damage is."""
    from ._support import table

    with scope(spark):
        records = staged(placed(table(spark, sf_dir, "pages")), "replica")
        return lasting(audit(records, damaged(records)), "audit")


ORACLE_SQL = {
    "op4_warc": f"""
with p as (select page_id as id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) ||
  'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record from pages),
b as (select *, sha256(record) as hash, 'part-' || coalesce(cast(id // {FILE_RECORDS} as varchar), 'none-' || substr(sha256(record), 1, {NULL_DIGITS})) as base, strlen(record) as n from p),
m as (select *, count(*) over (partition by base) as m from b),
f as (select *, base || case when m > {FILE_RECORDS} then '-' || substr(hash, {CUT_AT}, {" + ".join(f"cast(m > {FILE_RECORDS * 16**d} as integer)" for d in range(DEPTH))}) else '' end || '.warc' as file from m),
o as (select file, record, cast(coalesce(sum(n) over (partition by file order by id, hash, record rows between unbounded preceding and 1 preceding), 0) as bigint) as "offset" from f),
h as (select file, "offset", cast('0x' || substr(sha256(file || ':' || "offset"), 1, 8) as bigint) as place, sha256(record) as left_hash,
  sha256(substr(record, 1, 8) || chr(13) || chr(10) || 'WARC-Typo' || substr(record, 20)) as typo from o)
select file, "offset", 'missing' as status, left_hash, null as right_hash from h where place % {MISSING} = 7
union all select file, "offset", 'corrupt', left_hash, typo from h where place % {MISSING} <> 7 and place % {CORRUPT} = 3
"""
}
