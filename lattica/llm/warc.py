"""WARC replicas and their Merkle fixity audit.

Records are written by Spark's text writer with the record terminator as line separator, which makes each part file a
valid WARC file, and read as whole files: of at most ``RECORDS_PER_FILE`` records of up to ``FILE_BYTES`` / that many
bytes, or, apart from these, of as many larger records as fit ``FILE_BYTES``, at least one.

A leaf is the digest of a record's bytes with its place; an inner node digests the leaves or nodes of an ordered range of
places, with whole SHA-256 digests on all levels. Above the files' roots the tree goes on, over ranges of the files'
names ordered by digest, to one root. The audit compares the roots and goes down only where nodes differ: of two equal
replicas nothing but the roots is compared, and damage is found in as many steps as the tree has levels.

Groups are bounded by the fan-out; a tree level is one grouped aggregation of digests. No text is ever shuffled.

Defined results: null urls and payloads are empty; null ids are written as ``null``; repeated records are records; an empty
replica has no root, so that all records of the other are missing or extra; other columns are not looked at.
"""

from __future__ import annotations

import gzip
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import durable, is_empty
from lattica.llm.features import settled

END = "\r\n\r\n"
#: Children of a node, as bits of its place.
BITS = 4
RECORDS_PER_FILE, FILE_BYTES = 512, 64 << 20
LEAVES = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("offset", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("record_id", T.StringType()),
    T.StructField("uri", T.StringType()),
    T.StructField("digest", T.StringType()),
])


def record(record_id: Column, uri: Column, payload: Column) -> Column:
    """A resource record without its terminator."""
    body = F.coalesce(payload, F.lit(""))
    head = [
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record_id.cast("string"), F.lit("null")),
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]", ""),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(END),
    ]
    return F.concat(*head, body)


def write_warc(records: DataFrame, column: str, path: str, per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped WARC files below ``path``/small and ``path``/large, of bounded records and bytes; null records are left out."""
    # Worked out once for each row, though the size is asked for, too.
    own = records.select(settled(F.col(column)).alias("value")).where(F.col("value").isNotNull()).withColumn("size", F.octet_length("value"))
    bound, seen = max(1, file_bytes // per_file), Observation()
    small = own.observe(seen, F.max("size").alias("most")).where(F.col("size") <= bound)

    def write(rows: DataFrame, kind: str, n: int) -> None:
        rows.select("value").write.option("lineSep", END).option("maxRecordsPerFile", n).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").text(f"{path}/{kind}")

    write(small, "small", per_file)
    most = seen.get["most"] or 0
    if most > bound:
        write(own.where(F.col("size") > bound), "large", max(1, file_bytes // most))


_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)", re.I)
_FIELD = {k: re.compile(rb"\r\n" + v + rb": <?([^\r\n>]*)", re.I) for k, v in (("record_id", b"WARC-Record-ID"), ("uri", b"WARC-Target-URI"))}


def parse(data: bytes) -> Iterator[tuple[int, int, str, str, bytes]]:
    """(offset, length, record id, uri, bytes) of each record; what cannot be parsed up to the end is one last record."""
    at = 0
    while at < len(data):
        head = data.find(END.encode(), at)
        size = _LENGTH.search(data, at, head + 2) if head >= 0 else None
        stop = head + 4 + int(size[1]) + 4 if size else len(data)
        if not data.startswith(b"WARC/", at) or stop > len(data) or data[stop - 4 : stop] != END.encode():
            stop = len(data)
        own = data[at:stop]
        found = [m[1].decode("utf-8", "replace") if (m := _FIELD[k].search(own, 0, max(0, head - at) + 2)) else "" for k in ("record_id", "uri")]
        yield at, stop - at, *found, own
        at = stop


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The leaves of all files below ``path``; a file is named by its folder, part and number, which replicas share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_py()
                raw = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
                rows = [(name, k, a, n, i, u, hashlib.sha256(own).hexdigest()) for k, (a, n, i, u, own) in enumerate(parse(raw))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=LEAVES.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_replace(F.concat_ws("/", F.slice(F.split("path", "/"), -2, 2)), r"^(.*/part-\d+)-.*-(c\d+).*$", "$1-$2")
    return files.select(name.alias("file"), "content").mapInArrow(run, LEAVES)


def parents(nodes: DataFrame) -> DataFrame:
    """The level above: at most ``2 ** BITS`` children each, in order."""
    children = F.sort_array(F.collect_list(F.struct("place", "digest")))
    digest = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["place"], c["digest"])), ","), 256)
    up = nodes.groupBy("tree", F.shiftright("place", BITS).alias("place")).agg(digest.alias("digest"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return up.select("tree", "place", "digest", "lo", "hi")


def file_trees(leaves: DataFrame, levels: int) -> list[DataFrame]:
    """The levels of all files' trees, leaves first; a node has tree (the file), place, digest and the offsets lo..hi."""
    bound = F.sha2(F.concat_ws(":", "offset", "length", "digest"), 256)
    out = [leaves.select(F.col("file").alias("tree"), F.col("seq").alias("place"), bound.alias("digest"), F.col("offset").alias("lo"), (F.col("offset") + F.col("length")).alias("hi"))]
    for _ in range(levels):
        out.append(durable(parents(out[-1]), "tree-level"))
    return out


def name_ranges(files: DataFrame, digits: int) -> list[DataFrame]:
    """The levels above the files' roots, the root last: ranges of names that share 0 to ``digits`` first digits of their digest."""
    nodes = files.select(F.sha2("tree", 256).alias("name"), F.sha2(F.concat_ws(":", "tree", "digest"), 256).alias("digest"))
    out = []
    for n in range(digits, -1, -1):
        children = F.sort_array(F.collect_list(F.struct("name", "digest")))
        digest = F.sha2(F.array_join(F.transform(children, lambda c: F.concat_ws("=", c["name"], c["digest"])), ","), 256)
        nodes = durable(nodes.groupBy(F.substring("name", 1, n).alias("range")).agg(digest.alias("digest")).withColumnRenamed("range", "name"), "name-ranges")
        out.append(nodes.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "digest"))
    return out


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose digests differ or that one side lacks."""
    right = b.select(F.col("tree").alias("t"), F.col("place").alias("p"), F.col("digest").alias("other"))
    both = a.select("tree", "place", "digest").join(right, (F.col("tree") == F.col("t")) & (F.col("place") == F.col("p")), "full_outer")
    status = F.when(F.col("other").isNull(), "missing").when(F.col("digest").isNull(), "extra").otherwise("corrupt")
    return both.where(~F.col("digest").eqNullSafe(F.col("other"))).select(F.coalesce("tree", "t").alias("tree"), F.coalesce("place", "p").alias("place"), status.alias("status"))


def audit(ours: DataFrame, theirs: DataFrame, compared: list[int] | None = None) -> DataFrame:
    """file, seq and status (corrupt, missing from theirs, extra in theirs) of every record in which the replicas differ.

    ``compared``, if given, is filled with the number of nodes of ours compared on each level, from the root down.
    """
    tops = [x.agg(F.max("seq").alias("n")).first()["n"] or 0 for x in (ours, theirs)]
    levels = max(1, -(-max(tops).bit_length() // BITS))
    a, b = file_trees(ours, levels), file_trees(theirs, levels)
    files = max(x[-1].count() for x in (a, b))
    digits = -(-max(files - 1, 1).bit_length() // BITS)
    ranges = list(zip(name_ranges(a[-1], digits), name_ranges(b[-1], digits), strict=True))
    nothing = ours.sparkSession.createDataFrame([], "file string, seq long, status string")

    def step(left: DataFrame, right: DataFrame) -> DataFrame:
        if compared is not None:
            compared.append(left.count())
        return durable(differing(left, right), "differing")

    found = step(*ranges[-1])
    for n, (left, right) in enumerate(reversed(ranges[:-1]), 1):
        if is_empty(found):
            return nothing
        under = found.select(F.col("tree").alias("up"))
        child = F.substring("tree", 1, n - 1) == F.col("up")
        found = step(left.join(under, child, "left_semi"), right.join(under, child, "left_semi"))
    if is_empty(found):
        return nothing
    under = found.select(F.col("tree").alias("up"))
    child = F.substring(F.sha2("tree", 256), 1, digits) == F.col("up")
    found = step(a[-1].join(under, child, "left_semi"), b[-1].join(under, child, "left_semi"))
    for level in range(levels - 1, -1, -1):
        # Only the children of differing nodes are read and compared.
        under = found.select(F.col("tree").alias("up_tree"), F.col("place").alias("up"))
        child = (F.col("tree") == F.col("up_tree")) & (F.shiftright("place", BITS) == F.col("up"))
        found = step(a[level].join(under, child, "left_semi"), b[level].join(under, child, "left_semi"))
    return found.select(F.col("tree").alias("file"), F.col("place").alias("seq"), "status")
