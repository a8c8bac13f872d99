"""Merkle fixity audit of WARC records (operator 1).

A record's digest is the SHA-256 of its WARC form (header, payload, trailer).
Records are ordered by id; a node of level n covers the ids that agree above
their lowest n * FAN_BITS bits, and its digest is the SHA-256 of its children's
numbers, byte lengths and digests in order.  Ranges of ids, not of positions,
make the tree: a lost or added record changes its own path only.

Two replicas are compared by their roots, and level by level only the children
of nodes that differ are looked at.  Offsets are worked out for the WARC files
(nodes of level FILE_LEVEL) in which something differs, and for no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, ready

FAN_BITS = 4
#: A file holds the records of 16 ** 3 = 4096 consecutive ids.
FILE_LEVEL = 3
LEVELS = 16
BRANCH_BYTES = 32 << 20
FEW = 10_000


def warc(key: Column, url: Column, payload: Column) -> Column:
    """A WARC/1.1 response record; null url and payload are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def records(pages: DataFrame) -> DataFrame:
    """key, digest and n_bytes of each record; the payload goes no further than this projection."""
    ready(pages)
    record = warc(F.col("page_id"), F.col("url"), F.col("html"))
    return pages.select(F.col("page_id").cast("bigint").alias("key"), record.alias("record")).select(
        "key", F.unhex(F.sha2("record", 256)).alias("digest"), F.octet_length("record").cast("bigint").alias("n_bytes")
    )


def leaves(table: DataFrame) -> DataFrame:
    """One leaf (node, digest, n_bytes, n) per id; ids with several records take the digest of their sorted digests."""
    many = F.unhex(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list("digest")), F.hex)), 256))
    t = table.groupBy(F.col("key").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("digest").alias("one"), many.alias("many"), F.sum("n_bytes").alias("n_bytes"))
    return t.select("node", F.when(F.col("n") == 1, F.col("one")).otherwise(F.col("many")).alias("digest"), "n_bytes", "n")


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: at most 2 ** FAN_BITS children each, and a level as large as the one below over that."""
    child = F.struct("node", "n_bytes", "digest")
    t = nodes.groupBy(F.shiftright("node", FAN_BITS).alias("up")).agg(
        F.sort_array(F.collect_list(child)).alias("children"), F.sum("n_bytes").alias("n_bytes"), F.sum("n").alias("n"))
    text = F.transform("children", lambda c: F.concat_ws(":", F.coalesce(c["node"].cast("string"), F.lit("-")), c["n_bytes"].cast("string"), F.hex(c["digest"])))
    return t.select(F.col("up").alias("node"), F.unhex(F.sha2(F.concat_ws(";", text), 256)).alias("digest"), "n_bytes", "n")


class Tree:
    """The levels of one replica, from leaves up, each cut: a level is at most as large as the one below, mostly a sixteenth."""

    def __init__(self, pages: DataFrame):
        self.records = cut(records(pages))
        self.levels = [cut(leaves(self.records))]
        # up to one node, or one of negative ids and one of the others, which never meet
        top = self.levels[0].agg(F.min("node"), F.max("node")).first()
        low, high = top[0] or 0, top[1] or 0
        while len(self.levels) < LEVELS and (len(self.levels) <= FILE_LEVEL or (low, high) not in ((low, low), (-1, 0))):
            up = parents(self.levels[-1])
            self.levels.append(cut(up))
            low, high = low >> FAN_BITS, high >> FAN_BITS

    def level(self, n: int) -> DataFrame:
        while len(self.levels) <= n:
            self.levels.append(cut(parents(self.levels[-1])))
        return self.levels[n]

    def root(self) -> list[tuple]:
        """(node, digest, bytes, records) of the top: at most three nodes, of negative, other and null ids."""
        return sorted(((r["node"], bytes(r["digest"]), r["n_bytes"], r["n"]) for r in self.levels[-1].collect()), key=str)


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("node", F.col("digest").alias("da")), b.select(F.col("node").alias("other"), F.col("digest").alias("db"))
    t = x.join(y, F.col("node").eqNullSafe(F.col("other")) & (F.col("da").isNotNull() & F.col("db").isNotNull()), "full_outer")
    return t.where("NOT (da <=> db)").select(F.when(F.col("da").isNotNull(), F.col("node")).otherwise(F.col("other")).alias("node"))


def _found(branch: DataFrame) -> DataFrame:
    """Worked-out node numbers: as a literal, for broadcasting, while they are few; else as a checkpoint."""
    rows = branch.limit(FEW + 1).collect()
    if len(rows) <= FEW:
        return F.broadcast(branch.sparkSession.createDataFrame(rows, "node bigint"))
    return broadcast_if_small(cut(branch), BRANCH_BYTES, 16)


def _below(nodes: DataFrame, branch: DataFrame, bits: int) -> DataFrame:
    up = branch.select(F.col("node").alias("_up"))
    return nodes.join(up, F.shiftright("node", bits).eqNullSafe(F.col("_up")), "left_semi")


def audit(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Where two replicas of a table of page_id, url and html differ, found by descent from the roots.

    One row per differing id: page_id, file (number of its WARC file), status
    (corrupt, missing or extra: from the second replica's point of view),
    byte_offset in the first replica's file (the second's for extra ones),
    n_bytes, and both digests in hexadecimal (null where there is no record).
    Records with one id count as one, compared as a multiset, and their offset
    is that of the first; a null id is an id, whose file is null.  Null urls and
    payloads are empty.  Other columns are ignored.  Equal replicas, two
    empty ones among them, give an empty result.
    """
    a, b = Tree(expected), Tree(actual)
    top = max(len(a.levels), len(b.levels)) - 1
    a.level(top), b.level(top)
    if a.root() == b.root():
        branch = a.level(0).select("node").limit(0)
        return _located(a, b, branch)
    branch = _found(_differing(a.level(top), b.level(top)))
    for n in range(top - 1, -1, -1):
        branch = _found(_differing(_below(a.level(n), branch, FAN_BITS), _below(b.level(n), branch, FAN_BITS)))
    return _located(a, b, branch)


def _located(a: Tree, b: Tree, branch: DataFrame) -> DataFrame:
    bits = FAN_BITS * FILE_LEVEL
    files = _found(branch.select(F.shiftright("node", bits).alias("node")).distinct())

    def side(t: Tree, name: str) -> DataFrame:
        inside = _below(t.records.withColumnRenamed("key", "node"), files, bits)
        order = Window.partitionBy(F.shiftright("node", bits)).orderBy("node", "digest").rowsBetween(Window.unboundedPreceding, -1)
        placed = inside.withColumn("offset", F.coalesce(F.sum("n_bytes").over(order), F.lit(0)))
        placed = placed.groupBy("node").agg(F.min("offset").alias("offset"), F.sum("n_bytes").alias("n_bytes"))
        digests = t.level(0).select(F.col("node").alias("leaf"), "digest")
        only = placed.join(branch.withColumnRenamed("node", "_n"), F.col("node").eqNullSafe(F.col("_n")), "left_semi")
        only = only.join(digests, F.col("node").eqNullSafe(F.col("leaf")))
        return only.select(F.col("node").alias(f"n{name}"), F.col("offset").alias(f"o{name}"), F.col("n_bytes").alias(f"b{name}"), F.lower(F.hex("digest")).alias(f"d{name}"))

    t = side(a, "a").join(side(b, "b"), F.col("na").eqNullSafe(F.col("nb")), "full_outer")
    key = F.when(F.col("da").isNotNull(), F.col("na")).otherwise(F.col("nb"))
    status = F.when(F.col("db").isNull(), "missing").when(F.col("da").isNull(), "extra").otherwise("corrupt")
    return t.select(
        key.alias("page_id"), F.shiftright(key, bits).alias("file"), status.alias("status"), F.coalesce("oa", "ob").alias("byte_offset"),
        F.coalesce("ba", "bb").alias("n_bytes"), F.col("da").alias("expected_digest"), F.col("db").alias("actual_digest"),
    )


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages with damage decided by the MD5 of page_id: for the query, which has one copy only.

    Of the 256 values of its first byte, 00 replaces a payload's first
    character, 01 loses the record, and 02 adds a copy under the id -1 - page_id.
    """
    byte = F.substring(F.md5(F.col("page_id").cast("string")), 1, 2)
    kept = pages.where(~byte.eqNullSafe(F.lit("01"))).withColumn("html", F.when(byte == "00", F.concat(F.lit("\u0000"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    added = pages.where(byte == "02").withColumn("page_id", -1 - F.col("page_id"))
    return kept.unionByName(added)
