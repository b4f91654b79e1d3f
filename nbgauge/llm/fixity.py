"""Fixity audit of WARC replicas by Merkle trees over records and offset ranges.

A replica is a table of records (archive, offset, digest, ...).  Leaves are the
records at one offset; above them stand aligned ranges of offsets, each hashing
its children in their order, up to one root per archive.  Roots of two replicas
are compared, and only children of differing nodes are compared on the next
level, down to the offsets whose records differ.

Groups stay small: a node has at most one child per narrower range, and rows
that share an offset are first reduced to sums of their hashes.

Defined results: a NULL archive or offset counts as -1; a NULL payload is an
empty record; a long one is hashed whole where it is read.  Rows that repeat an offset are compared as one multiset: a copy
more or less is a change.  An empty replica makes all of the other's records
missing or extra.  Columns beyond those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nbgauge.operators.ordering import with_global_rank
from nbgauge.session import cut_lineage

#: Bits of the offset that lie within a node, level by level; the last level is the whole archive.
RANGE_BITS = (16, 20, 24, 63)


def warc_record(uri: Column, record_id: Column, payload: Column) -> Column:
    """Text of a WARC response record."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(uri, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")),
        F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def place_records(records: DataFrame, key: str, length: str, archive_bytes: int = 1 << 26) -> DataFrame:
    """Add archive and offset: records in key order, one after the other, a new archive every ``archive_bytes``.

    Sums of lengths per range partition give each partition its first byte, so
    no task sees more than its own rows.
    """
    names = records.columns
    # Equal keys, even a third of all rows, spread over partitions by the salt.
    salted = records.withColumn("_salt", F.monotonically_increasing_id())
    ranked = with_global_rank(salted, key, *[c for c in names if c != key], "_salt", rank="_rank").withColumn(
        "_block", F.floor((F.col("_rank") - 1) / 4096)
    )
    # Blocks of 4096 ranks: their totals run over one row per block, then within blocks.
    ranked = cut_lineage(ranked)
    totals = ranked.groupBy("_block").agg(F.sum(length).alias("_bytes")).withColumn("_super", F.floor(F.col("_block") / 4096))
    from pyspark.sql import Window

    inner = Window.partitionBy("_super").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    supers = totals.groupBy("_super").agg(F.sum("_bytes").alias("_sum"))
    # One row per 16 million records.
    outer = Window.orderBy("_super").rowsBetween(Window.unboundedPreceding, -1)
    bases = supers.select("_super", F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_base"))
    starts = totals.withColumn("_inner", F.coalesce(F.sum("_bytes").over(inner), F.lit(0))).join(bases, "_super").select(
        "_block", (F.col("_base") + F.col("_inner")).alias("_start")
    )
    within = Window.partitionBy("_block").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = ranked.withColumn("_within", F.coalesce(F.sum(length).over(within), F.lit(0))).join(starts, "_block")
    at = F.col("_start") + F.col("_within")
    return placed.select(*names, F.floor(at / archive_bytes).alias("archive"), (at % archive_bytes).alias("offset"))


def merkle_nodes(replica: DataFrame, range_bits: tuple[int, ...] = RANGE_BITS) -> DataFrame:
    """level, archive, node, digest, records, record_id of every node of the trees; level 0 is the offsets."""
    keyed = replica.select(
        F.coalesce("archive", F.lit(-1)).cast("long").alias("archive"), F.coalesce("offset", F.lit(-1)).cast("long").alias("node"),
        F.coalesce("digest", F.lit("")).alias("digest"), "record_id",
    )
    mixed = F.xxhash64("digest")
    leaves = keyed.groupBy("archive", "node").agg(
        F.count(F.lit(1)).alias("records"), F.min("digest").alias("_low"), F.max("digest").alias("_high"),
        F.sum(mixed.cast("decimal(38,0)")).alias("_sum"), F.bit_xor(mixed).alias("_xor"), F.min("record_id").alias("record_id"),
    )
    many = F.sha2(F.concat_ws(",", "records", "_low", "_high", "_sum", "_xor"), 256)
    level = cut_lineage(leaves.select("archive", "node", F.when(F.col("records") == 1, F.col("_low")).otherwise(many).alias("digest"), "records", "record_id"))
    nodes = level.withColumn("level", F.lit(0))
    below = 0
    for number, bits in enumerate(range_bits, 1):
        child = F.struct("node", "digest")
        parents = level.groupBy("archive", F.shiftright("node", bits - below).alias("up")).agg(
            F.sort_array(F.collect_list(child)).alias("children"), F.sum("records").alias("records")
        )
        joined = F.concat_ws(";", F.transform("children", lambda c: F.concat_ws(":", c["node"], c["digest"])))
        level = cut_lineage(parents.select("archive", F.col("up").alias("node"), F.sha2(joined, 256).alias("digest"), "records"))
        nodes = nodes.unionByName(level.withColumn("level", F.lit(number)), allowMissingColumns=True)
        below = bits
    return nodes


def differing(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nodes of one level that one replica lacks or that differ."""
    columns = ["archive", "node", "digest", "records", "record_id"]
    one = left.select("archive", "node", *[F.col(c).alias(f"left_{c}") for c in columns[2:]])
    two = right.select("archive", "node", *[F.col(c).alias(f"right_{c}") for c in columns[2:]])
    return one.join(two, ["archive", "node"], "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def audit(left: DataFrame, right: DataFrame, range_bits: tuple[int, ...] = RANGE_BITS) -> DataFrame:
    """archive, offset, status, record_id, digests and numbers of records of each offset at which the replicas differ.

    Both take archive, offset, digest and record_id.
    """
    mine, theirs = merkle_nodes(left, range_bits), merkle_nodes(right, range_bits)
    top = len(range_bits)
    frontier = differing(mine.where(F.col("level") == top), theirs.where(F.col("level") == top))
    for level in range(top - 1, -1, -1):
        narrower = range_bits[level - 1] if level else 0
        parents = cut_lineage(frontier.select("archive", F.col("node").alias("up")))

        def below(nodes: DataFrame) -> DataFrame:
            here = nodes.where(F.col("level") == level).withColumn("up", F.shiftright("node", range_bits[level] - narrower))
            return here.join(parents, ["archive", "up"], "left_semi")

        frontier = differing(below(mine), below(theirs))
    status = (
        F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    )
    return frontier.select(
        "archive", F.col("node").alias("offset"), status.alias("status"), F.coalesce("left_record_id", "right_record_id").alias("record_id"),
        "left_digest", "right_digest", "left_records", "right_records",
    )
