"""Sharding by histogram sort (operator 7), DataFrame functions only.

Every document gets a key: 60 bits of the MD5 of its text, then its id. Equal texts are therefore
neighbours. Splitters are found without sorting: the exact bytes in each bucket of a key histogram are
counted over all partitions, only the buckets in which a splitter must lie are divided further, and this
goes on until each splitter is exact to its tolerance. Then the rows are exchanged once, straight to
their final range. The driver sees the buckets in which a splitter lies, and the parts of those that are divided:
the shards' own and the few that hold more than an eighth of a range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import hash60, partitions, shielded, stage, table, unstage

#: Least bits of the key in the first histogram, and bits beyond those that the ranges need; bits added to a refined
#: bucket in each later round; low bits of a bucket's number that one window adds up.
FIRST_BITS, MORE_BITS, NEXT_BITS, HASH_BITS, WINDOW_BITS = 12, 5, 8, 60, 11
#: Bytes that a final range should hold at most.
RANGE_BYTES = 1 << 30
#: Counts as the id of a document without one.
NO_ID = -(1 << 63)


@dataclass(frozen=True, order=True)
class Splitter:
    """The first key of the range to the right."""

    h: int
    id: int


def _histogram(keys: DataFrame, bits: int, ranges: int, total: int, stats: list) -> list:
    """The buckets of the first ``bits`` of the key in which a splitter may lie, with ``below``, the bytes before them.

    The bytes are added up over runs of buckets and inside each; few buckets are collected.
    """
    hist = keys.groupBy(F.shiftright("h", HASH_BITS - bits).alias("prefix")).agg(*stats).withColumn("run", F.shiftright("prefix", WINDOW_BITS))
    before = lambda w: F.coalesce(F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = hist.groupBy("run").agg(F.sum("bytes").alias("bytes")).select("run", before(Window.orderBy("run")).alias("base"))
    placed = hist.withColumn("in", before(Window.partitionBy("run").orderBy("prefix"))).join(F.broadcast(runs), "run").withColumn("below", F.col("base") + F.col("in"))
    step = total / ranges
    some = F.floor((F.col("below") + F.col("bytes") + 1) / step) >= F.ceil((F.col("below") - 1) / step)
    return placed.where(some).select("prefix", "below", "bytes", "h0", "h1", "id0", "id1").collect()


def find_splitters(keys: DataFrame, ranges: int, tolerance: int = 0, per: int = 1) -> list[Splitter]:
    """Splitters that deal the bytes of ``keys`` (h, id, size) into ``ranges`` near-equal parts.

    With tolerance 0 each lies where the document that straddles the target ends or begins, whichever side
    holds its middle: the result is the same for every partitioning of the input. That goes for every ``per``-th
    splitter; the others may be off by an eighth of a range. Rows with the same text and id stay together. An empty
    table has no splitters.
    """
    spark = keys.sparkSession
    total = keys.agg(F.sum("size")).first()[0]
    if not total or ranges < 2:
        return []
    stats = [F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.min("id").alias("id0"), F.max("id").alias("id1")]
    targets = [-(-total * j // ranges) for j in range(1, ranges)]  # rounded up
    room = {t: max(tolerance, total // (8 * ranges)) for t in targets} | dict.fromkeys(targets[per - 1 :: per], tolerance)
    found: dict[int, Splitter] = {}
    by_hash: dict[int, tuple[int, list[int]]] = {}  # hash prefix -> bytes before it, targets inside
    by_id: list[tuple[int, int, int, int, list[int]]] = []  # hash, ids from and to, bytes before, targets

    def settle(buckets: list, targets: list[int], edge) -> None:
        """Put each target at an edge of its bucket (prefix, below and more), or keep the bucket for the next round.
        ``edge`` gives the first key of a bucket's prefix."""
        at = 0
        for t in targets:
            while at + 1 < len(buckets) and buckets[at + 1]["below"] <= t:
                at += 1
            b = buckets[at]
            below, after = b["below"], 2 * b["below"] + b["bytes"] < 2 * t
            one_hash = b["h0"] == b["h1"]
            if one_hash and b["id0"] == b["id1"]:
                found[t] = Splitter(b["h0"], b["id0"] + after)
            elif b["bytes"] <= room[t]:
                found[t] = edge(b["prefix"] + after)
            elif one_hash:
                if not by_id or by_id[-1][:3] != (b["h0"], b["id0"], b["id1"]):
                    by_id.append((b["h0"], b["id0"], b["id1"], below, []))
                by_id[-1][4].append(t)
            else:
                by_hash.setdefault(b["prefix"], (below, []))[1].append(t)

    def summed(buckets: list, below: int) -> list[dict]:
        out = []
        for b in sorted(buckets, key=lambda b: b["prefix"]):
            out.append(b.asDict() | {"below": below})
            below += b["bytes"]
        return out

    bits = first = min(HASH_BITS, max(FIRST_BITS, ranges.bit_length() + MORE_BITS))
    settle(sorted(_histogram(keys, bits, ranges, total, stats), key=lambda b: b["prefix"]), targets, lambda p: Splitter(p << (HASH_BITS - first), NO_ID))
    while by_hash:
        waiting, by_hash = by_hash, {}
        active = F.broadcast(spark.createDataFrame([(p,) for p in waiting], "parent long"))
        old, bits = bits, min(HASH_BITS, bits + NEXT_BITS)
        rows = keys.withColumn("parent", F.shiftright("h", HASH_BITS - old)).join(active, "parent")
        parts: dict[int, list] = {}
        for r in rows.groupBy("parent", F.shiftright("h", HASH_BITS - bits).alias("prefix")).agg(*stats).collect():
            parts.setdefault(r["parent"], []).append(r)
        for p, (below, todo) in waiting.items():
            settle(summed(parts[p], below), todo, lambda q, b=bits: Splitter(q << (HASH_BITS - b), NO_ID))
    while by_id:
        waiting, by_id = by_id, []
        shifts = [next(s for s in range(64) if (hi >> s) - (lo >> s) < 1 << NEXT_BITS) for _, lo, hi, _, _ in waiting]
        active = F.broadcast(spark.createDataFrame(
            [(h, k, lo, hi, s) for k, ((h, lo, hi, _, _), s) in enumerate(zip(waiting, shifts))], "h long, k int, lo long, hi long, s int"
        ))
        rows = keys.join(active, "h").where("id BETWEEN lo AND hi")
        parts = {}
        for r in rows.groupBy("k", F.expr("shiftright(id, s)").alias("prefix")).agg(*stats).collect():
            parts.setdefault(r["k"], []).append(r)
        for k, (h, _, _, below, todo) in enumerate(waiting):
            settle(summed(parts[k], below), todo, lambda q, h=h, s=shifts[k]: Splitter(h, q << s))
    # A splitter that may be off stays between the exact ones beside it.
    out, low = [], None
    for j, t in enumerate(targets):
        high = found[targets[(j // per + 1) * per - 1]] if (j // per + 1) * per - 1 < len(targets) else None
        s = found[t]
        s = min(s, high) if high else s
        low = max(s, low) if low else s
        out.append(low)
    return out


def _ranged(df: DataFrame, splitters: list[Splitter]) -> DataFrame:
    """Add the column ``mr_range``: how many splitters are at or below the row's key.

    The splitters are joined by the first bits of the key, so that a row is compared
    with those of its own bucket only.
    """
    by: dict[int, list] = {}
    for i, s in enumerate(splitters):
        by.setdefault(s.h >> (HASH_BITS - FIRST_BITS), []).append((i, s.h, s.id))
    rows, base = [], 0
    for p in range(1 << FIRST_BITS):
        rows.append((p, base, [(h, d) for _, h, d in by.get(p, [])]))
        base += len(by.get(p, []))
    near = df.sparkSession.createDataFrame(rows, "mr_p int, mr_base int, mr_cuts array<struct<h:long,id:long>>")
    return (
        df.withColumn("mr_p", F.shiftright("mr_h", HASH_BITS - FIRST_BITS).cast("int"))
        .join(F.broadcast(near), "mr_p")
        .withColumn("mr_range", F.expr("mr_base + size(filter(mr_cuts, c -> c.h < mr_h OR (c.h = mr_h AND c.id <= mr_id)))"))
        .drop("mr_p", "mr_base", "mr_cuts")
    )


@shielded("size", "text_crc32", "law", "shard", "slot", "grown_shard")
def shard(docs: DataFrame, n_shards: int = 40, tolerance: int = 0) -> DataFrame:
    """Deal ``docs`` (doc_id, text and any more columns) into shards of near-equal bytes.

    Adds size (UTF-8 bytes + 16), text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard, in
    key order) and grown_shard (null under this law); input columns of these names are replaced. A null or
    empty text counts 16 bytes and the CRC of nothing, 0. A null id comes first among equal texts. Repeated
    rows stay together, in any order among themselves. A document larger than a shard makes that shard
    larger, and shards beyond the documents stay empty. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    keyed = docs.withColumns({
        "mr_h": hash60(F.coalesce(docs["text"], F.lit(""))),
        "mr_id": F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)),
        "size": F.coalesce(F.octet_length(docs["text"]), F.lit(0)).cast("long") + 16,
        "text_crc32": F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary")),
        "law": F.lit("bytes"),
    })
    keys = stage(keyed.select(F.col("mr_h").alias("h"), F.col("mr_id").alias("id"), "size"), "op7-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    # Every shard is an equal number of ranges, so that more tasks than shards can work.
    per = max(1, -(-total // (n_shards * RANGE_BYTES)), -(-partitions(spark) // n_shards))
    splitters = find_splitters(keys, n_shards * per, tolerance, per)
    counts = {r[0]: r[1] for r in _ranged(keys.selectExpr("h AS mr_h", "id AS mr_id"), splitters).groupBy("mr_range").count().collect()}
    unstage(keys)
    starts, before = [], 0
    for r in range(n_shards * per):
        before = 0 if r % per == 0 else before
        starts.append((r, r // per, before))
        before += counts.get(r, 0)
    starts = F.broadcast(spark.createDataFrame(starts, "mr_range int, shard int, mr_start long"))
    # The one exchange. Each range is a partition of its own: the row's place in it is the low bits of the id that Spark counts up.
    dealt = _ranged(keyed, splitters).repartitionById(n_shards * per, F.col("mr_range")).sortWithinPartitions("mr_h", "mr_id")
    placed = dealt.withColumn("mr_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).drop("shard", "slot", "grown_shard").join(starts, "mr_range")
    return placed.withColumn("slot", F.col("mr_start") + F.col("mr_row")).withColumn("grown_shard", F.lit(None).cast("int")).drop("mr_h", "mr_id", "mr_range", "mr_row", "mr_start")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


QUERIES = {"op7_sharding": op7_sharding}

ORACLE = {
    "op7_sharding": """
WITH crc AS (  -- the reflected polynomial's table, one entry a byte
    SELECT [list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) FOR b IN range(256)] AS t
), k AS (
    SELECT doc_id, coalesce(text, '') AS x, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS h, strlen(coalesce(text, '')) + 16 AS size FROM documents
), c AS (
    SELECT *, sum(size) OVER (ORDER BY h, doc_id) - size AS below, sum(size) OVER () AS total FROM k
), s AS (
    SELECT *, least(39, 40 * ((2 * below + size) // 2) // total)::INT AS shard FROM c
)
SELECT doc_id, size::BIGINT AS size,
    xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS text_crc32,
    'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM s, crc
"""
}
