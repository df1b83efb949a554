"""SimHash near-duplicates through Golay-code keys (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.blocks import blocks, forest, stream
from millrace.llm.common import map_texts, partitions, shielded, stage, table, unstage
from millrace.llm.components import components
from millrace.llm.golay import DATA_BITS, fuzzy_keys

SEED, BITS, MOST_FLIPS = 42, 64, 2
#: Widths of the segments of a fingerprint. With two flips at most, one of three has none.
SEGMENTS = (21, 21, 22)
#: Fingerprints in a bucket that are compared pair by pair; a larger bucket goes another way.
BUCKET = 32
#: Near-duplicates have a Jaccard similarity of NEAR or more of their sets of five-word shingles. Flips of a
#: candidate in 128 bits (20 are expected at 0.8, with a deviation of 4.5), and fingerprints in a block.
NEAR, WIDE_FLIPS, WIDE_SHINGLE, WIDE_BLOCK = 0.8, 40, 5, 256
#: Shingles of a document that its wide keys are tied to, one for each segment of both halves.
ANCHORS = 2 * len(SEGMENTS)
_MIXERS = np.random.default_rng(17).integers(1, 1 << 63, ANCHORS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles whose bits are counted at a time.
BLOCK = 1 << 16


def _shingles(text: bytes | None, shingle: int) -> tuple[memoryview, list[int], list[int]]:
    """The words of a text joined by blanks, and where each shingle starts and ends; none if there are no words.

    Words are what lies between ASCII blanks, A-Z in lower case; shingles are counted as often as they occur.
    """
    words = text.lower().split() if text else []
    if not words:
        return memoryview(b""), [], []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - shingle + 1)
    return memoryview(b" ".join(words)), np.concatenate([[0], ends[: n - 1] + 1]).tolist(), ends[-n:].tolist()


def _vote(digests, n: int, size: int) -> np.ndarray:
    """The bits (little-endian, in bytes) set in over half of n digests, given in blocks."""
    votes = np.zeros(8 * size, np.int64)
    for h in digests:
        votes += np.unpackbits(h.reshape(-1, size), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > n, bitorder="little")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of one text as a signed long: 0 if it is null or has no words."""
    joined, starts, stops = _shingles(text, shingle)
    digest, n = xxhash.xxh64_intdigest, len(starts)
    if not n:
        return 0
    blocks_ = (np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[i : i + BLOCK], stops[i : i + BLOCK])), np.uint64).view(np.uint8) for i in range(0, n, BLOCK))
    return int(_vote(blocks_, n, 8).view(np.int64)[0])


def wide_fingerprint(text: bytes | None, shingle: int = WIDE_SHINGLE) -> tuple[int, ...]:
    """A SimHash of 128 bits as two signed longs, then ANCHORS longs: the least of the shingles' hashes under as
    many mixings. Shingles count once, however often they occur. Zeros if there are no words."""
    joined, starts, stops = _shingles(text, shingle)
    digest = xxhash.xxh3_128_digest
    if not starts:
        return (0,) * (2 + ANCHORS)
    distinct = list({digest(joined[s:e], SEED) for s, e in zip(starts, stops)})
    n, least = len(distinct), np.full(ANCHORS, np.iinfo(np.uint64).max)

    def digests():
        for i in range(0, n, BLOCK):
            h = np.frombuffer(b"".join(distinct[i : i + BLOCK]), np.uint8)
            word = h.view(np.uint64)[::2]
            for k, m in enumerate(_MIXERS):
                x = (word ^ (word >> np.uint64(31))) * m
                least[k] = min(least[k], (x ^ (x >> np.uint64(29))).min())
            yield h

    a, b = _vote(digests(), n, 16).view(np.int64).tolist()
    return a, b, *least.view(np.int64).tolist()


def with_fingerprint(docs: DataFrame, shingle: int = 3, name: str = "mr_fp", keep_text: bool = True) -> DataFrame:
    """``docs`` with the fingerprint of the column text as a long, and without text if that isn't kept."""
    at = docs.columns.index("text")
    keep = [i for i, c in enumerate(docs.columns) if keep_text or i != at]

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            fp = pa.array([fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, shingle) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], fp], names=[*[batch.schema.names[i] for i in keep], name])

    return map_texts(docs, run, T.StructType([*[docs.schema.fields[i] for i in keep], T.StructField(name, T.LongType())]))


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    fps, parts, low = fps.view(np.uint64), [], 0
    for w in SEGMENTS:
        parts.append(((fps >> np.uint64(low)) & np.uint64((1 << w) - 1)).astype(np.uint32))
        low += w
    return parts


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): keys of which fingerprints that differ in two bits or fewer share one at least.

    A key is one segment as it is, for the segment without a flip, and a Golay key of the next, which has
    two flips at most: about 16 of 35 bits for a fingerprint.
    """
    parts = _segments(fps)
    rows, keys = [], []
    fuzzy = [fuzzy_keys(p, w) for p, w in zip(parts, SEGMENTS)]
    for i in range(len(SEGMENTS)):
        row, code = fuzzy[(i + 1) % len(SEGMENTS)]
        rows.append(row)
        keys.append((np.int64(i) << np.int64(40)) | (parts[i][row].astype(np.int64) << np.int64(DATA_BITS)) | code.astype(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def wide_keys(f: list[np.ndarray], anchors: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of wide fingerprints: the Golay keys of each segment, each together with one anchor.

    Documents that share the anchor, as they do with a chance of their similarity, and differ in two bits or
    fewer of its segment share a key; there are about 32 for a document. A Golay key alone has 12 bits, and
    buckets of many millions would fill with strangers.
    """
    rows, keys = [], []
    for i, part in enumerate(x for half in f for x in _segments(half)):
        row, code = fuzzy_keys(part, SEGMENTS[i % len(SEGMENTS)])
        tied = (anchors[i].view(np.uint64) << np.uint64(15)) | np.uint64(i << DATA_BITS)
        rows.append(row)
        keys.append((tied[row] | code.astype(np.uint64)).view(np.int64))
    return np.concatenate(rows), np.concatenate(keys)


def _node(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for both halves of a wide fingerprint."""
    a, b = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), b.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = a ^ (b << np.uint64(29)) ^ (b >> np.uint64(35))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


_WIDE = ["f0", "f1", *[f"a{k}" for k in range(ANCHORS)]]


def _wide_batches(batches):
    """_WIDE -> (key, id, f0, f1)."""
    for batch in batches:
        c = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(len(_WIDE))]
        for i in range(0, batch.num_rows, 4096):
            part = [x[i : i + 4096] for x in c]
            row, key = wide_keys(part[:2], part[2:])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(_node(*part[:2])[row]), pa.array(part[0][row]), pa.array(part[1][row])], names=["key", "id", "f0", "f1"])


def _near(block: dict):
    """Pairs of WIDE_FLIPS or fewer, as indices."""
    x, y = (block[c].astype(np.int64).view(np.uint64) for c in ("f0", "f1"))
    flips = np.bitwise_count(x[:, None] ^ x[None, :]) + np.bitwise_count(y[:, None] ^ y[None, :])
    a, b = np.nonzero(np.triu(flips <= WIDE_FLIPS, 1))
    if block["mr_i"][0] != block["mr_j"][0]:
        across = block["mr_chunk"][a] != block["mr_chunk"][b]
        a, b = a[across], b[across]
    return a, b


def _near_links(block: dict):
    ids = block["id"]
    tree = forest(len(ids), *_near(block))
    if tree:
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[p]) for p, _ in tree]), pa.array([int(ids[q]) for _, q in tree])], names=["a", "b"])


def _near_sets(block: dict):
    """(key, id, f0, f1): ids that candidates join, under a key made of these ids: most keys of a document lead to
    the same few others, and are one set then."""
    ids = block["id"].astype(np.int64)
    tree = forest(len(ids), *_near(block))
    members: dict[int, list[int]] = {i: [i] for i in range(len(ids))}
    home = list(range(len(ids)))
    for p, q in tree:
        u, v = home[p], home[q]
        if len(members[u]) < len(members[v]):
            u, v = v, u
        for i in members[v]:
            home[i] = u
        members[u] += members.pop(v)
    for m in members.values():
        if len(m) > 1:
            key = xxhash.xxh64_intdigest(np.sort(ids[m]).tobytes(), SEED)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(m), key, np.uint64).view(np.int64)), pa.array(ids[m]), *[pa.array(block[c].astype(np.int64)[m]) for c in ("f0", "f1")]], names=["key", "id", "f0", "f1"]
            )


def jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """The Jaccard similarity of every two of some sets, arrays of distinct hashes: 0 where both are empty."""
    n, lens = len(sets), np.array(list(map(len, sets)), np.int64)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    more = times[at] > 1
    column, row = number[at[more]], np.repeat(np.arange(n), lens)[more]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    both = np.zeros((n, n), np.float64)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [low, low + 4096])
        held = np.zeros((n, 4096), np.float32)
        held[row[i:j], column[i:j] - low] = 1
        both += held @ held.T
    return both / np.maximum(lens[:, None] + lens[None, :] - both, 1)


def _verify(block: dict):
    ids = block["id"]
    a, b = _near(block)
    similar = jaccard([np.frombuffer(x, np.uint64) for x in block["grams"].to_pylist()])
    ok = similar[a, b] >= NEAR - 1e-12
    tree = forest(len(ids), a[ok], b[ok])
    if tree:
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[p]) for p, _ in tree]), pa.array([int(ids[q]) for _, q in tree])], names=["a", "b"])


def wide_links(prints: DataFrame, grams=None) -> DataFrame:
    """Links (a, b) between the ids of wide fingerprints (columns _WIDE), distinct: no two of more than
    WIDE_FLIPS differing bits; of fewer, enough to join all that share a key. Buckets of any size are compared
    in blocks.

    With ``grams``, a function from a table of ids (id) to their sets of shingles (id, grams), these are
    candidates only, and those whose sets have a Jaccard similarity of NEAR or more are links.
    """
    keys = prints.select(*_WIDE).mapInArrow(_wide_batches, "key long, id long, f0 long, f1 long")
    met = blocks(keys, None, WIDE_BLOCK)
    if grams is None:
        return stage(met.mapInArrow(lambda b: stream(b, _near_links), "a long, b long").distinct(), "op2-links")
    sets = stage(met.mapInArrow(lambda b: stream(b, _near_sets), "key long, id long, f0 long, f1 long").distinct(), "op2-sets")
    held = stage(grams(sets.select("id").distinct()), "op2-grams")
    whole = sets.selectExpr("*", "0 AS mr_i", "0 AS mr_j").join(held, "id").repartition(partitions(prints.sparkSession), "key").sortWithinPartitions("key")
    out = stage(whole.mapInArrow(lambda b: stream(b, _verify), "a long, b long").distinct(), "op2-links")
    unstage(sets, held)
    return out


def shingle_set(text: bytes | None) -> bytes:
    """The distinct hashes of a text's five-word shingles, as bytes."""
    joined, starts, stops = _shingles(text, WIDE_SHINGLE)
    digest = xxhash.xxh64_intdigest
    return np.array(sorted({digest(joined[s:e], SEED) for s, e in zip(starts, stops)}), np.uint64).tobytes()


def _grams(known: DataFrame, keyed: DataFrame):
    """For wide_links: the sets of one text for each fingerprint (mr_fp) in ``known``. Equal fingerprints of 128
    bits are taken for equal sets."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(1).cast(pa.large_binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "grams"])

    def of(ids: DataFrame) -> DataFrame:
        one = known.join(ids, F.col("mr_fp") == F.col("id"), "left_semi").groupBy(F.col("mr_fp").alias("id")).agg(F.min("mr_doc").alias("d"))
        texts = keyed.select("mr_doc", "text").join(one, F.col("mr_doc") == F.col("d")).select("id", "text")
        return map_texts(texts, run, "id long, grams binary").dropDuplicates(["id"])

    return of


def _with_wide(docs: DataFrame) -> DataFrame:
    """(mr_doc, doc_id, text) -> (mr_doc, doc_id, _WIDE, mr_fp)."""
    names = ["mr_doc", "doc_id", *_WIDE, "mr_fp"]

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                f = np.array([wide_fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column(2).cast(pa.large_binary())], np.int64).T.copy()
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, f), pa.array(_node(f[0], f[1]))], names=names)

    return map_texts(docs, run, ", ".join(f"{n} long" for n in names))


def _key_batches(batches):
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fps), 4096):
            row, key = golay_keys(fps[i : i + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 4096][row])], names=["key", "fp"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints in column fp: enough of those at MOST_FLIPS or fewer
    differing bits to join what all of them join, and none at more.

    Fingerprints that share a Golay key are compared in their bucket. In a bucket of more than BUCKET, every
    fingerprint and its 64 neighbours are the centres of balls instead: two lie in one ball exactly if they
    link, and a ball holds 65 at most. That costs 65 rows a fingerprint and no pairs.
    """
    keys = stage(fps.mapInArrow(_key_batches, "key long, fp long"), "op2-keys")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = stage(keys.join(sizes, "key"), "op2-shared")
    small = shared.where(f"n <= {BUCKET}").groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("x"))
    near = f"flatten(transform(x, (p, i) -> transform(filter(slice(x, i + 2, {BUCKET}), q -> bit_count(p ^ q) <= {MOST_FLIPS}), q -> struct(p AS a, q AS b))))"
    pairs = small.select(F.explode(F.expr(near)).alias("l")).select("l.a", "l.b")
    large = shared.where(f"n > {BUCKET}").select("fp").distinct()
    balls = large.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")).alias("centre"))
    hubs = balls.groupBy("centre").agg(F.collect_set("fp").alias("x"), F.min("fp").alias("a")).where("size(x) > 1")
    stars = hubs.select("a", F.explode("x").alias("b")).where("a <> b")
    out = stage(pairs.union(stars).distinct(), "op2-links")
    unstage(keys, shared)
    return out


def _named(known: DataFrame, find, *more: str) -> DataFrame:
    """(mr_node, component_id, root) of every fingerprint in ``known`` (mr_fp, doc_id, more)."""
    nodes = known.groupBy("mr_fp").agg(F.min("doc_id").alias("least"), F.min(F.struct("mr_fp", *more)).alias("m"))
    nodes = stage(nodes.select("mr_fp", "least", *[f"m.{c}" for c in more]), "op2-nodes")
    linked = components(find(nodes.select(F.col("mr_fp").alias("fp"), *more)))
    rooted = nodes.join(linked, F.col("mr_fp") == F.col("node"), "left").select("mr_fp", "least", F.coalesce("root", "mr_fp").alias("root"))
    rooted = stage(rooted, "op2-rooted")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "op2-least")
    names = stage(rooted.join(least, "root").select(F.col("mr_fp").alias("mr_node"), "component_id", "root"), "op2-names")
    unstage(nodes, rooted)
    return names


@shielded("mr_fp", "component_id")
def simhash_groups(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The columns of ``docs`` but text, with mr_fp (the fingerprint, a long) and component_id, which replace
    columns of these names.

    docs: doc_id, text and any more columns. component_id is the smallest doc_id reachable by links, over
    null ids none; it is null where a component has null ids only. Null, empty and blank texts have
    fingerprint 0. Repeated rows and equal texts share a component. An empty table gives an empty one.
    """
    known = stage(with_fingerprint(docs, shingle, keep_text=False), "op2-prints")
    return known.join(_named(known, links).drop("root"), F.col("mr_fp") == F.col("mr_node")).drop("mr_node")


@shielded()
def near_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates, that of the
    smallest doc_id (null last; of equal ids, by a hash of the text). Two are near at a Jaccard similarity of NEAR
    of their sets of five-word shingles, over the whole texts; a group is what such links join.

    Texts without words are one group. Repeated rows are copies like others. An empty table gives an empty one.
    """
    keyed = docs.withColumn("mr_doc", F.xxhash64("doc_id", "text"))
    known = stage(_with_wide(keyed.select("mr_doc", F.col("doc_id").cast("long").alias("doc_id"), "text")), "op2-prints")
    names = _named(known, lambda prints: wide_links(prints, _grams(known, keyed)), *_WIDE).select("mr_node", "root")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "mr_doc")
    first = known.join(names, F.col("mr_fp") == F.col("mr_node")).groupBy("root").agg(F.min(order).alias("x"))
    kept = stage(first.select(F.col("x.mr_doc").alias("mr_doc")).distinct(), "op2-kept")
    out = keyed.join(kept, "mr_doc", "left_semi")
    # Rows that repeat a kept one wholly in id and text: only then must survivors meet once more.
    if not known.join(kept, "mr_doc", "left_semi").groupBy("mr_doc").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["mr_doc"])
    return out.select(*docs.columns)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("mr_fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
