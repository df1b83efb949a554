"""Overlapping word windows over documents."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.params import CHUNK_OVERLAP, CHUNK_WORDS
from millrace.functions.staging import stage
from millrace.functions.tables import map_texts
from millrace.functions.text import words

#: Documents whose running totals are summed in one task.
BUCKET = 4096
#: Words of a slice of a file that are held before windows are made of them.
HELD_WORDS = 1 << 16


def n_windows(n: Column, size: int, overlap: int) -> Column:
    """Windows that n words need: the tail is one only if it has words that no window covers yet."""
    return F.when(n <= 0, 0).when(n <= size, 1).otherwise(F.ceil((n - overlap) / (size - overlap))).cast("int")


def chunk_words(df: DataFrame, word_array: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, cap: int | None = None, paged: bool = False) -> DataFrame:
    """One row for each window of the words in column ``word_array``, which the other columns repeat.

    Adds seq, start_word, end_word, text, and page: that of the window's first word, if the array holds
    (word, page), else null. At most ``cap`` windows of a row, if it is given; a row without words has none.
    """
    _check(size, overlap)
    stride, w = size - overlap, F.col(word_array)
    k = n_windows(F.size(w), size, overlap)
    k = k if cap is None else F.least(k, F.lit(cap))

    def window(c: Column) -> Column:
        part = F.slice(w, c * stride + 1, F.lit(size))
        return F.struct(
            c.alias("seq"), (c * stride).alias("start_word"), F.least(c * stride + size, F.size(w)).alias("end_word"),
            (F.get(w, c * stride)["page"] if paged else F.lit(None).cast("int")).alias("page"),
            F.array_join(F.transform(part, lambda x: x["word"]) if paged else part, " ").alias("text"),
        )

    # All windows of a row are made before they are spread out, so that no row but the source holds all words.
    windows = F.when((F.size(w) > 0) & (k > 0), F.transform(F.sequence(F.lit(0), k - 1), window))
    return df.select(*[c for c in df.columns if c != word_array], F.inline(windows))


def _check(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to less than size")


def _count(n: int, size: int, overlap: int, cap: int | None) -> int:
    k = 0 if n <= 0 else 1 if n <= size else -((overlap - n) // (size - overlap))
    return k if cap is None else min(k, cap)


def count_words(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words): the words of each text, 0 for a null one. ``str.split`` knows the same blanks as ``words``."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.split()) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], names=[key, "n_words"])

    return map_texts(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long")


def count_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, cap: int | None = None) -> DataFrame:
    """(key, n): the chunks that each text has, without making them."""
    _check(size, overlap)
    n = n_windows(F.col("n_words"), size, overlap)
    return count_words(docs, key, text).select(key, (n if cap is None else F.least(n, F.lit(cap))).cast("long").alias("n"))


def number_chunks(chunks: DataFrame, order: str, cap: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Adds chunk_id: 0, 1, ... over documents by ``order`` (a long), then seq. From ``cap`` on they go.
    counts: (order, n) of the chunks, if they are known without counting.
    """
    counts = chunks.groupBy(order).agg(F.count("*").alias("n")) if counts is None else counts
    first = first_chunks(counts, order)
    out = chunks.join(first, order).withColumn("chunk_id", F.col("first_chunk") + F.col("seq")).drop("first_chunk")
    return out if cap is None else out.where(F.col("chunk_id") < cap)


def first_chunks(counts: DataFrame, order: str) -> DataFrame:
    """(order, first_chunk): the number of the first chunk of each document, from counts (order, n).

    Totals run over buckets of document numbers and inside each, never over all documents at once.
    """
    counts = counts.withColumn("b", F.expr(f"{order} DIV {BUCKET}"))
    per = counts.groupBy("b").agg(F.sum("n").alias("n"))
    base = per.select("b", F.coalesce(F.sum("n").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = Window.partitionBy("b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(base, "b")
    return first.select(order, (F.col("base") + F.col("before")).alias("first_chunk"))


def chunk_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, cap: int | None = None, numbered: bool = False) -> DataFrame:
    """Chunks of plain texts: (key, seq, start_word, end_word, page: null, text).

    ``numbered``: also chunk_id, 0, 1, ... over documents by their key (a long, none twice), then seq. Documents meet the
    numbers of their first chunks before they are cut, so that chunks aren't shuffled. One pass in Arrow batches:
    finding words by a pattern costs several times as much.
    """
    _check(size, overlap)
    kind = f"`{key}` {docs.schema[key].dataType.simpleString()}, seq int, start_word int, end_word int, page int, text string"
    rows = docs.select(key, F.col(text).alias("mr_text"))
    if numbered:
        # Staged, as the running totals read them twice.
        rows = rows.join(first_chunks(stage(count_windows(docs, key, text, size, overlap, cap), "windows"), key), key).select(key, "mr_text", "first_chunk")
        kind += ", chunk_id long"

    def run(batches):
        for batch in batches:
            at, seq, start, end, texts = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                w = t.split() if t else []
                for k in range(_count(len(w), size, overlap, cap)):
                    a = k * (size - overlap)
                    at.append(i)
                    seq.append(k)
                    start.append(a)
                    end.append(min(a + size, len(w)))
                    texts.append(" ".join(w[a : a + size]))
            here, number = pa.array(at, pa.int32()), pa.array(seq, pa.int32())
            columns = [batch.column(0).take(here), number, pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.nulls(len(at), pa.int32()), pa.array(texts, pa.string())]
            if numbered:
                columns.append(pc.add(batch.column(2).take(here), number.cast(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "seq", "start_word", "end_word", "page", "text", "chunk_id"][: len(columns)])

    return map_texts(rows, run, kind)


#: Slices of files whose first words' numbers go to every task: 24 bytes each, so 48 MB.
MOST_SLICES = 2_000_000


def chunk_files(spark: SparkSession, path: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, cap: int | None = None, sep: str = "\n") -> DataFrame:
    """Chunks of the text files under a path (UTF-8): (path, seq, start_word, end_word, page: null, text), the same as ``chunk_documents`` makes
    of each file's text; but no row, task or worker ever holds a file.

    Spark cuts files into slices at ``sep``, a character at which no word goes on (give a blank for files without line ends). A
    first pass counts the words of each slice, so that the second knows at which word each begins. It makes the windows that lie
    in its slice whole; of those that run over an end it passes on its part, and the parts meet by file and window.
    """
    _check(size, overlap)
    stride = size - overlap
    found = spark.read.option("lineSep", sep).text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    rows = found.select(F.col("file_path").alias("path"), F.xxhash64("file_path", "file_block_start").alias("slice"), F.col("file_block_start").alias("at"), "value")

    def count(batches):
        for batch in batches:
            n = [len(t.split()) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["path", "slice", "at", "n"])

    counted = map_texts(rows, count, "path string, slice long, at long, n long").groupBy("path", "slice", "at").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("path").orderBy("at")
    slices = stage(counted.select("slice", (F.sum("n").over(w) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy("path")).alias("total")), "slices")
    if slices.count() > MOST_SLICES:
        raise ValueError("too many slices: read fewer files at once, or raise spark.sql.files.maxPartitionBytes")

    def cut(batches):
        """Rows of a slice come together and in order. Its words are held as far as windows that aren't done need them."""
        now, word, held, first, path, total = None, 0, [], 0, None, 0

        def windows(last: bool):
            """Of the windows that have words among those held, all that end there; at the slice's end the others' parts too."""
            nonlocal held, first
            out, k = [], max(0, -((size - first - 1) // stride) if first >= size else 0)
            n = _count(total, size, overlap, cap)
            while k < n and k * stride < first + len(held):
                start, end = k * stride, min(k * stride + size, total)
                if end > first + len(held) and not last:
                    break
                if end > first:
                    part = held[max(0, start - first) : end - first]
                    out.append((path, k, start, end, max(start, first), " ".join(part)))
                k += 1
            # The next window's words stay; those before it are done with.
            keep = max(0, min(len(held), k * stride - first))
            held, first = held[keep:], first + keep
            return out

        def batch_of(out):
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["path", "seq", "start_word", "end_word", "part", "text"])

        for batch in batches:
            for p, s, t, base, whole in zip(*(batch.column(c).to_pylist() for c in ("path", "slice", "value", "base", "total"))):
                if s != now:
                    if now is not None and (out := windows(True)):
                        yield batch_of(out)
                    now, held, first, path, total = s, [], base, p, whole
                held += t.split()
                if len(held) > HELD_WORDS and (out := windows(False)):
                    yield batch_of(out)
        if now is not None and (out := windows(True)):
            yield batch_of(out)

    placed = rows.join(F.broadcast(slices), "slice").select("path", "slice", "value", "base", "total")
    parts = map_texts(placed, cut, "path string, seq int, start_word int, end_word int, part long, text string")
    met = parts.groupBy("path", "seq", "start_word", "end_word").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    return met.select("path", "seq", "start_word", "end_word", F.lit(None).cast("int").alias("page"), F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def chunk_pages(pages: DataFrame, key: str, page: str, text: str = "text", size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, cap: int | None = None) -> DataFrame:
    """Chunks of documents given page by page; windows run over page ends."""
    listed = pages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("page"), words(F.col(text)).alias("w")))).alias("p"))
    flat = F.flatten(F.transform("p", lambda p: F.transform(p["w"], lambda w: F.struct(w.alias("word"), p["page"].alias("page")))))
    return chunk_words(listed.select(key, flat.alias("w")), "w", size, overlap, cap, paged=True)
