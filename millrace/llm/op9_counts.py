"""Token counts by source, language and tokenizer version, kept up by signed deltas (operator 9)."""

from __future__ import annotations

import base64
import uuid

import public_tokenizers
import pyarrow as pa
import tiktoken
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts, shared_dir, stage, table, unstage

KEYS = ("source", "lang", "version")
KIND = "source string, lang string, version string, n_docs long, n_tokens long"
#: Tokenizer versions of the query: rank files by name.
VERSIONS = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: Bytes that a token is taken for before it is counted.
ESTIMATE_BYTES = 4

_encodings: dict[tuple[str, int], tiktoken.Encoding] = {}


def _encoding(name: str, ranks_file: bytes) -> tiktoken.Encoding:
    key = (name, hash(ranks_file))
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        _encodings[key] = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def with_token_counts(docs: DataFrame, versions: dict[str, str]) -> DataFrame:
    """The columns of ``docs`` but text, with n_<version> for each version (its rank file's path): the exact
    token count of the whole text, 0 for a null or empty one."""
    spark, names = docs.sparkSession, [f"n_{v}" for v in versions]
    docs = docs.drop(*names)
    files = {}
    for v, path in versions.items():
        with open(path, "rb") as f:
            files[v] = f.read()
    shared, at = spark.sparkContext.broadcast(files), docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        encoders = [_encoding(v, raw) for v, raw in shared.value.items()]
        for batch in batches:
            counts = [[] for _ in encoders]
            for t in batch.column(at):
                text = t.as_py() or ""
                for c, e in zip(counts, encoders):
                    c.append(len(e.encode_ordinary(text)))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], *[pa.array(c, pa.int64()) for c in counts]], names=[*[batch.schema.names[i] for i in keep], *names])

    return map_texts(docs, run, T.StructType([*[docs.schema.fields[i] for i in keep], *[T.StructField(n, T.LongType()) for n in names]]))


def signed(changes: DataFrame) -> DataFrame:
    """(source, lang, version, n_docs, n_tokens): the sum of the changes by key.

    changes: op, source, lang, version, n_tokens, old_tokens, and optionally n_rows (1 if absent or null) for
    that many equal changes. 'insert' adds a document and its tokens, 'delete' takes them away, 'revise' adds
    n_tokens - old_tokens; another or null op is an error. Null token counts are 0; null keys are keys.
    """
    n = F.coalesce(F.col("n_rows"), F.lit(1)) if "n_rows" in changes.columns else F.lit(1)
    tokens, old = F.coalesce("n_tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    op = F.col("op")
    sign = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(F.raise_error("op is not insert, delete or revise"))
    delta = F.when(op == "revise", tokens - old).otherwise(sign * tokens)
    return changes.groupBy(*KEYS).agg(F.sum(n * sign).cast("long").alias("n_docs"), F.sum(n * delta).cast("long").alias("n_tokens"))


FOLDED = "batch string, folder string"


class Ledger:
    """Committed deltas in a folder, one batch each, and totals that are their sum.

    A batch's rows are written to a folder of their own. It is committed by one step after that: a small file named after
    the batch, which says where its rows are, gets its place by a rename that fails if the file is there. So a batch
    counts wholly or not at all, a batch that is committed again changes nothing, whoever comes first, and batches may
    arrive in any order. A base, made by ``fold``, is committed in the same way and lists the batches in it.

    What is read goes by one listing of these files. Totals are read when their plan runs: if a fold has removed the
    rows meanwhile, it fails, and asking for totals again helps.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._at = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(self._conf)
        self._fs.mkdirs(self._at(self.path))

    def _listed(self) -> tuple[str | None, list[str]]:
        """The latest base, and the batches beside it, by one listing."""
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)))
        bases = [n for n in names if n.startswith("base-")]
        return bases[-1] if bases else None, [n.removeprefix("batch-") for n in names if n.startswith("batch-")]

    def _rows_of(self, name: str) -> str:
        """The folder that a commit file names."""
        stream = self._fs.open(self._at(f"{self.path}/{name}"))
        try:
            return f"{self.path}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def _put(self, folder: str, name: str) -> bool:
        """Commit a folder of rows by the file ``name``; False, and the folder goes, if there is one."""
        fs = self._jvm.org.apache.hadoop.fs
        note, at = self._at(f"{self.path}/_note-{uuid.uuid4().hex}"), self._at(f"{self.path}/{name}")
        out = self._fs.create(note, False)
        out.writeBytes(folder)
        out.close()
        how = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
        try:
            fs.FileContext.getFileContext(note.toUri(), self._conf).rename(self._fs.makeQualified(note), self._fs.makeQualified(at), how)
            return self._rows_of(name).endswith(folder)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            self._fs.delete(note, False)
            self._fs.delete(self._at(f"{self.path}/{folder}"), True)
            return False

    def _folded(self, base: str | None) -> dict[str, str]:
        """The batches in a base, each with the folder that its rows were in."""
        return dict(map(tuple, self.spark.read.schema(FOLDED).parquet(f"{self._rows_of(base)}/batches").collect())) if base else {}

    def batches(self) -> list[str]:
        """Ids of the committed batches."""
        base, names = self._listed()
        return sorted({*self._folded(base), *names})

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add the changes as one batch. False, and nothing done, if there is a batch of this id."""
        if not batch.replace("-", "").replace("_", "").isalnum():
            raise ValueError("a batch id has letters, digits, - and _")
        if batch in self.batches():
            return False
        folder = f"rows-{uuid.uuid4().hex}"
        signed(changes).write.parquet(f"{self.path}/{folder}")
        if not self._put(folder, f"batch-{batch}"):
            return False
        # If another commit of the batch was folded between the look and the rename, the base lists that one's rows.
        if self._folded(self._listed()[0]).get(batch, folder) == folder:
            return True
        self._fs.delete(self._at(f"{self.path}/batch-{batch}"), False)
        self._fs.delete(self._at(f"{self.path}/{folder}"), True)
        return False

    def _sum(self, base: str | None, names: list[str]) -> DataFrame:
        parts = ([f"{self._rows_of(base)}/totals"] if base else []) + [self._rows_of(f"batch-{n}") for n in names]
        if not parts:
            return self.spark.createDataFrame([], KIND)
        rows = self.spark.read.schema(KIND).parquet(*parts)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 OR n_tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, n_docs, n_tokens) of all batches; keys of which nothing is left are absent."""
        base, names = self._listed()
        inside = self._folded(base)
        return self._sum(base, [n for n in names if n not in inside])

    def fold(self) -> bool:
        """Sum the batches that are committed now into a new base, so that totals read one table. Batches may be
        committed meanwhile: they aren't in the base's list, and count beside it. False if another fold came first."""
        base, names = self._listed()
        inside = self._folded(base)
        names = [n for n in names if n not in inside]
        if not names:
            return True
        folder = f"rows-{uuid.uuid4().hex}"
        self._sum(base, names).write.parquet(f"{self.path}/{folder}/totals")
        listed = inside | {n: self._rows_of(f"batch-{n}").rpartition("/")[2] for n in names}
        self.spark.createDataFrame(sorted(listed.items()), FOLDED).write.parquet(f"{self.path}/{folder}/batches")
        if not self._put(folder, f"base-{int(base.split('-')[1]) + 1 if base else 0:09d}"):
            return False
        gone = [f"batch-{n}" for n in names] + ([base] if base else [])
        for name, rows in [(n, self._rows_of(n)) for n in gone]:
            self._fs.delete(self._at(f"{self.path}/{name}"), False)
            self._fs.delete(self._at(rows), True)
        return True

    def clean(self) -> None:
        """Delete what commits and folds that broke off have left: rows that no file names, and files of batches that the
        base has. Nothing may write meanwhile."""
        base, names = self._listed()
        inside = self._folded(base)
        files = [f"batch-{n}" for n in names if n not in inside] + ([base] if base else [])
        keep = {*files, *(self._rows_of(f).rpartition("/")[2] for f in files)}
        for s in self._fs.listStatus(self._at(self.path)):
            if s.getPath().getName() not in keep:
                self._fs.delete(s.getPath(), True)

    def remove(self) -> None:
        """Delete the folder with all that is in it."""
        self._fs.delete(self._at(self.path), True)


def op9_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals after four batches over the whole table: every document comes in with an estimate for each
    tokenizer version, is counted and revised, and goes again if a document before it (by doc_id, null last)
    has the same text. The last batch is committed twice, as after a lost answer."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    facts = docs.withColumn("estimate", F.ceil(F.coalesce(F.octet_length("text"), F.lit(0)) / ESTIMATE_BYTES)).withColumn("same", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    facts = stage(with_token_counts(facts, {v: public_tokenizers.path(f"{v}.tiktoken") for v in VERSIONS}), "op9-facts")
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("version"), F.col(f"n_{v}").alias("n")) for v in VERSIONS]))
    counted = facts.select("source", "lang", "estimate", each.alias("v")).select("source", "lang", "v.version", "estimate", "v.n")
    ledger = Ledger(spark, f"{shared_dir(spark)}/op9-{uuid.uuid4().hex}")
    ledger.commit("0-insert", counted.selectExpr("'insert' AS op", *KEYS, "estimate AS n_tokens", "0L AS old_tokens"))
    ledger.commit("1-revise", counted.selectExpr("'revise' AS op", *KEYS, "n AS n_tokens", "estimate AS old_tokens"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "source", "lang")
    groups = stage(facts.groupBy("same", "doc_id", "source", "lang", *[f"n_{v}" for v in VERSIONS]).agg(F.count("*").alias("n_rows")), "op9-groups")
    first = stage(groups.groupBy("same").agg(F.min(order).alias("first")).withColumnRenamed("same", "s"), "op9-first")
    extra = groups.join(first, F.col("same") == F.col("s")).withColumn("n_rows", F.col("n_rows") - (order == F.col("first")).cast("long")).where("n_rows > 0")
    gone = extra.select("source", "lang", "n_rows", each.alias("v")).selectExpr("'delete' AS op", "source", "lang", "v.version AS version", "v.n AS n_tokens", "0L AS old_tokens", "n_rows")
    ledger.commit("2-copies", gone)
    ledger.commit("2-copies", gone)
    unstage(facts, groups, first)
    totals = stage(ledger.totals(), "op9-totals")
    ledger.remove()
    return totals


QUERIES = {"op9_counts": op9_counts}
