"""A corpus on disk: parts that are written once, snapshots that say what is in them, and the operations on both.

A part holds what one call of ``ingest`` added: chunks, postings in blocks and vectors, by document number and place, and
the statuses of the files that came. Beside the parts stand what adds up over them: sums of products of vectors, and counts of
the chunks that have a term. A snapshot is a table of documents, each with its part and the number of its first chunk, and a
manifest: which sums and counts hold, how many rows each part has, what made the vectors, and the last batch of each
stream. Nothing of a part is made again later; deleting a document writes a snapshot and negative counts and sums.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.params import CHUNK_OVERLAP, CHUNK_WORDS, EMBED_DIM, MAX_CHUNKS
from millrace.functions.staging import settled, stage, unstage
from millrace.functions.text import words
from millrace.operators import dense, spectral
from millrace.operators.blocks import BLOCK, BLOCKS, TERMS, BlockIndex, make_blocks, write_sorted
from millrace.operators.chunking import chunk_words, first_chunks
from millrace.operators.lexical import exploded, term_counts
from millrace.operators.search import Corpus, Embedder
from millrace.operators.spectral import SpectralMap

DOCS = "doc_no long, name string, sha256 string, bytes long, first_chunk long, n_chunks long, n_terms long, part string"
PART_CHUNKS = "part string, doc_no long, seq int, start_word int, end_word int, page int, text string, dl int"
VECTORS, GRAM = "part string, doc_no long, seq int, embedding array<double>", "i int, j int, g double"
STATUSES = "name string, sha256 string, status int, error string, n_chunks long"
#: kind: 'sum' and 'terms' (name), 'part' (name, rows of chunks, postings), 'embedder' (name, dimension), 'batch' (stream, number, and
#: the part as note), 'docs' (rows, chunks).
MANIFEST = "kind string, name string, a long, b long, note string"
#: What Spark says of a file that is missing or can't be read.
DAMAGE = ("PATH_NOT_FOUND", "FAILED_READ_FILE", "CANNOT_READ_FILE_FOOTER", "FileNotFoundException", "is not a Parquet file")
#: Makes one number of a document's and a place in it.
PLACES = 1 << 31


class UnknownDocument(KeyError):
    """No document has this digest (404)."""


@dataclass
class Store:
    """Documents and chunks in a folder of snapshots. Readers see one snapshot whole; a writer that fails
    leaves the pointer where it was. ``embed`` makes the vectors, ``dim`` components each, and ``embedder`` is its name
    and version: vectors of two names are never kept together."""

    spark: SparkSession
    path: str
    cap: int = MAX_CHUNKS
    size: int = CHUNK_WORDS
    overlap: int = CHUNK_OVERLAP
    embed: Embedder = dense.hash_embeddings
    embedder: str = "hashed-words-1"
    dim: int = EMBED_DIM

    def _hadoop(self, p: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _snapshots(self) -> list[str]:
        """The folders of all snapshots, oldest first."""
        fs, at = self._hadoop(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return [f"{self.path}/{n}" for n in sorted(names) if n.startswith("v-")]

    def current(self) -> str | None:
        """The folder of the current snapshot: that with the highest number."""
        return next(reversed(self._snapshots()), None)

    def _swap(self, docs: DataFrame, manifest: list[tuple]) -> None:
        """Write a snapshot aside and give it the next number in one rename."""
        now, name = self.current(), f"_new-{uuid.uuid4().hex}"
        tmp = f"{self.path}/{name}"
        docs.write.parquet(f"{tmp}/docs")
        n = self.spark.read.schema(DOCS).parquet(f"{tmp}/docs").agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
        rows = [*[r for r in manifest if r[0] != "docs"], ("docs", "", n[0], n[1], None)]
        self.spark.createDataFrame(rows, MANIFEST).write.parquet(f"{tmp}/manifest")
        fs, at = self._hadoop(tmp)
        target = self._hadoop(f"{self.path}/v-{int(now.rpartition('-')[2]) + 1 if now else 0:09d}")[1]
        if fs.exists(target) or not fs.rename(at, target):
            raise OSError("another writer was first")
        inside = self._hadoop(f"{target.toString()}/{name}")[1]
        if fs.exists(inside):  # some file systems move a folder into another one of the name
            fs.delete(inside, True)
            raise OSError("another writer was first")

    def docs(self) -> DataFrame:
        now = self.current()
        return self.spark.read.schema(DOCS).parquet(f"{now}/docs") if now else self.spark.createDataFrame([], DOCS)

    def _manifest(self, at: str | None = None) -> list[Row]:
        """The rows of a snapshot's manifest, that of the current one by default: one for each part, sum and stream."""
        at = at or self.current()
        return self.spark.read.schema(MANIFEST).parquet(f"{at}/manifest").collect() if at else []

    def _named(self, kind: str) -> list[str]:
        return sorted(r["name"] for r in self._manifest() if r["kind"] == kind)

    def _in(self) -> DataFrame:
        """The documents that have chunks."""
        return self.docs().where("n_chunks > 0").select("doc_no", "name", "sha256", "first_chunk", "n_chunks", "part")

    def _rows(self, kind: str, schema: str) -> DataFrame:
        """A table of all parts, as they were written."""
        parts = sorted(r[0] for r in self._in().select("part").distinct().collect())
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}/{kind}" for p in parts]) if parts else self.spark.createDataFrame([], schema)

    def _numbered_now(self, rows: DataFrame) -> DataFrame:
        """The rows (part, doc_no, seq) of documents and chunks that are still in; id is the chunk's number now."""
        # A deleted document's number may be another one's in a later part.
        return rows.join(self._in(), ["part", "doc_no"]).where("seq < n_chunks").withColumn("id", F.col("first_chunk") + F.col("seq"))

    def _kept(self, kind: str, schema: str) -> DataFrame:
        return self._numbered_now(self._rows(kind, schema))

    def all_chunks(self) -> DataFrame:
        return self._kept("chunks", PART_CHUNKS).select("id", "doc_no", "sha256", F.col("name").alias("doc"), "seq", "start_word", "end_word", "page", "text")

    def lexical(self) -> BlockIndex:
        """The kept index: nothing is tokenised, and counts and lengths are sums of what every part and deletion has left."""
        names = self._named("terms")
        counts = self.spark.read.schema(TERMS).parquet(*[f"{self.path}/terms/{n}" for n in names]) if names else self.spark.createDataFrame([], TERMS)
        stats = self.docs().agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_terms"), F.lit(0)).alias("total"))

        def live(rows: DataFrame) -> DataFrame:
            placed = rows.withColumns({"doc_no": F.expr(f"id DIV {PLACES}"), "seq": F.expr(f"id % {PLACES}")})
            return self._numbered_now(placed.drop("id")).select(*rows.drop("part").columns)

        return BlockIndex(self._rows("blocks", f"part string, {BLOCKS}"), counts, stats, live)

    def _numbered(self, names: DataFrame) -> DataFrame:
        """``names`` (name, sha256) with k: 0, 1, ... in their order. They are sorted over all partitions, and each counts on
        from those before it."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_ = names.repartitionByRange(n, "name", "sha256").sortWithinPartitions("name", "sha256")
        placed = stage(sorted_.select("name", "sha256", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row")), "names")
        before = placed.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
        return placed.join(before, "p").select("name", "sha256", (F.col("base") + F.col("row")).alias("k"))

    def ingest(self, files: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Add gated, extracted files (name, sha256, length, status, error, pages) in the order of name and digest.

        Returns (name, sha256, status, error, n_chunks): 409 for a digest that is known or came before, 422 and
        so on as gated. Chunks beyond the cap of the whole corpus aren't kept. A document without words is kept
        with none. Writes one part and a new snapshot; what was there before is neither read nor written anew, but for
        the table of documents. ``batch``: the name of a stream and a number in it, which is kept in the snapshot: a batch
        that the store has, whole, adds nothing and has the statuses that it had.
        """
        manifest = [tuple(r) for r in self._manifest()]
        for kind, name, number, dim, note in manifest:
            if kind == "embedder" and (name, number) != (self.embedder, self.dim):
                raise ValueError(f"the vectors kept here are of {name} with {number} components")
            if batch and (kind, name) == ("batch", batch[0]) and batch[1] <= number:
                if batch[1] < number:
                    raise ValueError(f"batch {batch[1]} of {name} comes after batch {number}")
                return self.spark.read.schema(STATUSES).parquet(f"{self.path}/parts/{note}/statuses")
        known, files = self.docs(), stage(files, "files")
        base = known.agg(F.coalesce(F.max("doc_no"), F.lit(-1)), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
        ok = files.where("status = 200").select("name", "sha256", "length", "pages")
        first = ok.groupBy("sha256").agg(F.min("name").alias("name")).join(known.select("sha256"), "sha256", "left_anti")
        numbers = stage(self._numbered(first).select("name", "sha256", (F.col("k") + base[0] + 1).alias("doc_no")), "numbers")
        fresh = ok.join(numbers, ["name", "sha256"]).dropDuplicates(["doc_no"])
        part, at = uuid.uuid4().hex, lambda kind: f"{self.path}/parts/{part}/{kind}"
        flat = F.flatten(F.transform("pages", lambda p: F.transform(words(p["text"]), lambda w: F.struct(w.alias("word"), p["page"].alias("page")))))
        cut = stage(chunk_words(fresh.select("doc_no", "length", flat.alias("w")), "w", self.size, self.overlap, self.cap, paged=True), "cut")
        counts = cut.groupBy("doc_no").agg(F.count("*").alias("n"))
        places = first_chunks(counts, "doc_no").join(counts, "doc_no").select("doc_no", (F.col("first_chunk") + base[1]).alias("first_chunk"), F.greatest(F.lit(0), F.least("n", self.cap - base[1] - F.col("first_chunk"))).alias("n_chunks"))
        places = stage(places, "places")
        kept = stage(cut.join(places, "doc_no").where("seq < n_chunks").select("doc_no", "seq", "start_word", "end_word", "page", "text", (F.col("first_chunk") + F.col("seq")).alias("at")), "kept")
        counted = stage(term_counts(kept.select("doc_no", "seq", "at", "text")), "counted")
        mine = F.lit(part).alias("part")
        kept.drop("at").join(counted.select("doc_no", "seq", "dl"), ["doc_no", "seq"]).select(mine, *PART_CHUNKS.replace(" string", "").replace(" long", "").replace(" int", "").split(", ")[1:]).write.parquet(at("chunks"))
        posted = exploded(counted).select(mine, "term", F.expr(f"at DIV {BLOCK}").alias("block"), (F.col("doc_no") * PLACES + F.col("seq")).alias("id"), "dl", "tf")
        write_sorted(make_blocks(posted, "part"), at("blocks"), "term", "block")
        write_sorted(exploded(counted).groupBy("term").agg(F.count("*").alias("df")), f"{self.path}/terms/{part}", "term")
        made = self.embed(kept.select((F.col("doc_no") * PLACES + F.col("seq")).alias("id"), "text"), "id")
        made.select(mine, F.expr(f"id DIV {PLACES}").alias("doc_no"), F.expr(f"CAST(id % {PLACES} AS int)").alias("seq"), F.col("embedding").cast("array<double>").alias("embedding")).write.parquet(at("vectors"))
        vectors = self.spark.read.schema(VECTORS).parquet(at("vectors"))
        size = counted.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
        fits = vectors.agg(F.count("*"), F.count_if(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dim)).first()
        if fits[0] != size[0] or fits[1]:
            raise ValueError(f"{self.embedder} has to make a vector of {self.dim} components for every chunk")
        spectral.gram(vectors).write.parquet(f"{self.path}/sums/{part}")
        lengths = fresh.select("doc_no", F.col("length").alias("bytes"))
        new = numbers.join(lengths, "doc_no").join(places, "doc_no", "left").join(counted.groupBy("doc_no").agg(F.sum("dl").alias("n_terms")), "doc_no", "left")
        new = new.select(
            "doc_no", "name", "sha256", "bytes", F.when(F.col("n_chunks") > 0, F.col("first_chunk")).alias("first_chunk"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
            F.coalesce("n_terms", F.lit(0)).alias("n_terms"), mine)
        new = stage(new, "new")
        self._statuses(files, new).write.parquet(at("statuses"))
        manifest = [r for r in manifest if r[0] != "embedder" and not (batch and r[:2] == ("batch", batch[0]))]
        manifest += [("sum", part, None, None, None), ("terms", part, None, None, None), ("part", part, size[0], size[1], None), ("embedder", self.embedder, self.dim, None, None)]
        manifest += [("batch", batch[0], batch[1], None, part)] if batch else []
        self._swap(known.unionByName(new), manifest)
        unstage(files, numbers, cut, places, kept, counted, new)
        return self.spark.read.schema(STATUSES).parquet(at("statuses"))

    def _statuses(self, files: DataFrame, new: DataFrame) -> DataFrame:
        """What became of each file: new has the documents that it made."""
        added = new.select("sha256", F.col("name").alias("mr_name"), F.col("n_chunks").cast("long").alias("n_chunks"))
        out = files.select("name", "sha256", "status", "error").join(added, "sha256", "left")
        here = F.col("mr_name") == F.col("name")
        again = (F.col("status") == 200) & ~F.coalesce(here, F.lit(False))
        return out.select(
            "name", "sha256", F.when(again, 409).otherwise(F.col("status")).alias("status"), F.when(again, "already indexed").otherwise(F.col("error")).alias("error"),
            F.when(here & (F.col("status") == 200), F.col("n_chunks")).alias("n_chunks"),
        )

    def delete(self, sha256: str) -> str:
        """Remove a document; the others keep their order and their chunks are numbered anew. Its name."""
        docs = self.docs()
        gone = docs.where(F.col("sha256") == sha256).first()
        if gone is None:
            raise UnknownDocument(sha256)
        manifest = [tuple(r) for r in self._manifest()]
        if gone["n_chunks"]:
            name, mine = uuid.uuid4().hex, F.col("sha256") == sha256
            vectors = self._kept("vectors", VECTORS).where(mine)
            spectral.gram(vectors).withColumn("g", -F.col("g")).write.parquet(f"{self.path}/sums/{name}")
            counted = exploded(term_counts(self.all_chunks().where(mine).select("id", "text"))).groupBy("term").agg((-F.count("*")).alias("df"))
            write_sorted(counted, f"{self.path}/terms/{name}", "term")
            manifest += [("sum", name, None, None, None), ("terms", name, None, None, None)]
        left = docs.where(F.col("sha256") != sha256)
        first = first_chunks(left.where("n_chunks > 0").select("doc_no", F.col("n_chunks").alias("n")), "doc_no")
        kept = stage(left.drop("first_chunk").join(first, "doc_no", "left").select(*docs.columns), "docs")
        self._swap(kept, manifest)
        unstage(kept)
        return gone["name"]

    def reset(self) -> None:
        """An empty snapshot. Streams go on from where they are; another embedder may be used from now on."""
        self._swap(self.spark.createDataFrame([], DOCS), [tuple(r) for r in self._manifest() if r["kind"] == "batch"])

    def sound(self, snapshot: str) -> bool:
        """Whether all that a snapshot names is there and can be read: its documents, and of each part every chunk, posting and
        vector, and all sums and counts."""
        try:
            manifest = self._manifest(snapshot)
            n = self.spark.read.schema(DOCS).parquet(f"{snapshot}/docs").agg(F.count("*"), F.coalesce(F.sum("n_chunks"), F.lit(0))).first()
            if [(r["a"], r["b"]) for r in manifest if r["kind"] == "docs"] != [tuple(n)]:
                return False
            want = {r["name"]: (r["a"], r["a"], r["b"]) for r in manifest if r["kind"] == "part" and r["a"]}
            tables = [(kind, [f"{self.path}/{folder}/{r['name']}" for r in manifest if r["kind"] == kind], schema) for kind, folder, schema in (("sum", "sums", GRAM), ("terms", "terms", TERMS))]
            for _, paths, schema in tables:
                if paths:
                    self.spark.read.schema(schema).parquet(*paths).agg(F.count("*"), F.sum(F.hash("*").cast("long"))).first()
            got: dict[str, list[int]] = {p: [] for p in want}
            for kind, schema, size in (("chunks", PART_CHUNKS, F.lit(1)), ("vectors", VECTORS, F.lit(1)), ("blocks", f"part string, {BLOCKS}", F.col("n"))):
                if want:
                    rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/parts/{p}/{kind}" for p in sorted(want)])
                    # The hash makes every column be read.
                    for r in rows.groupBy("part").agg(F.sum(size).alias("n"), F.sum(F.hash("*").cast("long"))).collect():
                        got[r["part"]].append(r["n"])
            return {p: tuple(x) for p, x in got.items()} == want
        except (PySparkException, Py4JJavaError) as e:
            if any(sign in str(e) for sign in DAMAGE):
                return False
            raise  # whatever else went wrong says nothing about the files

    def recover(self) -> str | None:
        """Take the newest snapshot that is sound. If that isn't the current one it is written anew as the current one; without
        a sound one the corpus is empty. Returns the snapshot that was taken."""
        found = self._snapshots()
        good = next((v for v in reversed(found) if self.sound(v)), None)
        if good is None:
            if found:
                self._swap(self.spark.createDataFrame([], DOCS), [])
        elif good != found[-1]:
            docs = stage(self.spark.read.schema(DOCS).parquet(f"{good}/docs"), "docs")
            self._swap(docs, [tuple(r) for r in self._manifest(good)])
            unstage(docs)
        return good

    def clean(self) -> None:
        """Delete old snapshots, and what the current one doesn't name. Nothing may read or write meanwhile."""
        now, fs, manifest = self.current(), self._hadoop(self.path)[0], self._manifest()
        parts = {r[0] for r in self.docs().select("part").distinct().collect()} | {r["note"] for r in manifest if r["kind"] == "batch"}
        named = {"parts": parts} | {folder: {r["name"] for r in manifest if r["kind"] == kind} for folder, kind in (("sums", "sum"), ("terms", "terms"))}
        for folder in ("", *named):
            at = self._hadoop(f"{self.path}/{folder}" if folder else self.path)[1]
            for s in fs.listStatus(at) if fs.exists(at) else []:
                name = s.getPath().getName()
                if name not in named[folder] if folder else name.startswith(("v-", "_new-")) and not now.endswith(name):
                    fs.delete(s.getPath(), True)

    def chunk(self, id: int):
        return self.all_chunks().where(F.col("id") == id).first()

    def health(self) -> dict:
        return {"ok": True, "chunks": self.docs().agg(F.coalesce(F.sum("n_chunks"), F.lit(0))).first()[0]}

    def page(self, offset: int, limit: int) -> DataFrame:
        """Chunks offset to offset + limit, in order; limit from 1 to 100."""
        if offset < 0 or not 1 <= limit <= 100:
            raise ValueError("offset from 0, limit from 1 to 100")
        return self.all_chunks().where(F.col("id").between(offset, offset + limit - 1)).orderBy("id")

    def corpus(self) -> Corpus:
        """The chunks with their kept index and vectors."""
        return Corpus(self.all_chunks().select("id", "doc", "page", "text"), self.lexical(), self.vectors(), self.embed)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """Passages of each query (query_id, text); k from 1 to 20. Queries of no or over 2000 characters have none."""
        if not 1 <= k <= 20:
            raise ValueError("k from 1 to 20")
        queries = queries.where(F.char_length("text").between(1, 2000))
        return settled(lambda: self.corpus().passages(queries, k), "passages")

    def vectors(self) -> DataFrame:
        """(id, embedding) of all chunks, as they were added."""
        return self._kept("vectors", VECTORS).select("id", "embedding")

    def fitted(self) -> SpectralMap | None:
        """The map of all chunks, from the sums of the parts; None without chunks. No vector is read."""
        n = self.health()["chunks"]
        if not n:
            return None
        rows = self.spark.read.schema(GRAM).parquet(*[f"{self.path}/sums/{s}" for s in self._named("sum")])
        return SpectralMap.of_gram(spectral.matrix(rows.groupBy("i", "j").agg(F.sum("g").alias("g"))), n)

    def map(self, queries: DataFrame | None = None, k: int = 5, max_points: int = 1500) -> dict:
        """points (id, x, y), queries (query_id, x, y), hits (query_id, rank, chunk_id), eta, n_total."""
        vectors, fitted = self.vectors(), self.fitted()
        if fitted is None:
            return {"points": vectors.selectExpr("id", "0D AS x", "0D AS y").limit(0), "queries": None, "hits": None, "eta": 0.0, "n_total": 0}
        hits = points_of = None
        if queries is not None:
            hits = self.search(queries, k).select("query_id", "rank", "chunk_id")
            q = self.embed(queries, "query_id").select(F.col("id").alias("query_id"), F.col("embedding").alias("e"))
            x, y = fitted.project(F.col("e"))
            points_of = q.select("query_id", x.alias("x"), y.alias("y"))
        points = fitted.points(vectors, hits.select(F.col("chunk_id").alias("id")) if hits is not None else None, max_points)
        return {"points": points, "queries": points_of, "hits": hits, "eta": fitted.eta, "n_total": fitted.n_rows}

    def stats(self, last_report: DataFrame | None = None) -> DataFrame:
        """One row: n_docs, n_chunks, vocab_size, avgdl, index_bytes, vector_bytes, eta, max_chunks, capped, and report, the
        rows of ``last_report`` (of metrics.report) as JSON, null without one."""
        index, fitted = self.lexical(), self.fitted()
        s = index.summary().select(F.col("n_docs").alias("n_chunks"), "vocab_size", F.round("avgdl", 2).alias("avgdl"))
        d = self.docs().agg(F.count("*").alias("n_docs"))
        v = self.docs().agg((F.coalesce(F.sum("n_chunks"), F.lit(0)) * self.dim * 4).alias("vector_bytes"))
        out = d.join(s, F.lit(True)).join(index.size_bytes(), F.lit(True)).join(v, F.lit(True)).withColumn("eta", F.lit(fitted.eta if fitted else 0.0))
        out = out.withColumn("max_chunks", F.lit(self.cap)).withColumn("capped", F.col("n_chunks") >= self.cap)
        if last_report is None:
            return out.withColumn("report", F.lit(None).cast("string"))
        return out.join(last_report.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*last_report.columns)))).alias("report")), F.lit(True))
