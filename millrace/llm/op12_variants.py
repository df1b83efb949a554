"""Spelling variants: words one code point apart, found by walking tries with an automaton for each word.

The dictionary is cut in the order of words into shards, each a compact trie: nodes in breadth-first order, the children of a
node beside each other and known by a bit each, and of a branch with one word only the word itself. Shards are broadcast
some at a time, ``BROADCAST_BYTES`` at most. Every word meets every shard: its automaton, which accepts what lies one inserted,
deleted or replaced code point from it, goes down the trie as far as both go, and wherever it spends its one change
that branch is followed to its end before the next. The automata of a few thousand words go down together, as arrays of
states. Of a word's accepting neighbours a task keeps their number and the one of largest count; these are added up over
the shards.

Words are of the 26 small letters of ASCII and U+00C0 to U+00FF, so a code point is a byte of Latin-1.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, settled, stage, table, unstage

#: Words of a shard, bytes of the shards that are broadcast together, words whose automata run together.
SHARD_WORDS, BROADCAST_BYTES, TOGETHER = 1 << 16, 48 << 20, 4096
#: Fixed by the operator's contract: the least length and count of a word, one in how many runs loses a code point, and
#: by how much a form outnumbers its variant.
LEAST_LENGTH, LEAST_COUNT, MUTED, TIMES = 7, 2, 31, 10

RUN = re.compile(rf"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}")
SMALL = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words that are counted in a task before their counts are handed on.
HELD = 200_000


def spelled(doc_id, runs: list[str]):
    """(word, times) of a document's runs in lower case: one in ``MUTED`` of the different ones, by a hash, without one of its code points."""
    head, counts = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), {}
    for run in runs:
        counts[run] = counts.get(run, 0) + 1
    for run, n in counts.items():
        h = zlib.crc32(run.encode(), head)
        if h % MUTED == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n): all words of at least ``LEAST_LENGTH`` code points and ``LEAST_COUNT`` occurrences in doc_id, text. A shorter run
    can't make one."""

    def run(batches):
        held: dict[str, int] = {}

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "c": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for word, n in spelled(doc_id, [r.translate(SMALL) for r in RUN.findall(text or "")]):
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    found = map_texts(docs.select("doc_id", "text"), run, "word string, c long")
    return found.groupBy("word").agg(F.sum("c").alias("n")).where(f"n >= {LEAST_COUNT}")


class Trie:
    """A compact trie of sorted words, as arrays. Node 0 is the root; ``low`` and ``high`` have a bit for each child by its letter
    (a to z; U+00C0 to U+00FF), ``first`` is the first child's number. ``ends`` is the word that ends at a node or -1; if
    ``alone`` it is the only word below, and the rest of it has no nodes."""

    FIELDS = (("low", np.uint32), ("high", np.uint64), ("first", np.int32), ("ends", np.int32), ("alone", np.bool_), ("depth", np.int32))

    def __init__(self, letters: np.ndarray, starts: np.ndarray, counts: np.ndarray):
        self.letters, self.starts, self.counts = letters, starts, counts
        self.lengths = np.diff(starts)
        for (name, _), column in zip(self.FIELDS, self._nodes()):
            setattr(self, name, column)

    @staticmethod
    def of(words: list[str], counts: list[int]) -> Trie:
        raw = [w.encode("latin-1") for w in words]
        return Trie(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), np.array(counts, np.int64))

    def _nodes(self):
        """Level by level: the words below each node are a stretch of those that go on."""
        columns = {name: [] for name, _ in self.FIELDS}
        words, node_of, size, depth, numbered = np.arange(len(self.lengths)), np.zeros(len(self.lengths), np.int64), 1, 0, 1
        while size:
            below = np.bincount(node_of, minlength=size)
            here = self.lengths[words] == depth
            alone = below == 1
            ends = np.full(size, -1, np.int32)
            settled = here | alone[node_of]
            ends[node_of[settled]] = words[settled]
            words, node_of = words[~settled], node_of[~settled]
            letter = self.letters[self.starts[words] + depth].astype(np.int64)
            fresh = np.ones(len(words), bool)
            fresh[1:] = (node_of[1:] != node_of[:-1]) | (letter[1:] != letter[:-1])
            parent, mark = node_of[fresh], letter[fresh]
            low, high = np.zeros(size, np.uint32), np.zeros(size, np.uint64)
            small = mark < 0xC0
            np.bitwise_or.at(low, parent[small], np.uint32(1) << (mark[small] - 97).astype(np.uint32))
            np.bitwise_or.at(high, parent[~small], np.uint64(1) << (mark[~small] - 0xC0).astype(np.uint64))
            children = np.bincount(parent, minlength=size)
            values = (low, high, numbered + np.cumsum(children) - children, ends, alone, np.full(size, depth))
            for (name, kind), v in zip(self.FIELDS, values):
                columns[name].append(v.astype(kind))
            node_of, depth, size = np.cumsum(fresh) - 1, depth + 1, int(fresh.sum())
            numbered += size
        return [np.concatenate(columns[name]) for name, _ in self.FIELDS]

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by a letter, -1 where there is none."""
        small = letter < 0xC0
        lb = np.where(small, np.uint32(1) << np.where(small, letter - 97, 0).astype(np.uint32), np.uint32(0)).astype(np.uint32)
        hb = np.where(small, np.uint64(0), np.uint64(1) << np.where(small, 0, letter - 0xC0).astype(np.uint64)).astype(np.uint64)
        low, high = self.low[node], self.high[node]
        there = ((low & lb) | (high & hb)) != 0
        before = np.where(small, np.bitwise_count(low & (lb - np.uint32(1))).astype(np.int64), np.bitwise_count(low).astype(np.int64) + np.bitwise_count(high & (hb - np.uint64(1))))
        return np.where(there, self.first[node] + before, -1)

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, child, letter) for all children of the nodes; which: the place in ``node``."""
        n = np.bitwise_count(self.low[node]).astype(np.int64) + np.bitwise_count(self.high[node])
        which = np.repeat(np.arange(len(node)), n)
        child = self.first[node][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return which, child, self._letter(child)

    def _letter(self, child: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_letters"):
            # The letter of a node is that of its bit in its parent; bits and children are in the same order.
            own = np.zeros(len(self.first), np.int64)
            for bits, count, base, skip in ((self.low, 26, 97, None), (self.high, 64, 0xC0, self.low)):
                at = self.first.astype(np.int64) + (np.bitwise_count(skip).astype(np.int64) if skip is not None else 0)
                for b in range(count):
                    has = (bits >> bits.dtype.type(b)) & bits.dtype.type(1) != 0
                    own[at[has]] = base + b
                    at[has] += 1
            self._letters = own
        return self._letters[child]


class Neighbours:
    """The walk of some words' automata through a trie; ``pairs`` collects (place of the word, number of the trie's word)."""

    def __init__(self, trie: Trie, letters: np.ndarray, starts: np.ndarray):
        self.t, self.w, self.starts, self.lengths = trie, letters, starts, np.diff(starts)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Down the way that each word itself takes; at each node of it all changes, each followed to its end."""
        t, word = self.t, np.arange(len(self.lengths))
        node, at = np.zeros(len(word), np.int64), 0
        while len(word):
            alone = t.alone[node]
            self._near_tail(word[alone], node[alone], at)
            word, node = word[~alone], node[~alone]
            more = self.lengths[word] > at
            # One code point more in the trie's word, or another one: any child but the one on the way.
            which, child, letter = t.children(node)
            own = np.where(more, self._letter(word, np.minimum(at, self.lengths[word] - 1)), -1)
            off = letter != own[which]
            which, child = which[off], child[off]
            self._follow(word[which], child, np.full(len(which), at))
            more_here = more[which]
            self._follow(word[which[more_here]], child[more_here], np.full(int(more_here.sum()), at + 1))
            # One less: the word's next code point is passed over.
            self._follow(word[more], node[more], np.full(int(more.sum()), at + 1))
            word, node = word[more], node[more]
            node = t.child(node, self._letter(word, at)) if len(word) else node
            word, node, at = word[node >= 0], node[node >= 0], at + 1
        a = np.concatenate([np.zeros(0, np.int64), *(f[0] for f in self.found)])
        b = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in self.found)])
        # The same neighbour is met by several ways if the changed code point stands in a run of equal ones.
        both = np.unique(a * len(t.lengths) + b) if len(a) else a
        return both // max(1, len(t.lengths)), both % max(1, len(t.lengths))

    def _letter(self, word: np.ndarray, at) -> np.ndarray:
        return self.w[self.starts[word] + at].astype(np.int64)

    def _follow(self, word: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
        """After its change, a word's rest from ``at`` has to be the rest of a trie's word."""
        t = self.t
        while len(word):
            alone = t.alone[node]
            if alone.any():
                self._same_tail(word[alone], t.ends[node[alone]].astype(np.int64), at[alone], t.depth[node[alone]].astype(np.int64))
                word, node, at = word[~alone], node[~alone], at[~alone]
            over = self.lengths[word] == at
            last = t.ends[node[over]].astype(np.int64)
            self.found.append((word[over][last >= 0], last[last >= 0]))
            word, node, at = word[~over], node[~over], at[~over]
            if len(word):
                node = t.child(node, self._letter(word, at))
                word, node, at = word[node >= 0], node[node >= 0], at[node >= 0] + 1

    def _same_tail(self, word: np.ndarray, own: np.ndarray, at: np.ndarray, depth: np.ndarray) -> None:
        """Found are the words whose rest from ``at`` equals the rest of the trie's word ``own`` from ``depth``."""
        t = self.t
        fits = self.lengths[word] - at == t.lengths[own] - depth
        word, own, at, depth = word[fits], own[fits], at[fits], depth[fits]
        while len(word):
            over = self.lengths[word] == at
            self.found.append((word[over], own[over]))
            word, own, at, depth = word[~over], own[~over], at[~over], depth[~over]
            same = self.w[self.starts[word] + at] == t.letters[t.starts[own] + depth]
            word, own, at, depth = word[same], own[same], at[same] + 1, depth[same] + 1

    def _near_tail(self, word: np.ndarray, node: np.ndarray, at: int) -> None:
        """Words without a change so far, at a node below which there is one word: both rests are passed over as long as they
        agree; where they first don't, or one ends, the change has to be made."""
        t, own = self.t, self.t.ends[node].astype(np.int64)
        a, b = np.full(len(word), at), self.t.depth[node].astype(np.int64)
        near = np.abs((self.lengths[word] - a) - (t.lengths[own] - b)) <= 1
        word, own, a, b = word[near], own[near], a[near], b[near]
        while len(word):
            left, right = self.lengths[word] - a, t.lengths[own] - b
            both = (left > 0) & (right > 0)
            same = np.zeros(len(word), bool)
            same[both] = self.w[self.starts[word[both]] + a[both]] == t.letters[t.starts[own[both]] + b[both]]
            for longer, da, db in ((left == right, 1, 1), (left > right, 1, 0), (left < right, 0, 1)):
                now = ~same & longer & ((left > 0) | (right > 0))
                self._same_tail(word[now], own[now], a[now] + da, b[now] + db)
            word, own, a, b = word[same], own[same], a[same] + 1, b[same] + 1


def shards(words: DataFrame, n_words: int, most: int = SHARD_WORDS) -> DataFrame:
    """(shard, trie): n_words words (word, n) in their order, ``most`` at most in a shard, each made into a trie where its words lie."""
    n = max(1, -(-n_words // most))

    def run(batches):
        held: list[tuple[str, int]] = []

        def out(part):
            return pa.RecordBatch.from_pydict({"trie": pa.array([pickle.dumps(Trie.of(*map(list, zip(*part))), pickle.HIGHEST_PROTOCOL)], pa.binary())})

        for batch in batches:
            held += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while len(held) >= most:
                yield out(held[:most])
                held = held[most:]
        if held:
            yield out(held)

    sorted_ = words.select("word", "n").repartitionByRange(n, "word").sortWithinPartitions("word")
    made = map_texts(sorted_, run, "trie binary")
    return stage(made.withColumn("shard", F.monotonically_increasing_id()), "shards")


def groups(made: DataFrame, most: int = BROADCAST_BYTES) -> list[list[int]]:
    """The shards' numbers, in groups of ``most`` bytes at most, or of one shard. Only the sizes come to the driver."""
    out, room = [], 0
    for r in made.select("shard", F.length("trie").alias("size")).orderBy("shard").toLocalIterator():
        if not out or r["size"] > room:
            out.append([])
            room = most
        out[-1].append(r["shard"])
        room -= r["size"]
    return out


def meet(words: DataFrame, tries) -> DataFrame:
    """(word, n_near, best_n, best): of each word that has neighbours in the broadcast tries, their number and the one of the
    largest count, of equals the smallest."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                asked = batch.column(0).slice(at, TOGETHER).to_pylist()
                raw = [w.encode("latin-1") for w in asked]
                letters, starts = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
                for trie in tries.value:
                    a, b = Neighbours(trie, letters, starts).pairs()
                    if len(a):
                        # The trie's words are in order: of equal counts the first is the smallest.
                        order = np.lexsort((b, -trie.counts[b], a))
                        first = order[np.concatenate([[True], a[order][1:] != a[order][:-1]])]
                        best = [trie.letters[trie.starts[i] : trie.starts[i + 1]].tobytes().decode("latin-1") for i in b[first].tolist()]
                        yield pa.RecordBatch.from_pydict({"word": pa.array([asked[i] for i in a[first].tolist()], pa.string()), "n_near": pa.array(np.bincount(a)[a[first]]), "best_n": pa.array(trie.counts[b[first]]), "best": pa.array(best, pa.string())})

    return map_texts(words.select("word"), run, "word string, n_near long, best_n long, best string")


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a neighbour. Every word meets every shard."""
    spark, n_words, parts = words.sparkSession, words.count(), []
    made = shards(words, n_words, shard_words)
    # Neighbours in the order go down the tries together. There are as many tasks as the work asks for, not as the words' bytes do.
    dealt = words.select("word").repartitionByRange(max(1, -(-n_words // (4 * TOGETHER))), "word").sortWithinPartitions("word")
    for group in groups(made, broadcast_bytes):
        rows = made.where(F.col("shard").isin(group)).orderBy("shard").collect()
        tries = spark.sparkContext.broadcast([pickle.loads(r["trie"]) for r in rows])
        parts.append(stage(meet(dealt, tries), "near"))
        tries.destroy()
    if not parts:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).where("false")
    unstage(made)
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # Of each shard the best of a word: as many rows a word as shards have a neighbour of it.
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return whole.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. A form has ten times the count, so ways are short and
    end; each round doubles how far a word looks."""
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = stage(now.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        unstage(now)
        if after.where("moved").isEmpty():
            return after.select("word", "root")
        now = after.select("word", "root")
        now._millrace_path = after._millrace_path


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of documents (doc_id, text; more columns are left out).

    A null or empty text has no runs; a null doc_id is hashed as no text. Repeated rows count each. Texts and words of any
    length are taken whole. Without words the table is empty.
    """

    def formed() -> DataFrame:
        words = stage(count_words(docs), "words")
        joined = words.join(near_words(words), "word", "left")
        outnumbered = F.col("best_n") >= TIMES * F.col("n")
        return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(outnumbered, F.col("best")).alias("form"), F.when(outnumbered, F.col("best_n")).alias("form_n"))

    out = settled(formed, "formed")
    last = roots(out.where("form IS NOT NULL"))
    return out.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op12_variants": op12_variants}

ORACLE = {
    "op12_variants": """
WITH RECURSIVE crc AS (  -- the reflected polynomial's table, one entry a byte
    SELECT [list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) FOR b IN range(256)] AS t
), runs AS (
    SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{7,}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents
), counted AS (
    SELECT d, r, count(*) AS c FROM runs GROUP BY ALL
), hashed AS (
    SELECT r, c, xor(4294967295, list_reduce(
        list_transform(regexp_extract_all(hex(encode(d || ':' || r)), '..'), lambda b: ('0x' || b)::BIGINT),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM counted, crc
), spelled AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM hashed
), words AS MATERIALIZED (
    SELECT word, sum(c)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2
), places AS (
    SELECT word, unnest(range(length(word)))::INT AS i FROM words
), holes AS MATERIALIZED (
    SELECT DISTINCT word, substr(word, 1, i) AS a, substr(word, i + 2) AS b, length(word) AS l FROM places
), near AS (
    SELECT x.word, y.word AS other FROM holes x JOIN holes y ON x.a = y.a AND x.b = y.b AND x.l = y.l AND x.word <> y.word
    UNION SELECT holes.word, words.word FROM holes JOIN words ON words.word = a || b
    UNION SELECT words.word, holes.word FROM holes JOIN words ON words.word = a || b
), best AS (
    SELECT near.word, count(*) AS n_near, first(other ORDER BY words.n DESC, other) AS other, max(words.n) AS n FROM near JOIN words ON words.word = other GROUP BY near.word
), formed AS MATERIALIZED (
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.n >= 10 * words.n THEN other END AS form, CASE WHEN best.n >= 10 * words.n THEN best.n END AS form_n
    FROM words LEFT JOIN best ON best.word = words.word
), ways(word, root) AS (
    SELECT word, coalesce(form, word) FROM formed
    UNION SELECT ways.word, form FROM ways JOIN formed ON formed.word = root WHERE form IS NOT NULL
)
SELECT formed.word, formed.form, root, formed.n, formed.n_near, formed.form_n
FROM formed JOIN ways ON ways.word = formed.word JOIN formed ends ON ends.word = root AND ends.form IS NULL
"""
}
