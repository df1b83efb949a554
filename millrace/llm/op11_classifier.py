"""Quality scores: word vectors by random indexing, pooled per document, and a small calibrated network over them.

Every document is read twice. The first pass makes word vectors of the whole corpus: a word's index vector is sparse, of
a few entries of 1 and -1 that follow from a seed, and its context vector is the sum of the index vectors of all words
near it, wherever it stands. Words share rows by a hash into ``BUCKETS`` rows, so that the table has the same size for
any corpus (8 MB), and so does what each task adds to it; sums are whole numbers and don't depend on their order. The
second pass pools a document's context vectors and scores them. In between, a network with one hidden layer is fitted on
pooled documents that have a label, ``MOST_LABELLED`` of them at most, by a hash of their id; a fifth of these are left
out of the fit and set the temperature by which the scores become probabilities.

What the labels say is learned from nothing else: neither language nor source nor id is an input, nor is a row of which
crc32(doc_id as text) mod 3 is 1.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import hash60, load, map_texts, partitions, shielded, stage, table, unstage

#: Rows of the table of word vectors, components of each, entries of an index vector, words that count as near on a side.
BUCKETS, DIMS, ENTRIES, NEAR = 1 << 15, 64, 4, 2
#: Rows of the table that travel together; pairs of words that are added at once; characters that are cut into words at once.
ROWS, PAIRS, SLICE = 128, 1 << 18, 1 << 20
#: The most labelled documents that the network is fitted on; units of its hidden layer; passes over the rows.
MOST_LABELLED, HIDDEN, EPOCHS = 20_000, 32, 60
#: A word of this share of all words weighs half in a document.
HALF = 1e-3
SEED = 42

#: Words keep their case; runs of signs are words too.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
BLANK = re.compile(r"\s")
REMEMBERED = 500_000


class _Rows(dict):
    """word -> its row. Words repeat: rows are remembered, up to a number of words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        got = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % BUCKETS
        return got


_rows = _Rows()


def word_rows(text: str | None) -> np.ndarray:
    """The rows of a text's words in order. Long texts are cut at blanks, where no word is."""
    found, at, text = [], 0, text or ""
    while at < len(text):
        end = BLANK.search(text, at + SLICE)
        stop = end.start() if end else len(text)
        words = TOKEN.findall(text, at, stop)
        found.append(np.fromiter(map(_rows.__getitem__, words), np.int32, len(words)))
        at = stop
    return np.concatenate([*found, np.zeros(0, np.int32)])


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the entries of every row's index vector, and of a last row without any."""
    rng = np.random.default_rng(SEED)
    places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, :ENTRIES]
    signs = rng.integers(0, 2, (BUCKETS, ENTRIES)) * 2 - 1
    return np.vstack([places, np.zeros((1, ENTRIES), places.dtype)]).astype(np.int32), np.vstack([signs, np.zeros((1, ENTRIES), signs.dtype)]).astype(np.int32)


def add_contexts(total: np.ndarray, rows: np.ndarray, places: np.ndarray, signs: np.ndarray) -> None:
    """Add to ``total`` (BUCKETS + 1, DIMS + 1) the index vectors around each word of ``rows``, and in the last column
    its count. Row BUCKETS is no word; NEAR of it part documents."""
    flat, wide = total.reshape(-1), DIMS + 1
    for at in range(0, len(rows), PAIRS):
        np.add.at(flat, rows[at : at + PAIRS].astype(np.int64) * wide + DIMS, np.int32(1))
        for away in range(1, NEAR + 1):
            a = rows[at : at + PAIRS]
            b = rows[at + away : at + away + PAIRS]
            a = a[: len(b)]
            for left, right in ((a, b), (b, a)):
                base = left.astype(np.int64) * wide
                for e in range(ENTRIES):
                    np.add.at(flat, base + places[right, e], signs[right, e])


def _partial(batches):
    """One task's sums: for each part of the table the rows that it has met, and their values."""
    total, (places, signs) = np.zeros((BUCKETS + 1, DIMS + 1), np.int32), index_vectors()
    pad, held, size = np.full(NEAR, BUCKETS, np.int32), [], 0
    for batch in batches:
        for text in batch.column(0).to_pylist():
            held += [word_rows(text), pad]
            size += len(held[-2]) + NEAR
            if size >= PAIRS:
                add_contexts(total, np.concatenate(held), places, signs)
                held, size = [], 0
    if held:
        add_contexts(total, np.concatenate(held), places, signs)
    met = np.nonzero(total[:BUCKETS, DIMS])[0]
    for part in np.unique(met // ROWS).tolist():
        own = met[met // ROWS == part]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "rows": pa.array([(own % ROWS).astype(np.int16).tobytes()], pa.binary()), "sums": pa.array([total[own].tobytes()], pa.binary())})


def _added(batches):
    """Sums of the parts of all tasks, of rows that come in the order of parts."""
    part, total = None, None

    def out():
        return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    for batch in batches:
        for p, rows, sums in zip(*(batch.column(c).to_pylist() for c in ("part", "rows", "sums"))):
            if p != part:
                if part is not None:
                    yield out()
                part, total = p, np.zeros((ROWS, DIMS + 1), np.int64)
            total[np.frombuffer(rows, np.int16)] += np.frombuffer(sums, np.int32).reshape(-1, DIMS + 1)
    if part is not None:
        yield out()


def context_sums(texts: DataFrame) -> np.ndarray:
    """(BUCKETS, DIMS + 1): the context vectors of all words of the column ``text``, and their counts."""
    parts = map_texts(texts.select("text"), _partial, "part int, rows binary, sums binary", owner="op11")
    dealt = parts.repartition(min(partitions(texts.sparkSession), BUCKETS // ROWS), "part").sortWithinPartitions("part")
    out = np.zeros((BUCKETS, DIMS + 1), np.int64)
    # As many rows as the table has parts, whatever the corpus: 17 MB in all.
    for r in dealt.mapInArrow(_added, "part int, sums binary").collect():
        out[r["part"] * ROWS : (r["part"] + 1) * ROWS] = np.frombuffer(r["sums"], np.int64).reshape(ROWS, DIMS + 1)
    return out


@dataclass
class Words:
    """The word vectors that documents are pooled from: unit length, without what all words have in common."""

    vectors: np.ndarray  # (BUCKETS, DIMS)
    weights: np.ndarray  # (BUCKETS,): frequent words weigh less

    @staticmethod
    def of(sums: np.ndarray) -> Words:
        counts = sums[:, DIMS].astype(np.float64)
        share = counts / max(1.0, counts.sum())
        v = sums[:, :DIMS] / np.maximum(counts, 1.0)[:, None]
        v -= share @ v
        v /= np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-12)[:, None]
        return Words(v.astype(np.float32), HALF / (HALF + share))

    def pool(self, rows: np.ndarray) -> np.ndarray:
        """A document's inputs: mean and spread of its words' vectors, how far each word is from the next, and how many
        and how many different ones there are. Zeros for no words."""
        out = np.zeros(2 * DIMS + 3)
        if len(rows):
            own, n = np.unique(rows, return_counts=True)
            w, v = n * self.weights[own], self.vectors[own].astype(np.float64)
            w /= w.sum()
            out[:DIMS] = w @ v
            out[DIMS : 2 * DIMS] = np.sqrt(np.maximum(0.0, w @ (v * v) - out[:DIMS] ** 2))
            out[-3] = np.mean(rows[1:] == rows[:-1]) if len(rows) > 1 else 0.0
            out[-2], out[-1] = len(own) / len(rows), np.log1p(len(rows))
        return out


INPUTS = 2 * DIMS + 3


@dataclass
class Network:
    """Inputs, scaled; tanh units; one output; a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0.0, z) - y * z))


def temperature(z: np.ndarray, y: np.ndarray) -> float:
    """What to divide logits by so that they fit the labels best. The targets lie as far from 0 and 1 as one more row of
    the other label would pull them, so that rows without a mistake don't ask for certainty."""
    n1 = y.sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (len(y) - n1 + 2))
    low, high = np.log(1 / 16), np.log(16.0)
    for _ in range(60):  # the loss has one minimum in 1 / T
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if _loss(z / np.exp(a), target) < _loss(z / np.exp(b), target):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def fit(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> Network:
    """A network for rows x with labels y (0 or 1), fitted on those that aren't ``held`` and calibrated on those that
    are, of whose losses it also takes the least. With labels of one kind or none only the share of 1 is known."""
    fit_x, fit_y = x[~held], y[~held]
    if len(set(fit_y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(INPUTS), np.ones(INPUTS), np.zeros((INPUTS, 1)), np.zeros(1), np.zeros(1), float(np.log(share / (1 - share))))
    if not held.any():
        held = ~held
    rng = np.random.default_rng(SEED)
    net = Network(fit_x.mean(axis=0), np.maximum(fit_x.std(axis=0), 1e-6), rng.normal(0, INPUTS**-0.5, (INPUTS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), 0.0)
    z = np.clip((fit_x - net.mean) / net.scale, -8, 8)
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    m, v, step, best = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, (np.inf, None)
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(z), 64):
            b = order[at : at + 64]
            h = np.tanh(z[b] @ params[0] + params[1])
            d = (_sigmoid(h @ params[2] + params[3][0]) - fit_y[b]) / len(b)
            dh = d[:, None] * params[2][None, :] * (1 - h * h)
            step += 1
            for i, g in enumerate((z[b].T @ dh + 1e-3 * params[0], dh.sum(axis=0), h.T @ d + 1e-3 * params[2], np.array([d.sum()]))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] = params[i] - 2e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
        loss = _loss(net.logits(x[held]), y[held])
        if loss < best[0]:
            best = loss, [np.copy(p) for p in params]
    net.w1, net.b1, net.w2, net.b2 = best[1][0], best[1][1], best[1][2], float(best[1][3][0])
    net.temperature = temperature(net.logits(x[held]), y[held])
    return net


def is_held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3: such rows teach nothing. A null id counts as no text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def sample_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, quality, calibrates): labels to learn from, ``MOST_LABELLED`` of them at most, by a hash of their ids; a fifth of
    them to calibrate with. Ids whose labels are null, other than 0 and 1 or contradict each other are left out."""
    one = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~is_held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most")
    h = hash60("doc_id")
    return one.select("doc_id", "quality", (h % 5 == 0).alias("calibrates")).orderBy(h, "doc_id").limit(MOST_LABELLED)


def pooled(texts: DataFrame, words) -> DataFrame:
    """The rows of ``texts``, of which the last column is a text, with its inputs in place of it. words: broadcast."""
    kept = texts.columns[:-1]

    def run(batches):
        for batch in batches:
            x = [words.value.pool(word_rows(t)).tobytes() for t in batch.column(len(kept)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(x, pa.binary())], names=[*kept, "inputs"])

    kinds = [f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in kept]
    return map_texts(texts, run, ", ".join([*kinds, "inputs binary"]), owner="op11")


def train(docs: DataFrame, labels: DataFrame):
    """(words, network) for documents (doc_id, text) and labels (doc_id, quality); words is a broadcast Words."""
    spark = docs.sparkSession
    words = spark.sparkContext.broadcast(Words.of(context_sums(docs)))
    chosen = stage(sample_labels(labels.select("doc_id", "quality")), "labels")
    # At most MOST_LABELLED rows, so the join needs no exchange of texts. Repeated rows of an id count once each.
    rows = pooled(docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "calibrates", "text"), words)
    # Repeated rows of an id may be many: of each id the row with the least inputs stands for it.
    rows = sorted(tuple(r) for r in rows.groupBy("doc_id", "quality", "calibrates").agg(F.min("inputs")).collect())
    unstage(chosen)
    x = np.array([np.frombuffer(r[3]) for r in rows]).reshape(-1, INPUTS)
    return words, fit(x, np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], bool))


@shielded("held_out", "score", "predicted")
def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any more) with held_out, score (0 to 1) and predicted (1 from 0.5 on).

    A null text counts as an empty one, whose inputs are zeros; it is scored too. Repeated rows get the same score. Without
    labels of both kinds every document gets the smoothed share of 1 among those that there are (0.5 without any).
    Texts of any length are read whole. An empty table gives an empty one.
    """
    words, network = train(docs.select("doc_id", "text"), labels)
    more = [c for c in docs.columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(more))
            x = np.array([words.value.pool(word_rows(t)) for t in texts.to_pylist()]).reshape(-1, INPUTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(network.scores(x))], names=[*more, "text", "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in [*more, "text"])
    out = map_texts(docs.select(*more, "text"), run, f"{kinds}, score double", owner="op11")
    return out.select(*docs.columns, is_held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op11_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = classify(docs, load(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op11_classifier": op11_classifier}
