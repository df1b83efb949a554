"""Removal of passages that repeat across documents, by windows of words and MinHash banding of paragraphs (operator 4).

What repeats word by word is found by windows of PASSAGE_WORDS words, whatever the text's form: every stretch of
so many words holds a shorter window that its own hashes pick. The documents that have a picked window are
classed by the words around it, up to the next picked windows. Of a class all go but the first, with these words;
only firsts of several classes are compared window by window, where repeats begin and end. What repeats with
changes is found by paragraphs.

A paragraph here is a stretch of whole sentences of at least UNIT_WORDS words. It ends at the first sentence
or line end from there on, or inside a very long sentence at a word that its own hash picks; so the cuts fall
into step again soon after a passage begins, wherever in a document's own paragraph it was put.

Whole texts are cut once. What has to be looked up in them later is chosen by bitmaps of documents and of what is wanted
in them, which let a few others through; joins make it exact.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.blocks import blocks, forest, stream
from millrace.llm.common import map_texts, shielded, stage, table, unstage
from millrace.llm.components import components

UNIT_WORDS, LONG_SENTENCE, SHINGLE = 8, 48, 5  # a paragraph has at most 8 + 48 words
#: Bands of rows: two paragraphs at the threshold of 0.8 meet with a chance of 0.95, at 0.9 with 0.99.
BANDS, ROWS, THRESHOLD = 3, 2, 0.8
#: Words that a repeated passage has to have. Its first and last sentences may have grown together with the text
#: around them: words on either side of the paragraphs are compared, as many as may be lacking.
PASSAGE_WORDS = 50
BLOCK = 256
#: A bitmap has 16 bits for each of its members, and 2^LEAST_BITS to 2^MOST_BITS (32 MB) in all: with many more
#: members it lets more through to the joins.
LEAST_BITS, MOST_BITS = 16, 28
#: Of STEP windows of WINDOW words in a row, which PASSAGE_WORDS words hold, one at least is picked. The least
#: paragraphs that have PASSAGE_WORDS words are MOST_UNITS at most.
WINDOW = 32
STEP, MOST_UNITS = PASSAGE_WORDS - WINDOW + 1, -(-PASSAGE_WORDS // UNIT_WORDS)
#: Words up to which a chain of paragraphs needs more than four words on one side; see _chains.
SURELY, MARGIN = PASSAGE_WORDS - 9, 6
#: Words by which chains of the same classes may differ in length: at the threshold, 50 words and a fifth of them less.
SPREAD = 12
#: Whether a chain has n words beside it, and how many of these can be on its left: as many as there are, and not so few that its
#: right hasn't the rest. lefts and rights have a hash for none too.
ENOUGH = "n <= size(lefts) + size(rights) - 2"
WAYS = "sequence(greatest(0, n - size(rights) + 1), least(n, size(lefts) - 1))"
#: Neighbouring ways are looked for together first, in about four steps of 8 or more. All ways of step s have s * step words on the
#: left and as many as LEAST says on the right, or more.
STEPS, LEAST = "greatest(8, (n + 4) DIV 4)", "greatest(0, n - s * step - step + 1)"
#: Makes one number of a place in a document and a number of words.
PLACE = 2654435761

_WORD = re.compile(rb"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*")
_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_GROWING = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(PASSAGE_WORDS)], np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_BLANK, _LOWER = np.isin(np.arange(256), list(b" \t\n\v\f\r")), np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A number for each byte, by which words are hashed.
_BYTES = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes that are hashed at a time, and words of which powers are remembered.
USUAL = 1 << 18


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower, starts, ends, bounds): the bytes of all texts in a row, in lower case (A-Z); where in them the words begin and end;
    and before which word each text begins, and the last one ends. A null text has no words."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    solid = ~_BLANK[data]
    begins, stops = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    stops[:-1] &= ~solid[1:]
    # Words don't run on from one text into the next.
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner], stops[inner - 1] = solid[inner], solid[inner - 1]
    starts = np.nonzero(begins)[0]
    return _LOWER[data], starts, np.nonzero(stops)[0] + 1, np.searchsorted(starts, edges)


def _cuts(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Before which word each paragraph ends, in order, of the texts of ``_words``. All words are in one; the last of a text may be short."""
    if not len(starts):
        return starts
    # Sentence and line ends after each word: a sign and a blank, and each stretch of newlines.
    mark, new = lower[ends - 1], np.nonzero(lower == 10)[0]
    new = new[np.concatenate([[True], np.diff(new) > 1])] if len(new) else new
    follows = np.searchsorted(starts, new) - 1
    many = np.bincount(follows[follows >= 0], minlength=len(starts))
    after = lower[np.minimum(ends, len(lower) - 1)]
    many += ((mark == 46) | (mark == 33) | (mark == 63)) & (after != 10)
    last = np.zeros(len(starts), bool)
    last[bounds[1:][np.diff(bounds) > 0] - 1] = True
    stops = np.nonzero((many > 0) | last)[0] + 1
    out, start, at = [], 0, 0
    for stop, several, end in zip(stops.tolist(), (many[stops - 1] > 1).tolist(), last[stops - 1].tolist()):
        long = stop - at > LONG_SENTENCE
        if long:
            text, (a, b) = lower[starts[at] : ends[stop - 1]].tobytes(), (x[at:stop] - starts[at] for x in (starts, ends))
            for k, (i, j) in enumerate(zip(a.tolist(), b.tolist()), at + 1):
                if k - start >= UNIT_WORDS and (k - start >= LONG_SENTENCE or crc32(text[i:j]) % 16 == 0):
                    out.append(k)
                    start = k
        # What is left of a long sentence goes on in the next one, but not over a second end.
        if stop - start >= UNIT_WORDS and (several or not long) or end and stop > start:
            out.append(stop)
            start = stop
        at = stop
    return np.array(out)


def paragraphs(text: bytes) -> list[tuple[int, int, list[bytes]]]:
    """(start, end, words) of the paragraphs, in bytes; words in lower case (A-Z). The last may be short."""
    lower, starts, ends, bounds = _words(pa.array([text], pa.binary()))
    cuts = _cuts(lower, starts, ends, bounds).tolist()
    at = [0, *starts[cuts[:-1]].tolist(), len(text)] if cuts else []
    return [(a, b, lower[a:b].tobytes().split()) for a, b in zip(at, at[1:])]


@lru_cache(maxsize=1)
def _table(n: int) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
    powers[0] = inverse[0] = 1
    return np.cumprod(powers), np.cumprod(inverse)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of a number, and their inverses. Long ones aren't remembered."""
    powers, inverse = _table(USUAL) if n <= USUAL else _table.__wrapped__(n)
    return powers[: n + 1], inverse[: n + 1]


def _hashes(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word of ``_words``: equal ones for equal words, wherever they stand."""
    out = np.zeros(len(starts), np.uint64)
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(lower), USUAL // 2)), len(starts)))
    for i, j in zip(edges.tolist(), edges[1:].tolist()):
        first, a, b = starts[i], starts[i:j] - starts[i], ends[i:j] - starts[i]
        powers, inverse = _powers(int(b[-1]))
        total = np.zeros(b[-1] + 1, np.uint64)
        np.cumsum(_BYTES[lower[first : first + b[-1]]] * powers[:-1], out=total[1:])
        out[i:j] = (total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64)
    out = (out ^ (out >> np.uint64(31))) * _MULTIPLIERS[4]
    return out ^ (out >> np.uint64(29))


def _name(words: list[bytes]) -> int:
    return int(_stretch(_sums(_hashes(*_words(pa.array([b" ".join(words)]))[:3])), np.array([0]), np.array([len(words)]))[0])


def _sums(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For _stretch: running totals of word hashes times powers, and the powers' inverses."""
    powers, inverse = _powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers[:-1], out=total[1:])
    return total, inverse


def _stretch(sums: tuple[np.ndarray, np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """One number for the words from first to before last."""
    total, inverse = sums
    x = (total[last] - total[first]) * inverse[first] + (last - first).astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[0]
    return x ^ (x >> np.uint64(29))


def _slide(f, x: np.ndarray, n: int) -> np.ndarray:
    """f over every n consecutive values; f is a minimum or maximum."""
    w = 1
    while 2 * w <= n:
        x, w = f(x[:-w], x[w:]), 2 * w
    return f(x[: len(x) - n + w], x[n - w :]) if w < n else x


def _picked(sums: tuple[np.ndarray, np.ndarray], stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, id) of the picked windows of WINDOW words; stops: for every word, the end of its document.

    A window is picked if it has the least hash of STEP in a row. That depends on no word outside these, so equal
    stretches of PASSAGE_WORDS words have an equal picked window, wherever they stand.
    """
    at = np.arange(max(0, len(stops) - WINDOW + 1))
    g = _stretch(sums, at, at + WINDOW)
    if len(g) < STEP:
        return at[:0], g[:0]
    least = _slide(np.minimum, g, STEP)
    at = at[: len(least)]
    least[at + PASSAGE_WORDS > stops[: len(least)]] = 0
    none = np.zeros(STEP - 1, np.uint64)
    picked = np.nonzero(_slide(np.maximum, np.concatenate([none, least, none]), STEP) == g)[0]
    # The least of some hashes has few high bits, and 0 stands for none.
    picked = picked[g[picked] > 0]
    x = g[picked] * _MULTIPLIERS[1]
    return picked, x ^ (x >> np.uint64(32))


def _around(sums: tuple[np.ndarray, np.ndarray], at: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, class) of picked windows at ``at`` in documents from first to last. left is where the shortest
    stretch of PASSAGE_WORDS words begins that ends with this window and starts with a picked one, right where that ends
    which starts with this and ends with a picked one; the document's ends if it has none. The class is a number for all
    words between."""
    need = PASSAGE_WORDS - WINDOW
    i = np.searchsorted(at, at - need, "right") - 1
    j = np.searchsorted(at, at + need)
    left = np.maximum(np.where(i >= 0, at[i], -1), first)
    right = np.minimum(np.where(j < len(at), at[np.minimum(j, len(at) - 1)] + WINDOW, np.iinfo(np.int64).max), last)
    return left, right, _stretch(sums, left, right) ^ ((at - left).astype(np.uint64) * _MULTIPLIERS[2])


def _bands(units: list[list[bytes]]) -> np.ndarray:
    """Band keys of each paragraph (UNIT_WORDS words at least), one column a band."""
    text = b" ".join(w for u in units for w in u)
    return _bands_of(_hashes(*_words(pa.array([text]))[:3]), np.fromiter(map(len, units), np.int64, len(units)))


def _bands_of(h: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The same, of the paragraphs' word hashes in a row and their numbers of words."""
    n = len(h) - SHINGLE + 1
    grams = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        grams += h[k : k + n] * _POWERS[k]
    grams ^= grams >> np.uint64(31)
    starts = np.cumsum(lens) - lens
    # Shingles that run over a paragraph's end are left out: reduce over (start, stop) pairs.
    edges = np.stack([starts, starts + lens - SHINGLE + 1], axis=1).ravel()
    edges = edges[:-1] if edges[-1] >= n else edges
    out = np.zeros((len(lens), BANDS), np.uint64)
    for i, a in enumerate(_MULTIPLIERS):
        mixed = grams * a
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum.reduceat(mixed * a, edges)[::2]
        out[:, i // ROWS] = (out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15)) ^ least
    return (out & ~np.uint64(3)) | np.arange(BANDS, dtype=np.uint64)


_UNITS = "mr_doc long, doc_id long, unit long, " + ", ".join(f"m{b} long" for b in range(BANDS)) + ", first int, last int, seq int, b1 int, b4 int, a1 int, a4 int"


def _probes(h: np.ndarray, starts: np.ndarray, stops: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[pa.Array]:
    """b1, b4, a1, a4: hashes of the one and the four words before and after stretches, in documents from first to last;
    null where there are fewer."""
    four = h.copy()
    for k in range(1, 4):
        four[: len(h) - k] += h[k:] * _POWERS[k]
    out = []
    for x, n, at in ((h, 1, starts - 1), (four, 4, starts - 4), (h, 1, stops), (four, 4, stops)):
        inside = (at >= first) & (at + n <= last)
        v = x[np.clip(at, 0, len(h) - 1)] * _MULTIPLIERS[3]
        out.append(pa.array((v >> np.uint64(32)).astype(np.uint32).view(np.int32), mask=~inside))
    return out


def _unit_batches(batches):
    """(mr_doc, doc_id, text) -> _UNITS: paragraphs, the words from first to before last, with their band keys and _probes;
    and picked windows, of which m0 is null, m1 their class, and first and last the words that it is about."""
    names = [c.split()[0] for c in _UNITS.split(", ")]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            lower, begins, stops, ends = _words(part.column(2))
            cuts = _cuts(lower, begins, stops, ends)
            if not len(cuts):
                continue
            h = _hashes(lower, begins, stops)
            sums, starts = _sums(h), np.concatenate([[0], cuts[:-1]])
            doc = np.searchsorted(ends[1:], starts, "right")
            seq, lens = np.arange(len(cuts)) - np.searchsorted(doc, doc), cuts - starts
            starts, lens, seq, doc = (x[lens >= UNIT_WORDS] for x in (starts, lens, seq, doc))
            if not len(starts):
                continue
            units = _stretch(sums, starts, starts + lens)
            inner = np.repeat(starts - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            m = _bands_of(h[inner], lens).view(np.int64)
            which, first, last = pa.array(doc, pa.int32()), ends[doc], ends[doc + 1]
            here = [pa.array(x.astype(np.int32)) for x in (starts - first, starts + lens - first, seq)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(which), part.column(1).take(which), pa.array(units.view(np.int64)), *[pa.array(m[:, b]) for b in range(BANDS)], *here, *_probes(h, starts, starts + lens, first, last)],
                names=names,
            )
            at, ids = _picked(sums, np.repeat(ends[1:], np.diff(ends)))
            doc = np.searchsorted(ends[1:], at, "right")
            left, right, cls = _around(sums, at, ends[doc], ends[doc + 1])
            none, short, which = pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.int32()), pa.array(doc, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(which), part.column(1).take(which), pa.array(ids.view(np.int64)), none, pa.array(cls.view(np.int64)), *[none] * (BANDS - 2), *[pa.array((x - ends[doc]).astype(np.int32)) for x in (left, right)], *[short] * 5],
                names=names,
            )


def _bitmaps(ids: DataFrame, members: int) -> list[np.ndarray]:
    """For each column of ``ids``, longs, bits of which those of its values are set. members: about how many there are."""
    bits = min(MOST_BITS, max(LEAST_BITS, (16 * members).bit_length()))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(c).alias("id")) for k, c in enumerate(ids.columns)])).alias("x")
    low = f"pmod(x.id, {1 << bits})"
    words = ids.select(each).groupBy("x.k", F.expr(f"CAST({low} DIV 64 AS int)").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST({low} % 64 AS int))")).alias("b")).toArrow()
    which, at, values = (words[c].to_numpy() for c in ("k", "w", "b"))
    out = []
    for k in range(len(ids.columns)):
        bitmap = np.zeros(1 << (bits - 6), np.int64)
        bitmap[at[which == k]] = values[which == k]
        out.append(bitmap.view(np.uint64))
    return out


def _in(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of some ids may be in a bitmap."""
    low = ids.view(np.uint64) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[low >> np.uint64(6)] >> (low & np.uint64(63)) & np.uint64(1)) > 0


def _chosen(rows: DataFrame, *by: tuple[str, DataFrame, int]) -> DataFrame:
    """The rows whose columns, longs without nulls, are in tables of ids, and a few others: ``by`` has the column, the
    table (id) and about how many there are. One pass, as each that follows another at once takes a worker of its own."""
    seen = rows.sparkSession.sparkContext.broadcast([_bitmaps(ids, members)[0] for _, ids, members in by])
    at = [rows.columns.index(c) for c, _, _ in by]

    def run(batches):
        for batch in batches:
            for k, bitmap in zip(at, seen.value):
                batch = batch.filter(pa.array(_in(bitmap, batch.column(k).to_numpy())))
            yield batch

    return map_texts(rows, run, rows.schema)


def _parts(docs: DataFrame, wanted: DataFrame, members: int, run, kind: str) -> DataFrame:
    """``run(part, pairs)`` over parts (mr_doc, doc_id, text) of the documents that ``wanted`` (mr_doc, id) is about, and
    a few others; pairs is a bitmap of mr_doc XOR id."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmaps(wanted.selectExpr("mr_doc", "mr_doc ^ id AS pair"), members))

    def each(batches):
        members, pairs = shared.value
        for batch in batches:
            some = batch.filter(pa.array(_in(members, batch.column(0).to_numpy())))
            for k in range(0, some.num_rows, 500):
                yield from run(some.slice(k, 500), pairs)

    return map_texts(docs.select("mr_doc", F.col("doc_id").cast("long").alias("doc_id"), "text"), each, kind)


def _texts(docs: DataFrame, wanted: DataFrame, members: int) -> DataFrame:
    """(id, text): the words of paragraphs, of ``wanted`` (mr_doc, id) and a few others."""

    def run(part, pairs):
        lower, begins, stops, bounds = _words(part.column(2))
        last = _cuts(lower, begins, stops, bounds)
        first = np.concatenate([[0], last])[: len(last)]
        first, last = (x[last - first >= UNIT_WORDS] for x in (first, last))
        doc = np.searchsorted(bounds[1:], first, "right")
        names = _stretch(_sums(_hashes(lower, begins, stops)), first, last)
        seen = np.nonzero(_in(pairs, names ^ part.column(0).to_numpy().view(np.uint64)[doc]))[0]
        texts = [b" ".join(lower[a:b].tobytes().split()).decode("utf-8") for a, b in zip(begins[first[seen]].tolist(), stops[last[seen] - 1].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(names[seen].view(np.int64)), pa.array(texts, pa.string())], names=["id", "text"])

    return _parts(docs, wanted, members, run, "id long, text string")


def _windows(docs: DataFrame, wanted: DataFrame, members: int) -> DataFrame:
    """(window, mr_doc, doc_id, first, last): all windows of PASSAGE_WORDS words that hold picked windows in ``wanted``
    (mr_doc, id), and a few others. first and before last are numbers of words in the document."""

    def run(part, pairs):
        *text, ends = _words(part.column(2))
        h = _hashes(*text)
        sums, doc = _sums(h), np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        at, ids = _picked(sums, ends[1:][doc])
        at = at[_in(pairs, ids ^ part.column(0).to_numpy().view(np.uint64)[doc[at]])]
        change = np.zeros(len(h) + 1, np.int32)
        np.add.at(change, np.maximum(at - STEP + 1, ends[doc[at]]), 1)
        np.add.at(change, np.minimum(at, ends[doc[at] + 1] - PASSAGE_WORDS) + 1, -1)
        first = np.nonzero(np.cumsum(change) > 0)[0]
        which = pa.array(doc[first], pa.int32())
        here = (first - ends[doc[first]]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(_stretch(sums, first, first + PASSAGE_WORDS).view(np.int64)), part.column(0).take(which), part.column(1).take(which), pa.array(here), pa.array(here + np.int32(PASSAGE_WORDS))],
            names=["window", "mr_doc", "doc_id", "first", "last"],
        )

    return _parts(docs, wanted, members, run, "window long, mr_doc long, doc_id long, first int, last int")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers whose high bits tell on the low ones too."""
    x = (x ^ (x >> np.uint64(31))) * _MULTIPLIERS[5]
    return x ^ (x >> np.uint64(29))


def _chains(classed: DataFrame, gone: DataFrame) -> DataFrame:
    """Of paragraphs (_UNITS, class, near) (chain, classes, mr_doc, doc_id, at, words, goes): up to MOST_UNITS adjoining paragraphs, one of them at least in a class with
    others that aren't equal, named by their classes; goes: whether they lie wholly in what ``gone`` (mr_doc, runs) says.

    A chain that is long enough has one such name. One that needs words beside it that are equal has names that tell
    those on one side too, by a necessary condition: of SURELY words or less four on the longer side, of more words one.
    Chains of the same classes needn't have the same number of words; so names overlap by MARGIN words.
    """
    members = F.struct("seq", F.col("first").alias("at"), F.expr("last - first").alias("words"), "class", "near", "b1", "b4", "a1", "a4")
    whole = classed.groupBy("mr_doc").agg(F.min("doc_id").alias("doc_id"), F.collect_list(members).alias("x")).where("exists(x, e -> e.near)")
    whole = whole.join(gone.selectExpr("mr_doc", "transform(runs, r -> struct(r.first, r.last)) AS runs"), "mr_doc", "left")
    kind = "chain long, classes long, mr_doc long, doc_id long, at int, words int, goes boolean"

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                yield from chains(batch.slice(k, 500))

    def chains(part):
        x, runs = part.column(2), part.column(3)
        units = x.flatten()
        doc, seq = np.repeat(np.arange(part.num_rows), pc.list_value_length(x).to_numpy()), pc.struct_field(units, "seq").to_numpy()
        # In order, a unit of a row that repeats once.
        order = np.lexsort((seq, doc))
        order = order[np.concatenate([[True], (np.diff(doc[order]) != 0) | (np.diff(seq[order]) != 0)])]
        doc, seq = doc[order], seq[order]
        first, size, cls, near = (pc.struct_field(units, c).to_numpy(zero_copy_only=False)[order] for c in ("at", "words", "class", "near"))
        beside = {c: pc.struct_field(units, c).take(pa.array(order)) for c in ("b4", "a4", "b1", "a1")}
        there = {c: (v.is_valid().to_numpy(zero_copy_only=False), v.fill_null(0).to_numpy().view(np.uint32).astype(np.uint64)) for c, v in beside.items()}
        # Where the runs of each document begin and end; they don't overlap.
        gone = runs.flatten()
        of = np.repeat(np.arange(part.num_rows), pc.list_value_length(runs).fill_null(0).to_numpy())
        run_first, run_last = (pc.struct_field(gone, c).to_numpy() for c in ("first", "last"))
        begins = of * (1 << 32) + run_first
        cls = cls.view(np.uint64)
        name, words, some = np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.int64), np.zeros(len(doc), bool)
        for k in range(1, MOST_UNITS + 1):
            i = np.arange(max(0, len(doc) - k + 1))
            j = i + k - 1
            name = _mixed(name[: len(i)] * _MULTIPLIERS[0] + cls[j])
            words, some = words[: len(i)] + size[j], some[: len(i)] | near[j]
            i = i[(doc[i] == doc[j]) & (seq[j] - seq[i] == k - 1) & some]
            if not len(i):
                continue
            j, own, n = i + k - 1, name[i], words[i]
            r = np.searchsorted(begins, doc[i] * (1 << 32) + first[i], "right") - 1
            goes = np.zeros(len(i), bool)
            if len(begins):
                goes = (r >= 0) & (of[r] == doc[i]) & (first[i] + n <= run_last[r])
            short = n < PASSAGE_WORDS + MARGIN
            called = [(n >= PASSAGE_WORDS - MARGIN, own)]
            for m, (side, at, least) in enumerate((("b4", i, 0), ("a4", j, 0), ("b1", i, SURELY - MARGIN + 1), ("a1", j, SURELY - MARGIN + 1)), 1):
                valid, h = there[side]
                called.append((short & valid[at] & (n >= least), _mixed(own * _MULTIPLIERS[m] + h[at])))
            for which, chain in called:
                w = np.nonzero(which)[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(chain[w].view(np.int64)), pa.array(own[w].view(np.int64)), part.column(0).take(d := pa.array(doc[i[w]])), part.column(1).take(d), pa.array(first[i[w]], pa.int32()), pa.array(n[w], pa.int32()), pa.array(goes[w])],
                    names=[c.split()[0] for c in kind.split(", ")],
                )

    return map_texts(whole, run, kind)


def _contexts(docs: DataFrame, wanted: DataFrame, members: int) -> DataFrame:
    """(mr_doc, at, words, lefts, rights): of ``wanted`` (mr_doc, at, words) and a few others; lefts and rights have a hash of none, one,
    two and so on of the nearest words on that side together, of as many as a chain of the same classes may lack, if it has up
    to SPREAD words less."""
    kind = "mr_doc long, at int, words int, lefts array<int>, rights array<int>"

    def growing(h: np.ndarray, at: np.ndarray, step: int, n: np.ndarray) -> pa.ListArray:
        """For each place, hashes of none up to n of the words from ``at`` on, in direction ``step``."""
        k = np.arange(int(n.max()))
        words = np.where(k < n[:, None], h[np.clip(at[:, None] + step * k, 0, len(h) - 1)] | np.uint64(1), np.uint64(0))
        total = np.zeros((len(n), len(k) + 1), np.uint64)
        np.cumsum(words * _GROWING[: len(k)], axis=1, out=total[:, 1:])
        made = (total[np.arange(len(k) + 1) <= n[:, None]] >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n + 1)]), pa.int32()), pa.array(made))

    def run(part, pairs):
        *text, ends = _words(part.column(2))
        starts = np.concatenate([[0], _cuts(*text, ends)]).astype(np.int64)
        ids, doc, h = part.column(0).to_numpy(), np.searchsorted(ends[1:], starts[:-1], "right"), _hashes(*text)
        chosen = []
        for k in range(1, MOST_UNITS + 1):
            i = np.nonzero(doc[: max(0, len(doc) - k + 1)] == doc[k - 1 :])[0]
            n = starts[i + k] - starts[i]
            seen = _in(pairs, ((starts[i] - ends[doc[i]]) * PLACE + n) ^ ids[doc[i]])
            chosen.append((i[seen], n[seen]))
        i, n = map(np.concatenate, zip(*chosen))
        which = doc[i]
        for k in range(0, len(i), 4096):
            d, a, m = which[k : k + 4096], starts[i[k : k + 4096]], n[k : k + 4096]
            room = np.minimum(PASSAGE_WORDS - 1, np.maximum(0, PASSAGE_WORDS - m) + SPREAD)
            lefts, rights = growing(h, a - 1, -1, np.minimum(room, a - ends[d])), growing(h, a + m, 1, np.minimum(room, ends[d + 1] - a - m))
            yield pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array((a - ends[d]).astype(np.int32)), pa.array(m.astype(np.int32)), lefts, rights], names=[c.split()[0] for c in kind.split(", ")])

    return _parts(docs, wanted.selectExpr("mr_doc", f"at * {PLACE}L + words AS id"), members, run, kind)


def _union(batches):
    """(mr_doc, x: array of (first, last, keeper)) -> (mr_doc, runs): stretches that overlap or adjoin are one."""
    for batch in batches:
        x = batch.column(1)
        rows, doc = x.flatten(), np.repeat(np.arange(batch.num_rows), pc.list_value_length(x).to_numpy())
        first, last, keeper = (pc.struct_field(rows, c) for c in ("first", "last", "keeper"))
        first, last, none, keeper = first.to_numpy(), last.to_numpy(), keeper.is_null().to_numpy(zero_copy_only=False), keeper.fill_null(0).to_numpy()
        order = np.lexsort((last, first, doc))
        first, last, none, keeper, doc = first[order], last[order], none[order], keeper[order], doc[order]
        # The furthest end so far; that of an earlier document lies before all of this one's.
        base = doc * (1 << 32)
        far = np.maximum.accumulate(base + last)
        new = np.ones(len(doc), bool)
        new[1:] = (base + first)[1:] > far[:-1]
        new[1:] |= doc[1:] != doc[:-1]
        run, at = np.cumsum(new) - 1, np.nonzero(new)[0]
        end = np.append(at[1:], len(doc))[: len(at)] - 1
        order = np.lexsort((keeper, none, run))
        r, k, o = run[order], keeper[order], none[order]
        one = np.ones(len(r), bool)
        one[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        edges = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
        keepers = pa.ListArray.from_arrays(edges(np.bincount(r[one], minlength=len(at))), pa.array(k[one], pa.int64(), mask=o[one]))
        runs = pa.StructArray.from_arrays([pa.array(first[at], pa.int32()), pa.array((far - base)[end], pa.int32()), keepers], names=["first", "last", "keepers"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges(np.bincount(doc[at], minlength=batch.num_rows)), runs)], names=["mr_doc", "runs"])


def _runs(stretches: DataFrame) -> DataFrame:
    """(mr_doc, runs) of stretches (mr_doc, first, last, keeper)."""
    listed = stretches.groupBy("mr_doc").agg(F.collect_list(F.struct("first", "last", "keeper")).alias("x"))
    return map_texts(listed, _union, "mr_doc long, runs array<struct<first:int,last:int,keepers:array<bigint>>>")


def _verify(block: dict):
    sets = []
    for t in block["text"].to_pylist():
        w = t.split(" ")
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)})
    n = len(sets)
    if n <= 12:
        found = [(i, j) for i in range(n) for j in range(i + 1, n) if (both := len(sets[i] & sets[j])) >= THRESHOLD * (len(sets[i]) + len(sets[j]) - both)]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
    else:
        where: dict[tuple, list[int]] = {}
        for i, s in enumerate(sets):
            for g in s:
                where.setdefault(g, []).append(i)
        sizes = np.array([len(s) for s in sets])
        both = np.zeros((n, n), np.int32)
        for at in where.values():
            if len(at) > 1:
                both[np.ix_(at, at)] += 1
        a, b = np.nonzero(np.triu(both >= THRESHOLD * (sizes[:, None] + sizes[None, :] - both), 1))
    if block["mr_i"][0] != block["mr_j"][0]:
        across = block["mr_chunk"][a] != block["mr_chunk"][b]
        a, b = a[across], b[across]
    tree = forest(n, a, b)
    if tree:
        ids = block["id"]
        yield pa.RecordBatch.from_arrays([pa.array([int(ids[x]) for x, _ in tree], pa.int64()), pa.array([int(ids[y]) for _, y in tree], pa.int64())], names=["a", "b"])


def _release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("mr_doc", F.xxhash64("doc_id", "text"))


def _later(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """``rows`` (name, mr_doc, doc_id, more) of names that several documents have, without those of the document
    with the smallest doc_id (null last), the keeper: a struct of its doc_id, mr_doc and more."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mr_doc", *more)
    kept = rows.groupBy(F.col(name).alias("c")).agg(F.min(order).alias("keeper"), F.min("mr_doc").alias("d0"), F.max("mr_doc").alias("d1")).where("d0 <> d1").select("c", "keeper")
    return rows.join(stage(kept, "op4-kept"), F.col(name) == F.col("c")).where("mr_doc <> keeper.mr_doc")


def _partners(met: DataFrame, contexts: DataFrame) -> DataFrame:
    """(mr_doc, first, last, keeper): of chains (met: classes, mr_doc, doc_id, at, words, goes) that don't go yet, stretches of PASSAGE_WORDS words and
    more that an earlier document has with the same classes and beside them equal words.

    A chain that lacks n words has them as l on its left and n - l on its right, for some l. Each of these n + 1 ways is a
    key, so that every stretch of PASSAGE_WORDS words around a chain meets the earliest of all documents that have it,
    however many have the chain. Ways of a step have some words in common: keys are made only where one that asks and another
    document share these. Chains with the same words beside them as far as may matter are one for this: the earliest stands for all.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mr_doc", "at").alias("rep")
    # Contexts meet their chains once; those of rows that repeat come more than once, which changes nothing.
    here = stage(met.join(contexts, ["mr_doc", "at", "words"]).withColumn("beside", F.xxhash64("lefts", "rights")), "op4-here")
    group = ["classes", "words", "beside"]
    reps = stage(here.groupBy(*group).agg(F.min(order).alias("rep"), F.bool_or(~F.col("goes")).alias("asks"), F.first("lefts").alias("lefts"), F.first("rights").alias("rights")), "op4-reps")
    lack = F.greatest(F.lit(0), PASSAGE_WORDS - F.col("words"))
    lacking = reps.where("asks").groupBy("classes").agg(F.collect_set(lack).alias("lacks"))
    ways = reps.join(lacking, "classes").select("*", F.explode("lacks").alias("n"), lack.alias("own"))
    ways = ways.where(ENOUGH).select("*", F.expr(WAYS).alias("at"), F.expr(STEPS).cast("int").alias("step"), F.expr("n = own AND asks").alias("asking"))
    ways = ways.select("*", F.explode(F.expr("sequence(CAST(at[0] DIV step AS int), CAST(element_at(at, -1) DIV step AS int))")).alias("s")).select(
        F.xxhash64("classes", "n", "s", F.expr("lefts[s * step]"), F.expr(f"rights[{LEAST}]")).alias("least"), *group, "rep", "asking",
        F.expr("transform(filter(at, l -> l DIV step = s), l -> xxhash64(classes, n, l, lefts[l], rights[n - l]))").alias("ways"),
    )
    ways = stage(ways, "op4-steps")
    some = ways.groupBy(F.col("least").alias("c")).agg(F.bool_or("asking").alias("asked"), F.min("rep.mr_doc").alias("d0"), F.max("rep.mr_doc").alias("d1")).where("asked AND d0 <> d1").select("c")
    ways = ways.join(some, F.col("least") == F.col("c"), "left_semi").select(F.explode("ways").alias("way"), *group, "rep", "asking")
    ways = stage(ways, "op4-ways")
    kept = ways.groupBy(F.col("way").alias("w")).agg(F.min("rep").alias("keeper"), F.max("rep").alias("last")).where("keeper <> last").select("w", "keeper")
    pairs = ways.where("asking").join(kept, F.col("way") == F.col("w")).where("rep.mr_doc <> keeper.mr_doc").select(*group, "keeper").distinct()
    # How far the words beside both agree.
    same = lambda a, b: f"coalesce(nullif(array_position(zip_with({a}, {b}, (x, y) -> x IS NOT NULL AND y IS NOT NULL AND x = y), false), 0) - 2, least(size({a}), size({b})) - 1)"
    other = reps.select("classes", F.col("rep").alias("keeper"), F.col("lefts").alias("k_lefts"), F.col("rights").alias("k_rights"))
    met_pairs = pairs.join(reps.select(*group, "lefts", "rights"), group).join(other, ["classes", "keeper"])
    far = met_pairs.selectExpr(*group, "keeper", f"CAST({same('lefts', 'k_lefts')} AS int) AS left", f"CAST({same('rights', 'k_rights')} AS int) AS right")
    far = far.union(reps.where("asks").selectExpr(*group, "rep AS keeper", "size(lefts) - 1", "size(rights) - 1"))
    asking = here.where("NOT goes").select("mr_doc", "at", *group).join(far, group).where("mr_doc <> keeper.mr_doc")
    return asking.where(f"left + words + right >= {PASSAGE_WORDS}").selectExpr("mr_doc", "at - left AS first", "at + words + right AS last", "keeper.doc_id AS keeper")


def repeats(docs: DataFrame) -> DataFrame:
    """(mr_doc, runs) of the documents from which something goes; runs: array of (first, last, keepers), the words
    from number first to before number last.

    Every PASSAGE_WORDS words in a row that an earlier document has too go; earlier is that of the smaller doc_id
    (null last). Further, paragraphs that are equal, or whose sets of five-word shingles have a Jaccard similarity
    of THRESHOLD, are one class with all that they lead to. Adjoining paragraphs go if paragraphs of the same
    classes adjoin in an earlier document and they have PASSAGE_WORDS words, with the words beside them that are
    equal there, whichever of the earlier documents that is. Paragraphs that go word by word anyway need nothing more.
    """
    spark, docs = docs.sparkSession, _keyed(docs)
    whole = stage(map_texts(docs.select("mr_doc", F.col("doc_id").cast("long").alias("doc_id"), "text"), _unit_batches, _UNITS), "op4-units")
    n_units, n_picks = whole.agg(F.count("m0"), F.count_if(F.col("m0").isNull())).first()
    # Word by word: the classes of picked windows that several documents have.
    picks = whole.where("m0 IS NULL").selectExpr("unit AS pick", "m1 AS class", "mr_doc", "doc_id", "first", "last")
    twice = picks.groupBy(F.col("pick").alias("id")).agg(F.min("mr_doc").alias("d0"), F.max("mr_doc").alias("d1")).where("d0 <> d1").select("id")
    held = stage(_chosen(picks, ("pick", twice, n_picks // 8)), "op4-held")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mr_doc")
    classes = held.groupBy("pick", "class").agg(F.min(order).alias("keeper"), F.min("mr_doc").alias("d0"), F.max("mr_doc").alias("d1"))
    classes = stage(classes.selectExpr("pick AS p", "class AS c", "keeper", "d0 <> d1 AS several"), "op4-classes")
    alike = held.join(classes.where("several").drop("several"), F.expr("pick = p AND class = c")).where("mr_doc <> keeper.mr_doc")
    alike = alike.selectExpr("mr_doc", "first", "last", "keeper.doc_id AS keeper")
    ends = classes.groupBy(F.col("p").alias("id")).agg(F.min("keeper.mr_doc").alias("d0"), F.max("keeper.mr_doc").alias("d1")).where("d0 <> d1").select("id")
    firsts = classes.join(ends, F.col("p") == F.col("id"), "left_semi").selectExpr("keeper.mr_doc AS mr_doc", "p AS id")
    windows = stage(_windows(docs, firsts, n_picks // 8), "op4-windows")
    same_words = alike.union(_later(windows, "window").selectExpr("mr_doc", "first", "last", "keeper.doc_id AS keeper"))
    gone = stage(_runs(same_words), "op4-gone")
    unstage(held, classes, windows)
    _release(spark)
    # With changes: paragraphs, each once, that share a band with another one.
    units = whole.where("m0 IS NOT NULL")
    names = units.groupBy("unit").agg(F.min("mr_doc").alias("d0"), F.max("mr_doc").alias("d1"), *[F.min(f"m{b}").alias(f"m{b}") for b in range(BANDS)])
    names = stage(names, "op4-names")
    _release(spark)
    keyed = names.select("unit", F.explode(F.array(*[f"m{b}" for b in range(BANDS)])).alias("key"))
    mixed = stage(keyed.groupBy("key").agg(F.min("unit").alias("lo"), F.max("unit").alias("hi")).where("lo <> hi").select(F.col("key").alias("id")), "op4-mixed")
    keys = _chosen(keyed, ("key", mixed, n_units // 8)).join(mixed, F.col("key") == F.col("id"), "left_semi")
    keys = stage(keys.select("key", F.col("unit").alias("id")), "op4-keys")
    _release(spark)
    wanted = names.join(keys.select("id").distinct(), F.col("unit") == F.col("id"), "left_semi").selectExpr("d0 AS mr_doc", "unit AS id")
    texts = _texts(docs, wanted, n_units // 8).groupBy("id").agg(F.first("text").alias("text"))
    edges = blocks(keys, texts, BLOCK).mapInArrow(lambda b: stream(b, _verify), "a long, b long")
    roots = stage(components(edges), "op4-roots")
    unstage(mixed, keys)
    _release(spark)
    # Of documents with such paragraphs, those that others have too.
    near = _chosen(units.select("mr_doc", "unit"), ("unit", roots.select(F.col("node").alias("id")), n_units // 8)).select(F.col("mr_doc").alias("id"))
    repeated = names.where("d0 <> d1").select(F.col("unit").alias("id")).union(roots.select("node"))
    at = _chosen(units.drop(*[f"m{b}" for b in range(BANDS)]), ("mr_doc", near, n_picks // 8), ("unit", repeated, n_units // 2))
    classed = at.join(roots, F.col("unit") == F.col("node"), "left").withColumn("class", F.coalesce("root", "unit")).withColumn("near", F.col("root").isNotNull())
    chains = stage(_chains(classed, gone), "op4-chains")
    unstage(whole, names, roots)
    _release(spark)
    # Chains that several documents have, under a name that tells some of the words beside them, meet by classes.
    several = chains.groupBy(F.col("chain").alias("c")).agg(F.min("mr_doc").alias("d0"), F.max("mr_doc").alias("d1"), F.min("goes").alias("all")).where("d0 <> d1 AND NOT all").select("c")
    met = stage(chains.join(several, F.col("chain") == F.col("c"), "left_semi").drop("chain").distinct(), "op4-met")
    unstage(chains)
    _release(spark)
    near = stage(_partners(met, _contexts(docs, met.select("mr_doc", "at", "words"), n_units // 8)), "op4-near")
    before = gone.select("mr_doc", F.explode("runs").alias("r")).select("mr_doc", "r.first", "r.last", F.explode("r.keepers").alias("keeper"))
    out = stage(_runs(before.union(near)), "op4-runs")
    unstage(gone, met, near)
    return out


def _spans(text: bytes, runs: list) -> list[tuple[int, int]]:
    """Bytes of a text that runs cover."""
    words = [m.span() for m in _WORD.finditer(text)]
    return [(words[r["first"]][0], words[r["last"] - 1][1]) for r in runs]


@shielded("mr_removed")
def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from text, and mr_removed: the words that went; n_chars, if there
    is one, is counted anew. A document of which nothing is left has the empty text.

    docs: doc_id, text and any more columns. Null and empty texts have no paragraphs and stay. Repeated rows
    are one document and stay alike. An empty table gives an empty one.
    """
    runs = repeats(docs).withColumnRenamed("mr_doc", "mr_d")
    # By a merge at every size: the runs grow with the input.
    joined = _keyed(docs).join(runs.hint("merge"), F.col("mr_doc") == F.col("mr_d"), "left").drop("mr_doc", "mr_d")
    at, names = joined.columns.index("text"), docs.columns

    def run(batches):
        for batch in batches:
            texts, gone = batch.column(at).to_pylist(), []
            for i, r in enumerate(batch.column(len(names)).to_pylist()):
                gone.append(0)
                if r:
                    text, out, last = texts[i].encode(), [], 0
                    for start, end in _spans(text, r):
                        out.append(text[last:start])
                        gone[-1] += len(text[start:end].split())
                        last = end
                    texts[i] = (b"".join(out) + text[last:]).decode()
            columns = [*batch.columns[:-1], pa.array(gone, pa.int64())]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "mr_removed"])

    out = map_texts(joined, run, T.StructType([*docs.schema.fields, T.StructField("mr_removed", T.LongType())]))
    return out.withColumn("n_chars", F.when(F.col("mr_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))) if "n_chars" in docs.columns else out


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: words and runs that go from it, and the documents that keep them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    runs = repeats(docs).withColumnRenamed("mr_doc", "d")
    joined = _keyed(docs).drop("text").join(runs, F.col("mr_doc") == F.col("d"), "left")
    return joined.select(
        "doc_id",
        F.coalesce(F.expr("aggregate(runs, 0L, (n, r) -> n + r.last - r.first)"), F.lit(0)).cast("long").alias("n_removed_words"),
        F.coalesce(F.size("runs"), F.lit(0)).cast("long").alias("n_runs"),
        F.coalesce(F.expr("array_sort(array_distinct(flatten(transform(runs, r -> r.keepers))))"), F.array().cast("array<bigint>")).alias("kept_in"),
    )


QUERIES = {"op4_passages": op4_passages}
