"""Byte-level BPE encoding and decoding by recursive DuckDB queries in each partition (operator 1).

Every piece of a text that a worker hasn't met goes through the queries, whatever its kind or length. Long ones are cut
into windows that overlap. Where two windows have a token in common, the tokens of one before it and those of the other
from it on are the whole's: if two encodings meet in tokens that stand beside each other in some encoding, no merge
crosses the place, neither there nor in the whole. Where windows have no token in common, longer ones are encoded, if need
be the whole piece, so that the result is exact for any text.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache
from itertools import islice

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.tables import give_back, hold
from millrace.llm.common import map_texts, table

RANKS, PATTERN = "byte_bpe_50k.tiktoken", public_tokenizers.PATTERN

#: Characters of text whose new pieces are encoded by one query, and of a text that is split as a stream.
BLOCK_CHARS, STREAM_CHARS = 1 << 20, 1 << 22
#: Pieces in a generation of those that a worker remembers: what the new one doesn't meet goes with the next. Two
#: generations take about 100 MB. Documents in a batch that it returns.
REMEMBERED, ROWS = 200_000, 256
#: Bytes of a window, and from one window to the next; a shorter piece is one window.
WINDOW, STEP = 64, 32
#: Bytes that are encoded by one query, unless one window has more, and rows of all its rounds together: a query makes as
#: many rounds as that allows, and the next one goes on from its last state.
QUERY_BYTES, QUERY_ROWS = 1 << 16, 1 << 21
#: Ids that are decoded as one.
DECODED = 1 << 12

#: Rows are tokens: bytes from b to before e of window w. A round joins neighbours with the merge table and
#: contracts the leftmost pair of least rank in every window that has one. n is 0 for a window that can't go on.
ENCODE = """
WITH RECURSIVE s(n, w, b, e, tok) AS (
    SELECT 0, w, b, e, tok FROM seed
    UNION ALL
    (WITH pair AS (
        SELECT x.w, x.b, y.b AS mid, y.e, m.tok, m.tok::BIGINT * 4294967296 + x.b AS rank
        FROM s x JOIN s y ON x.w = y.w AND x.e = y.b JOIN merges m ON x.tok = m.l AND y.tok = m.r WHERE x.n < $rounds
    ), least AS (
        SELECT w, min(rank) AS rank FROM pair GROUP BY w
    ), pick AS (
        SELECT pair.* FROM pair JOIN least USING (w, rank)
    )
    SELECT n + 1, s.w, s.b, CASE WHEN s.b = pick.b THEN pick.e ELSE s.e END, CASE WHEN s.b = pick.b THEN pick.tok ELSE s.tok END
    FROM s JOIN pick USING (w) WHERE s.b <> pick.mid)
), last AS (
    SELECT w, max(n) AS n FROM s GROUP BY w
)
SELECT CASE WHEN n = $rounds THEN n ELSE 0 END AS n, w, b, e, tok FROM s JOIN last USING (w, n) ORDER BY w, b
"""

DECODE = "SELECT unhex(string_agg(v.hex, '' ORDER BY b)) AS text FROM ids LEFT JOIN vocab v USING (tok) GROUP BY w ORDER BY w"


def _ranges(chars: set[str]) -> str:
    """Characters as the inside of a set of a pattern."""
    at = sorted(map(ord, chars))
    first = [x for x, y in zip(at, [None, *at]) if y is None or x != y + 1]
    last = [x for x, y in zip(at, [*at[1:], None]) if y is None or y != x + 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last))


@cache
def _as_library(pattern: str) -> tuple[re.Pattern | None, re.Pattern | None, regex.Pattern]:
    """(what finds a character that the pattern's classes hold in this process's tables of characters but not in the
    library's, or the other way round; what finds one from the first of these on, which is faster; the pattern with the
    library's classes). The library is asked for every code point."""
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    ranks, odd = {bytes([i]): i for i in range(256)}, set()
    for name in (r"\p{L}", r"\p{N}"):
        theirs = set(bytes(tiktoken.Encoding("classes", pat_str=name, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)).decode())
        ours = set(regex.findall(name, every))
        if theirs != ours:
            more, less = _ranges(theirs - ours), _ranges(ours - theirs)
            pattern = pattern.replace(name, "[" + (f"[{name}{more}]" if more else name) + (f"--[{less}]" if less else "") + "]")
            odd |= theirs ^ ours
    exact = regex.compile(pattern, regex.V1)
    return (re.compile(f"[{_ranges(odd)}]"), re.compile(f"[{min(odd)}-\U0010ffff]"), exact) if odd else (None, None, exact)


class Codec:
    """A vocabulary in a DuckDB database of this process, and the pieces met so far."""

    def __init__(self, ranks_file: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, ranks_file.splitlines()) if t}
        self.plain, (self.odd, self.high, self.exact) = regex.compile(pattern), _as_library(pattern)
        self.name = [b"%d" % i for i in range(len(self.ranks))]
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        ranks = self.ranks
        merges = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        for name, columns, rows in (("merges", ("l", "r", "tok"), merges), ("vocab", ("tok", "hex"), [(r, t.hex()) for t, r in ranks.items()])):
            at = pa.table([pa.array(c, pa.string() if isinstance(c[0], str) else pa.int32()) for c in zip(*rows)], names=columns)
            self.db.register("given", at)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        #: piece -> its ids in decimal, joined by a space; and those of the generation before
        self.ids: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: piece -> the bytes that its ids decode to, where these aren't its own: only those take room
        self.decoded: dict[str, bytes] = {}

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that aren't known yet, and decode their ids."""
        if len(self.ids) > REMEMBERED:
            self.older, self.ids = self.ids, {}
        unknown = pieces.difference(self.ids)
        older = self.older
        for p in [p for p in unknown if p in older]:
            self.ids[p] = older[p]
        new = sorted(unknown.difference(older))
        if new:
            own = [p.encode() for p in new]
            flat, ends = self._encode(own)
            name, found, low = self.name, flat.tolist(), 0
            for p, high, text, given in zip(new, ends[1:].tolist(), self._decode(flat, np.diff(ends)), own):
                self.ids[p] = b" ".join([name[i] for i in found[low:high]])
                if text != given:
                    self.decoded[p] = text
                low = high

    def _contract(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(w, b, e, tok) of the tokens of windows, in order, by ENCODE until nothing contracts."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens) - lens
        at = (np.arange(lens.sum()) - np.repeat(first, lens)).astype(np.int32)
        seed = pa.table({"w": np.repeat(np.arange(len(texts), dtype=np.int32), lens), "b": at, "e": at + np.int32(1), "tok": self.byte[np.frombuffer(b"".join(texts), np.uint8)]})
        done = []
        while seed.num_rows:
            self.db.register("seed", seed)
            rounds = max(1, QUERY_ROWS // seed.num_rows)
            n, *columns = (c.to_numpy() for c in self.db.sql(ENCODE, params={"rounds": rounds}).to_arrow_table().columns)
            self.db.unregister("seed")
            done.append([c[n == 0] for c in columns])
            seed = pa.table(dict(zip(("w", "b", "e", "tok"), (c[n > 0] for c in columns))))
        if len(done) == 1:
            return tuple(done[0])
        columns = [np.concatenate(c) for c in zip(*done)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns)

    def _in_blocks(self, texts: list[bytes]):
        """(number of the first, how many, what _contract gives) for blocks of QUERY_BYTES of windows."""
        at, ends = 0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + QUERY_BYTES, "right")))
            yield at, to - at, self._contract(texts[at:to])
            at = to

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece (of a byte or more)."""
        flat, ends = self._encode(pieces)
        return np.split(flat, ends[1:-1]) if pieces else []

    def _encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces in a row, and where those of each begin and the last ones end."""
        short = [k for k, p in enumerate(pieces) if len(p) <= WINDOW]
        parts, counts = [], np.zeros(len(pieces), np.int64)
        for at, n, (w, _, _, tok) in self._in_blocks([pieces[k] for k in short]):
            parts.append(tok)
            counts[short[at : at + n]] = np.bincount(w, minlength=n)
        if len(short) < len(pieces):
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            alone = dict(zip(short, np.split(flat, np.cumsum(counts[short])[:-1])))
            long = [k for k in range(len(pieces)) if len(pieces[k]) > WINDOW]
            for k, tok in zip(long, self._encode_long([pieces[k] for k in long])):
                alone[k], counts[k] = tok, len(tok)
            parts = [alone[k] for k in range(len(pieces))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _encode_long(self, pieces: list[bytes]) -> list[np.ndarray]:
        spans = [[(a, min(a + WINDOW, len(p))) for a in range(0, len(p) - STEP, STEP)] for p in pieces]
        found: list[dict] = [{} for _ in pieces]
        todo = [(k, s) for k, x in enumerate(spans) for s in x]
        while todo:
            for at, n, (w, b, e, tok) in self._in_blocks([pieces[k][a:b] for k, (a, b) in todo]):
                edges = np.searchsorted(w, np.arange(n + 1)).tolist()
                for (k, s), i, j in zip(todo[at : at + n], edges, edges[1:]):
                    found[k][s] = np.append(b[i:j], e[j - 1]) + s[0], tok[i:j]
            changed, todo = {k for k, _ in todo}, []
            for k in changed:
                spans[k], fresh = _joined(spans[k], found[k])
                todo += [(k, s) for s in fresh]
        return [_stitched(x, f) for x, f in zip(spans, found)]

    def decode(self, sequences: list) -> list[bytes]:
        """The bytes of each sequence of ids. An id outside the vocabulary raises."""
        if not sequences:
            return []
        return self._decode(np.concatenate([np.asarray(s, np.int64) for s in sequences]), np.fromiter(map(len, sequences), np.int64, len(sequences)))

    def _decode(self, flat: np.ndarray, lens: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids, given in a row with their lengths: tokens aggregated in order."""
        if len(flat) and not (0 <= flat.min() and flat.max() < len(self.ranks)):
            raise ValueError("an id lies outside the vocabulary")
        # Long sequences are put together from stretches of DECODED ids.
        within = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
        stretch = np.cumsum(within % DECODED == 0) - 1
        found: list[bytes] = []
        at = 0
        while at < len(flat):
            # A stretch lies whole in one query.
            to = len(flat) if len(flat) - at <= QUERY_BYTES else int(np.searchsorted(stretch, max(stretch[at] + 1, stretch[at + QUERY_BYTES])))
            self.db.register("ids", pa.table({"w": stretch[at:to], "b": within[at:to], "tok": flat[at:to].astype(np.int32)}))
            found += self.db.sql(DECODE).to_arrow_table().column("text").to_pylist()
            self.db.unregister("ids")
            at = to
        if ((lens > 0) & (lens <= DECODED)).all():
            return found
        ends = np.cumsum(-(-lens // DECODED)).tolist()
        return [b"".join(found[i:j]) for i, j in zip([0, *ends], ends)]

    def split(self, text: str) -> regex.Pattern:
        """The pattern for a text: the plain one is faster, and the same where no character is in doubt."""
        if not self.odd or text.isascii() or not self.high.search(text):
            return self.plain
        return self.exact if self.odd.search(text) else self.plain

    def pieces(self, text: str):
        """Lists of the pieces of a text: one list, or of a very long text one for each stretch of it."""
        if len(text) <= STREAM_CHARS:
            yield self.split(text).findall(text)
            return
        found = (m.group() for m in self.split(text).finditer(text))
        while part := list(islice(found, BLOCK_CHARS // 8)):
            yield part

    def texts(self, texts: list[str], ids: bool):
        """(n_tokens, sha256 of the ids, sha256 of the decoded bytes, ids or None) of each text."""
        at = 0
        while at < len(texts):
            to, chars = at, 0
            while to < len(texts) and (to == at or chars + len(texts[to]) <= BLOCK_CHARS):
                chars += len(texts[to])
                to += 1
            if chars <= STREAM_CHARS:
                split = [self.split(t).findall(t) for t in texts[at:to]]
                self.learn(set().union(*split))
                for s in split:
                    yield self._digest([s], ids)
            else:
                yield self._digest(self.pieces(texts[at]), ids, learn=True)
            at = to

    def _digest(self, parts, ids: bool, learn: bool = False):
        n, first, h_ids, h_text, got = 0, True, hashlib.sha256(), hashlib.sha256(), []
        for part in parts:
            if learn:
                self.learn(set(part))
            joined = b" ".join(map(self.ids.__getitem__, part))
            if joined:
                n += joined.count(b" ") + 1
                h_ids.update(joined if first else b" " + joined)
                first = False
            h_text.update(b"".join([self.decoded[p] if p in self.decoded else p.encode() for p in part]) if self.decoded else "".join(part).encode())
            if ids and joined:
                got.append(np.fromstring(joined, np.int32, sep=" "))
        return n, h_ids.hexdigest(), h_text.hexdigest(), np.concatenate(got) if got else np.zeros(0, np.int32) if ids else None


def _cuts(spans: list, found: dict) -> list[int | None]:
    """For every two neighbouring windows of a piece, where the first token begins that they have in common and that
    no cut before it has passed; None if there is none."""
    out: list[int | None] = []
    low = 0
    for s, t in zip(spans, spans[1:]):
        a, b = found[s][0], found[t][0]
        ends = dict(zip(b[:-1].tolist(), b[1:].tolist()))
        k = int(np.searchsorted(a, max(low, t[0])))
        out.append(next((x for x, y in zip(a[k:-1].tolist(), a[k + 1 :].tolist()) if ends.get(x) == y), None))
        low = low if out[-1] is None else out[-1]
    return out


def _joined(spans: list, found: dict) -> tuple[list, list]:
    """The windows of a piece, in which runs of neighbours without a cut are divided anew into windows, and overlaps, of
    four times the length; and the new ones."""
    cuts = _cuts(spans, found)
    out, fresh, k = [], [], 0
    while k < len(spans):
        j = k
        while j < len(cuts) and cuts[j] is None:
            j += 1
        if j == k:
            out.append(spans[k])
        else:
            size, end = 4 * max(b - a for a, b in spans[k : j + 1]), spans[j][1]
            new = [(a, min(a + size, end)) for a in range(spans[k][0], max(spans[k][0] + 1, end - size // 2), size // 2)]
            out += new
            fresh += new
        k = j + 1
    return out, fresh


def _stitched(spans: list, found: dict) -> np.ndarray:
    """The tokens of a piece from those of its windows."""
    if len(spans) == 1:
        return found[spans[0]][1]
    cuts = [0, *_cuts(spans, found), spans[-1][1]]
    return np.concatenate([found[s][1][slice(*np.searchsorted(found[s][0], cuts[k : k + 2]))] for k, s in enumerate(spans)])


_codecs: dict[str, Codec] = {}


def codec(ranks_file: bytes, pattern: str = PATTERN) -> Codec:
    """One codec for a vocabulary and process; Spark's workers serve many tasks. It goes when the worker does other work."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _codecs:
        _codecs[key] = Codec(ranks_file, pattern)
        hold("bpe", _codecs.clear)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str | None):
    """The vocabulary file (under 1 MB), read by the driver and broadcast."""
    with open(path or public_tokenizers.path(RANKS), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, pattern: str = PATTERN, ids: bool = True) -> DataFrame:
    """The columns of ``docs`` but text, with n_tokens, ids_sha256, decoded_sha256 and, if asked, ids.

    docs: text and any more columns; input columns with the names of outputs are replaced. ids is
    array<int>; the digests are of its decimal numbers joined by a space, and of the bytes they decode to.
    A null or empty text has no tokens and the digests of nothing. Repeated rows give equal rows. An empty
    table gives an empty one.
    """
    added = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids
    docs = docs.drop(*added)
    vocabulary, at = _vocabulary(docs.sparkSession, path), docs.columns.index("text")
    keep = [i for i in range(len(docs.columns)) if i != at]

    def run(batches):
        c = codec(vocabulary.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, ROWS):
                part = batch.slice(k, ROWS)
                n, a, b, i = zip(*c.texts([x or "" for x in part.column(at).to_pylist()], ids))
                new = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if ids:
                    ends = np.cumsum([0, *map(len, i)])
                    new.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(i))))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keep], *new], names=[*[part.schema.names[k] for k in keep], *added])
                # What queries and pieces have left free between what stays adds up over a task.
                give_back()

    types = [T.LongType(), T.StringType(), T.StringType()] + [T.ArrayType(T.IntegerType())] * ids
    return map_texts(docs, run, T.StructType([*[docs.schema.fields[k] for k in keep], *[T.StructField(c, t) for c, t in zip(added, types)]]), "bpe")


def decode(tokens: DataFrame, path: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """The columns of ``tokens`` but ids (array<int>), with decoded (binary). Null ids decode to null; an id
    outside the vocabulary is an error."""
    tokens = tokens.drop("decoded")
    vocabulary, at = _vocabulary(tokens.sparkSession, path), tokens.columns.index("ids")
    keep = [i for i in range(len(tokens.columns)) if i != at]

    def run(batches):
        c = codec(vocabulary.value, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                given = part.column(at).to_pylist()
                out = [None if g is None else d for g, d in zip(given, c.decode([g or [] for g in given]))]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in keep], pa.array(out, pa.binary())], names=[*[batch.schema.names[i] for i in keep], "decoded"])

    return map_texts(tokens, run, T.StructType([*[tokens.schema.fields[k] for k in keep], T.StructField("decoded", T.BinaryType())]), "bpe")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, ids=False)


QUERIES = {"op1_bpe": op1_bpe}
