"""SQL of the registered queries for an engine that isn't Spark, as common table expressions to put together."""

from __future__ import annotations

from millrace.functions.params import RRF_K, STOPWORDS

WORD = r"[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)


def windows(source: str, key: str = "doc_id") -> str:
    """k and c0: the windows of an array w of ``source``."""
    return f"""k AS (SELECT *, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 150 THEN 1 ELSE ceil((len(w) - 30) / 120)::INT END AS k FROM {source}),
c0 AS (SELECT *, unnest(range(k))::INT AS seq FROM k)"""


CHUNKS = f"""w AS (SELECT doc_id, regexp_extract_all(text, '{WORD}') AS w FROM documents),
{windows('w')},
chunks AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id, seq) - 1 AS id, doc_id, seq, seq * 120 AS start_word, least(seq * 120 + 150, len(w))::INT AS end_word,
    array_to_string(w[seq * 120 + 1 : seq * 120 + 150], ' ') AS text FROM c0)"""


def tokens(text: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda t: lower(t)), lambda t: t NOT IN ({STOP}))"


LEXICAL = f"""tok AS (SELECT id, {tokens('text')} AS t FROM chunks),
dl AS (SELECT id, len(t) AS dl FROM tok),
post AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(dl) AS total FROM dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term)"""

QUERIES = f"""q AS (SELECT item_id AS query_id, text FROM benchmark),
qt AS (SELECT DISTINCT query_id, unnest({tokens('text')}) AS term FROM q)"""

BM25 = """bm AS MATERIALIZED (SELECT query_id, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (total / n)))) AS bm25
    FROM qt JOIN df USING (term) JOIN post USING (term) JOIN dl USING (id), st GROUP BY ALL)"""


def ranked(name: str, source: str, score: str) -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round({score}, 9) DESC, id) AS rank FROM {source})"


def hashed(name: str, source: str, key: str) -> str:
    """Sparse unit vectors of hashed words."""
    md5 = "md5(trim(x, '.,?'))"
    piece = lambda i: f"('0x' || substr({md5}, {8 * i + 1}, 8))::BIGINT"
    return f"""{name}_b AS (SELECT {key} AS id, ((({piece(0)} + {piece(1)} + {piece(2)}) * 256 + {piece(3)}) % 384)::INT AS bucket
    FROM (SELECT {key}, unnest(regexp_extract_all(lower(text), '{WORD}')) AS x FROM {source})),
{name}_c AS (SELECT id, bucket, count(*) AS c FROM {name}_b GROUP BY ALL),
{name} AS (SELECT id, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS weight FROM {name}_c)"""


DENSE = f"""{hashed('cv', 'chunks', 'id')},
{hashed('qv', 'q', 'query_id')},
cs AS MATERIALIZED (SELECT qv.id AS query_id, cv.id AS id, sum(qv.weight * cv.weight) AS cosine FROM qv JOIN cv USING (bucket) GROUP BY ALL),
ds AS MATERIALIZED (SELECT query_id, chunks.id, coalesce(cosine, 0) AS cosine FROM q CROSS JOIN chunks LEFT JOIN cs USING (query_id, id))"""


def fused(depth: int = 50) -> str:
    return f"""{ranked('dr0', 'ds', 'cosine')},
{ranked('br0', 'bm', 'bm25')},
fu AS (SELECT query_id, id, d.rank AS dense_rank, b.rank AS bm25_rank, coalesce(1 / ({RRF_K} + d.rank), 0) + coalesce(1 / ({RRF_K} + b.rank), 0) AS rrf
    FROM (FROM dr0 WHERE rank <= {depth}) d FULL JOIN (FROM br0 WHERE rank <= {depth}) b USING (query_id, id)),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, least(dense_rank, bm25_rank), id) AS rank FROM fu)"""


HYBRID = ",\n".join([CHUNKS, LEXICAL, QUERIES, BM25, DENSE, fused()])

UNIT = "(SELECT vec_id AS id, label, list_transform(embedding::DOUBLE[], lambda x: x / greatest(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-12)) AS e FROM embeddings)"
