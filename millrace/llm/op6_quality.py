"""Quality rules with thresholds learned per language and source (operator 6).

Word, symbol, line and repetition counts are taken of every whole text. The rates made of them go into
mergeable quantile sketches: counts per logarithmic bucket (relative error SKETCH_ERROR), which add up the
same in any order, so that partial sums before the shuffle, later batches and single runs all agree. Each
language and source gets its own limits from the quantiles of its own sketch, drawn towards those of its language
the less the more documents it has, and documents are filtered by a join. No limit is a fixed number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import map_texts, shielded, stage, table, WORD

SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Relative error of the sketches.
SKETCH_ERROR = 0.01


def text_counts(text: bytes | None) -> tuple[int, ...]:
    """COUNTS of one text; a null text has none of anything."""
    if not text:
        return (0,) * len(COUNTS)
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace")) if not joined.isascii() else len(joined)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines)


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pair = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    _, which, count = np.unique(pair[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    twice = count[which] > 1
    if not twice.any():
        return 0
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def with_counts(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns COUNTS, which replace input columns of these names."""
    docs = docs.drop(*COUNTS)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).cast(pa.large_binary())
            rows = [text_counts(x.as_buffer().to_pybytes() if x.is_valid else None) for x in texts]
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *COUNTS])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])
    return map_texts(docs, run, schema)


#: A document fails at 50 words or fewer than that, or with more than half its words in repeats.
BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
#: name -> (what is counted, out of what, lower and upper quantile, spreads, two-sided). The rate is
#: (counted + 1) / (out of + 1), so that a text with none still has one, the less the longer it is. A group's limit
#: is its median times (upper / lower quantile) to the power of the spreads, and for a two-sided rule also its
#: median divided by that. Where a rule is about too much of something, both quantiles lie in the lower half, which
#: bad documents don't reach before they are half of a group.
RULES = {
    "symbols": ("n_symbols", "word_chars", 0.1, 0.5, 2.5, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, 0.5, 1.5, False),
    "word_length": ("word_chars", "n_words", 0.25, 0.75, 6.0, True),
}
#: Documents that a group's quantiles weigh as much as those of its language, and a language's as those of everything:
#: a group of n has the weight n / (n + PRIOR) in its own limits, at every size.
PRIOR = 100
#: A count may differ from what its group's limit makes it by so many standard deviations of a Poisson count.
NOISE = 3.0
LOG_GAMMA = float(np.log((1 + SKETCH_ERROR) / (1 - SKETCH_ERROR)))


def sketch(counts: DataFrame) -> DataFrame:
    """Quantile sketches of documents that pass the base rules, as rows (lang, source, rule, bucket, n); a bucket is
    the logarithm of a rate, rounded up. Two tables of such rows merge by summing n."""
    rates = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.expr(f"({r[0]} + 1) / ({r[1]} + 1)").alias("v")) for k, r in RULES.items()]))
    rows = counts.where(f"NOT ({BASE_FAILED})").select("lang", "source", rates.alias("x")).select("lang", "source", "x.rule", "x.v")
    return rows.groupBy("lang", "source", "rule", F.ceil(F.ln("v") / LOG_GAMMA).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def _quantiles(sketches: DataFrame, *keys: str) -> DataFrame:
    """One row for each value of keys: documents, and the buckets lo, mid, hi of each rule."""
    from pyspark.sql import Window

    merged = sketches.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "rule")
    cum = merged.select(*keys, "rule", "bucket", "n", F.sum("n").over(w.orderBy("bucket")).alias("cum"), F.sum("n").over(w).alias("all"))
    at = lambda rule, q: F.min(F.when((F.col("rule") == rule) & (F.col("cum") >= F.col("all") * q), F.col("bucket")))
    found = [at(rule, q).cast("double").alias(f"{rule}_{name}") for rule, r in RULES.items() for name, q in (("lo", r[2]), ("mid", 0.5), ("hi", r[3]))]
    return cum.groupBy(*keys).agg(F.max("all").alias("n"), *found)


def thresholds(sketches: DataFrame) -> DataFrame:
    """(mr_lang, mr_source, and for each rule the least and the most that is allowed) of every group.

    Windows run over the buckets of one sketch, of which there are at most some thousands.
    """
    names = [f"{rule}_{q}" for rule in RULES for q in ("lo", "mid", "hi")]
    own = _quantiles(sketches, "lang", "source")
    lang = _quantiles(sketches, "lang").select(F.col("lang").alias("l_lang"), F.col("n").alias("l_n"), *[F.col(c).alias(f"l_{c}") for c in names])
    every = _quantiles(sketches).select(*[F.col(c).alias(f"e_{c}") for c in names])
    met = own.join(lang, F.expr("lang <=> l_lang"), "left").join(F.broadcast(every), F.lit(True), "left")
    blend = lambda n, own, over: (F.col(n) * F.col(own) + PRIOR * over) / (F.col(n) + PRIOR)
    out = met.select("lang", "source", *[blend("n", c, blend("l_n", f"l_{c}", F.col(f"e_{c}"))).alias(c) for c in names])
    room = {rule: F.lit(r[4]) * (F.col(f"{rule}_hi") - F.col(f"{rule}_lo")) for rule, r in RULES.items()}
    return out.select(
        F.col("lang").alias("mr_lang"), F.col("source").alias("mr_source"),
        *[F.exp(F.lit(LOG_GAMMA) * (F.col(f"{rule}_mid") + room[rule])).alias(f"mr_{rule}_max") for rule in RULES],
        *[F.exp(F.lit(LOG_GAMMA) * (F.col(f"{rule}_mid") - room[rule])).alias(f"mr_{rule}_min") for rule, r in RULES.items() if r[5]],
    )


def _fine(prefix: str = "mr_") -> str:
    """The method's verdict, as SQL over the counts and limits."""
    parts = []
    for rule, (count, base, _, _, _, two_sided) in RULES.items():
        most, least = f"{prefix}{rule}_max * {base}", f"{prefix}{rule}_min * {base}"
        parts.append(f"{count} <= {most} + {NOISE} * sqrt({most})")
        if two_sided:
            parts.append(f"{count} >= {least} - {NOISE} * sqrt({least})")
    return " AND ".join(parts)


def _judge(counts: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds base_failed and kept by a join with the limits of each row's group."""
    joined = counts.join(limits, F.expr("lang <=> mr_lang AND source <=> mr_source"), "left")
    judged = joined.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.expr(_fine()), F.lit(False)))
    return judged.drop(*limits.columns)


@shielded(*COUNTS, "base_failed", "kept")
def verdicts(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, COUNTS, base_failed and kept; one row for each row.

    docs: text, lang, source and any more columns; input columns with the names of outputs are replaced. A
    null or empty text has no words and fails. Null languages and sources form groups like any other. Ties
    and repeated rows are judged alike. An empty table gives an empty one.
    """
    counts = stage(with_counts(docs).drop("text"), "op6-counts")
    return _judge(counts, stage(thresholds(sketch(counts)), "op6-limits"))


@shielded(own=(*COUNTS, "base_failed", "kept"))
def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, unchanged. Texts are counted twice rather than shuffled or stored."""
    limits = stage(thresholds(sketch(with_counts(docs.select("text", "lang", "source")))), "op6-limits")
    return _judge(with_counts(docs), limits).where("kept").select(*docs.columns)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return verdicts(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op6_quality": op6_quality}


def _oracle() -> str:
    rates = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS rule, ({r[0]} + 1) / ({r[1]} + 1) AS v FROM m WHERE NOT ({BASE_FAILED})" for k, r in RULES.items())
    quantiles = ", ".join(f"min(CASE WHEN rule = '{k}' AND cum >= a * {q}::DOUBLE THEN bucket END)::DOUBLE AS {k}_{name}" for k, r in RULES.items() for name, q in (("lo", r[2]), ("mid", 0.5), ("hi", r[3])))

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        return f"""{name}_b AS (SELECT {by}rule, bucket, sum(n) AS n FROM k GROUP BY ALL),
{name}_c AS (SELECT *, sum(n) OVER (PARTITION BY {by}rule ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {by}rule) AS a FROM {name}_b),
{name} AS (SELECT {by}max(a)::DOUBLE AS n, {quantiles} FROM {name}_c {'GROUP BY ' + keys if keys else ''})"""

    names = [f"{rule}_{q}" for rule in RULES for q in ("lo", "mid", "hi")]
    blended = ", ".join(f"(o.n * o.{c} + {PRIOR} * ((l.n * l.{c} + {PRIOR} * e.{c}) / (l.n + {PRIOR}))) / (o.n + {PRIOR}) AS {c}" for c in names)
    limits = ", ".join(f"exp({LOG_GAMMA!r}::DOUBLE * ({rule}_mid {sign} {r[4]}::DOUBLE * ({rule}_hi - {rule}_lo))) AS {rule}_{end}" for rule, r in RULES.items() for sign, end in (("+", "max"), ("-", "min")))
    return f"""
WITH w AS (
    SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), windows AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), repeated AS (
    SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS place FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
    SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM w
), m AS (
    SELECT doc_id, lang, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines
    FROM w JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)
), k AS (
    SELECT lang, source, rule, ceil(ln(v) / {LOG_GAMMA!r}::DOUBLE)::INT AS bucket, count(*) AS n FROM ({rates}) GROUP BY ALL
), {level('o', 'lang, source')}, {level('l', 'lang')}, {level('e', '')}, b AS (
    SELECT o.lang, o.source, {blended} FROM o LEFT JOIN l ON o.lang IS NOT DISTINCT FROM l.lang CROSS JOIN e
), t AS (
    SELECT lang, source, {limits} FROM b
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
    ({BASE_FAILED}) AS base_failed, NOT ({BASE_FAILED}) AND coalesce({_fine('t.')}, false) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


ORACLE = {"op6_quality": _oracle()}
