"""Preference formatting: a shared prompt and two completions with masks (operator 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import shielded, stage, table

#: The role of a turn without one, and the role whose turns are trained on.
NO_ROLE, MODEL = "user", "assistant"


def _render(turns: Column) -> Column:
    """The turns as one string."""
    piece = lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n<|end|>\n"))
    return F.array_join(F.transform(turns, piece), "")


def _pieces(turns: Column) -> Column:
    """(text, trained) for each stretch of a completion: what the assistant wrote is trained on, its frame and other roles aren't."""
    def of(t: Column) -> Column:
        body = F.struct(F.concat(t["text"], F.lit("\n<|end|>\n")).alias("text"), (t["role"] == MODEL).alias("trained"))
        return F.array(F.struct(F.concat(F.lit("<|"), t["role"], F.lit("|>\n")).alias("text"), F.lit(False).alias("trained")), body)

    return F.flatten(F.transform(turns, of))


@shielded("prompt", "chosen_completion", "rejected_completion", "chosen_mask", "rejected_mask", "n_shared")
def format_preferences(pairs: DataFrame) -> DataFrame:
    """Adds prompt, chosen_completion, rejected_completion, chosen_mask, rejected_mask and n_shared to ``pairs``.

    pairs: chosen and rejected, arrays of (role, text), and any more columns; input columns with the names of
    outputs are replaced. The longest common prefix of turns, equal in role and text, is the prompt, rendered
    once; each completion is the rest of its side. Masks are arrays of (start, end), in characters of the
    completion, that the assistant wrote and that count in training. If one side is a prefix of the other, or
    both are equal, its completion is empty. A null side has no turns; a null role is 'user', a null text
    empty. Nothing is compared between rows, so ties and repeated rows need no rule.
    """
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit(NO_ROLE)).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    df = pairs.withColumns({"mr_c": clean(F.col("chosen")), "mr_r": clean(F.col("rejected"))})
    # The first place where the sides differ: nulls pad the shorter one, so that its end differs too.
    differs = F.expr("array_position(zip_with(mr_c, mr_r, (c, r) -> c <=> r AND c IS NOT NULL), false)")
    df = df.withColumn("n_shared", F.when(differs > 0, differs - 1).otherwise(F.greatest(F.size("mr_c"), F.size("mr_r"))).cast("int"))
    rest = lambda c: F.slice(F.col(c), F.col("n_shared") + 1, F.greatest(F.size(c) - F.col("n_shared"), F.lit(0)))
    df = df.withColumn("prompt", _render(F.slice("mr_c", F.lit(1), F.col("n_shared"))))
    for side, c in (("chosen", "mr_c"), ("rejected", "mr_r")):
        df = df.withColumn("mr_p", _pieces(rest(c))).withColumn(f"{side}_completion", F.array_join(F.transform("mr_p", lambda p: p["text"]), ""))
        spans = F.aggregate(
            "mr_p",
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("x")),
            lambda s, p: F.struct(
                (s["at"] + F.char_length(p["text"])).alias("at"),
                F.when(p["trained"], F.concat(s["x"], F.array(F.struct(s["at"].alias("start"), (s["at"] + F.char_length(p["text"])).alias("end"))))).otherwise(s["x"]).alias("x"),
            ),
        )
        df = df.withColumn(f"{side}_mask", spans["x"])
    return df.drop("mr_c", "mr_r", "mr_p")


def _clean(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (role, text) in order."""
    full = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNull().alias("none"), "turn", F.coalesce("role", F.lit(NO_ROLE)).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    listed = full.groupBy("conv_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def pair_conversations(turns: DataFrame) -> DataFrame:
    """Pairs of conversations: (chosen_id, rejected_id, borrowed, chosen, rejected).

    turns: conv_id, turn, role, text; other columns are ignored. Of conversations that open alike, in the order of
    conv_id, the first and second, the third and fourth and so on are a pair. The longer one is chosen (more turns, then
    more characters, then the smaller conv_id). A conversation that is left over, or opens alone, is chosen over
    itself with another answer: its last turn of the assistant is replaced by the last one of the next conversation, by
    conv_id, that is left over and has one; the first follows the last. borrowed says so, and rejected_id is then
    the conversation that the answer comes from. Where nothing can be borrowed the rejected side is null.

    A null role is 'user' and a null text empty, before anything is compared. Turns without a conv_id are left out;
    null turn numbers come last, and equal ones are in the order of role and text; repeated rows are one turn. An empty
    table gives an empty one. No group of openings is ever in one task: places in a group are counted from the
    sizes of its slices.
    """
    convs = _clean(turns)
    opening = F.col("turns")[0]
    # The length of the role tells it from the text. 128 bits, so that no two openings are taken for one.
    convs = convs.withColumn("opening", F.unhex(F.md5(F.concat(F.length(opening["role"]).cast("string"), F.lit(":"), opening["role"], opening["text"]))))
    from_end = F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), MODEL)
    convs = stage(convs.withColumn("at", F.when(from_end > 0, F.size("turns") - from_end + 1).cast("int")), "op3-convs")
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.char_length(t["text"]))
    order = F.struct((-F.size("turns")).alias("a"), (-chars).alias("b"), F.col("conv_id").alias("id"))
    facts = stage(convs.select("conv_id", "opening", "at", order.alias("s")), "op3-facts")
    places = _places(facts.select("opening", "conv_id"))
    sides = facts.join(places.select("conv_id", F.expr("place DIV 2").alias("pair")), "conv_id")
    duo = sides.groupBy("opening", "pair").agg(F.array_sort(F.collect_list("s")).alias("s"), F.max("at").alias("at"))
    duo = stage(duo.select(F.col("s")[0]["id"].alias("conv_id"), F.get("s", F.lit(1))["id"].alias("other"), "at"), "op3-pairs")
    alone = stage(_places(duo.where("other IS NULL AND at IS NOT NULL").select(F.lit(0).alias("opening"), "conv_id")), "op3-alone")
    n = alone.count()
    lent = alone.select("conv_id", F.expr(f"(place + 1) % {n or 1}").alias("next")).join(alone.select(F.col("conv_id").alias("lender"), "place"), F.expr("next = place"))
    lent = lent.where("lender <> conv_id").select("conv_id", F.col("lender").alias("other"), F.lit(True).alias("borrowed"))
    known = duo.where("other IS NOT NULL").select("conv_id", "other", F.lit(False).alias("borrowed")).union(lent)
    # What the other conversation gives goes to the chosen one: all of it, or one turn.
    given = convs.join(known.withColumnRenamed("conv_id", "to"), F.col("conv_id") == F.col("other"))
    given = given.select("to", "other", "borrowed", F.when(F.col("borrowed"), F.slice("turns", F.coalesce("at", F.lit(1)), F.lit(1))).otherwise(F.col("turns")).alias("sent"))
    chosen = convs.join(duo.select("conv_id"), "conv_id").join(given, F.col("conv_id") == F.col("to"), "left")
    other = F.concat(F.slice("turns", F.lit(1), F.col("at") - 1), F.col("sent"), F.slice("turns", F.col("at") + 1, F.size("turns")))
    return chosen.select(
        F.col("conv_id").alias("chosen_id"), F.col("other").alias("rejected_id"), F.coalesce("borrowed", F.lit(False)).alias("borrowed"),
        F.col("turns").alias("chosen"), F.when(F.col("borrowed"), other).otherwise(F.col("sent")).alias("rejected"),
    )


#: Conversation numbers in a slice; runs of slices that are summed in one task.
SLICE, RUN = 256, 4096


def _places(keys: DataFrame) -> DataFrame:
    """(opening, conv_id, place): the place of each of ``keys`` (opening, conv_id) in its group, from 0, by conv_id.

    Ids are counted in slices of SLICE numbers. Windows run over RUN slices of an opening, and over the sums of such
    runs: a group of a thousand million conversations has about a thousand of those.
    """
    from pyspark.sql import Window

    slices = keys.withColumn("slice", F.expr(f"conv_id DIV {SLICE}")).groupBy("opening", "slice").agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    slices = stage(slices.withColumn("run", F.expr(f"slice DIV {RUN}")), "op3-slices")
    counts = slices.select("opening", "slice", "run", F.size("ids").cast("long").alias("n"))
    inner = Window.partitionBy("opening", "run").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("opening").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.groupBy("opening", "run").agg(F.sum("n").alias("n")).select("opening", "run", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    before = counts.withColumn("in", F.coalesce(F.sum("n").over(inner), F.lit(0))).join(runs, ["opening", "run"]).select("opening", "slice", (F.col("base") + F.col("in")).alias("before"))
    return slices.join(before, ["opening", "slice"]).select("opening", "before", F.posexplode("ids").alias("k", "conv_id")).selectExpr("opening", "conv_id", "before + k AS place")


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = pair_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    out = format_preferences(pairs)
    spans = lambda c: F.array_join(F.transform(c, lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return out.select(
        "chosen_id", "rejected_id", "borrowed", "n_shared", "prompt", "chosen_completion", "rejected_completion",
        spans("chosen_mask").alias("chosen_mask"), spans("rejected_mask").alias("rejected_mask"),
    )


QUERIES = {"op3_preferences": op3_preferences}

_PIECE = "'<|' || x.role || '|>' || chr(10) || x.text || chr(10) || '<|end|>' || chr(10)"
_SPANS = """array_to_string(list_filter(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN {0}[i].role = 'assistant' THEN
        coalesce(list_sum(list_transform({0}[1 : i - 1], lambda x: length(x.role) + length(x.text) + 14)), 0) + 14 || '-' ||
        coalesce(list_sum(list_transform({0}[1 : i - 1], lambda x: length(x.role) + length(x.text) + 14)), 0) + 14 + length({0}[i].text) + 9 END), lambda x: x IS NOT NULL), ',')"""

ORACLE = {
    "op3_preferences": f"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS LAST, role, text) AS t, sum(length(text)) AS chars FROM t GROUP BY conv_id
), g AS (
    SELECT *, t[1] AS opening, (row_number() OVER (PARTITION BY t[1] ORDER BY conv_id) - 1) // 2 AS pair FROM c
), s AS (
    SELECT list(conv_id ORDER BY len(t) DESC, chars DESC, conv_id) AS id, list(t ORDER BY len(t) DESC, chars DESC, conv_id) AS t FROM g GROUP BY opening, pair
), alone AS (
    SELECT id[1] AS id, t[1] AS t, len(t[1]) + 1 - nullif(list_position(list_reverse(list_transform(t[1], lambda x: x.role)), 'assistant'), 0) AS k FROM s WHERE len(id) = 1
), turns AS (
    SELECT *, t[k] AS answer, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM alone WHERE k IS NOT NULL
), lent AS (
    SELECT a.id, b.id AS lender, a.t[1 : a.k - 1] || [b.answer] || a.t[a.k + 1 :] AS t FROM turns a JOIN turns b ON b.place = (a.place + 1) % a.n WHERE a.id <> b.id
), p AS (
    SELECT s.id[1] AS chosen_id, coalesce(s.id[2], lender) AS rejected_id, lender IS NOT NULL AS borrowed, s.t[1] AS c, coalesce(s.t[2], lent.t, []) AS r FROM s LEFT JOIN lent ON s.id[1] = lent.id
), n AS (
    SELECT *, coalesce(nullif(list_position(list_transform(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] IS NOT NULL AND r[i] IS NOT NULL AND c[i] = r[i]), false), 0) - 1, greatest(len(c), len(r)))::INT AS n_shared FROM p
), x AS (
    SELECT *, c[n_shared + 1 :] AS a, r[n_shared + 1 :] AS b FROM n
)
SELECT chosen_id, rejected_id, borrowed, n_shared,
    array_to_string(list_transform(c[1 : n_shared], lambda x: {_PIECE}), '') AS prompt,
    array_to_string(list_transform(a, lambda x: {_PIECE}), '') AS chosen_completion,
    array_to_string(list_transform(b, lambda x: {_PIECE}), '') AS rejected_completion,
    {_SPANS.format('a')} AS chosen_mask, {_SPANS.format('b')} AS rejected_mask
FROM x
"""
}
