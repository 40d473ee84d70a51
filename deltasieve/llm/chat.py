"""Preference pairs of conversations: the shared prompt once, and two completions with loss masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Turns that are rendered together, before the pieces of a section are put together.
PIECE = 64
TRAINED = "assistant"


def _opening(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


_CLOSING = "<|end|>\n"


SECTIONS = ("prompt", "chosen", "rejected")


def format_preferences(turns: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each pair: pair_id, prompt, chosen, rejected, and of the two the spans and numbers of turns.

    From rows pair_id, side (chosen or rejected), turn, role, text. The prompt is the longest common prefix of the two
    sides' turns (equal in place, role and text), rendered once; what follows on each side is its completion. A turn is
    rendered as an opening with its role, its text and a closing. chosen_spans and rejected_spans list the places
    "begin-end" of a completion that are trained on: the texts of its assistant's turns; the prompt is all masked.

    Turns are in order of turn (null first), and those with one number in order of role and text; a null role
    is 'unknown', a null text empty. A section without turns is an empty text. A side that is missing altogether
    shares nothing. Rows with a null pair_id are one pair. Other columns play no part; an empty table gives no rows.

    A long conversation's turns are rendered piece by piece, by ranges of places, and only these texts meet: a
    task holds a piece's turns, or one pair's rendered row, which is the result and must fit in a row.
    """
    rows = turns.select("pair_id", "side", F.col("turn").cast("bigint").alias("number"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # A side's turns are known by their places, whatever its numbers are.
    rows = rows.withColumn("turn", F.row_number().over(Window.partitionBy("pair_id", "side").orderBy("number", "role", "text")) - 1).drop("number")
    # Places at which one side has no turn like the other's; the least of them ends the prompt.
    place = F.col("turn")
    same = rows.groupBy("pair_id", "turn").agg(F.count(F.lit(1)).alias("sides"), F.countDistinct("role", "text").alias("kinds"))
    ends = same.where("sides < 2 OR kinds > 1").groupBy("pair_id").agg(F.min(place).alias("end"))
    ends = ends.withColumnRenamed("pair_id", "p")
    split = rows.join(ends, F.col("pair_id").eqNullSafe(F.col("p")), "left").drop("p")
    shared = F.col("end").isNull() | (place < F.col("end"))
    split = split.where(~shared | (F.col("side") == "chosen")).withColumn("section", F.when(shared, F.lit("prompt")).otherwise(F.col("side")))
    split = split.withColumn("piece", F.floor(F.col("turn") / piece).cast("bigint"))
    opening = _opening(F.col("role"))
    body = F.struct("turn", F.concat(opening, F.col("text"), F.lit(_CLOSING)).alias("shown"), F.char_length(opening).alias("skip"), F.char_length("text").alias("long"), ((F.col("role") == TRAINED) & (F.col("section") != "prompt")).alias("trained"))
    groups = split.groupBy("pair_id", "section", "piece").agg(F.sort_array(F.collect_list(body)).alias("parts"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + part["skip"]
        span = F.struct(begin.alias("begin"), (begin + part["long"]).alias("end"))
        return F.struct((acc["at"] + F.char_length(part["shown"])).alias("at"), F.when(part["trained"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    spans = F.aggregate("parts", start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("parts", lambda p: p["shown"]), "")
    pieces = groups.select("pair_id", "section", F.struct("piece", text.alias("text"), spans.alias("spans"), F.size("parts").alias("turns")).alias("x"))
    whole = pieces.groupBy("pair_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("section") == s, F.col("x")))).alias(s) for s in SECTIONS])

    def moved(acc: Column, x: Column) -> Column:
        """A piece's spans stand after the texts of those before it."""
        own = F.transform(x["spans"], lambda s: F.concat_ws("-", (s["begin"] + acc["at"]).cast("string"), (s["end"] + acc["at"]).cast("string")))
        return F.struct((acc["at"] + F.char_length(x["text"])).alias("at"), F.concat(acc["spans"], own).alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    texts = [F.array_join(F.transform(s, lambda x: x["text"]), "").alias(s) for s in SECTIONS]
    masks = [F.array_join(F.aggregate(s, none, moved, lambda acc: acc["spans"]), ",").alias(f"{s}_spans") for s in SECTIONS[1:]]
    counts = [F.aggregate(s, F.lit(0).cast("bigint"), lambda n, x: n + x["turns"]).alias(f"{s}_turns") for s in SECTIONS]
    return whole.select("pair_id", *texts, *masks, *counts)


def stale_replies(conversations: DataFrame) -> DataFrame:
    """Preference rows from plain conversations: chosen as they are, rejected with the last reply gone stale.

    The text of the last assistant turn is replaced by that of the first one, or by nothing if that is the same turn. Where
    there is no assistant turn, or the two texts are equal, both sides are alike, and such a pair has two empty completions.
    Of turns with one number the least role and text counts as the first; all with the last number are replaced. A null text
    is a text of its own here, and empty when rendered; rows with a null conv_id are one conversation.
    """
    plain = conversations.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    reply = F.when(F.col("role") == TRAINED, F.col("turn"))
    ends = plain.groupBy("pair_id").agg(F.max(reply).alias("last"), F.min(reply).alias("first"), F.min(F.when(F.col("role") == TRAINED, F.struct("turn", "text")))["text"].alias("stale"))
    ends = ends.withColumnRenamed("pair_id", "p")
    both = plain.join(ends, F.col("pair_id").eqNullSafe(F.col("p")), "left").withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    stale = (F.col("side") == "rejected") & (F.col("role") == TRAINED) & (F.col("turn") == F.col("last"))
    text = F.when(stale, F.when(F.col("first") == F.col("last"), F.lit("")).otherwise(F.col("stale"))).otherwise(F.col("text"))
    return both.select("pair_id", "side", "turn", "role", text.alias("text"))


def op7_chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """format_preferences() over all conversations, each paired with its stale copy; one row for each conv_id."""
    return format_preferences(stale_replies(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


OP7_SQL = r"""
WITH e AS (
  SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last, min(turn) FILTER (WHERE role = 'assistant') AS first,
         arg_min(coalesce(text, ''), turn) FILTER (WHERE role = 'assistant') AS stale
  FROM conversations GROUP BY conv_id),
c AS (SELECT conv_id AS pair_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, last, first, stale FROM conversations JOIN e USING (conv_id)),
r AS (
  SELECT pair_id, 'chosen' AS side, turn, role, text FROM c
  UNION ALL
  SELECT pair_id, 'rejected', turn, role, CASE WHEN role = 'assistant' AND turn = last THEN CASE WHEN first = last THEN '' ELSE stale END ELSE text END FROM c),
m AS (SELECT a.pair_id, min(a.turn) AS cut FROM r a JOIN r b ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.side = 'chosen' AND b.side = 'rejected' WHERE a.text <> b.text GROUP BY a.pair_id),
s AS (
  SELECT r.pair_id, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' ELSE side END AS section, turn, role, text,
         '<|' || role || '|>' || chr(10) AS opening
  FROM r LEFT JOIN m ON r.pair_id = m.pair_id WHERE side = 'chosen' OR turn >= cut),
p AS (
  SELECT *, opening || text || '<|end|>' || chr(10) AS shown,
         sum(length(opening) + length(text) + 8) OVER (PARTITION BY pair_id, section ORDER BY turn) - length(text) - 8 AS begin
  FROM s),
g AS (
  SELECT pair_id, section, string_agg(shown, '' ORDER BY turn) AS text, count(*) AS n,
         coalesce(string_agg(CASE WHEN role = 'assistant' AND section <> 'prompt' THEN begin::BIGINT || '-' || (begin + length(text))::BIGINT END, ',' ORDER BY turn), '') AS spans
  FROM p GROUP BY pair_id, section)
SELECT pair_id, coalesce(max(text) FILTER (WHERE section = 'prompt'), '') AS prompt, coalesce(max(text) FILTER (WHERE section = 'chosen'), '') AS chosen,
       coalesce(max(text) FILTER (WHERE section = 'rejected'), '') AS rejected, coalesce(max(spans) FILTER (WHERE section = 'chosen'), '') AS chosen_spans,
       coalesce(max(spans) FILTER (WHERE section = 'rejected'), '') AS rejected_spans, coalesce(max(n) FILTER (WHERE section = 'prompt'), 0) AS prompt_turns,
       coalesce(max(n) FILTER (WHERE section = 'chosen'), 0) AS chosen_turns, coalesce(max(n) FILTER (WHERE section = 'rejected'), 0) AS rejected_turns
FROM g GROUP BY pair_id
"""
