"""Operator 9, chat formatting: preference pairs.

A pair has a chosen and a rejected conversation.  Their longest common prefix of turns (equal
role and text at equal places) is rendered once as the prompt; what follows is rendered for each
side as its completion, with a mask: the character spans of assistant text, which training may
learn from.  Everything is joins and aggregates of turns; a conversation's turns meet only in the
row that holds its rendering.

Defined results: turns are put in order of (turn, role, text), so gaps, ties and repeated turns
keep a fixed place; a null role is ``user`` and a null text is empty; a pair with equal sides has
empty completions; a pair that lacks one side has an empty prompt and one empty completion; turns without
an id are left out; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16


def ordered_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, place (from 0), role, text."""
    rows = conversations.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("user")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    return rows.select("conv_id", place.alias("place"), "role", "text")


def swapped_replies(turns: DataFrame) -> DataFrame:
    """Pairs from single conversations: chosen ends with the last assistant turn, rejected with the first one in its place.

    Columns: pair_id, side, place, role, text.  Conversations with two assistant turns or more.
    """
    replies = turns.where("role = 'assistant'").groupBy("conv_id")
    replies = replies.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("last"), F.min_by("text", "place").alias("first_reply")).where("n > 1")
    rows = turns.join(replies, "conv_id").where("place <= last")
    pair = F.concat(F.lit("swap-"), F.col("conv_id").cast("string")).alias("pair_id")
    chosen = rows.select(pair, F.lit("chosen").alias("side"), "place", "role", "text")
    text = F.when(F.col("place") == F.col("last"), F.col("first_reply")).otherwise(F.col("text")).alias("text")
    return chosen.unionByName(rows.select(pair, F.lit("rejected").alias("side"), "place", "role", text))


def siblings(turns: DataFrame, salts: int = SALTS) -> DataFrame:
    """Pairs of conversations that open with the same turn: each with the next one by id.

    Ids are cut into ``salts`` ranges.  Within an opening and range the next id follows in a window; the last of a range
    is followed by the first of the opening's next range that isn't empty, from a table of at most ``salts`` rows an opening.
    """
    opening = turns.where("place = 0").select("conv_id", F.md5(F.concat_ws("\u0001", "role", "text")).alias("opening"))
    cuts = opening.approxQuantile("conv_id", [i / salts for i in range(1, salts)], 0.01) if salts > 1 else []  # any cuts give the same pairs
    part = sum((F.when(F.col("conv_id") >= F.lit(int(c)), 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    opening = opening.withColumn("part", part)
    firsts = opening.groupBy("opening", "part").agg(F.min("conv_id").alias("first"))
    firsts = firsts.select("opening", "part", F.lead("first").over(Window.partitionBy("opening").orderBy("part")).alias("onward"))
    group = Window.partitionBy("opening", "part").orderBy("conv_id")
    pairs = opening.withColumn("within", F.lead("conv_id").over(group)).join(firsts, ["opening", "part"])
    pairs = pairs.select("conv_id", F.coalesce("within", "onward").alias("other")).where("other is not null")
    pair = F.concat_ws("-", F.lit("sibling"), F.col("conv_id").cast("string"), F.col("other").cast("string")).alias("pair_id")
    sides = pairs.select(pair, F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("conv_id").alias("conv_id")), F.struct(F.lit("rejected").alias("side"), F.col("other").alias("conv_id")))).alias("x"))
    return sides.select("pair_id", "x.side", "x.conv_id").join(turns, "conv_id").select("pair_id", "side", "place", "role", "text")


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair: prompt_turns, prompt, chosen, rejected, and the spans ("start:end,...") that may be learned from."""
    by_place = pairs.groupBy("pair_id", "place").agg(
        F.max(F.when(F.col("side") == "chosen", F.struct("role", "text"))).alias("c"), F.max(F.when(F.col("side") == "rejected", F.struct("role", "text"))).alias("r")
    )
    common = by_place.groupBy("pair_id").agg(F.coalesce(F.min(F.when(~F.coalesce(F.col("c") == F.col("r"), F.lit(False)), F.col("place"))), F.max("place") + 1).alias("prompt_turns"))
    turns = by_place.join(common, "pair_id")
    block = lambda side: F.when(F.col(side).isNotNull(), rendered(F.col(f"{side}.role"), F.col(f"{side}.text")))
    before = F.col("place") < F.col("prompt_turns")

    def gather(value: Column) -> Column:
        return F.sort_array(F.collect_list(value))

    def side(name: str) -> Column:
        spans = F.struct("place", block(name).alias("block"), (F.col(f"{name}.role") == "assistant").alias("learn"), F.length(F.col(f"{name}.role")).alias("head"))
        return gather(F.when(~before & F.col(name).isNotNull(), spans))

    whole = turns.groupBy("pair_id", "prompt_turns").agg(gather(F.when(before, F.struct("place", block("c").alias("block")))).alias("p"), side("c").alias("c"), side("r").alias("r"))
    text = lambda col: F.array_join(F.transform(col, lambda x: x["block"]), "")

    def mask(col: str) -> Column:
        """Spans of assistant text within the completion: after the role line, up to and with the end mark."""
        start = F.lit(0).cast("long")
        step = F.aggregate(
            col,
            F.struct(start.alias("at"), F.array().cast("array<string>").alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x["block"])).alias("at"),
                F.when(x["learn"], F.concat(a["spans"], F.array(F.concat_ws(":", (a["at"] + x["head"] + 5).cast("string"), (a["at"] + F.length(x["block"]) - 1).cast("string")))))
                .otherwise(a["spans"])
                .alias("spans"),
            ),
        )
        return F.array_join(step["spans"], ",")

    return whole.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), text("p").alias("prompt"), text("c").alias("chosen"), text("r").alias("rejected"), mask("c").alias("chosen_spans"), mask("r").alias("rejected_spans"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """Both kinds of pairs from a table of conversations, formatted."""
    turns = ordered_turns(conversations)
    return format_pairs(swapped_replies(turns).unionByName(siblings(turns)))


ORACLE = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place,
         coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
replies AS (
  SELECT conv_id, max(place) AS last, min_by(text, place) AS first_reply
  FROM turns WHERE role = 'assistant' GROUP BY conv_id HAVING count(*) > 1),
opening AS (
  SELECT conv_id, lead(conv_id) OVER (PARTITION BY role, text ORDER BY conv_id) AS other
  FROM turns WHERE place = 0),
pairs AS (
  SELECT 'swap-' || t.conv_id AS pair_id, place, struct_pack(role := role, text := text) AS c,
         struct_pack(role := role, text := CASE WHEN place = last THEN first_reply ELSE text END) AS r
  FROM turns t JOIN replies USING (conv_id) WHERE place <= last
  UNION ALL
  SELECT 'sibling-' || o.conv_id || '-' || o.other, coalesce(a.place, b.place),
         CASE WHEN a.place IS NOT NULL THEN struct_pack(role := a.role, text := a.text) END,
         CASE WHEN b.place IS NOT NULL THEN struct_pack(role := b.role, text := b.text) END
  FROM opening o JOIN (SELECT conv_id, unnest(range(0, max(place) + 1)) AS place FROM turns GROUP BY conv_id) s
    ON s.conv_id IN (o.conv_id, o.other) LEFT JOIN turns a ON a.conv_id = o.conv_id AND a.place = s.place
    LEFT JOIN turns b ON b.conv_id = o.other AND b.place = s.place
  WHERE o.other IS NOT NULL AND (s.conv_id = o.conv_id OR a.place IS NULL)),
common AS (
  SELECT pair_id, coalesce(min(CASE WHEN c IS DISTINCT FROM r THEN place END), max(place) + 1) AS prompt_turns
  FROM pairs GROUP BY pair_id),
blocks AS (
  SELECT pair_id, place, prompt_turns, side, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS block
  FROM (SELECT pair_id, place, 'c' AS side, c.role AS role, c.text AS text FROM pairs WHERE c IS NOT NULL
        UNION ALL SELECT pair_id, place, 'r', r.role, r.text FROM pairs WHERE r IS NOT NULL) JOIN common USING (pair_id)),
spans AS (
  SELECT *, CAST(coalesce(sum(CASE WHEN place >= prompt_turns THEN length(block) END)
         OVER (PARTITION BY pair_id, side ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
  FROM blocks)
SELECT pair_id, CAST(prompt_turns AS BIGINT) AS prompt_turns,
  coalesce(string_agg(block, '' ORDER BY place) FILTER (WHERE side = 'c' AND place < prompt_turns), '') AS prompt,
  coalesce(string_agg(block, '' ORDER BY place) FILTER (WHERE side = 'c' AND place >= prompt_turns), '') AS chosen,
  coalesce(string_agg(block, '' ORDER BY place) FILTER (WHERE side = 'r' AND place >= prompt_turns), '') AS rejected,
  coalesce(string_agg((begins + length(role) + 5) || ':' || (begins + length(block) - 1), ',' ORDER BY place)
    FILTER (WHERE side = 'c' AND place >= prompt_turns AND role = 'assistant'), '') AS chosen_spans,
  coalesce(string_agg((begins + length(role) + 5) || ':' || (begins + length(block) - 1), ',' ORDER BY place)
    FILTER (WHERE side = 'r' AND place >= prompt_turns AND role = 'assistant'), '') AS rejected_spans
FROM spans GROUP BY pair_id, prompt_turns
"""
