"""Preference formatting: the turns that two conversations begin with are rendered once, the rest as a pair of masked completions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` role ``middle`` text ``close``. In texts and roles ``guard`` is broken up, so that they can't open or close a turn."""

    open: str = "<|im_start|>"
    middle: str = "\n"
    close: str = "<|im_end|>\n"
    guard: str = "<|"
    broken: str = "< |"
    trained: str = "assistant"

    def clean(self, text: Column) -> Column:
        return F.replace(F.coalesce(text, F.lit("")), F.lit(self.guard), F.lit(self.broken))

    def head(self, said: Column) -> Column:
        return F.concat(F.lit(self.open), self.clean(said["role"]), F.lit(self.middle))

    def body(self, said: Column) -> Column:
        return F.concat(self.clean(said["text"]), F.lit(self.close))

    def render(self, said: Column) -> Column:
        """The turns of an array, one after another."""
        return F.array_join(F.transform(said, lambda m: F.concat(self.head(m), self.body(m))), "")

    def mask(self, said: Column) -> Column:
        """Runs ``length:1`` of letters to train on and ``length:0`` of others, comma-joined; they cover the rendered turns.

        Trained are the texts of the trained role with what closes them.
        """
        run = lambda length, trained: F.concat(F.length(length).cast("string"), F.lit(f":{trained}"))
        own = lambda m: F.when(m["role"] == self.trained, F.concat(run(self.head(m), 0), F.lit(","), run(self.body(m), 1)))
        return F.array_join(F.transform(said, lambda m: F.coalesce(own(m), run(F.concat(self.head(m), self.body(m)), 0))), ",")


def preferences(chosen: DataFrame, rejected: DataFrame, template: Template = Template(), pair_col: str = "pair_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, n_prompt, prompt, n_chosen, chosen, chosen_mask, n_rejected, rejected, rejected_mask) of every pair.

    Both inputs hold turns of pairs. The prompt is the longest common run of turns from the start: turns are equal if their
    number, role and text are. What follows is each side's completion, empty where a side ends with the prompt; a pair that
    only one side has has no prompt. Rows with the same turn number are one turn, its messages ordered by role and text. Null
    turn numbers come first; null roles and texts are rendered empty and equal each other only. Rows without a pair are left
    out, as they have no partner. No rows give no rows; other columns are ignored.

    Turns are matched by grouping on pair and turn, so a common opening is no hot key; only what is rendered into one row
    meets in one task.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.filter(F.col(pair_col).isNotNull()).select(
            F.col(pair_col).alias("pair_id"), F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 63))).alias("turn"), F.lit(name).alias("side"),
            F.struct(F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text")).alias("said"),
        )

    said = lambda name: F.array_sort(F.collect_list(F.when(F.col("side") == name, F.col("said"))))
    turns = side(chosen, "c").union(side(rejected, "r")).groupBy("pair_id", "turn").agg(said("c").alias("c"), said("r").alias("r"))
    apart = F.min(F.when(F.col("c") != F.col("r"), F.col("turn")))
    pairs = turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("turn", "c", "r"))).alias("t"), apart.alias("apart"))
    before = lambda x: F.col("apart").isNull() | (x["turn"] < F.col("apart"))
    parts = pairs.select(
        "pair_id",
        F.flatten(F.transform(F.filter("t", before), lambda x: x["c"])).alias("p"),
        *[F.flatten(F.transform(F.filter("t", lambda x: ~before(x)), lambda x: x[k])).alias(k) for k in ("c", "r")],
    )
    size = lambda k: F.size(k).cast("long")
    return parts.select(
        "pair_id", size("p").alias("n_prompt"), template.render(F.col("p")).alias("prompt"),
        size("c").alias("n_chosen"), template.render(F.col("c")).alias("chosen"), template.mask(F.col("c")).alias("chosen_mask"),
        size("r").alias("n_rejected"), template.render(F.col("r")).alias("rejected"), template.mask(F.col("r")).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", answer: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """(chosen, rejected) turns made from conversations alone, one pair each.

    Chosen is a whole conversation. Rejected is the same with the last answer of the conversation whose number is next in the
    place of its own last answer, and without one where there is none; turns after it stand on both sides. A conversation without
    an answer is both.
    """
    rows = turns.select(F.col(conv_col).alias("pair_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    answers = rows.filter((F.col("role") == answer) & F.col("turn").isNotNull() & F.col("pair_id").isNotNull())
    last = answers.groupBy("pair_id").agg(F.max(F.struct("turn", "text")).alias("last"))
    ends = last.select("pair_id", F.col("last.turn").alias("end"))
    known = rows.join(ends, "pair_id", "left")
    is_last = F.coalesce((F.col("role") == answer) & (F.col("turn") == F.col("end")), F.lit(False))
    chosen, kept = known.drop("end"), known.filter(~is_last).drop("end")
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("text"))
    swapped = ends.join(other, "pair_id").select("pair_id", F.col("end").alias("turn"), F.lit(answer).alias("role"), "text")
    return chosen, kept.union(swapped)


#: The pairs of swapped answers over the conversations table, formatted, in DuckDB's SQL.
SWAPPED_SQL = r"""
WITH answers AS (SELECT conv_id, max(struct_pack(turn := turn, text := text)) AS a FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1),
known AS (SELECT c.conv_id, c.turn, c.role, c.text, a.a.turn AS ending FROM conversations c LEFT JOIN answers a USING (conv_id) WHERE c.conv_id IS NOT NULL),
sides AS (
  SELECT conv_id AS pair_id, turn, role, text, 'c' AS side FROM known
  UNION ALL SELECT conv_id, turn, role, text, 'r' FROM known WHERE NOT coalesce(role = 'assistant' AND turn = ending, false)
  UNION ALL SELECT a.conv_id, a.a.turn, 'assistant', b.a.text, 'r' FROM answers a JOIN answers b ON b.conv_id = a.conv_id + 1),
said AS (SELECT pair_id, coalesce(turn, -9223372036854775808) AS turn, side, role, text, '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
  replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body FROM sides),
turns AS (SELECT pair_id, turn, coalesce(list(struct_pack(role := role, text := text) ORDER BY role NULLS FIRST, text NULLS FIRST) FILTER (side = 'c'), [])
    IS DISTINCT FROM coalesce(list(struct_pack(role := role, text := text) ORDER BY role NULLS FIRST, text NULLS FIRST) FILTER (side = 'r'), []) AS differs FROM said GROUP BY 1, 2),
apart AS (SELECT pair_id, min(turn) FILTER (differs) AS apart FROM turns GROUP BY 1),
parts AS (SELECT s.*, CASE WHEN a.apart IS NULL OR s.turn < a.apart THEN 'p' || s.side ELSE s.side END AS part,
  CASE WHEN role = 'assistant' THEN length(head) || ':0,' || length(body) || ':1' ELSE length(head || body) || ':0' END AS run FROM said s JOIN apart a USING (pair_id))
SELECT pair_id,
  count(*) FILTER (part = 'pc') AS n_prompt, coalesce(string_agg(head || body, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (part = 'pc'), '') AS prompt,
  count(*) FILTER (part = 'c') AS n_chosen, coalesce(string_agg(head || body, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (part = 'c'), '') AS chosen,
  coalesce(string_agg(run, ',' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (part = 'c'), '') AS chosen_mask,
  count(*) FILTER (part = 'r') AS n_rejected, coalesce(string_agg(head || body, '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (part = 'r'), '') AS rejected,
  coalesce(string_agg(run, ',' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) FILTER (part = 'r'), '') AS rejected_mask
FROM parts GROUP BY 1
"""
