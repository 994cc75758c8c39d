"""Chat formatting of preference pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role whose turns are trained on.
TRAINED = "assistant"


def _render(turn) -> F.Column:
    return F.concat(F.lit(OPEN), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE), F.coalesce(turn["text"], F.lit("")), F.lit(CLOSE))


def _completion(turns) -> tuple[F.Column, F.Column]:
    """The text of the turns, and the spans of it that are trained on, as "start-end,..." in characters.

    A trained turn's span is its text with the end mark; role headers and other turns are masked.
    """
    text = F.array_join(F.transform(turns, _render), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc, turn):
        end = acc["at"] + F.length(_render(turn))
        head = acc["at"] + F.length(F.lit(OPEN)) + F.length(F.coalesce(turn["role"], F.lit(""))) + F.length(F.lit(MIDDLE))
        span = F.concat(head.cast("string"), F.lit("-"), (end - 1).cast("string"))
        spans = F.when(turn["role"] == TRAINED, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return text, F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each ``conv_id`` of ``chosen`` and ``rejected``, tables with ``turn``, ``role`` and ``text``.

    The turns of each side are ordered by ``turn``, then role and text. Their longest common prefix, by role
    and text, is rendered once as ``prompt``; ``prompt_turns`` counts it. What is left of each side is its
    completion, with the spans that its mask lets through: the assistant's words and end marks, by their
    offsets in the completion. Equal sides have two empty completions. A side without turns has an empty
    completion and the prompt is empty. A null role or text is rendered as empty and equals a null alone.
    Rows of a null ``conv_id`` are left out. Repeated turns stay, side by side. A completion without
    assistant turns has an empty mask. Other columns aren't read. No rows give no rows.
    """
    side = lambda df, k: df.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(k).alias("side"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    both = side(chosen, "c").unionByName(side(rejected, "r")).filter("conv_id is not null")
    return format_pairs(both.groupBy("conv_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("t")))).alias(k) for k in "cr")))


def format_pairs(turns: DataFrame) -> DataFrame:
    """``preference_pairs`` of rows of ``conv_id`` and the ordered turns ``c`` and ``r`` of both sides; nothing is shuffled."""
    most = F.least(F.size("c"), F.size("r"))
    differs = lambda i: ~(F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"]))
    first = F.get(F.filter(F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>")), differs), F.lit(0))
    turns = turns.withColumn("n", F.coalesce(first, most))
    out = turns.select("conv_id", "n", F.slice("c", 1, F.col("n")).alias("p"), *(F.slice(k, F.col("n") + 1, F.size(k)).alias(k) for k in "cr"))
    c_text, c_mask = _completion(F.col("c"))
    r_text, r_mask = _completion(F.col("r"))
    return out.select(
        "conv_id", F.col("n").cast("long").alias("prompt_turns"), F.array_join(F.transform("p", _render), "").alias("prompt"),
        c_text.alias("chosen"), c_mask.alias("chosen_mask"), r_text.alias("rejected"), r_mask.alias("rejected_mask"),
    )


def made_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, c, r): the turns of both sides of every conversation that has an assistant turn, made from a
    table that has no preferences.

    Turns are in the order of turn, role and text, nulls first, so that repeated turns stay side by side. The
    sides part at the last assistant turn; what follows it stays on both sides, where no mask lets it through.
    Rejected has in its place the last answer, by turn and text, of the next answered conversation by
    ``conv_id``, after the last of which comes the first. A sole answered conversation has no other answer;
    its is left out. Rows of a null ``conv_id`` are left out. Other columns aren't read. No rows give no rows.
    """
    text = F.col("text").cast("string").alias("text")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text)
    rows = conversations.filter("conv_id is not null").withColumn("conv_id", F.col("conv_id").cast("long"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("c"))
    answers = rows.filter(F.col("role") == TRAINED).groupBy("conv_id").agg(F.max(F.struct(F.col("turn").cast("long").alias("turn"), text)).alias("other"))
    following = _next(answers.select("conv_id"))
    other = following.join(answers.withColumnRenamed("conv_id", "next"), "next").select("conv_id", F.when(F.col("next") != F.col("conv_id"), F.col("other")).alias("other"))
    at = F.size("c") - F.array_position(F.reverse(F.transform("c", lambda t: F.coalesce(t["role"] == TRAINED, F.lit(False)))), True).cast("int")
    parts = whole.join(other, "conv_id").withColumn("at", at)
    before, after = F.slice("c", 1, F.col("at")), F.slice("c", F.col("at") + 2, F.size("c"))
    worse = F.struct(F.get("c", F.col("at"))["turn"].alias("turn"), F.lit(TRAINED).alias("role"), F.col("other.text").alias("text"))
    return parts.select("conv_id", "c", F.when(F.col("other").isNull(), F.concat(before, after)).otherwise(F.concat(before, F.array(worse), after)).alias("r"))


def _next(ids: DataFrame) -> DataFrame:
    """(conv_id, next): the following one of the distinct ``ids``, and the least one after the greatest.

    Ids are ordered by ranges; only the first of each range is collected.
    """
    ranges = cut(ids.repartitionByRange("conv_id").select("conv_id", F.spark_partition_id().alias("part")))
    first = ranges.groupBy("part").agg(F.min("conv_id").alias("first")).orderBy("part").collect()
    after = [(r.part, first[(i + 1) % len(first)].first) for i, r in enumerate(first)]
    after = ids.sparkSession.createDataFrame(after, "part int, first long")
    inside = F.lead("conv_id").over(Window.partitionBy("part").orderBy("conv_id"))
    return ranges.withColumn("inside", inside).join(F.broadcast(after), "part").select("conv_id", F.coalesce("inside", "first").alias("next"))


def sql() -> str:
    def render(t: str) -> str:
        return f"('{OPEN}' || {t}.role || chr(10) || {t}.text || '<|im_end|>' || chr(10))"

    head = len(OPEN) + 1
    return f"""
WITH placed_turns AS (
  SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), answered AS (
  SELECT conv_id, max(place) AS at, arg_max(text, {{'turn': turn, 'text': text}}) AS answer FROM placed_turns WHERE role = '{TRAINED}' GROUP BY conv_id
), following AS (
  SELECT *, coalesce(lead(conv_id) OVER (ORDER BY conv_id), min(conv_id) OVER ()) AS next_id FROM answered
), others AS (SELECT f.conv_id, f.at, f.next_id, b.answer FROM following f JOIN answered b ON b.conv_id = f.next_id),
chosen AS (SELECT c.conv_id, c.place AS turn, c.role, c.text FROM placed_turns c JOIN answered USING (conv_id)),
rejected AS (
  SELECT c.conv_id, c.place AS turn, c.role, CASE WHEN c.place = o.at THEN o.answer ELSE c.text END AS text
  FROM placed_turns c JOIN others o USING (conv_id) WHERE c.place <> o.at OR o.next_id <> o.conv_id
), numbered AS (
  SELECT 'c' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM chosen
  UNION ALL
  SELECT 'r' AS side, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM rejected
), parted AS (
  SELECT conv_id, min(i) FILTER (WHERE n < 2 OR a_role <> b_role OR a_text <> b_text) AS first_i, max(i) AS last_i FROM (
    SELECT conv_id, i, count(*) AS n, min(role) AS a_role, max(role) AS b_role, min(text) AS a_text, max(text) AS b_text FROM numbered GROUP BY conv_id, i
  ) GROUP BY conv_id
), prefix AS (SELECT conv_id, coalesce(first_i - 1, last_i) AS n FROM parted),
placed AS (
  SELECT t.side, t.conv_id, t.i, t.role, {render("t")} AS r, p.n,
    coalesce(sum(length({render("t")})) OVER (PARTITION BY t.side, t.conv_id, t.i > p.n ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM numbered t JOIN prefix p USING (conv_id)
)
SELECT conv_id, max(n)::BIGINT AS prompt_turns,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'c' AND i <= n), '') AS prompt,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'c' AND i > n), '') AS chosen,
  coalesce(string_agg((pos + {head} + length(role))::VARCHAR || '-' || (pos + length(r) - 1)::VARCHAR, ',' ORDER BY i) FILTER (WHERE side = 'c' AND i > n AND role = '{TRAINED}'), '') AS chosen_mask,
  coalesce(string_agg(r, '' ORDER BY i) FILTER (WHERE side = 'r' AND i > n), '') AS rejected,
  coalesce(string_agg((pos + {head} + length(role))::VARCHAR || '-' || (pos + length(r) - 1)::VARCHAR, ',' ORDER BY i) FILTER (WHERE side = 'r' AND i > n AND role = '{TRAINED}'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
