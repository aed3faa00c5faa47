"""Chat formatting by perspective rotation: every participant of a dialogue in turn is the assistant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the rendered dialogue.
SYSTEM, ASSISTANT, USER, END = "<|system|>\n", "<|assistant|>\n", "<|user name={}|>\n", "<|end|>\n"
#: Turns whose offsets are summed in one window; the windows' totals are summed in a second.
SPAN = 256


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """A row for each dialogue, perspective and turn.

    The participants are the distinct roles of a dialogue but ``system`` and null; each is a perspective. Seen from it,
    its own turns are the assistant's, the system's stay the system's, all others are a user's with the speaker's name
    (a null role is named ``unknown``). ``rendered`` is the turn with its markers; [start, end) is its place in the
    rendered dialogue, in code points; [loss_start, loss_end) is what training counts: the assistant's words and the end
    marker, null for other turns. A null text counts as empty. Turns with equal numbers stand in the order of role and
    text, nulls first; repeated rows stay. A dialogue without participants gives no row, a null dialogue id is a dialogue of its own.

    Offsets are prefix sums in two steps, over SPAN turn numbers and over such spans, so that a dialogue with very many
    turns is not one sort.
    """
    base = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("speaker"), F.coalesce(text, F.lit("")).alias("content"), F.col(text).alias("raw"))
    base = base.withColumn("span", F.floor(F.col("turn") / SPAN))
    people = base.where(F.col("speaker").isNotNull() & (F.col("speaker") != system)).select(F.col("conv_id").alias("of"), F.col("speaker").alias("perspective")).distinct()
    seen = base.join(people, base["conv_id"].eqNullSafe(people["of"])).drop("of")
    mine, rules = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False)), F.coalesce(F.col("speaker") == system, F.lit(False))
    before, after = USER.split("{}")
    head = F.when(mine, F.lit(ASSISTANT)).when(rules, F.lit(SYSTEM)).otherwise(F.concat(F.lit(before), F.coalesce("speaker", F.lit("unknown")), F.lit(after)))
    seen = seen.withColumn("chat_role", F.when(mine, F.lit("assistant")).when(rules, F.lit("system")).otherwise(F.lit("user")))
    seen = seen.withColumn("rendered", F.concat(head, "content", F.lit(END))).withColumn("size", F.length("rendered").cast("bigint")).withColumn("head", F.length(head).cast("bigint"))
    inside = Window.partitionBy("conv_id", "perspective", "span").orderBy(F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), F.col("raw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("c", "p").orderBy(F.col("s").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    spans = seen.groupBy(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("span").alias("s")).agg(F.sum("size").alias("total"), F.count("*").alias("rows"))
    spans = spans.select("c", "p", "s", F.coalesce(F.sum("total").over(over), F.lit(0)).alias("base"), F.coalesce(F.sum("rows").over(over), F.lit(0)).alias("rows_before"))
    seen = seen.withColumn("to", F.sum("size").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside))
    same = seen["conv_id"].eqNullSafe(spans["c"]) & (seen["perspective"] == spans["p"]) & seen["span"].eqNullSafe(spans["s"])
    placed = seen.join(spans, same).withColumn("end", F.col("base") + F.col("to"))
    start = F.col("end") - F.col("size")
    counts = F.col("chat_role") == "assistant"
    return placed.select(
        "conv_id", "perspective", (F.col("rows_before") + F.col("nth") - 1).alias("position"), "turn", "speaker", "chat_role", "rendered", start.alias("start"), "end",
        F.when(counts, start + F.col("head")).alias("loss_start"), F.when(counts, F.col("end")).alias("loss_end"),
    )


#: The same rows in SQL, over the table ``conversations``.
SQL = r"""
with people as (select distinct conv_id, role as perspective from conversations where role is not null and role <> 'system'),
seen as (
  select c.conv_id, p.perspective, c.turn, c.role as speaker, c.text as raw, coalesce(c.text, '') as content,
    case when c.role = p.perspective then 'assistant' when c.role = 'system' then 'system' else 'user' end as chat_role,
    case when c.role = p.perspective then '<|assistant|>' || chr(10) when c.role = 'system' then '<|system|>' || chr(10)
      else '<|user name=' || coalesce(c.role, 'unknown') || '|>' || chr(10) end as head
  from conversations c join people p on c.conv_id is not distinct from p.conv_id),
sized as (select *, head || content || '<|end|>' || chr(10) as rendered from seen),
placed as (
  select *, sum(length(rendered)) over w as upto, row_number() over w as nth
  from sized window w as (partition by conv_id, perspective order by turn nulls first, speaker nulls first, raw nulls first rows between unbounded preceding and current row))
select conv_id, perspective, cast(nth - 1 as bigint) as position, turn, speaker, chat_role, rendered,
  cast(upto - length(rendered) as bigint) as "start", cast(upto as bigint) as "end",
  case when chat_role = 'assistant' then cast(upto - length(rendered) + length(head) as bigint) end as loss_start,
  case when chat_role = 'assistant' then cast(upto as bigint) end as loss_end
from placed
"""
