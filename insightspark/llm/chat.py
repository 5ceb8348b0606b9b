"""Chat formatting from an event log: fold the events of each message, then render each conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from insightspark.llm.common import table_of

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Where a backslash is put: after a backslash, and after the first character of any control string.
_OPENERS = r"(\\|<(?=\||/?s>)|\[(?=/?INST\]))"
LEARNT = "assistant"
#: Messages joined in one task at first; the runs of a conversation are joined after that.
RUN = 256


def escaped(text: Column) -> Column:
    """Text in which no control string occurs; a backslash is added to it and to whatever would open one."""
    return F.regexp_replace(text, _OPENERS, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, seq, msg, role, text``: the final messages of ``events(conv_id, seq, msg, op, role, text)``.

    The events of a message are taken by ``seq`` (NULL first; ties by op, role and text). ``message``, ``edit``, ``regenerate``
    and any other op replace its text, ``delta`` adds to it; NULL text is empty. The role is the last one given, else
    empty. A message stands where its first event stands. Messages are the groups, so a conversation with very many
    rows is spread by message; a single message, however streamed, is one text in the end.
    """
    item = F.struct("seq", F.coalesce("op", F.lit("message")).alias("op"), "role", F.coalesce("text", F.lit("")).alias("text"))
    got = events.groupBy("conv_id", "msg").agg(F.sort_array(F.collect_list(item)).alias("log"))
    last = "coalesce(array_max(transform(log, (x, i) -> if(x.op = 'delta', null, i))), 0)"
    return got.withColumn("last", F.expr(last)).select(
        "conv_id", F.expr("log[0].seq").alias("seq"), "msg",
        F.expr("coalesce(aggregate(log, cast(null as string), (acc, x) -> coalesce(x.role, acc)), '')").alias("role"),
        F.expr("array_join(transform(slice(log, last + 1, size(log)), x -> x.text), '')").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss``: one text per conversation, and the spans ``start, end`` of its assistant texts in it.

    A turn is start mark, role, separator, text, end mark, with role and text escaped, so the marks stay unique and the
    turns can be read back exactly. Messages go by ``seq`` (NULL first), ties by role, text and ``msg``. Runs of messages
    are joined first and the runs of a conversation after that; NULL conversations are one conversation.
    """
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    turn = F.concat(F.lit(START), role, F.lit(SEP), text, F.lit(END))
    lead = F.length(role).cast("long") + len(START) + len(SEP)
    item = F.struct("seq", "role", "text", "msg", turn.alias("turn"), lead.alias("lead"), F.length(text).cast("long").alias("size"), (F.col("role") == LEARNT).alias("learnt"))
    spans = "array<struct<start:bigint,end:bigint>>"
    runs = messages.withColumn("run", F.floor(F.col("seq") / RUN)).groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(item)).alias("m"))
    runs = runs.withColumn("walk", F.expr(f"""aggregate(m, named_struct('at', 0L, 'loss', cast(array() as {spans})), (acc, x) -> named_struct(
        'at', acc.at + x.lead + x.size + {len(END)},
        'loss', if(x.learnt, array_append(acc.loss, named_struct('start', acc.at + x.lead, 'end', acc.at + x.lead + x.size)), acc.loss)))"""))
    runs = runs.select("conv_id", F.struct("run", F.expr("array_join(transform(m, x -> x.turn), '')").alias("piece"), F.col("walk.at").alias("size"), F.col("walk.loss").alias("loss")).alias("r"))
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    whole = whole.withColumn("walk", F.expr(f"""aggregate(r, named_struct('at', 0L, 'loss', cast(array() as {spans})), (acc, x) -> named_struct(
        'at', acc.at + x.size, 'loss', concat(acc.loss, transform(x.loss, s -> named_struct('start', s.start + acc.at, 'end', s.end + acc.at)))))"""))
    return whole.select("conv_id", F.expr("array_join(transform(r, x -> x.piece), '')").alias("formatted"), F.col("walk.loss").alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns ``role, text`` read back from a formatted conversation."""
    parts = F.split(formatted, r"<\|end\|>")
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda t: F.struct(
        unescaped(F.substring_index(F.substring(t, len(START) + 1, 2_147_483_647), SEP, 1)).alias("role"), unescaped(F.substring_index(t, SEP, -1)).alias("text")))


def learnt_text(formatted: str, loss: str) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(F.col(loss), lambda s: F.col(formatted).substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def turn_events(rows: DataFrame) -> DataFrame:
    """Turns of a table as events: every row is a message of its own."""
    return rows.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("msg"), F.lit("message").alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def op1_chat(spark, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select -1L as conv_id, i as turn, if(i = 0, 'user', '{LEARNT}') as role, '{said}' as text from (select explode(sequence(0L, 1L)) as i)")
    rows = table_of(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(extra)
    out = render(fold(turn_events(rows))).withColumn("turns", turns_of(F.col("formatted"))).withColumn("learnt", learnt_text("formatted", "loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
                      F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _added(column: str) -> str:
    """SQL for the backslashes that escaping adds."""
    return " + ".join(f"(length({column}) - length(replace({column}, '{x}', ''))) // {len(x)}" for x in ("\\", "<|", "<s>", "</s>", "[INST]", "[/INST]"))


SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       cast(sum(length(role) + length(text) + {len(START) + len(SEP) + len(END)} + {_added('role')} + {_added('text')}) as bigint) as formatted_chars
from rows group by conv_id
"""
