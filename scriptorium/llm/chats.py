"""Conversations rebuilt from message rows by one operator: sort, split at pauses, number, judge roles.

``sessions`` sorts the rows of a channel, splits them at pauses longer than a calibrated gap and
numbers them. ``sessionize`` uses it for plain message streams; ``conversations`` uses it where a
turn table declares the sessions and their order, so that there is no pause to split at. Channels
may be huge: rows are range-partitioned over (channel, order), each partition is worked on alone,
and what crosses its edges comes from one small row a partition and channel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut

# Spellings of the two roles after trimming and lower-casing.
USER = ("user", "human", "customer", "prompter")
ASSISTANT = ("assistant", "ai", "model", "bot", "gpt", "chatbot")
#: A character that shows: no space, control, format or filler character.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\x{34f}\x{115f}\x{1160}\x{3164}\x{ffa0}\x{2800}\x{fe00}-\x{fe0f}]"


def role_of(spelling: Column) -> Column:
    """user, assistant, or null where the spelling can't be read."""
    word = F.lower(F.regexp_replace(spelling, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(word.isin(*USER), "user").when(word.isin(*ASSISTANT), "assistant")


def sessions(rows: DataFrame, channel: str, order: list[str], ts: str | None = None, gap: DataFrame | None = None) -> DataFrame:
    """``rows`` with session_no and ord: their session inside the channel and their place in the session, both from 1.

    ``order`` sorts a channel's rows totally. With ``ts`` (a timestamp that ``order`` begins with) and
    ``gap``, one row (gap_s), a session ends where a pause is longer; a null gap never splits. Also
    gives the row before and after, where they are of the same session: before and after, structs of
    all columns of ``rows``. No channel is ever gathered in one task.
    """
    row = F.struct(*(F.col(c) for c in rows.columns))
    key = F.struct(*(F.col(c) for c in order))
    placed = cut(rows.repartitionByRange(F.col(channel), *(F.col(c) for c in order)).withColumn("_part", F.spark_partition_id()))
    edges = placed.groupBy(channel, "_part").agg(F.min_by(row, key).alias("first"), F.max_by(row, key).alias("last"))
    by_part = Window.partitionBy(channel).orderBy("_part")
    edges = edges.select(F.col(channel).alias("_c"), F.col("_part").alias("_p"), F.lag("last").over(by_part).alias("_last"), F.lead("first").over(by_part).alias("_first"))
    inside = Window.partitionBy(channel, "_part").orderBy(*order)
    near = placed.withColumn("_row", row).withColumn("before", F.lag("_row").over(inside)).withColumn("after", F.lead("_row").over(inside)).drop("_row")
    near = near.join(edges, (F.col(channel) == F.col("_c")) & (F.col("_part") == F.col("_p")))
    near = near.withColumn("before", F.coalesce("before", "_last")).withColumn("after", F.coalesce("after", "_first")).drop("_last", "_first", "_c", "_p")
    if ts is None or gap is None:
        near = near.withColumn("_new", F.col("before").isNull().cast("int"))
    else:
        apart = lambda a, b: (F.unix_micros(b) - F.unix_micros(a)) / 1e6 > F.col("gap_s")
        near = near.crossJoin(F.broadcast(gap))
        starts, ends = (F.coalesce(x, F.lit(False)) for x in (apart(F.col(f"before.{ts}"), F.col(ts)), apart(F.col(ts), F.col(f"after.{ts}"))))
        near = near.withColumn("_new", (F.col("before").isNull() | starts).cast("int")).withColumn("after", F.when(~ends, F.col("after"))).drop("gap_s")
        near = near.withColumn("before", F.when(F.col("_new") == 0, F.col("before")))
    near = near.withColumn("_s", F.sum("_new").over(inside))
    earlier = lambda c: F.coalesce(F.sum(c).over(by_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begun = near.groupBy(channel, "_part").agg(F.sum("_new").alias("_n")).select(F.col(channel).alias("_c"), F.col("_part").alias("_p"), earlier("_n").alias("_before"))
    near = near.join(begun, (F.col(channel) == F.col("_c")) & (F.col("_part") == F.col("_p"))).withColumn("session_no", (F.col("_s") + F.col("_before")).cast("int")).drop("_c", "_p", "_s", "_before", "_new")
    of_session = Window.partitionBy(channel, "session_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = near.groupBy(channel, "session_no", "_part").agg(F.count("*").alias("_n"))
    held = held.select(F.col(channel).alias("_c"), F.col("session_no").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(of_session), F.lit(0)).alias("_before"))
    near = near.withColumn("_in", F.row_number().over(Window.partitionBy(channel, "session_no", "_part").orderBy(*order)))
    near = near.join(held, (F.col(channel) == F.col("_c")) & (F.col("session_no") == F.col("_s")) & (F.col("_part") == F.col("_p")))
    return near.withColumn("ord", (F.col("_in") + F.col("_before")).cast("int")).drop("_c", "_s", "_p", "_in", "_before", "_part")


def conversations(turns: DataFrame, messages: DataFrame) -> DataFrame:
    """Every message (session, ord, message_id, role) of every whole session, in order.

    ``turns``: id, session, sequence, cancelled; ``messages``: id, session, turn, role, body.
    Re-delivered ids count once. Cancelled turns and their messages are left out first. A session is
    dropped if no turn remains, if a remaining turn has no user or no assistant message with visible
    text, a second message of a role or one of unreadable role, if a message of one of its turns
    names another session, or if a message names the session but a turn that does not exist. Turns
    with a null session or id belong to no session; a null turn of a message is a turn that does
    not exist. Messages are reduced to one row a turn, with partial aggregation, before any join. A
    message of unreadable role counts against its session, so that no role is inferred here from the
    turn-taking, as ``sessionize`` does.
    """
    turns = turns.where(F.col("id").isNotNull()).groupBy("id").agg(*(F.first(c).alias(c) for c in ("session", "sequence", "cancelled")))
    shown = F.coalesce(F.col("body").rlike(VISIBLE), F.lit(False))
    m = messages.where(F.col("id").isNotNull()).select("id", F.col("session").alias("named"), "turn", role_of(F.col("role")).alias("kind"), shown.alias("shown"))
    m = m.groupBy("id").agg(*(F.first(c).alias(c) for c in ("named", "turn", "kind", "shown")))
    is_user, is_answer = (F.col("kind") == k for k in ("user", "assistant"))
    count = lambda c: F.count(F.when(c, 1))
    a_pair = m.groupBy("turn", "named").agg(
        count(is_user).alias("users"), count(is_answer).alias("answers"), count(F.col("kind").isNull()).alias("unread"), count(is_user & F.col("shown")).alias("shown_users"),
        count(is_answer & F.col("shown")).alias("shown_answers"), F.min(F.when(is_user, F.col("id"))).alias("user_id"), F.min(F.when(is_answer, F.col("id"))).alias("answer_id"),
    )
    total = lambda c: F.sum(c).alias(c)
    a_turn = a_pair.groupBy("turn").agg(
        *(total(c) for c in ("users", "answers", "unread", "shown_users", "shown_answers")),
        F.min("user_id").alias("user_id"), F.min("answer_id").alias("answer_id"), F.min("named").alias("lo"), F.max("named").alias("hi"),
    )
    live = turns.where((F.coalesce("cancelled", F.lit(0)) == 0) & F.col("session").isNotNull())
    joined = live.join(a_turn, live["id"] == a_turn["turn"], "left")
    whole = (F.col("users") == 1) & (F.col("answers") == 1) & (F.col("unread") == 0) & (F.col("shown_users") == 1) & (F.col("shown_answers") == 1)
    own = F.col("lo").isNull() | ((F.col("lo") == F.col("session")) & (F.col("hi") == F.col("session")))
    judged = joined.select("session", "sequence", "user_id", "answer_id", F.coalesce(whole & own, F.lit(False)).alias("good"))
    astray = a_pair.select("turn", "named").where(F.col("named").isNotNull()).join(turns.select(F.col("id").alias("turn")), "turn", "left_anti").select(F.col("named").alias("session")).distinct()
    kept = judged.groupBy("session").agg(F.min("good").alias("good")).where("good").join(astray, "session", "left_anti").select("session")
    declared = judged.join(kept, "session", "left_semi").select("session", "sequence", "user_id", "answer_id")
    numbered = sessions(declared, "session", ["sequence", "user_id"]).select("session", "user_id", "answer_id", F.col("ord").alias("turn_no"))
    row = lambda k, who, c: F.struct((F.col("turn_no") * 2 - k).alias("ord"), F.col(c).alias("message_id"), F.lit(who).alias("role"))
    out = numbered.select("session", F.explode(F.array(row(1, "user", "user_id"), row(0, "assistant", "answer_id"))).alias("m"))
    return out.select("session", F.col("m.ord").cast("int").alias("ord"), "m.message_id", "m.role")


def calibrated_gap(messages: DataFrame, channel: str = "channel", ts: str = "ts") -> DataFrame:
    """One row (gap_s): the pause that best parts the short pauses of a stream from its long ones.

    Pauses inside channels are counted in steps of a quarter octave; of all cuts between two steps the
    one with the greatest variance between its two sides is taken (Otsu's threshold), the lowest of
    equal ones, and the gap is its upper edge. Null if all pauses are of one step. The counts are a few
    hundred rows, whatever the number of messages.
    """
    order = [ts, "id"]
    placed = sessions(messages.select(channel, ts, "id"), channel, order)
    pause = (F.unix_micros(ts) - F.unix_micros(F.col(f"before.{ts}"))) / 1e6
    steps = placed.where("before is not null").select(F.floor(F.round(4 * F.log2(1 + F.greatest(pause, F.lit(0.0))), 9)).alias("b")).groupBy("b").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(F.lit(0)).orderBy("b")
    whole = Window.partitionBy(F.lit(0))
    c = steps.select("b", F.sum("n").over(upto).alias("w0"), F.sum(F.col("n") * F.col("b")).over(upto).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("b")).over(whole).alias("s"))
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))
    c = c.where("w0 < w").select("b", (F.col("w0").cast("double") * (F.col("w") - F.col("w0")).cast("double") * apart * apart).alias("v"))
    return c.agg((F.pow(F.lit(2.0), (F.max_by("b", F.struct(F.round("v", 6), -F.col("b"))) + 1) / 4) - 1).alias("gap_s"))


def sessionize(messages: DataFrame, gap: DataFrame | None = None) -> DataFrame:
    """``messages`` (channel, ts, id, role) cut into sessions where a channel pauses longer than the gap.

    Gives (channel, session_no, ord, id, role) for sessions in which both roles speak; the others
    are dropped. The gap is calibrated on the messages if none is given. Roles come from their
    spelling; an unreadable one is inferred from the turn-taking: the opposite of its neighbours in
    the session if they agree or only one is known, else it stays null. Null channels and timestamps
    take no part, ties in ts go by id, and of re-delivered ids the earliest row counts.
    """
    m = messages.where(F.col("channel").isNotNull() & F.col("ts").isNotNull() & F.col("id").isNotNull()).groupBy("channel", "id").agg(F.min(F.struct("ts", "role")).alias("x"))
    m = m.select("channel", "x.ts", "id", role_of(F.col("x.role")).alias("kind"))
    cutting = calibrated_gap(m) if gap is None else gap
    rows = sessions(m, "channel", ["ts", "id"], "ts", cutting)
    a, b = F.col("before.kind"), F.col("after.kind")
    other = lambda c: F.when(c == "user", "assistant").when(c == "assistant", "user")
    inferred = F.when(a.isNotNull() & b.isNotNull() & (a != b), F.lit(None)).otherwise(other(F.coalesce(a, b)))
    rows = rows.select("channel", "session_no", "ord", "id", F.coalesce("kind", inferred).alias("role"))
    both = rows.groupBy("channel", "session_no").agg(F.max(F.col("role") == "user").alias("u"), F.max(F.col("role") == "assistant").alias("v")).where("u and v").select("channel", "session_no")
    return rows.join(both, ["channel", "session_no"], "left_semi")
