"""Rebuilding conversations from message rows, and dropping the broken ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corroborate.session import cut

#: Seqs of one conversation are dealt into segments of this many, so that no window or group holds more than a
#: segment of a conversation, however long it is.
SEGMENT = 4096


def speaker_of(party: Column) -> Column:
    return F.when(F.lower(F.trim(_spaces(party))) == "victim", "victim").otherwise("operator")


def _spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", " ")


def _blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(r"(?U)\S")


def rebuild(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(group_name, chat_id, turn, msg_id, speaker) of every turn of every whole conversation.

    A conversation is (group_name, chat_id). Its rows pass a finite-state automaton in the order of seq:

        state = (next seq due, roles heard), start (0, none); a row at the seq due moves on, and a turn adds its
        role; a gap, two different turns at one seq, or a turn without a party lead to `broken`, which is final;
        the end is accepted in states that have heard both roles.

    The automaton's transition over any stretch of seqs composes: (first seq, last seq, seqs seen, roles heard,
    broken). Stretches are summed up per segment of `segment` seqs, then per conversation, so a conversation that
    holds a third of all rows is neither sorted in one task nor collected. Turn numbers are the turns of earlier
    segments plus the rank within the segment.

    Rows of a seq with the same content and speaker are one turn under the smallest msg_id; it is without a party
    if any of them is. Null or blank content makes no turn, but its seq is there. A null group_name or chat_id is
    a key like others. A row with a null or negative seq breaks its conversation. An empty table gives no rows.
    """
    key = ["group_name", "chat_id"]
    rows = messages.select(
        *[F.coalesce(F.concat(F.lit("="), F.col(k)), F.lit("")).alias(k) for k in key],
        "seq",
        "msg_id",
        F.when(~_blank(F.col("content")), F.col("content")).alias("content"),
        speaker_of(F.col("party")).alias("speaker"),
        (_blank(F.col("party")) & ~_blank(F.col("content"))).alias("nameless"),
    ).withColumn("part", F.floor(F.coalesce(F.col("seq"), F.lit(-1)) / segment))
    # the turns of a seq, repeats made one; content is compared by two independent 64-bit hashes, so texts don't travel
    said = F.when(F.col("content").isNotNull(), F.struct(F.xxhash64("content").alias("a"), F.xxhash64(F.lit(1), "content").alias("b")))
    turns = (
        rows.withColumn("said", said)
        .groupBy(*key, "part", "seq", "said", "speaker")
        .agg(F.min("msg_id").alias("msg_id"), F.max("nameless").alias("nameless"))
    )
    spoken = F.col("said").isNotNull()
    role = F.when(spoken, F.when(F.col("speaker") == "victim", 1).otherwise(2)).otherwise(0)
    # seqs serve the verdict, the offsets and the turns, and are worked out once
    seqs = turns.groupBy(*key, "part", "seq").agg(
        F.count_if(spoken).alias("turns"),
        F.bit_or(role).alias("roles"),
        F.max("nameless").alias("nameless"),
        F.min(F.when(spoken, F.struct("msg_id", "speaker"))).alias("turn"),
    )
    seqs = cut(seqs)
    stretch = seqs.groupBy(*key, "part").agg(
        F.min("seq").alias("first"),
        F.max("seq").alias("last"),
        F.count("*").alias("seen"),
        F.bit_or("roles").alias("roles"),
        F.max((F.col("turns") > 1) | F.col("nameless") | F.col("seq").isNull()).alias("broken"),
        F.sum("turns").alias("turns"),
    )
    whole = (F.min("first") == 0) & (F.max("last") + 1 == F.sum("seen")) & (F.bit_or("roles") == 3) & ~F.max("broken")
    before = F.sum("turns").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    kept = stretch.groupBy(*key).agg(whole.alias("whole")).where("whole").drop("whole")
    offsets = stretch.select(*key, "part", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy(*key, "part").orderBy("seq"))
    return (
        seqs.where("turn is not null")
        .withColumn("rank", rank)
        .join(offsets, [*key, "part"])
        .join(kept, key)
        .select(
            *[F.when(F.col(k) != "", F.substr(F.col(k), F.lit(2))).alias(k) for k in key],
            (F.col("before") + F.col("rank")).cast("int").alias("turn"),
            F.col("turn.msg_id").alias("msg_id"),
            F.col("turn.speaker").alias("speaker"),
        )
    )


def transcripts(messages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(group_name, chat_id, part, n_turns, turns): whole conversations as ordered arrays of (turn, speaker,
    content), at most `segment` turns to a row, so that no array grows without bound."""
    turns = rebuild(messages, segment)
    text = messages.select("msg_id", "content").dropDuplicates(["msg_id"])
    item = F.struct("turn", "speaker", "content")
    return (
        turns.join(text, "msg_id")
        .groupBy("group_name", "chat_id", F.floor((F.col("turn") - 1) / segment).alias("part"))
        .agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(item)).alias("turns"))
    )
