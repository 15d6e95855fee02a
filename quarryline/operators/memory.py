"""Sessions, transcripts and episodic memory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarryline.functions.text import json_text, words
from quarryline.operators.models import json_field


def recent_turns(turns: DataFrame, n: int, *, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    last = Window.partitionBy(session).orderBy(F.desc(turn))
    return turns.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= n).drop("_n")


def speaker(role: Column) -> Column:
    return F.when(role == "user", "User: ").otherwise("Assistant: ")


def transcript(turns: DataFrame, *, session: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    line = F.concat(speaker(F.col(role)), F.coalesce(F.col(text), F.lit("")))
    said = F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l")))), lambda x: x["l"])
    return turns.groupBy(session).agg(F.array_join(said, "\n").alias("transcript"))


def overflowing(turns: DataFrame, limit: int = 10, *, session: str = "conv_id") -> DataFrame:
    return turns.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns")).withColumn("overflow", F.col("n_turns") > limit)


def rewrite_query(message: Column, n_turns: Column, rewritten: Column | None = None) -> tuple[Column, Column]:
    """(effective query, whether rewritten): a session without turns passes the message through."""
    has = F.coalesce(n_turns, F.lit(0)) > 0
    return F.when(has & F.lit(rewritten is not None), rewritten if rewritten is not None else message).otherwise(message), has & F.lit(rewritten is not None)


def episode_line(created: Column, tags: Column, summary: Column) -> Column:
    named = F.when(F.size(tags) > 0, F.array_join(tags, ", ")).otherwise("general")
    return F.concat(F.lit("["), F.date_format(created, "yyyy-MM-dd HH:mm"), F.lit(" | Topics: "), named, F.lit("] "), summary)


def recent_episodes(episodes: DataFrame, n: int = 5, *, user: str = "user_id", created: str = "created_at", tie: str = "session_id") -> DataFrame:
    last = Window.partitionBy(user).orderBy(F.desc(created), F.desc(tie))
    return episodes.withColumn("recency", F.row_number().over(last)).where(F.col("recency") <= n)


def summarise(transcript: Column) -> Column:
    """Stand-in for the model that compresses a session: its first 200 characters, and its longest words as tags, as JSON."""
    longest = F.slice(F.array_sort(F.array_distinct(words(F.lower(F.regexp_replace(transcript, "[^A-Za-z ]", " ")))), lambda a, b: F.length(b) - F.length(a)), 1, 3)
    return F.to_json(F.struct(F.substring(transcript, 1, 200).alias("summary"), longest.alias("topic_tags")))


def compress_sessions(turns: DataFrame, *, session: str = "session_id", user: str = "user_id", turn: str = "turn", role: str = "role", text: str = "text", created: str = "ts", model=summarise) -> DataFrame:
    """Episodes of whole sessions: user_id, session_id, summary, topic_tags, turn_count, created_at (the last turn's time)."""
    said = transcript(turns, session=session, turn=turn, role=role, text=text)
    about = turns.groupBy(session).agg(F.first(user).alias("user_id"), F.count(F.lit(1)).cast("int").alias("turn_count"), F.max(created).alias("created_at"))
    rows = about.join(said.withColumn("answer", model(F.col("transcript"))), session)
    tags = F.coalesce(F.try_variant_get(F.try_parse_json(json_text(F.col("answer"))), "$.topic_tags", "array<string>"), F.array().cast("array<string>"))
    return rows.select("user_id", F.col(session).alias("session_id"), json_field(F.col("answer"), "summary", "string", "").alias("summary"), tags.alias("topic_tags"), "turn_count", "created_at")


def save_episodes(episodes: DataFrame, folder: str, buckets: int = 64) -> None:
    """Append to the table of episodes, parted by user so that a user's are found in one folder."""
    part = F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int")
    episodes.withColumn("user_part", part).write.mode("append").partitionBy("user_part").parquet(folder)


def load_episodes(spark, folder: str, users: DataFrame | None = None, n: int = 5, buckets: int = 64) -> DataFrame:
    """The users' last episodes as lines; users are looked up in their parts alone."""
    rows = spark.read.parquet(folder)
    if users is not None:
        asked = users.select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(buckets)).cast("int").alias("user_part")).distinct()
        rows = rows.join(asked, ["user_id", "user_part"])
    last = recent_episodes(rows, n)
    return last.select("user_id", "recency", episode_line(F.col("created_at"), F.col("topic_tags"), F.col("summary")).alias("line"))


def add_turn(sessions: DataFrame, turns: DataFrame, *, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """Sessions with new turns behind the last; one whose session is new starts at 0."""
    last = sessions.groupBy(session).agg((F.max(turn) + 1).alias("__ql_next"))
    place = F.row_number().over(Window.partitionBy(session).orderBy(turn)) - 1
    new = turns.withColumn("__ql_place", place).join(last, session, "left").withColumn(turn, F.coalesce("__ql_next", F.lit(0)) + F.col("__ql_place"))
    return sessions.unionByName(new.select(*sessions.columns))
