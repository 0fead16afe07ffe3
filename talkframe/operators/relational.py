"""Queries over the service's tables: lookups, visibility, pages, joins and statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import space_word_count, words

#: Roles from the least to the most powerful, and the modes of a transcript.
ROLES = ("member", "admin", "superadmin")
MODES = ("general", "engineering", "office")
# What columns of requests may hold; packs are named in scopes.
ALLOWED = {
    "scope": ("personal", "team"), "role": ROLES, "mode": MODES, "output_format": ("prose", "code_comment", "pr_description", "jira_ticket"),
    "pack": ("office", "engineering"), "user_action": ("approved", "edited", "dismissed"),
}


def matching(df: DataFrame, **values: object) -> DataFrame:
    """Rows equal to all given values; None leaves its column free, a list asks for membership."""
    wanted = []
    for name, v in values.items():
        if v is None:
            continue
        wanted.append(F.col(name).isin(*v) if isinstance(v, (list, tuple, set, frozenset)) else F.col(name) == F.lit(v))
    return df.where(reduce(Column.__and__, wanted)) if wanted else df


def point(df: DataFrame, **key: object) -> DataFrame:
    """The row of a key, or none."""
    return matching(df, **key).limit(1)


def page(df: DataFrame, order_by: Sequence[Column], limit: int = 100, offset: int = 0) -> DataFrame:
    """``order_by`` should end in a key, so that pages do not overlap."""
    return df.orderBy(*order_by).offset(offset).limit(limit)


def history(transcripts: DataFrame, tenant: str, role: str, user: str, asked: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    """Newest first. Members see their own rows; who is an admin may ask for another user's or all."""
    if ROLES.index(role) < ROLES.index("admin"):
        if asked not in (None, user):
            raise PermissionError("only admins see another user's history")
        asked = user
    rows = matching(transcripts, tenant_id=tenant, user_id=asked)
    return page(rows, [F.desc("created_at"), F.desc("id")], limit, offset)


def visible_in_pipeline(entries: DataFrame, user: str, shared: Sequence[str] = ("team", "bundle")) -> DataFrame:
    """Entries that text processing uses: shared scopes and all of the user's own; longest trigger first."""
    rows = entries.where(F.col("scope").isin(*shared) | (F.col("user_id") == user))
    return rows.orderBy(F.desc(F.length("trigger")), "trigger")


def visible_to_user(entries: DataFrame, user: str, trigger: str = "trigger", personal_only: bool = True) -> DataFrame:
    """Entries that the settings show: the team's, and the user's own (personal ones only, for a dictionary)."""
    own = F.col("user_id") == user
    if personal_only:
        own &= F.col("scope") == "personal"
    return entries.where((F.col("scope") == "team") | own).orderBy("scope", trigger)


def search(df: DataFrame, text: Column, query: str) -> DataFrame:
    """Rows whose text holds the query in any case; wildcards have no meaning."""
    return df.where(F.contains(F.lower(text), F.lit(query.lower())))


def recorded(sentences: DataFrame, recordings: DataFrame, key: str = "id", foreign: str = "sentence_id") -> DataFrame:
    """Sentences with a recording, each once."""
    return sentences.join(recordings, sentences[key] == recordings[foreign], "left_semi")


def unrecorded(sentences: DataFrame, recordings: DataFrame, key: str = "id", foreign: str = "sentence_id") -> DataFrame:
    return sentences.join(recordings, sentences[key] == recordings[foreign], "left_anti")


def take_counts(sentences: DataFrame, recordings: DataFrame, key: str = "id", foreign: str = "sentence_id") -> DataFrame:
    """Sentences with take_count, zero included; takes are counted before the join."""
    counts = recordings.groupBy(F.col(foreign).alias("_key")).agg(F.count("*").alias("take_count"))
    joined = sentences.join(counts, F.col(key) == F.col("_key"), "left").drop("_key")
    return joined.withColumn("take_count", F.coalesce("take_count", F.lit(0)).cast("long"))


def with_recordings(sentences: DataFrame, recordings: DataFrame, fields: Sequence[str], key: str = "id", foreign: str = "sentence_id") -> DataFrame:
    """Recorded sentences with their recordings as an array, in the order of the fields."""
    nested = recordings.groupBy(F.col(foreign).alias("_key")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("recordings"))
    return sentences.join(nested, F.col(key) == F.col("_key")).drop("_key")


def pick_unrecorded(sentences: DataFrame, recordings: DataFrame, seed: int, key: str = "id", foreign: str = "sentence_id") -> DataFrame:
    """One sentence without a recording, or, where all have one, any: the first in the order of a digest of seed and key."""
    rest = take_counts(sentences, recordings, key, foreign)
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string")))
    return rest.orderBy(F.col("take_count") > 0, digest, key).limit(1).drop("take_count")


def usage(transcripts: DataFrame, group: Sequence[str] = (), text: str = "text", duration: str = "duration") -> DataFrame:
    """Number of transcripts, words (spaces plus one each) and mean duration, rounded to cents."""
    return transcripts.groupBy(*group).agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(space_word_count(F.col(text))), F.lit(0)).cast("long").alias("total_words"),
        F.coalesce(F.round(F.avg(duration), 2), F.lit(0.0)).alias("avg_duration"),
    )


def active_users(facts: DataFrame, as_of: Column, days: int = 7, user: str = "user_id", at: str = "created_at") -> DataFrame:
    """Distinct users with a row in the days before ``as_of``."""
    recent = facts.where(F.col(user).isNotNull() & (F.col(at) >= as_of - F.make_dt_interval(F.lit(days))))
    return recent.agg(F.countDistinct(user).alias("active_users"))


def active_users_each_day(facts: DataFrame, days: int = 7, user: str = "user_number", at: str = "created_at", by: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """by, day and active_users, the distinct users with a row on the day or the ``days`` - 1 before it, for each day up to the last one.

    ``user`` is a whole number, close to others: users are bits of a map. Each day's rows become
    maps once; a window's maps are joined bit by bit, so no user is counted again for every
    window. Users given by other keys are numbered first (``numbered_users``).
    """
    rows = facts.where(F.col(user).isNotNull()).select(*by, F.to_date(at).alias("day"), F.bitmap_bucket_number(user).alias("_bucket"), F.bitmap_bit_position(user).alias("_bit"))
    maps = rows.groupBy(*by, "day", "_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    last = maps.agg(F.max("day").alias("_last"))
    ends = maps.select(*by, "_bucket", "_map", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda i: F.date_add("day", i))).alias("day"))
    windows = ends.join(F.broadcast(last), F.col("day") <= F.col("_last")).groupBy(*by, "day", "_bucket").agg(F.bitmap_or_agg("_map").alias("_map"))
    return windows.groupBy(*by, "day").agg(F.sum(F.bitmap_count("_map")).alias("active_users"))


def numbered_users(facts: DataFrame, user: str = "user_id", into: str = "user_number") -> DataFrame:
    """``facts`` with each different user's number from 0; rows of no user have none."""
    from .datasets import numbered

    users = numbered(facts.where(F.col(user).isNotNull()).select(F.col(user).alias("_user")).distinct(), 0, "_user").withColumnRenamed("n", into)
    return facts.join(users, F.col(user) == F.col("_user"), "left").drop("_user")


def trailing_phrases(transcripts: DataFrame, tenant: str, newest: Sequence[Column], text: str = "text", last: int = 200, words_: int = 5, sizes: Sequence[int] = (2, 3, 4, 5), share: float = 0.15) -> DataFrame:
    """tenant, phrase, n and share: runs of words that end so many of a tenant's latest texts, as what is recognised in silence does.

    Of each tenant's ``last`` texts, the first in the order ``newest``, which should end in a key, the last ``words_`` words count; a
    phrase counts once a text. Spark keeps the first rows of each tenant before it exchanges any,
    so a tenant with many rows costs no more than ``last`` of them a task.
    """
    from ..functions.text import ngrams, words

    latest = transcripts.where(F.col(text).isNotNull()).withColumn("_rank", F.row_number().over(Window.partitionBy(tenant).orderBy(*newest))).where(F.col("_rank") <= last)
    said = words(F.lower(text))
    ending = latest.select(tenant, "_rank", F.slice(said, F.greatest(F.lit(1), F.size(said) - (words_ - 1)), F.lit(words_)).alias("_end"))
    grams = [F.transform(F.coalesce(ngrams(F.col("_end"), n), F.array().cast("array<array<string>>")), lambda g: F.array_join(g, " ")) for n in sizes]
    counted = ending.select(tenant, F.explode(F.array_distinct(F.concat(*grams))).alias("phrase")).groupBy(tenant, "phrase").agg(F.count("*").alias("n"))
    totals = latest.groupBy(tenant).agg(F.count("*").alias("_texts"))
    return counted.join(totals, tenant).where(F.col("n") >= share * F.col("_texts")).select(tenant, "phrase", "n", (F.col("n") / F.col("_texts")).alias("share"))


def mode_breakdown(transcripts: DataFrame, modes: Sequence[str] = MODES, mode: str = "mode") -> DataFrame:
    """Transcripts of every mode, zero included. A null mode counts as the first one."""
    spark = transcripts.sparkSession
    all_modes = spark.range(1).select(F.explode(F.array(*map(F.lit, modes))).alias("mode"))
    counts = transcripts.groupBy(F.coalesce(F.col(mode), F.lit(modes[0])).alias("mode")).agg(F.count("*").alias("n"))
    joined = all_modes.join(counts, "mode", "full")
    return joined.select("mode", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def tenant_stats(transcripts: DataFrame, users: DataFrame, tenant: str, as_of: Column) -> DataFrame:
    """One row: usage, active users, a map of mode to count, and the number of users.

    Transcripts are read once for all figures but the modes.
    """
    own = matching(transcripts, tenant_id=tenant)
    recent = F.col("created_at") >= as_of - F.expr("INTERVAL 7 DAYS")
    figures = own.agg(
        F.count("*").alias("total"),
        F.coalesce(F.sum(space_word_count(F.col("text"))), F.lit(0)).cast("long").alias("total_words"),
        F.coalesce(F.round(F.avg("duration"), 2), F.lit(0.0)).alias("avg_duration"),
        F.countDistinct(F.when(recent, F.col("user_id"))).alias("active_users"),
    )
    modes = mode_breakdown(own).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("mode", "n")))).alias("modes"))
    people = matching(users, tenant_id=tenant).agg(F.count("*").alias("total_users"))
    return figures.crossJoin(modes).crossJoin(people)  # three tables of one row


def context_status(symbols: DataFrame, user: str) -> DataFrame:
    return matching(symbols, user_id=user).agg(F.count("*").alias("symbols"), F.max("indexed_at").alias("last_indexed"))


def projects(symbols: DataFrame, user: str) -> DataFrame:
    """Symbols of each project, and a last row with a null project for all of them."""
    return matching(symbols, user_id=user).rollup("project_path").agg(F.count("*").alias("symbols"))


def first_of_each(df: DataFrame, keys: Sequence[Column | str], order_by: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def running_best(rounds: DataFrame, order_by: str, value: str, group: Sequence[str] = ()) -> DataFrame:
    """The least value so far, whether the round improved on it, and by how many percent.

    Rounds are few; without a group they are ordered in one task.
    """
    w = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order_by)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    best = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    better = before.isNull() | (F.col(value) < before)
    percent = F.when(before.isNotNull(), (before - F.col(value)) / before * 100)
    return rounds.withColumns({"best": best, "improved": better, "improvement_pct": percent})


def feedback(rows: DataFrame) -> DataFrame:
    """Feedback rows with ``error``: null if the row may be stored.

    raw_whisper and model_output are required; the action is approved, edited or dismissed.
    """
    missing = F.col("raw_whisper").isNull() | F.col("model_output").isNull() | F.col("user_action").isNull()
    wrong = ~F.col("user_action").isin(*ALLOWED["user_action"])
    return rows.withColumn("error", F.when(missing, "missing field").when(wrong, "unknown action"))


def guarded(rows: DataFrame, *columns: str, allowed: Mapping[str, Sequence[str]] = ALLOWED) -> DataFrame:
    """Rows with ``errors``, an array of those of the columns that hold a value that they may not; null is no value.

    Without names all columns are looked at that have a list.
    """
    checked = columns or [c for c in rows.columns if c in allowed]
    wrong = [F.when(~F.col(c).isin(*allowed[c]), F.lit(c)) for c in checked]
    return rows.withColumn("errors", F.array_compact(F.array(*wrong)) if wrong else F.array().cast("array<string>"))


def looked_up(rows: DataFrame, cache: DataFrame, column: str = "text", key: str = "text", value: str = "value") -> DataFrame:
    """Rows in which a text that is in the cache is replaced by what the cache has for it; others stay.

    The join is on equal texts: a short cache is broadcast, a long one exchanged. A key that is
    there more than once gives its largest value.
    """
    known = cache.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias("_value"))
    joined = rows.join(known, F.col(column) == F.col("_key"), "left")
    return joined.withColumn(column, F.coalesce("_value", F.col(column))).drop("_key", "_value")


def edited_words(feedback_rows: DataFrame, least: int = 2, before: str = "model_output", after: str = "user_edit") -> DataFrame:
    """word and n: words that users' edits added, in so many edits or more; in each edit a word counts once."""
    edits = feedback_rows.where(F.col("user_action") == "edited")
    added = F.array_except(words(F.lower(after)), F.coalesce(words(F.lower(before)), F.array().cast("array<string>")))
    return edits.select(F.explode(added).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
