"""Idempotent changes of tables, each a function from frames to the new frame. Writing it is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import ranks


def sorted_side(df: DataFrame) -> DataFrame:
    """df as a side that isn't broadcast: files of keys in order, or of repeated texts, are a few MB, and what they hold isn't."""
    return df.hint("merge")


def insert_ignore(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """old and the first row, by order (null first), of each key of new that old lacks."""
    first = new.groupBy(key).agg(F.min_by(F.struct(*new.columns), F.struct(order)).alias("r")).select("r.*")
    return old.unionByName(first.join(sorted_side(old.select(key)), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, updated: list[str], stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """Rows of both by key; where both have one, old's with the columns named in updated from new. stamp: a column that such a change sets to now."""
    a, b = old.select(F.struct(*old.columns).alias("o"), F.col(key)), new.select(F.struct(*new.columns).alias("n"), F.col(key))
    both = a.join(sorted_side(b), key, "full")
    pick = lambda c: F.when(F.col("o").isNull(), F.col(f"n.{c}")).when(F.col("n").isNull() | F.lit(c not in updated), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    changed = F.col("o").isNotNull() & F.col("n").isNotNull()
    return both.select(*[F.col(key) if c == key else F.when(changed, now).otherwise(pick(c)).alias(c) if c == stamp else pick(c).alias(c) for c in old.columns])


def partial_update(old: DataFrame, changes: DataFrame, key: str, stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """old with those values of changes that aren't null; null keeps what is there. stamp: a column that any change of a row sets to now."""
    changed = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"new_{c}") for c in changed], F.lit(True).alias("is_changed"))
    pick = lambda c: F.when(F.col("is_changed"), now).otherwise(F.col(c)).alias(c) if c == stamp else F.coalesce(f"new_{c}", c).alias(c) if c in changed else F.col(c)
    return old.join(sorted_side(new), key, "left").select(*[pick(c) for c in old.columns])


def mark_complete(old: DataFrame, keys: DataFrame, key: str, stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """old with the rows named by keys processed. Their error isn't cleared: what isn't given is kept."""
    return partial_update(old, keys.select(key, F.lit(True).alias("is_processed"), F.lit(None).cast("string").alias("last_error")), key, stamp, now)


def reset_state(old: DataFrame, keys: DataFrame, key: str, stamp: str | None = None, now: Column | None = None) -> DataFrame:
    """old with the rows named by keys as before their first page; their error isn't cleared either."""
    return partial_update(old, keys.select(key, F.lit(0).cast("long").alias("current_page"), F.lit(False).alias("is_processed"), F.lit(None).cast("string").alias("last_error")), key, stamp, now)


def append_new(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target and the rows whose keys it lacks, of its columns (null where rows have none). Run again it adds nothing."""
    shaped = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in target.dtypes])
    return target.unionByName(shaped.join(sorted_side(target.select(*keys)), keys, "left_anti"))


def resolve_or_create(dimension: DataFrame, wanted: DataFrame, key: str, name: str, position: str) -> DataFrame:
    """id, key, name of the dimension with a row for each missing key; of several names the last by position counts.

    New ids follow the largest, in order of key. Keys are numbered by ranges of them, so that no task numbers them all.
    """
    missing = wanted.groupBy(key).agg(F.max_by(name, position).alias(name)).join(sorted_side(dimension.select(key)), key, "left_anti")
    places = ranks.positions(missing.where(F.col(key).isNotNull()).select(F.lit(1).alias("one"), F.col(key).alias("value"), F.lit(1).cast("long").alias("n")), ["one"])
    top = dimension.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    numbered = missing.join(sorted_side(places.select(F.col("value").alias(key), (F.col("before") + 1).alias("nth"))), key).crossJoin(F.broadcast(top))  # one row
    return dimension.select("id", key, name).unionByName(numbered.select((F.col("top") + F.col("nth")).alias("id"), key, name))


def upsert_with_handles(dimension: DataFrame, wanted: DataFrame, key: str, name: str, handles: str, position: str) -> DataFrame:
    """id, key, name, handles (map<string, array<string>>) of the dimension after wanted (key, name, handles, position).

    A key that isn't there gets the next id. Of a key that wanted has, the name becomes its last by position, and each
    platform's handles are those of all its rows and of the dimension, sorted, each once. Other keys stay as they are; rows
    of wanted without key don't count. Handles are made distinct before those of a key meet.
    """
    wanted = wanted.where(F.col(key).isNotNull())
    last = wanted.groupBy(key).agg(F.max_by(F.struct(F.col(name).alias("x")), position).alias("last"))
    ids = resolve_or_create(dimension, wanted, key, name, position)
    rows = dimension.join(sorted_side(last.select(key)), key, "left_semi").select(key, handles).unionByName(wanted.select(key, handles))
    each = rows.select(key, F.explode(handles).alias("platform", "own")).select(key, "platform", F.explode_outer("own").alias("handle")).distinct()
    lists = each.groupBy(key, "platform").agg(F.array_sort(F.collect_set("handle")).alias("own"))
    merged = lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("platform", "own")))).alias("merged"))
    out = ids.join(sorted_side(last), key, "left").join(sorted_side(merged), key, "left").join(sorted_side(dimension.select(key, F.col(handles).alias("before"))), key, "left")
    none = F.create_map().cast("map<string, array<string>>")
    known = F.coalesce("before", none)
    return out.select("id", key, F.when(F.col("last").isNotNull(), F.col("last.x")).otherwise(F.col(name)).alias(name), F.when(F.col("last").isNotNull(), F.coalesce("merged", none)).otherwise(known).alias(handles))


def merge_handles(old: Column, new: Column) -> Column:
    """Maps of lists, joined by key; lists without repeats, sorted."""
    empty = F.array().cast("array<string>")
    return F.map_zip_with(old, new, lambda _, a, b: F.array_sort(F.array_union(F.coalesce(a, empty), F.coalesce(b, empty))))


def scrape_update(queue: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """queue (id, content, social_data, outlet_id, scraped, last_at, retry, error) after outcomes (id, ok, text, social, outlet, message).

    Success sets what was found and resets the tries; failure counts one more and keeps the beginning of its message. A
    rate limit is neither: the row stays as it was, and is tried again.
    """
    both = queue.join(sorted_side(outcomes), "id", "left")
    ok = F.coalesce("ok", F.lit(False))
    limited = F.coalesce(~ok & (X.error_class(F.col("message"))["code"] == X.RATE_LIMITED), F.lit(False))
    failed = F.col("ok").isNotNull() & ~ok & ~limited
    on = lambda column, found, lost: F.when(ok, found).when(failed, lost).otherwise(F.col(column)).alias(column)
    return both.select(
        "id", on("content", F.coalesce("text", F.lit("")), F.col("content")), on("social_data", F.coalesce("social", F.lit("{}")), F.col("social_data")), on("outlet_id", F.col("outlet"), F.col("outlet_id")),
        on("scraped", F.lit(True), F.col("scraped")), on("last_at", now, now), on("retry", F.lit(0), F.col("retry") + 1).cast("int").alias("retry"),
        on("error", F.lit(None).cast("string"), X.shortened(F.coalesce("message", F.lit("Unknown error")))),
    )


def repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The rows that aren't the first of their key by order, with nth (from 2): what delete_repeats takes away.

    Places are counted over ranges of (key, order), so a key that very many rows have is many tasks. Rows that have both in
    common follow each other in any order; a null order comes first.
    """
    rows = rows.where(F.col(key).isNotNull())
    counts = rows.groupBy(F.col(key).alias("key"), F.col(order).alias("value")).agg(F.count("*").alias("n"))
    placed = ranks.positions(counts, ["key"]).select("key", "value", "before")
    found = rows.join(sorted_side(placed), (rows[key] == placed["key"]) & rows[order].eqNullSafe(placed["value"]))
    nth = F.col("before") + F.row_number().over(Window.partitionBy(key, order).orderBy(F.lit(1)))
    return found.select(*[rows[c] for c in rows.columns], nth.cast("int").alias("nth")).where("nth > 1")


def delete_repeats(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows but for all of a key that aren't its first by order; rows without key stay."""
    first = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return rows.join(sorted_side(first), key, "left").where(F.col(key).isNull() | (F.col(order) == F.col("first"))).drop("first")


def clean_repeats(rows: DataFrame, key: str, order: str, backup: str, dry_run: bool = True) -> DataFrame:
    """delete_repeats, after what goes was written to the folder backup as CSV. A dry run writes the backup and returns rows."""
    repeats(rows, key, order).write.mode("errorifexists").option("header", True).csv(backup)
    return rows if dry_run else delete_repeats(rows, key, order)
