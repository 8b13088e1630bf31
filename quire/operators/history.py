"""The history store: newest-first lists, retention, owner-checked lookup, merges and deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import or_default, truncate_mark, valid_document_id

# What the service keeps for a user and prunes in one save.
KEPT, PRUNED_AT_ONCE = 20, 50
UNINDEXED_SPARE = 200  # rows that are read besides where the store has no index


def ranked(rows: DataFrame) -> DataFrame:
    """rank of each row among its owner's, newest first; rows without a time are not in the order."""
    newest = Window.partitionBy("uid").orderBy(F.col("timestamp").desc(), F.col("doc_id"))
    return rows.where(F.col("timestamp").isNotNull()).withColumn("rank", F.row_number().over(newest))


def recent(rows: DataFrame, limit: int = KEPT) -> DataFrame:
    """The newest rows of every owner. Spark prunes each task's groups to the limit before the shuffle."""
    return ranked(rows).where(F.col("rank") <= limit)


def recent_of(rows: DataFrame, uid: object, limit: int = KEPT, offset: int = 0) -> DataFrame:
    """One owner's page of rows, newest first; no owner, no rows."""
    mine = rows.where((F.col("uid") == F.lit(uid)) & F.col("timestamp").isNotNull())
    return mine.orderBy(F.col("timestamp").desc(), "doc_id").offset(offset).limit(limit)


def surplus(rows: DataFrame, kept: int = KEPT, at_once: int = PRUNED_AT_ONCE) -> DataFrame:
    """Keys of the rows that a save would prune: those behind the kept ones, so many at once."""
    return ranked(rows).where(F.col("rank").between(kept + 1, kept + at_once)).select("doc_id")


def retained(rows: DataFrame, kept: int = KEPT, at_once: int = PRUNED_AT_ONCE) -> DataFrame:
    """What is left after one save's pruning. Rows without a time stay; they are never ranked."""
    return rows.join(surplus(rows, kept, at_once), "doc_id", "left_anti")


def owned_item(rows: DataFrame, doc_id: str, uid: object | DataFrame) -> DataFrame:
    """The row of an id if it is a valid id and the row is the owner's. The id is cast to the column's type, not the column to text, so the scan filters by it.

    uid is a value, or a table of one row and one column.
    """
    typed = F.lit(doc_id).try_cast(rows.schema["doc_id"].dataType)
    mine = rows.where(valid_document_id(F.lit(doc_id)) & (typed.cast("string") == doc_id) & (F.col("doc_id") == typed))
    if isinstance(uid, DataFrame):
        return mine.join(uid.toDF("uid"), "uid", "left_semi")
    return mine.where(F.col("uid") == F.lit(uid))


def listed(rows: DataFrame) -> DataFrame:
    """The list's columns with their defaults."""
    return rows.select("doc_id", or_default(F.col("fileName"), "").alias("fileName"), or_default(F.col("ocrType"), "convert").alias("ocrType"), F.col("timestamp"), F.coalesce(F.col("truncated"), F.lit(False)).alias("truncated"))


def saved(rows: DataFrame, new: DataFrame, most: int) -> DataFrame:
    """Appends results of signed-in owners, cut to the stored length; guests' and empty ones are not stored."""
    ok = new.where((F.coalesce(F.col("uid").cast("string"), F.lit("")) != "") & (F.coalesce(F.trim("result"), F.lit("")) != ""))
    cut = ok.withColumns({"truncated": F.length("result") > most, "result": truncate_mark(F.col("result"), most)})
    return rows.unionByName(cut.select(rows.columns))


def merged(rows: DataFrame, patches: DataFrame, key: str, listed: list[str] | None = None) -> DataFrame:
    """Writes the patches' fields over the rows of equal key; new keys are added. Fields that the patch lacks stay.

    The listed fields are written as they are, null too; without a list, fields that are null in the patch stay.
    """
    own, new = rows.alias("r"), patches.withColumn("_in", F.lit(True)).alias("p")

    def field(c: str) -> Column:
        if c not in patches.columns:
            return F.col(f"r.{c}")
        if c != key and listed is not None:
            return F.when(F.col("p._in"), F.col(f"p.{c}")).otherwise(F.col(f"r.{c}")) if c in listed else F.col(f"r.{c}")
        return F.coalesce(f"p.{c}", f"r.{c}")

    return own.join(new, F.col(f"r.{key}") == F.col(f"p.{key}"), "full_outer").select(*(field(c).alias(c) for c in rows.columns))


def deleted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't listed; keys that aren't there are no error."""
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def upserted_profiles(profiles: DataFrame, logins: DataFrame) -> DataFrame:
    """createdAt is set once, lastLogin always, e-mail and displayName as the latest login has them, empty where it has none."""
    p, at = profiles.alias("p"), F.max_by(F.struct(F.coalesce("email", F.lit("")).alias("email"), F.coalesce("displayName", F.lit("")).alias("displayName")), "at")
    latest = logins.groupBy("uid").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), at.alias("as")).alias("l")
    return p.join(latest, F.col("p.uid") == F.col("l.uid"), "full_outer").select(
        F.coalesce("p.uid", "l.uid").alias("uid"), F.coalesce("l.as.email", "p.email").alias("email"), F.coalesce("l.as.displayName", "p.displayName").alias("displayName"),
        F.coalesce("p.createdAt", "l.first_at").alias("createdAt"), F.coalesce("l.last_at", "p.lastLogin").alias("lastLogin"),
    )


def unindexed_surplus(rows: DataFrame, uid: object, kept: int = KEPT, at_once: int = PRUNED_AT_ONCE, spare: int = UNINDEXED_SPARE) -> DataFrame:
    """What surplus() gives where the store can't sort: of the owner's first rows by id, so many at most, those behind the kept ones by the text of their time, missing ones last."""
    mine = rows.where(F.col("uid") == F.lit(uid)).orderBy("doc_id").limit(kept + at_once + spare)
    order = F.coalesce(F.col("timestamp").cast("string"), F.lit("")).desc()
    return mine.orderBy(order, "doc_id").offset(kept).limit(at_once).select("doc_id")


ID_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"  # fixed value


def with_document_ids(rows: DataFrame, seed: int | None = None) -> DataFrame:
    """rows with an id of twenty letters and digits each, random ones or, with a seed, those of the row's place."""
    letter = lambda k: F.substr(F.lit(ID_ALPHABET), F.floor(F.rand(None if seed is None else seed + k) * len(ID_ALPHABET)).cast("int") + 1, F.lit(1))
    return rows.withColumn("doc_id", F.concat(*(letter(k) for k in range(20))))


def guest_entries(entries: DataFrame, kept: int = KEPT) -> DataFrame:
    """Each guest's list as one array, newest first, no longer than the cap."""
    newest = F.sort_array(F.collect_list(F.struct("at", "doc_id")), asc=False)
    return recent(entries.withColumn("timestamp", F.col("at")), kept).groupBy("uid").agg(newest.alias("entries"))


def guest_added(lists: DataFrame, new: DataFrame, kept: int = KEPT) -> DataFrame:
    """(uid, entries) with a new entry (uid, at, doc_id) of a guest in front; what is then over the cap falls out."""
    both = lists.join(new.select("uid", F.struct("at", "doc_id").alias("entry")), "uid", "full_outer")
    front = F.filter(F.array("entry"), lambda e: e.isNotNull())
    return both.select("uid", F.slice(F.concat(front, F.coalesce("entries", F.array())), 1, kept).alias("entries"))


def guest_removed(lists: DataFrame, place: Column | int) -> DataFrame:
    """(uid, entries) without the entry at a place from 0; a place that isn't there removes nothing."""
    place = F.lit(place) if isinstance(place, int) else place
    return lists.withColumn("entries", F.filter("entries", lambda e, k: k != place))


def guest_cleared(lists: DataFrame, uids: DataFrame) -> DataFrame:
    """(uid, entries), empty for the guests of uids."""
    gone = lists.join(uids.select("uid").distinct().withColumn("_gone", F.lit(True)), "uid", "left")
    return gone.select("uid", F.filter("entries", lambda _: F.col("_gone").isNull()).alias("entries"))
