"""Dedup, incremental merges and listing joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import first_non_empty, non_empty, strip
from .keyed import key_set, one_per_key
from .mapping import union_all


def require_title(master: DataFrame) -> DataFrame:
    return master.where(F.col("job_title") != "")


def require_id(df: DataFrame, *columns: str) -> DataFrame:
    return df.where(first_non_empty(*columns) != "")


def dedup_across_sources(master: DataFrame) -> DataFrame:
    """First row per url (else id) in source order, then file order; keyless rows stay."""
    key = first_non_empty("posting_url", "job_id")
    return one_per_key(master, [key], ["source_rank", "ord"], F.when(key == "", F.struct("source_rank", "ord")))


def merge_master(raw_union: DataFrame) -> DataFrame:
    """Titled rows only, then dedup: the title test decides who may win."""
    return dedup_across_sources(require_title(raw_union))


def dedup_listing(cards: DataFrame, key: str, order: list, keep_blank: bool = False) -> DataFrame:
    """First card per key; blank keys are dropped, or all kept."""
    if keep_blank:
        return one_per_key(cards, [key], order, F.when(F.col(key) == "", F.struct(*order)))
    return one_per_key(cards.where(F.col(key) != ""), [key], order)


def last_per_key(df: DataFrame, key: Column, order: str) -> DataFrame:
    return one_per_key(df, [key], [F.desc(order)])


def load_keyed(existing: DataFrame, key: str, order: str) -> DataFrame:
    """A stored snapshot by key: blank keys dropped, the last row of a key wins."""
    return last_per_key(existing.where(strip(key) != ""), strip(key), order)


# --- anti joins ------------------------------------------------------------------

def _absent(cards: DataFrame, stored_keys: DataFrame, key: str) -> DataFrame:
    """Cards whose key is not stored. Blank keys never match.

    A stripped key never starts with a space, so blank cards get a key that does:
    it matches nothing and spreads them over all tasks.
    """
    spread = F.concat(F.lit(" "), F.xxhash64(*[F.col(c) for c in cards.columns]).cast("string"))
    keyed = cards.withColumn("_key", F.when(strip(key) == "", spread).otherwise(strip(key)))
    return keyed.join(key_set(stored_keys, "_key"), "_key", "left_anti").drop("_key")


def new_only(cards: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Cards none of whose keys is stored under any of the same keys.

    With one key: ids not stored yet. With two (number, url) a card is new only if
    neither value is stored as a number or as a url; one equi anti join per key.
    """
    stored = union_all([existing.select(strip(k).alias("_key")) for k in keys]).where("_key <> ''")
    for key in keys:
        cards = _absent(cards, stored, key)
    return cards


# --- upserts -----------------------------------------------------------------------

def upsert_newest(existing: DataFrame, new: DataFrame, key: str = "job_id", order: str = "ord",
                  stored_unique: bool = False) -> DataFrame:
    """Existing rows, replaced or extended by new ones; the last row of a key wins on each side.

    A snapshot known to have one row per key (`stored_unique`) meets the new keys in
    one anti join and is neither sorted nor ranked.
    """
    if stored_unique:
        newest = last_per_key(new.where(strip(key) != ""), strip(key), order)
        return _without(existing.where(strip(key) != ""), strip(key), newest, strip(key)).unionByName(newest)
    both = (existing.withColumn("_new", F.lit(0))
            .unionByName(new.withColumn("_new", F.lit(1)))
            .where(strip(key) != ""))
    return one_per_key(both, [strip(key)], [F.desc("_new"), F.desc(order)]).drop("_new")


def _without(stored: DataFrame, stored_key: Column, newest: DataFrame, new_key: Column) -> DataFrame:
    """Stored rows whose key has no new row."""
    return (stored.withColumn("_key", stored_key)
            .join(newest.select(new_key.alias("_key")), "_key", "left_anti").drop("_key"))


def _dual_winners(existing: DataFrame, number: str, url: str, order: str) -> DataFrame:
    """`(key, order)`: the stored row that stands for each canonical key (number, else url).

    A row is filed under its number and under its url, and the last row filed under
    a value holds it; a row that holds nothing any more is gone. Among holders with one
    canonical key, the one under the value filed first counts. Only keys and positions
    move, combined map-side.
    """
    n, u = strip(number), strip(url)
    filed = existing.select(F.col(order).alias("o"), first_non_empty(n, u).alias("key"), F.posexplode(F.array(n, u)).alias("w", "k"))
    held = filed.where("k <> ''").groupBy("k").agg(
        F.max(F.struct("o", "key")).alias("last"), F.min(F.struct("o", "w")).alias("first"))
    return held.groupBy(F.col("last.key").alias("key")).agg(F.min_by("last.o", "first").alias(order))


def dedup_dual_keyed(existing: DataFrame, number: str, url: str, order: str = "ord") -> DataFrame:
    """Rows filed under number and url, back to one per canonical key; keyless rows are dropped.

    `order` must be unique: the winning rows are picked by it.
    """
    return existing.join(_dual_winners(existing, number, url, order).select(order), order, "left_semi")


def upsert_canonical(existing: DataFrame, new: DataFrame, number: str, url: str, order: str = "ord",
                     stored_unique: bool = False) -> DataFrame:
    """New rows (the last per number, else url) and the stored rows they do not replace.

    Keyless rows are dropped; `carried` tells rows that come from the stored snapshot.
    The stored rows to keep are found on keys and positions alone, so wide rows move
    once; with `stored_unique` that search is left out.
    """
    key = first_non_empty(strip(number), strip(url))
    newest = last_per_key(new.where(key != ""), key, order)
    if stored_unique:
        carried = _without(existing.where(key != ""), key, newest, key)
    else:
        kept = _without(_dual_winners(existing, number, url, order), F.col("key"), newest, key)
        carried = existing.join(kept.select(order), order, "left_semi")
    return carried.withColumn("carried", F.lit(True)).unionByName(newest.withColumn("carried", F.lit(False)))


def append_new(existing: DataFrame, fetched: DataFrame, key: str = "job_id") -> DataFrame:
    """Stored rows as they are (see `load_keyed`), plus fetched rows with an id not stored."""
    return existing.unionByName(new_only(fetched, existing, [key]))


def expire_missing(snapshot: DataFrame, listing: DataFrame, key: str = "job_id") -> DataFrame:
    """Optional: drop stored rows that the listing no longer shows."""
    return snapshot.join(key_set(listing.where(F.col(key) != ""), key), key, "left_semi")


def merge_accounting(existing: DataFrame, listed: DataFrame, key: str = "job_id") -> DataFrame:
    """One row: keys listed, new, skipped (already stored) and carried over (stored, not listed)."""
    sides = (existing.select(strip(key).alias("k"), F.lit(1).alias("e"), F.lit(0).alias("n"))
             .unionAll(listed.select(strip(key).alias("k"), F.lit(0).alias("e"), F.lit(1).alias("n")))
             .where("k <> ''"))
    per_key = sides.groupBy("k").agg(F.max("e").alias("e"), F.max("n").alias("n"))
    return per_key.agg(
        F.count_if(F.expr("n = 1")).alias("total_listed"),
        F.count_if(F.expr("n = 1 and e = 0")).alias("new"),
        F.count_if(F.expr("n = 1 and e = 1")).alias("skipped"),
        F.count_if(F.expr("n = 0 and e = 1")).alias("carried_over"),
        F.count("*").alias("total_after"),
    )


# --- listing + detail -----------------------------------------------------------------

def enrich_listing(cards: DataFrame, details: DataFrame, key: str, policy: dict[str, str],
                   url: str | None = None) -> DataFrame:
    """Cards with their details, one row per card whether or not a detail exists.

    `policy` says per shared column who wins when both have a value: `detail` or
    `card`; other shared columns come from the detail. Columns without any value
    are `''`. With `url`, blank `posting_url` and `apply_link` take that card column.
    Both sides must hold one row per key.
    """
    shared = [c for c in details.columns if c != key]
    renamed = details.select(F.col(key), *[F.col(c).alias(f"_d_{c}") for c in shared],
                             F.lit(True).alias("_found"))
    joined = cards.join(renamed, key, "left")

    def value(c: str) -> Column:
        sides = [f"_d_{c}"] + ([c] if c in cards.columns else [])
        if policy.get(c) == "card":
            sides.reverse()
        if url and c in ("posting_url", "apply_link"):
            sides.append(url)
        return first_non_empty(*sides).alias(c)

    only_cards = [c for c in cards.columns if c != key and c not in shared]
    extra = [F.coalesce(non_empty(url), F.lit("")).alias(c) for c in ("posting_url", "apply_link")
             if url and c not in shared and c not in cards.columns]
    return joined.select(key, *only_cards, *[value(c) for c in shared], *extra,
                         F.col("_found").isNull().alias("stub"))


def stub_missing(cards: DataFrame, details: DataFrame, key: str, url: str) -> DataFrame:
    """Rows for cards without a detail: card fields, its url in both link columns, rest blank."""
    return enrich_listing(cards, details, key, {}, url).where("stub").drop("stub")


def attach_user(events: DataFrame, customers: DataFrame) -> DataFrame:
    """Events with the user of their customer; events without a user are dropped."""
    known = customers.where((F.col("user_id") != "") & F.col("user_id").isNotNull())
    return events.join(known, "customer")
