"""Paging with a total order, token states, guarded inserts and cascades as pure functions of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, sort: str, tie: str, limit: int, descending: bool = False, after: tuple[str, str] | None = None) -> DataFrame:
    """One page and ``has_next``: a null sort key counts as '', ties follow ``tie`` in the same direction.

    ``after`` is the last (sort, tie) seen; the predicate is an OR of comparisons, which the scan can prune by. One row
    more than ``limit`` is read to learn of a further page, so the plan is a bounded top-k, not a full sort; the window numbers those rows only.
    """
    key = F.coalesce(F.col(sort), F.lit(""))
    if after:
        k, t = after
        df = df.where((key < k) | ((key == k) & (F.col(tie) < t)) if descending else (key > k) | ((key == k) & (F.col(tie) > t)))
    order = [key.desc(), F.col(tie).desc()] if descending else [key.asc(), F.col(tie).asc()]
    whole = Window.partitionBy(F.lit(1))
    look = df.orderBy(*order).limit(limit + 1).withColumns({"__nth": F.row_number().over(whole.orderBy(*order)), "has_next": F.count("*").over(whole) > limit})
    return look.where(F.col("__nth") <= limit).drop("__nth")


def point_lookup(requests: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """request and the row of each of requests (request, key), which are many prepared lookups in one join; nulls where there is none."""
    found = rows.select(*(F.col(c).alias(f"__{c}") for c in key), *rows.columns)
    asked = requests.select("request", *(F.col(c).alias(f"__{c}") for c in key))
    return asked.join(found, [f"__{c}" for c in key], "left").select("request", *rows.columns)


def offset_page(df: DataFrame, order: list[Column], page: int, per_page: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def token_state(now: int) -> Column:
    """``revoked`` wins; expired when the expiry is at or before now; else ``active``."""
    return F.when(F.col("revoked_at").isNotNull(), "revoked").when(F.col("expires_at_unix") <= now, "expired").otherwise("active")


def authorized(tokens: DataFrame, wanted: str, now: int) -> DataFrame:
    """Tokens that may act: active, and of the wanted scope (write covers read)."""
    scope = F.col("scope") == "write" if wanted == "write" else F.col("scope").isin("read", "write")
    return tokens.where(F.col("revoked_at").isNull() & (F.col("expires_at_unix") > now) & scope)


def insert_outcomes(new: DataFrame, existing: DataFrame, parents: DataFrame, key: list[str], parent: str) -> DataFrame:
    """new with an ``outcome``: parent-missing, name-taken or created; of equal new keys the least ``pos`` is first."""
    have = existing.select(*key).distinct().withColumn("__taken", F.lit(True))
    known = parents.select(parent).distinct().withColumn("__known", F.lit(True))
    first = new.groupBy(*key).agg(F.min("pos").alias("__first"))
    rows = new.join(have, key, "left").join(known, parent, "left").join(first, key)
    outcome = F.when(F.col("__known").isNull(), "parent-missing").when(F.col("__taken").isNotNull() | (F.col("pos") > F.col("__first")), "name-taken").otherwise("created")
    return rows.withColumn("outcome", outcome).drop("__taken", "__known", "__first")


def cascade_delete(parents: DataFrame, children: DataFrame, on: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """(parents kept, children kept) when the parents that ``gone`` holds for are deleted with their children."""
    dead = parents.where(gone).select(on)
    return parents.where(~gone), children.join(dead, on, "left_anti")
