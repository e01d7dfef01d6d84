"""Access tokens: their form, what is kept of them, and who may act with one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Prefix and form of a token; bounds and default of its life in seconds.
PREFIX, FORM = "art_v1_", r"^art_v1_([0-9a-f]{40})(?:\?expires=([0-9]+))?$"
TTL_LEAST, TTL_MOST, TTL = 60, 31_536_000, 86_400


def plaintext(secret: Column, expires_at_unix: Column) -> Column:
    return F.concat(F.lit(PREFIX), secret, F.lit("?expires="), expires_at_unix.cast("string"))


def parsed(token: Column) -> Column:
    """(secret, expires_at_unix) of a token; null if it is none; a token without an expiry has a null one."""
    expiry = F.nullif(F.regexp_extract(token, FORM, 2), F.lit(""))
    return F.when(token.rlike(FORM), F.struct(F.regexp_extract(token, FORM, 1).alias("secret"), expiry.try_cast("long").alias("expires_at_unix")))


def digest(secret: Column) -> Column:
    """What is stored of a secret: its SHA-256 in hexadecimal."""
    return F.sha2(secret, 256)


def ttl_fault(ttl: Column) -> Column:
    return F.when(ttl.isNull() | ~ttl.between(TTL_LEAST, TTL_MOST), "invalid-ttl")


def create(commands: DataFrame, repositories: DataFrame, now: int) -> DataFrame:
    """commands (namespace_slug, repository_name, scope, ttl, id, secret) with ``outcome`` created or repository-missing, and of
    those created secret_hash, created_at_unix, expires_at_unix and plaintext, which is shown once. ``now`` is given, so runs agree."""
    keys = ["namespace_slug", "repository_name"]
    known = repositories.select("namespace_slug", F.col("name").alias("repository_name")).distinct().withColumn("__known", F.lit(True))
    rows = commands.join(known, keys, "left")
    ends = F.lit(now) + F.col("ttl")
    made = lambda c: F.when(F.col("__known"), c)
    return rows.select(*keys, "id", "scope", F.when(F.col("__known"), "created").otherwise("repository-missing").alias("outcome"), made(digest(F.col("secret"))).alias("secret_hash"), made(F.lit(now).cast("long")).alias("created_at_unix"), made(ends.cast("long")).alias("expires_at_unix"), made(plaintext(F.col("secret"), ends)).alias("plaintext"))


def revoke(tokens: DataFrame, commands: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """(tokens, outcomes) when commands are revoked at ``now``: each names a token of its namespace by id, or, where it has a
    repository_name, one of that repository by id or by the whole token, of which only the digest is compared.

    commands are (command, namespace_slug, repository_name or null, token); outcomes add ``revoked``. A token revoked before
    gets the new time, as the last one counts.
    """
    asked = commands.select("command", "namespace_slug", F.col("repository_name").alias("__repo"), F.col("token").alias("__id"), digest(parsed(F.col("token"))["secret"]).alias("__hash"))
    own = tokens.select("namespace_slug", "repository_name", "id", "secret_hash")
    by_id = asked.join(own.withColumnRenamed("id", "__id"), ["namespace_slug", "__id"]).where("__repo IS NULL OR __repo = repository_name").select("command", F.col("__id").alias("id"))
    by_hash = asked.where("__repo IS NOT NULL AND __hash IS NOT NULL").join(own.withColumnRenamed("secret_hash", "__hash"), ["namespace_slug", "__hash"]).where("__repo = repository_name").select("command", "id")
    met = by_id.unionByName(by_hash)
    hit = met.select("id").distinct().withColumn("__hit", F.lit(True))
    after = tokens.join(hit, "id", "left").withColumn("revoked_at", F.when(F.col("__hit"), F.lit(now)).otherwise(F.col("revoked_at"))).select(*tokens.columns)
    outcomes = commands.join(met.select("command").distinct().withColumn("revoked", F.lit(True)), "command", "left")
    return after, outcomes.select(*commands.columns, F.coalesce("revoked", F.lit(False)).alias("revoked"))


def authorize(requests: DataFrame, tokens: DataFrame, now: int) -> DataFrame:
    """requests (request, presented, namespace_slug, repository_name, scope) with ``allowed``.

    The presented token must parse, be unexpired by its own word, and its digest must belong to a token of that repository
    that is not revoked, has not expired, ends when the presented one says if it says so, and covers the scope (write covers read).
    """
    token = parsed(F.col("presented"))
    rows = requests.withColumns({"__ends": token["expires_at_unix"], "secret_hash": digest(token["secret"])})
    held = tokens.select("secret_hash", *(F.col(c).alias(f"__{c}") for c in ("namespace_slug", "repository_name", "scope", "revoked_at", "expires_at_unix")))
    rows = rows.join(held, "secret_hash", "left")
    good = (F.col("__namespace_slug") == F.col("namespace_slug")) & (F.col("__repository_name") == F.col("repository_name")) & F.col("__revoked_at").isNull() & (F.col("__expires_at_unix") > now)
    good = good & (F.col("__ends").isNull() | (F.col("__ends") > now) & (F.col("__ends") == F.col("__expires_at_unix"))) & ((F.col("scope") == "read") | (F.col("__scope") == "write"))
    return rows.groupBy("request").agg(F.max(F.coalesce(good, F.lit(False))).alias("allowed"))
