"""Native expressions: name rules, literal search, object ids, size buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths, patterns and reserved slugs of the name rules.
SLUG_MAX, REPOSITORY_MAX, BRANCH_MAX = 39, 100, 255
SLUG, REPOSITORY, BRANCH = "^[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$", "^[a-z0-9](?:[a-z0-9._-]*[a-z0-9])?$", "^[A-Za-z0-9][A-Za-z0-9._/-]*$"
RESERVED = ("api", "git", "healthz", "static", "well-known")


def slug_violation(c: Column) -> Column:
    """Null for a good namespace slug, else its first fault."""
    return F.when(F.length(c) == 0, "empty").when(F.length(c) > SLUG_MAX, "too-long").when(~c.rlike(SLUG), "malformed").when(c.isin(*RESERVED), "reserved")


def repository_violation(c: Column) -> Column:
    return F.when(F.length(c) == 0, "empty").when(F.length(c) > REPOSITORY_MAX, "too-long").when(~c.rlike(REPOSITORY), "malformed").when(c.endswith(".git"), "git-suffix")


def branch_violation(c: Column) -> Column:
    good = F.forall(F.split(c, "/"), lambda p: (F.length(p) > 0) & ~p.startswith(".") & ~p.endswith(".lock"))
    return F.when(F.length(c) == 0, "empty").when(F.length(c) > BRANCH_MAX, "too-long").when(~c.rlike(BRANCH) | c.contains("..") | c.endswith(".") | ~good, "malformed")


def folded(c: Column) -> Column:
    """A-Z to a-z only, as the search compares."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def holds(c: Column, term: str) -> Column:
    """Literal substring search without ASCII case: wildcards in the term are ordinary characters."""
    return F.contains(folded(c), folded(F.lit(term)))


def object_id(kind: Column, body: Column) -> Column:
    """SHA-1 of ``type SP size NUL bytes`` as lowercase hex."""
    raw = body.cast("binary")
    return F.sha1(F.concat(F.concat(kind, F.lit(" "), F.octet_length(raw).cast("string")).cast("binary"), F.unhex(F.lit("00")), raw))


def size_bucket(kind: Column, size: Column) -> Column:
    """``type:floor(log2(max(1, size)))`` by binary digits, free of rounding."""
    return F.concat(kind, F.lit(":"), (F.length(F.bin(F.greatest(size, F.lit(1)).cast("long"))) - 1).cast("string"))
