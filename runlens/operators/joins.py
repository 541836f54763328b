"""Joins between runs, errors, users, settings and files.

No join carries a broadcast hint: Spark broadcasts a side when its size is known to be small (from
file statistics, or at run time from the shuffle) and otherwise sorts and merges, splitting
skewed partitions. Sides that were just reduced to one row per key go through ``join_on_unique``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_text, text_key
from .skew import join_on_unique

# ---------------------------------------------------------------- general forms

# Join words of the query interface → Spark join types.
JOIN_TYPES = {
    "": "inner", "INNER": "inner", "LEFT": "left", "LEFT OUTER": "left",
    "RIGHT": "right", "RIGHT OUTER": "right", "OUTER": "full",
}


def join_typed(a: DataFrame, b: DataFrame, condition: Column, how: str = "") -> DataFrame:
    return a.join(b, condition, JOIN_TYPES[how.strip().upper()])


def join_using(a: DataFrame, b: DataFrame, *columns: str, how: str = "") -> DataFrame:
    """USING: equality on columns of the same name, kept once."""
    return a.join(b, list(columns), JOIN_TYPES[how.strip().upper()])


def join_on(a: DataFrame, b: DataFrame, equal: Sequence[Column], extra: Column | None = None, how: str = "") -> DataFrame:
    """ON with several conditions. ``equal`` are the key equalities, of which there must be at
    least one so that rows meet by key; ``extra`` is any further condition, OR included."""
    if not equal:
        raise ValueError("join_on needs at least one key equality")
    condition = reduce(lambda x, y: x & y, equal)
    return join_typed(a, b, condition if extra is None else condition & extra, how)


def from_tables(a: DataFrame, b: DataFrame, *equal: Column) -> DataFrame:
    """Several tables in FROM with equalities in WHERE, which is an inner join on those keys.

    A list without an equality would pair every row with every row and is refused.
    """
    return join_on(a, b, equal)


# ---------------------------------------------------------------- errors and runs


def errors_for_instance(
    errs: DataFrame, runs: DataFrame, instance_id: str | None = None, distinct_errors: bool = False
) -> DataFrame:
    """Errors of runs, for one instance or for all.

    Several runs may share an instance; joined row by row each error then appears once per run.
    Here an error is one row with that number in ``copies``: the same information, but one hot
    instance cannot multiply its rows. ``distinct_errors`` leaves the column out.
    """
    if instance_id is not None:
        errs = errs.where(same_text(F.col("tmf_id"), instance_id))
        runs = runs.where(same_text(F.col("instance_id"), instance_id))
    per_instance = runs.groupBy(text_key(runs, "instance_id").alias("tmf_id")).agg(F.count(F.lit(1)).alias("copies"))
    out = join_on_unique(errs, per_instance, ["tmf_id"], "inner")
    return out.drop("copies") if distinct_errors else out


# ---------------------------------------------------------------- users


# Columns of the user listing.
LISTED = ("userId", "email", "name", "mobile", "createdDtm", "role", "group")


def users_with_role(users: DataFrame, roles: DataFrame, groups: DataFrame) -> DataFrame:
    """Users with role and group names; a user without either is kept."""
    named = groups.select(F.col("id").alias("groupId"), F.col("name").alias("group"))
    return users.join(roles, "roleId", "left").join(named, "groupId", "left")


def user_listing(users: DataFrame, roles: DataFrame, groups: DataFrame, text: str = "") -> DataFrame:
    """Users that are neither deleted nor administrators (role 1), optionally searched, in the columns
    that a listing shows."""
    from .predicates import active, not_equal, search_users

    found = search_users(users, text) if text else users
    named = users_with_role(not_equal(active(found), "roleId", 1), roles, groups)
    return named.select(*[c for c in LISTED if c in named.columns])


def user_page(
    users: DataFrame, roles: DataFrame, groups: DataFrame, text: str = "", limit: int = 10, offset: int = 0
) -> DataFrame:
    """One page of the user listing, newest user first."""
    from .paging import page

    return page(user_listing(users, roles, groups, text), [("userId", "desc")], limit, offset)


def user_profile(users: DataFrame, roles: DataFrame, groups: DataFrame) -> DataFrame:
    """Active users with their role (required) and group (optional), without passwords."""
    from .predicates import active

    named = groups.select(F.col("id").alias("groupId"), F.col("name").alias("group"))
    return active(users).drop("password").join(roles, "roleId").join(named, "groupId", "left")


# ---------------------------------------------------------------- settings


def templates_with_smtp(email: DataFrame, smtp: DataFrame) -> DataFrame:
    """Mail templates with the server they name; ``smtp`` names are unique."""
    server = smtp.select(
        F.upper("name").alias("_name"), "smtp_host", "smtp_port", "username", "password", "ssl"
    )
    return email.join(server, F.upper("smtp") == F.col("_name")).drop("_name")


# ---------------------------------------------------------------- existence tests


def new_rows(
    incoming: DataFrame, existing: DataFrame, keys: Sequence[str], first_by: str | None = None
) -> DataFrame:
    """Incoming rows whose key does not exist yet.

    With ``first_by`` only the first of several incoming rows with one key is kept, as if they
    were inserted one after another. The existing keys are reduced to one row each before they
    are joined, so a key with very many rows is no problem.
    """
    keys = list(keys)
    if first_by is not None:
        picked = F.min_by(F.struct(*incoming.columns), F.col(first_by)).alias("row")
        folded = [text_key(incoming, k).alias(f"_{k}") for k in keys]
        incoming = incoming.groupBy(*folded).agg(picked).select("row.*")
    return join_on_unique(incoming, existing.select(*keys).distinct(), keys, "left_anti")


def duplicate_keys(df: DataFrame, key: str, id_col: str) -> DataFrame:
    """Values held by more than one row, with their number and their smallest id."""
    return (
        df.groupBy(F.lower(key).alias(key))
        .agg(F.count(F.lit(1)).alias("amount"), F.min(id_col).alias(f"first_{id_col}"))
        .where(F.col("amount") > 1)
    )


def taken_by_other(df: DataFrame, key: str, value: str, id_col: str, own_id: int) -> DataFrame:
    """Rows of others that hold a value: does any exist besides the row being edited?"""
    return df.where((F.lower(key) == value.lower()) & (F.col(id_col) != own_id)).limit(1)


def match_files(files: DataFrame, registry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Delivered files against their registry entry.

    An entry with ``file`` = 1 requires exactly ``file_name`` + ``component_type``; with 2 any
    name is accepted. A file without entry is rejected. With several entries of one key (text without regard
    to case) a file is accepted if one of them does, and the smallest ``file`` and ``required`` are shown.
    """
    required = F.when(F.col("file") == 1, F.concat("file_name", "component_type"))
    entry = registry.withColumn("_required", required).groupBy(*[text_key(registry, k).alias(k) for k in keys]).agg(
        F.min("file").alias("file"), F.min("_required").alias("required"), F.max(F.col("file") == 2).alias("_any"),
        F.collect_set("_required").alias("_names"),
    )
    ok = F.col("_any") | F.array_contains("_names", F.col("delivered"))
    matched = join_on_unique(files, entry, keys, "left")
    return matched.withColumn("accepted", F.coalesce(ok, F.lit(False))).drop("_any", "_names")
