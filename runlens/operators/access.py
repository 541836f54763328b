"""Who may see which report.

A report lists user names and group names as comma-joined text. ``reference`` mode compares the
whole group text with the one group of the user; ``strict`` mode compares the single names and
also looks for the user's own name. A report whose user list holds ``*`` is public.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_list
from .aggregates import distinct_rows, group_count
from .skew import join_on_unique

# Texts stored when no user or no group was chosen.
ALL_USERS_OF_GROUP = "All Users from group"
NO_GROUP = "None"


def is_public() -> Column:
    return F.col("users").contains("*")


def user_groups(users: DataFrame, groups: DataFrame, user: str | None = None) -> DataFrame:
    """Distinct (user name, group name) pairs."""
    named = groups.select(F.col("id").alias("groupId"), F.col("name").alias("group"))
    who = users if user is None else users.where(F.upper("name") == user.upper())
    return distinct_rows(who.join(named, "groupId").select(F.col("name").alias("user"), "group"), ["user", "group"])


def reports_for_user(reports: DataFrame, users: DataFrame, groups: DataFrame, user: str) -> DataFrame:
    """Reports whose group text equals a group of the user, as a semi join."""
    return _in_groups(reports, user_groups(users, groups, user))


def all_group_reports(reports: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """Reports whose group text equals a group that has any user."""
    return _in_groups(reports, user_groups(users, groups))


def _in_groups(reports: DataFrame, members: DataFrame) -> DataFrame:
    names = members.select(F.upper("group").alias("_g")).distinct()
    return join_on_unique(reports.withColumn("_g", F.upper("groups")), names, ["_g"], "left_semi").select(*reports.columns)


def _own_reports(reports: DataFrame, users: DataFrame, groups: DataFrame, user: str) -> DataFrame:
    names = F.transform(split_list(F.col("groups")), lambda g: F.upper(F.trim(g)))
    listed = reports.withColumn("_g", F.explode(names))
    mine = user_groups(users, groups, user).select(F.upper("group").alias("_g")).distinct()
    by_group = join_on_unique(listed, mine, ["_g"], "left_semi").select("name", "type")
    own_name = F.exists(split_list(F.col("users")), lambda u: F.upper(F.trim(u)) == user.upper())
    return by_group.union(reports.where(own_name).select("name", "type"))


def visible_reports(
    reports: DataFrame, users: DataFrame, groups: DataFrame, user: str, mode: str = "reference"
) -> DataFrame:
    """Distinct (name, type) of the reports a user may open: own ones and public ones."""
    if mode == "reference":
        own = reports_for_user(reports, users, groups, user).select("name", "type")
    else:
        own = _own_reports(reports, users, groups, user)
    return distinct_rows(own.union(reports.where(is_public()).select("name", "type")), ["name", "type"])


def has_permission(
    reports: DataFrame, users: DataFrame, groups: DataFrame, user: str, report: str,
    mode: str = "reference",
) -> DataFrame:
    """One row ``allowed``. In reference mode any public report opens every report."""
    named = F.upper("name") == report.upper()
    if mode == "reference":
        own = reports_for_user(reports.where(named), users, groups, user).select("name")
        seen = own.union(reports.where(is_public()).select("name"))
    else:
        seen = visible_reports(reports.where(named), users, groups, user, mode).select("name")
    return seen.agg((F.count(F.lit(1)) > 0).alias("allowed"))


def report_access(
    reports: DataFrame, users: DataFrame, groups: DataFrame, mode: str = "reference"
) -> DataFrame:
    """The access matrix of all reports: one row per report and audience, with its user count.

    An audience is a group, a single user (strict mode) or ``*`` for everybody. The matrix is kept
    at this level instead of one row per (user, report): a public report or a large group would
    otherwise repeat each report once per user.
    """
    group_names = F.array("groups") if mode == "reference" else split_list(F.col("groups"))
    listed = reports.select(
        F.col("id").alias("report_id"), F.col("name").alias("report"),
        F.explode(F.array_distinct(F.transform(group_names, lambda g: F.upper(F.trim(g))))).alias("audience"),
    )
    members = (
        user_groups(users, groups).groupBy(F.upper("group").alias("audience"))
        .agg(F.count(F.lit(1)).alias("n_users"))
    )
    out = join_on_unique(listed, members, ["audience"], "inner").select(
        "report_id", "report", F.lit("group").alias("kind"), "audience", "n_users"
    )
    everybody = group_count(users, "name").scalar()
    public = reports.where(is_public()).select(
        F.col("id").alias("report_id"), F.col("name").alias("report"), F.lit("public").alias("kind"),
        F.lit("*").alias("audience"), everybody.alias("n_users"),
    )
    out = out.unionByName(public)
    if mode == "reference":
        return out
    names = F.array_distinct(F.transform(split_list(F.col("users")), lambda u: F.upper(F.trim(u))))
    named = reports.select(
        F.col("id").alias("report_id"), F.col("name").alias("report"), F.explode(names).alias("audience")
    ).where(F.col("audience") != "*")
    accounts = users.select(F.upper("name").alias("audience")).distinct()
    single = join_on_unique(named, accounts, ["audience"], "inner").select(
        "report_id", "report", F.lit("user").alias("kind"), "audience",
        F.lit(1).cast("bigint").alias("n_users"),
    )
    return out.unionByName(single)
