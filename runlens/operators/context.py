"""Key/value contexts per project and environment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import same_text, text_key
from .aggregates import active_count
from .projections import with_qualified_star


def contexts(ctx: DataFrame, env: DataFrame, proj: DataFrame) -> DataFrame:
    """Contexts with the names of their project and environment."""
    c, e, p = ctx.alias("cd"), env.alias("env"), proj.alias("pd")
    joined = c.join(e, F.col("cd.EnvironmentFK") == F.col("env.Id")).join(
        p, F.col("cd.ProjectDetailsFK") == F.col("pd.Id")
    )
    return with_qualified_star(joined, "cd", ["env.Environment", "pd.ProjectName"])


def context_by_key(
    ctx: DataFrame, env: DataFrame, proj: DataFrame, key: str,
    project: str | None = None, environment: str | None = None, id: int | None = None,
) -> DataFrame:
    """Contexts restricted to one id or to a key, project and environment."""
    out = contexts(ctx, env, proj)
    if id is not None:
        return out.where(F.col("Id") == id)
    out = out.where(same_text(F.col("ContextKey"), key))
    if project is not None:
        out = out.where(same_text(F.col("ProjectName"), project))
    if environment is not None:
        out = out.where(same_text(F.col("Environment"), environment))
    return out


def context_view(ctx: DataFrame, proj: DataFrame, env: DataFrame, name: str | None = None) -> DataFrame:
    """The context view; with ``name`` it is also registered as a temporary view."""
    out = contexts(ctx, env, proj).select(
        "Id", "ContextKey", "ContextValue", "isEncrypted", "ProjectName", "Environment",
        "Description", "IsActive",
    )
    if name:
        out.createOrReplaceTempView(name)
    return out


def resolve_context(
    ctx: DataFrame, env: DataFrame, proj: DataFrame,
    environment: str | None = None, project: str | None = None, active_only: bool = False,
) -> DataFrame:
    """Every context key per environment with its value, NULL unless exactly one row matches.

    Project and active flag are ignored by default, so one key used by two projects is ambiguous.
    """
    rows = context_view(ctx, proj, env)
    if environment is not None:
        rows = rows.where(same_text(F.col("Environment"), environment))
    if project is not None:
        rows = rows.where(same_text(F.col("ProjectName"), project))
    if active_only:
        rows = rows.where(F.col("IsActive") == 1)
    n = F.count(F.lit(1))
    only: Column = F.when(n == 1, F.min("ContextValue"))
    found = rows.groupBy(F.upper("ContextKey").alias("context_key"), F.upper("Environment").alias("_environment"))
    return found.agg(
        F.min("Environment").alias("Environment"), n.alias("n_matches"), only.alias("context_value")
    ).drop("_environment")


def context_matrix(
    ctx: DataFrame, env: DataFrame, proj: DataFrame, environments: list[str]
) -> DataFrame:
    """One row per key with a column per environment."""
    resolved = resolve_context(ctx, env, proj).withColumn("_environment", F.upper("Environment"))
    found = (
        resolved.groupBy("context_key").pivot("_environment", [e.upper() for e in environments])
        .agg(F.first("context_value", ignorenulls=True))
    )
    return found.toDF("context_key", *environments)


def context_panel(ctx: DataFrame, env: DataFrame, proj: DataFrame) -> DataFrame:
    """Available and active projects, environments and contexts.

    Available means distinct names; active counts the rows with the flag set.
    """
    parts = {"project": (proj, "ProjectName"), "environment": (env, "Environment"), "context": (ctx, "ContextKey")}
    out = None
    for kind, (df, column) in parts.items():
        # rows per name first: one name with very many rows stays one group
        names = df.groupBy(text_key(df, column).alias("name")).agg(F.count_if(F.col("IsActive") == 1).alias("n"))
        row = names.agg(
            F.count(F.lit(1)).alias("available"), F.coalesce(F.sum("n"), F.lit(0)).alias("active")
        ).select(F.lit(kind).alias("kind"), "available", "active")
        out = row if out is None else out.unionByName(row)
    return out


def active_contexts(ctx: DataFrame) -> DataFrame:
    return active_count(ctx)
