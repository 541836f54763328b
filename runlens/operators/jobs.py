"""Job definitions stored as XML documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timefmt import cron_fields

_MAIL = "struct<email: struct<recipientList: string, subject: string, body: string, attachBuildLog: string>>"
_TRIGGER = "hudson.plugins.emailext.plugins.trigger."

# Element names of a job document.
JOB_SCHEMA = f"""
  description string,
  triggers struct<`hudson.triggers.TimerTrigger`: struct<spec: string>>,
  builders struct<
    `hudson.tasks.Shell`: struct<command: string>,
    `hudson.tasks.BatchFile`: struct<command: string>>,
  publishers struct<
    `hudson.tasks.Mailer`: struct<recipients: string>,
    `hudson.tasks.BuildTrigger`: struct<childProjects: string, threshold: struct<name: string>>,
    `hudson.plugins.emailext.ExtendedEmailPublisher`: struct<
      configuredTriggers: struct<
        `{_TRIGGER}SuccessTrigger`: {_MAIL},
        `{_TRIGGER}FailureTrigger`: {_MAIL},
        `{_TRIGGER}AbortedTrigger`: {_MAIL}>,
      from: string>>,
  buildWrappers struct<
    `hudson.plugins.build__timeout.BuildTimeoutWrapper`: struct<
      strategy: struct<timeoutMinutes: string, timeoutSecondsString: string>>>
"""


def _mail(kind: str) -> Column:
    mails = F.col("_x.publishers.`hudson.plugins.emailext.ExtendedEmailPublisher`.configuredTriggers")
    return mails[f"{_TRIGGER}{kind}Trigger"]["email"]


def extract_jobs(documents: DataFrame, xml: str = "xml") -> DataFrame:
    """One row per document: command, schedule, time limits, next jobs and mail settings.

    Each document is parsed once, by the built-in XML reader.
    """
    parsed = documents.withColumn("_x", F.from_xml(xml, JOB_SCHEMA.replace("\n", " ")))
    builders = F.col("_x.builders")
    wrapper = F.col("_x.buildWrappers.`hudson.plugins.build__timeout.BuildTimeoutWrapper`.strategy")
    trigger = F.col("_x.publishers.`hudson.tasks.BuildTrigger`")
    spec = F.col("_x.triggers.`hudson.triggers.TimerTrigger`.spec")
    columns = {
        "description": F.col("_x.description"),
        "command": F.coalesce(
            builders["hudson.tasks.Shell"]["command"], builders["hudson.tasks.BatchFile"]["command"]
        ),
        "spec": spec,
        "timeout_minutes": wrapper["timeoutMinutes"].try_cast("int"),
        "timeout_seconds": wrapper["timeoutSecondsString"].try_cast("int"),
        "children": trigger["childProjects"],
        "threshold": trigger["threshold"]["name"],
        "recipients": F.col("_x.publishers.`hudson.tasks.Mailer`.recipients"),
        "mail_from": F.col("_x.publishers.`hudson.plugins.emailext.ExtendedEmailPublisher`.from"),
    }
    for kind in ("Success", "Failure", "Aborted"):
        short = kind.lower()
        columns[f"{short}_to"] = _mail(kind)["recipientList"]
        columns[f"{short}_subject"] = _mail(kind)["subject"]
    out = parsed.select(
        *[c for c in documents.columns if c != xml], *[c.alias(n) for n, c in columns.items()]
    )
    return out.withColumn("_cron", cron_fields(F.col("spec"))).select(*out.columns, "_cron.*")
