"""Host utilisation from tables of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import human_size, load_pct, percent_used
from .predicates import ignore_rows


def host_utilisation(samples: DataFrame) -> DataFrame:
    """Memory and load of each sample. Sizes come in KiB: free, buffers, cached, total."""
    free = F.col("free") + F.col("buffers") + F.col("cached")
    used = F.col("total") - free
    return samples.withColumns({
        "free_size": human_size(free * 1024),
        "used_size": human_size(used * 1024),
        "total_size": human_size(F.col("total") * 1024),
        "percent_used": percent_used(free, F.col("total")),
        "load_percent": load_pct(F.col("load"), F.col("cores")),
    })


def disk_usage(
    disks: DataFrame, order: str, ignore_mounts: Sequence[str] = (), show_tmpfs: bool = False,
    show_loop: bool = False,
) -> DataFrame:
    """First row (by ``order``) of every host and mount, after the rows to ignore."""
    kept = ignore_rows(
        disks, ignore_mounts, () if show_tmpfs else ("tmpfs",), () if show_loop else ("/dev/loop",)
    )
    first = F.min_by(F.struct(*disks.columns), F.col(order)).alias("row")
    rows = kept.groupBy("host", "mount").agg(first).select("row.*")
    return rows.withColumns({
        "total_size": human_size(F.col("total") * 1024),
        "used_size": human_size(F.col("used") * 1024),
        "free_size": human_size(F.col("free") * 1024),
        "percent": F.least("percent", F.lit(100)),
    })
