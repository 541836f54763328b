"""Timed headline queries; prints one JSON line.

All queries run twice to warm up, then three times, in rounds, into Spark's ``noop`` sink, which computes every
row without sending any to the driver; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from checks.adapters import Tables  # noqa: E402
from checks.change_checks import shared_events  # noqa: E402
from runlens.functions.text import text_prep  # noqa: E402
from runlens.operators import aggregates, builds, changes, joins, lifecycle, paging, tree, validation  # noqa: E402
from runlens.operators.predicates import filter_runs  # noqa: E402
from runlens.plans import trends  # noqa: E402
from runlens.session import build_session, work_dir  # noqa: E402

REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))
CPUS = os.environ.get("BENCH_CPUS", "8")
AS_OF = "2024-01-31 12:00:00"
PREP = [
    ("strip_tags", {}), ("to_ascii_letters", {}), ("censor_words", {"words": ["the", "que"]}),
    ("reduce_multiples", {"character": "a"}), ("strip_quotes", {}), ("word_limit", {"limit": 100}),
]
RULES = {
    "text": ["required", ("min_length", 200), ("max_length", 5000)],
    "lang": [("in_list", ["en", "de", "fr"])],
}


def separate_series(t):
    """The dashboard as its single statements: what one scan replaces."""
    runs = t.runs
    out = [aggregates.runs_by_status(runs), aggregates.runs_by_job(runs), aggregates.runs_by_job_status(runs)]
    out += [aggregates.runs_by_month_for_status(runs, s) for s in aggregates.STATUSES]
    out += [aggregates.month_labels(runs)]
    out += [trends.window_counts(runs, [d], AS_OF, [s]) for d in trends.WINDOWS for s in aggregates.STATUSES]
    out += [aggregates.executions_by_layer(runs, n) for n in trends.LISTED_LAYERS]
    out += [aggregates.layer_counts(runs).select(n) for n in ("stg", "dim", "fact", "dw", "dm")]
    return out


def headline(t):
    path = work_dir(t.spark, "bench-labels")  # made once, as a stored tree keeps them
    tree.store_labels(tree.label_tree(t.tree), path)
    labels = t.spark.read.parquet(path)
    changed = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderpriority"))
    return {
        "D1_dashboard": lambda: trends.dashboard(t.runs, AS_OF),
        "F1_filter_and_A4": lambda: aggregates.runs_by_status(filter_runs(
            t.runs, ["ready", "error"], None, ["dw_master", "dw_sales"], ["dev", "prod"],
            from_date="05-01-2024", to_date="25-01-2024")),
        "A9_W1_growth": lambda: trends.growth(t.runs, as_of=AS_OF),
        "J6_errors_runs": lambda: joins.errors_for_instance(t.errs, t.runs),
        "J12_lineitem_orders": lambda: joins.join_on(
            t.lineitem, t.orders, [F.col("l_orderkey") == F.col("o_orderkey")],
            (F.col("l_quantity") > 30) | (F.col("o_orderstatus") == "F")),
        "L2_fold_runs": lambda: lifecycle.fold_runs(t.run_events),
        "L2_fold_runs_shared": lambda: lifecycle.fold_runs(shared_events(t)),
        "M1_update_by_key": lambda: changes.update_by_key(t.orders, changed, ["o_custkey"]),
        "W4_build_range": lambda: builds.build_range(t.builds, block=10_000),
        "J14_descendants": lambda: tree.descendants(t.tree, 1),
        "J14_descendants_labels": lambda: tree.labelled_descendants(labels, 1),
        "O4_deep_page": lambda: paging.page(
            t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice"),
            [("l_orderkey", "asc"), ("l_linenumber", "asc")], 10, 400_000),
        "V1_validate_documents": lambda: validation.violations(
            validation.check_rows(t.documents, RULES, "doc_id"), "doc_id"),
        "V7_text_prep": lambda: text_prep(t.documents, PREP, partitions=int(CPUS)),
    }


def run(make) -> float:
    start = time.perf_counter()
    made = make()
    for df in made if isinstance(made, list) else [made]:
        df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")

    def measure(queries) -> dict[str, float]:
        # rounds over all queries, so that none has the warm-up to itself
        taken = {name: [] for name in queries}
        for i in range(2 + REPEATS):
            for name, make in queries.items():
                seconds = run(make)
                if i >= 2:
                    taken[name].append(seconds)
        times = {name: round(statistics.median(found), 3) for name, found in taken.items()}
        for name, seconds in times.items():
            print(f"{name:28} {seconds:8.3f}s", file=sys.stderr)
        return times

    tables = Tables(spark, folder)
    times = measure(headline(tables))
    # shapes to compare with: not part of the sum
    statuses = [s.upper() for s in aggregates.STATUSES]
    comparison = measure({
        "D1_as_27_statements": lambda: separate_series(tables),
        "D1_default_as_of": lambda: trends.dashboard(tables.runs),
        "F1_unfused": lambda: [aggregates.count_where(tables.runs, F.upper("status") == s) for s in statuses],
    })
    sizes = {"L2_fold_runs": tables.run_events.count(), "V7_text_prep": tables.documents.count(), "D1_dashboard": tables.runs.count()}
    rate = {k: round(n / times[k]) for k, n in sizes.items()}
    print(json.dumps({
        "metric": "run-log headline queries, sum of medians", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "comparison": comparison, "rows_per_sec": rate, "sf": Path(folder).name.removeprefix("sf"), "cores": int(CPUS),
        "shuffle_partitions": int(CPUS), "spark": spark.version,
    }))


if __name__ == "__main__":
    main()
