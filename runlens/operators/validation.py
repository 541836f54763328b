"""Row validation: rules per column → violations and accepted rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_ws
from .skew import join_on_unique

Rule = str | tuple

# Patterns of the format rules.
NUMBER = r"^[-+]?[0-9]*\.?[0-9]+$"
COMPARED = r"^[ \t\n\r\x0B\f]*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?[ \t\n\r\x0B\f]*\z"  # what comparisons take as a number
PATTERNS = {
    "alpha": r"^[A-Za-z]+\z",
    "alpha_numeric": r"^[A-Za-z0-9]+\z",
    "alpha_numeric_spaces": r"^[A-Za-z0-9 ]+$",
    "alpha_dash": r"^[A-Za-z0-9_-]+$",
    "numeric": NUMBER,
    "integer": r"^[-+]?[0-9]+$",
    "decimal": r"^[-+]?[0-9]+\.[0-9]+$",
    "natural": r"^[0-9]+\z",
}

# Own patterns for addresses; all are ordinary forms, without quoted local parts.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
EMAIL = rf"^(?=.{{1,64}}@){_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+{_LABEL}$"
URL = rf"^(?:(?:[Hh][Tt][Tt][Pp][Ss]?:)?//)?(?:[^\s/@:]+(?::[^\s/@]*)?@)?{_LABEL}(?:\.{_LABEL})*(?::[0-9]{{1,5}})?(?:[/?#]\S*)?$"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"
_H = r"[0-9A-Fa-f]{1,4}"
IPV6 = (
    "^(?:" + "|".join(
        [rf"(?:{_H}:){{7}}{_H}", r"::", rf"(?:{_H}:){{1,7}}:"]
        + [rf"(?:{_H}:){{1,{7 - n}}}(?::{_H}){{1,{n}}}" for n in range(1, 7)]
        + [rf":(?::{_H}){{1,7}}"]
    ) + ")$"
)


def is_email(c: Column) -> Column:
    return c.rlike(EMAIL)


def is_ip(c: Column, which: str = "") -> Column:
    tests = {"ipv4": c.rlike(IPV4), "ipv6": c.rlike(IPV6)}
    return tests[which] if which in tests else tests["ipv4"] | tests["ipv6"]


def _emails(c: Column) -> Column:
    parts = F.transform(F.split(c, ","), lambda e: F.trim(e))
    single = ~c.contains(",")
    return F.when(single, is_email(F.trim(c))).otherwise(F.forall(parts, lambda e: (e == "") | is_email(e)))


def _compare(op: str) -> Callable[[Column, object], Column]:
    def test(c: Column, bound: object) -> Column:
        # texts such as 5d, NaN or Infinity cast to a double but are no numbers here
        n = F.when(c.rlike(COMPARED), c.try_cast("double"))
        ok = {"<": n < bound, "<=": n <= bound, ">": n > bound, ">=": n >= bound}[op]
        return F.coalesce(ok, F.lit(False))

    return test


# Rule name → test that a value passes. Lengths count characters.
TESTS: dict[str, Callable[..., Column]] = {
    "regex": lambda c, p: c.rlike(p),
    "matches": lambda c, other: F.coalesce(c == F.col(other).cast("string"), F.lit(False)),
    "differs": lambda c, other: ~c.eqNullSafe(F.col(other).cast("string")),
    "min_length": lambda c, n: F.length(c) >= n,
    "max_length": lambda c, n: F.length(c) <= n,
    "exact_length": lambda c, n: F.length(c) == n,
    "valid_email": is_email,
    "valid_emails": _emails,
    "valid_url": lambda c: c.rlike(URL),
    "valid_ip": is_ip,
    "less_than": _compare("<"),
    "less_than_equal": _compare("<="),
    "greater_than": _compare(">"),
    "greater_than_equal": _compare(">="),
    "in_list": lambda c, values: c.isin([str(v) for v in values]),
    "natural_no_zero": lambda c: c.rlike(PATTERNS["natural"]) & ~c.rlike("^0+$"),
    "base64": lambda c: F.coalesce(F.base64(F.try_to_binary(c, F.lit("base64"))) == c, F.lit(False)),
    **{name: (lambda c, p=pattern: c.rlike(p)) for name, pattern in PATTERNS.items()},
}


def _failed(column: str, rule: Rule) -> Column:
    """True where a value breaks a rule. Blank values break only ``required`` and ``matches``."""
    name, args = (rule, ()) if isinstance(rule, str) else (rule[0], rule[1:])
    c = F.col(column).cast("string")
    blank = c.isNull() | (c == "")
    if name == "required":
        return F.coalesce(trim_ws(c) == "", F.lit(True))
    if name == "is_unique":
        return F.coalesce(F.col(_taken(column)), F.lit(False))
    passed = F.coalesce(TESTS[name](c, *args), F.lit(False))
    return ~passed if name == "matches" else ~blank & ~passed


def _taken(column: str) -> str:
    return f"_taken_{column}"


def _mark_taken(df: DataFrame, column: str, key: str, existing: DataFrame | None) -> DataFrame:
    """Mark values that exist already, or that an earlier row of the same table holds."""
    value = F.upper(F.col(column).cast("string")).alias("_v")
    firsts = df.where(F.col(column).isNotNull() & (F.col(column).cast("string") != "")).groupBy(value)
    known = firsts.agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n"))
    if existing is None:
        known = known.where(F.col("_n") > 1).withColumn("_old", F.lit(False))
    else:
        old = existing.select(F.upper(F.col(column).cast("string")).alias("_v")).distinct()
        known = known.join(old.withColumn("_old", F.lit(True)), "_v", "left")
        known = known.where((F.col("_n") > 1) | F.col("_old"))
    joined = join_on_unique(df.withColumn("_v", value), known.drop("_n"), ["_v"], "left", fold=False)
    taken = F.coalesce("_old", F.lit(False)) | (F.col("_first").isNotNull() & (F.col(key) != F.col("_first")))
    return joined.withColumn(_taken(column), taken).drop("_v", "_first", "_old")


def check_rows(
    df: DataFrame, rules: Mapping[str, Sequence[Rule]], key: str,
    existing: DataFrame | None = None, first_only: bool = True,
) -> DataFrame:
    """The table with an array ``violations`` of (column, rule) per row.

    Rules are checked in order; ``first_only`` reports the first broken rule of each column.
    ``("is_unique",)`` compares with ``existing`` and with earlier rows (smaller ``key``).
    """
    out = df
    for column, column_rules in rules.items():
        if any((r if isinstance(r, str) else r[0]) == "is_unique" for r in column_rules):
            out = _mark_taken(out, column, key, existing)
    per_column = []
    for column, column_rules in rules.items():
        broken = F.array_compact(F.array(*[
            F.when(_failed(column, r), F.struct(
                F.lit(column).alias("column"), F.lit(r if isinstance(r, str) else r[0]).alias("rule")
            )) for r in column_rules
        ]))
        per_column.append(F.slice(broken, 1, 1) if first_only else broken)
    return out.withColumn("violations", F.concat(*per_column)).select(*df.columns, "violations")


def violations(checked: DataFrame, key: str) -> DataFrame:
    """One row (key, column, rule) per violation."""
    return checked.select(key, F.inline("violations"))


def accepted(checked: DataFrame) -> DataFrame:
    """The rows without violation."""
    return checked.where(F.size("violations") == 0).drop("violations")


def validate_rows(
    df: DataFrame, rules: Mapping[str, Sequence[Rule]], key: str, **options
) -> tuple[DataFrame, DataFrame]:
    """(violations, accepted rows). Both come from one pass over each row's own values."""
    checked = check_rows(df, rules, key, **options)
    return violations(checked, key), accepted(checked)


def violation_counts(checked: DataFrame) -> DataFrame:
    return checked.select(F.inline("violations")).groupBy("column", "rule").agg(
        F.count(F.lit(1)).alias("amount")
    )
