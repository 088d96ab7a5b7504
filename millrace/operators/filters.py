"""Ordered rejection and licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_failure(df: DataFrame, checks: dict[str, Column], name: str = "reason") -> DataFrame:
    """df with the name of the first check that is true, or null: each row is counted under one reason."""
    reason = F.lit(None).cast("string")
    for label, failed in reversed(list(checks.items())):
        reason = F.when(F.coalesce(failed, F.lit(False)), label).otherwise(reason)
    return df.withColumn(name, reason)


#: Fixed names of folders that hold others' code.
VENDOR_PARTS = ("vendor", "vendors", "third_party", "third-party", "node_modules", "site-packages")


def vendor_truth(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"))).isin("1", "true", "yes", "y")


def code_file_checks(language: Column, allowed: list[str], license_type: Column, wanted: str, licenses: Column, vendor: Column, path: Column) -> dict[str, Column]:
    """The checks of a nested code file, in their order, for first_failure."""
    parts = F.filter(F.split(F.lower(path), r"[\\/]+"), lambda p: p != "")
    return {
        "language": ~F.coalesce(F.lower(F.trim(language)).isin(*[a.lower() for a in allowed]), F.lit(False)),
        "license_type": ~F.coalesce(F.lower(F.trim(license_type)) == wanted.lower(), F.lit(False)),
        "missing_detected_license": F.size(F.filter(F.coalesce(licenses, F.array().cast("array<string>")), lambda x: F.trim(x) != "")) == 0,
        "vendor": F.coalesce(vendor_truth(vendor), F.lit(False)),
        "vendor_path": F.coalesce(F.exists(parts, lambda p: p.isin(*VENDOR_PARTS)), F.lit(False)),
        "vendor_signal_missing": vendor.isNull() & path.isNull(),
    }


def license_list(value: Column) -> Column:
    """A licence text or JSON array of texts as a sorted list in lower case."""
    parts = F.coalesce(F.from_json(value, "array<string>"), F.split(value, r"[,;|]"))
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: F.lower(F.trim(x))), lambda x: x != "")))


def license_agreement(declared: DataFrame, resolved: DataFrame, key: str = "source_id") -> DataFrame:
    """Each declared source with whether its revision and licence are the resolved ones."""
    right = resolved.select(key, F.col("revision").alias("r__"), license_list(F.col("license")).alias("l__"))
    rows = declared.join(right, key, "left")
    return rows.withColumn("revision_equal", F.coalesce(F.col("revision") == F.col("r__"), F.lit(False))).withColumn("license_equal", F.coalesce(license_list(F.col("license")) == F.col("l__"), F.lit(False))).drop("r__", "l__")


def severe_repetition(text: Column, least_words: int = 30, ratio: float = 0.2) -> Column:
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    return (F.size(words) > least_words) & (F.size(F.array_distinct(words)) / F.size(words) < ratio)


def exact_keys(json: Column, keys: list[str]) -> Column:
    """Whether a JSON object has exactly these top-level keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(json)) == F.array(*[F.lit(k) for k in sorted(keys)]), F.lit(False))
