"""Personal data in copy: detection, gates, tenants, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pattern of each kind of personal data.
PATTERNS = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "credit_card": r"\b(?:\d[ -]*?){13,19}\b",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s](?!00)\d{2}[-\s](?!0000)\d{4}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b",
    "phone": r"(?:\+\d{1,3}[\s.-]?)?(?:\(\d{1,4}\)[\s.-]?)?\d[\d\s.()-]{7,17}\d",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b",
    "postal_address": r"(?i)\b\d{1,5}\s+[A-Za-z0-9.'-]+(?:\s+[A-Za-z0-9.'-]+){0,3}\s+(?:street|st|avenue|ave|road|rd|boulevard|blvd|lane|ln|drive|dr|court|ct|way|close|crescent)\b",
    "date_of_birth": r"(?i)\b(?:dob|d\.o\.b\.?|date of birth|born)\b[\s:]*\d{1,4}[/\-.]\d{1,2}[/\-.]\d{1,4}",
}
TENANT = "^[a-zA-Z0-9][a-zA-Z0-9_-]{2,63}$"


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = digits(m)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def plausible_phone(m: Column) -> Column:
    """10 to 15 digits, not all zero, and punctuated or of 11 digits at least."""
    d = digits(m)
    return F.length(d).between(10, 15) & ~d.rlike("^0+$") & (F.trim(m).rlike(r"[+()\-.\s]") | (F.length(d) >= 11))


CHECKS = {"credit_card": luhn, "phone": plausible_phone}


def findings(t: Column, kind: str) -> Column:
    """The matches of one kind that pass its check. Values stay inside the expression."""
    found = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(PATTERNS[kind]), F.lit(0))
    return F.filter(found, CHECKS[kind]) if kind in CHECKS else found


def scan_pii(t: Column) -> Column:
    """array<struct(kind, count)> of the kinds that occur; a match is never returned."""
    rows = [F.struct(F.lit(k).alias("kind"), F.size(findings(t, k)).alias("count")) for k in PATTERNS]
    return F.filter(F.array(*rows), lambda r: r["count"] > 0)


def locate_pii(t: Column) -> Column:
    """array<struct(kind, start, len)> of every match that passes its check, by start and kind; start counts from 0.

    The places of a kind are a fold over what lies between its matches and the matches' lengths. Both come from one pattern
    over the whole text, so a match is placed where the pattern found it, whatever equals it elsewhere. Its value stays
    inside the expression.
    """
    text = F.coalesce(t, F.lit(""))

    def fold(kind: str):
        def step(a, x):
            ok = CHECKS[kind](x["m"]) if kind in CHECKS else F.lit(True)
            at = a["end"] + F.length(x["gap"])
            row = F.struct(at.alias("start"), F.lit(kind).alias("kind"), F.length(x["m"]).alias("len"))
            return F.struct((at + F.length(x["m"])).alias("end"), F.concat(a["all"], F.when(ok, F.array(row)).otherwise(F.array().cast(PLACES))).alias("all"))

        return step

    found = []
    for kind, pattern in PATTERNS.items():
        gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        both = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m")))
        start = F.struct(F.lit(0).alias("end"), F.array().cast(PLACES).alias("all"))
        found.append(F.aggregate(both, start, fold(kind))["all"])
    return F.transform(F.array_sort(F.concat(*found)), lambda r: F.struct(r["kind"].alias("kind"), r["start"].alias("start"), r["len"].alias("len")))


PLACES = "array<struct<start: int, kind: string, len: int>>"


def cell_report(df: DataFrame, row_id: str, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` cells that hold personal data by row and column, one row: how many there are, in how many rows).

    A report is cut so that it can be read; the count beside it is of all. Rows are ordered by their id.
    """
    cells = scan_cells(df, row_id)
    total = cells.agg(F.count("*").alias("cells"), F.count_distinct("row").alias("rows"))
    return cells.orderBy("row", "column").limit(most), total


def scan_cells(df: DataFrame, row_id: str) -> DataFrame:
    """(row, column, kinds) of every string cell that holds personal data."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name != row_id]
    long = df.unpivot([row_id], names, "column", "cell")
    kinds = F.transform(scan_pii(F.col("cell")), lambda r: r["kind"])
    return long.select(F.col(row_id).alias("row"), "column", kinds.alias("kinds")).where(F.size("kinds") > 0)


def pii_gate(df: DataFrame, row_id: str) -> DataFrame:
    """The table itself, or an error that names kinds and a count only: rejected, never redacted."""
    found = scan_cells(df, row_id).agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("kinds")).first()
    if found.n:
        raise ValueError(f"{found.n} cells hold personal data ({', '.join(found.kinds)}); the upload is rejected")
    return df


def quarantine(df: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(clean, held back): for streams, where one row must not stop the rest."""
    bad = F.size(scan_pii(F.col(text))) > 0
    return df.where(~bad), df.where(bad)


def pii_preview(df: DataFrame, row_id: str, problem: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that break a rule with the rule, cells that hold personal data): what an upload would be rejected for."""
    return df.select(F.col(row_id).alias("row"), problem.alias("problem")).where("problem is not null"), scan_cells(df, row_id)


def tenant_stamp(df: DataFrame, tenant_id: str) -> DataFrame:
    """Rows as the tenant's own, whatever tenant they claim."""
    import re

    if not re.match(TENANT, tenant_id):
        raise ValueError("not a tenant id")
    return df.withColumn("tenant_id", F.lit(tenant_id))


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    """Only the tenant's own rows; the id itself is checked."""
    import re

    if not re.match(TENANT, tenant_id):
        raise ValueError("not a tenant id")
    return df.where(F.col("tenant_id") == tenant_id)


def apply_retention(df: DataFrame, days: int, now: Column, time: str = "created_at") -> DataFrame:
    """Rows no older than ``days``. A time that cannot be read is an error, not a reason to keep."""
    at = F.col(time).try_cast("timestamp")
    sound = F.when(at.isNull(), F.raise_error(F.lit("a row's time cannot be read")).cast("boolean")).otherwise(F.lit(True))
    return df.where(sound & ((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400.0 <= days))
