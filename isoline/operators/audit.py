"""Privacy and contract audits: violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the audits: patterns and key hints.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(^|[^\d])\+?\d[\d .()\-]{8,}\d([^\d]|$)"
SECRET_KEYS = ("api_key", "secret", "token", "authorization", "password", "private_key")
PII_KEYS = ("patient_name", "patientname", "mrn", "medical_record", "hospital_number", "id_card", "phone", "email", "date_of_birth", "dob", "address")
REDACTED = ("", "[redacted]", "redacted", "***", "null", "none")
MEDIA_STARTS = ("data:image/", "data:video/", "data:application/dicom")


def text_codes(text: Column) -> Column:
    """Codes of what a text leaf holds: personal patterns and embedded media."""
    return F.array_compact(F.array(
        F.when(text.rlike(EMAIL), F.lit("email")), F.when(text.rlike(PHONE), F.lit("phone")),
        F.when(F.contains(text, F.lit(MEDIA_STARTS[0])) | F.contains(text, F.lit(MEDIA_STARTS[1])) | F.contains(text, F.lit(MEDIA_STARTS[2])), F.lit("embedded_media"))))


def audit_texts(df: DataFrame, source: str, text: str) -> DataFrame:
    """(source, code) for each text and code."""
    return df.select(F.lit(source).alias("source"), F.explode(text_codes(F.coalesce(text, F.lit("")))).alias("code"))


def hinted(path: Column, hints: tuple[str, ...]) -> Column:
    low = F.lower(path)
    out = F.lit(False)
    for h in hints:
        out = out | F.contains(low, F.lit(h))
    return out


def audit_leaves(leaves: DataFrame) -> DataFrame:
    """Violations (…, path, code) of JSON leaves (path, value as text; null for null)."""
    value = F.trim(F.coalesce("value", F.lit("")))
    redacted, leaf = F.lower(value).isin(*REDACTED), F.element_at(F.split("path", "\\."), -1)
    codes = F.array_compact(F.array(
        F.when(hinted(F.col("path"), SECRET_KEYS) & ~F.endswith(F.lower(leaf), F.lit("_present")) & ~redacted, F.lit("secret_value_present")),
        F.when(hinted(F.col("path"), PII_KEYS) & (value != ""), F.lit("pii_field_present")),
        F.when(value.rlike(EMAIL) | value.rlike(PHONE), F.lit("pii_pattern_present"))))
    return leaves.withColumn("code", F.explode(codes))


def violations(df: DataFrame, key: list[str], rules: dict[str, Column], unique: list[str] | None = None) -> DataFrame:
    """(key, rule) for each row and rule that it breaks; rows that share a unique key break ``duplicate``."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    out = df.select(*key, F.explode(broken).alias("rule"))
    if unique:
        twice = df.groupBy(*unique).agg(F.count("*").alias("n")).filter("n > 1").select(*unique)
        out = out.unionByName(df.join(twice, unique, "left_semi").select(*key, F.lit("duplicate").alias("rule")))
    return out
