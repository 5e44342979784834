"""Masking and row access by role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENGINEER, ANALYST, ADMIN, BI = "DATA_ENGINEER", "DATA_ANALYST", "SYSADMIN", "BI_USER"
CLEAR = (ENGINEER, ADMIN)
REDACTED = "**REDACTED**"


def mask_email(c: Column, role: str) -> Column:
    return c if role in CLEAR else F.regexp_replace(c, "^[^@]+", "***") if role == ANALYST else F.when(c.isNotNull(), REDACTED)


def mask_phone(c: Column, role: str) -> Column:
    return c if role in CLEAR else F.concat(F.left(c, F.lit(3)), F.lit("****"), F.right(c, F.lit(2)))


def mask_name(c: Column, role: str) -> Column:
    return c if role in (*CLEAR, ANALYST) else F.when(c.isNotNull(), REDACTED)


MASKS = {"email": mask_email, "phone": mask_phone, "first_name": mask_name, "last_name": mask_name, "full_name": mask_name}


def apply_masking(df: DataFrame, role: str) -> DataFrame:
    """Masks the personal columns that are there; the full name too, which holds the same data as its parts."""
    return df.withColumns({c: mask(F.col(c), role) for c, mask in MASKS.items() if c in df.columns})


def row_access(df: DataFrame, role: str, region: str | None = None, column: str = "country") -> DataFrame:
    if role in (ENGINEER, ANALYST, ADMIN):
        return df
    return df.filter(F.col(column) == region) if role == BI and region is not None else df.filter(F.lit(False))
