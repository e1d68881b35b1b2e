"""Cleaning of names, contacts and sales (Q16, Q17, Q19, Q21)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import date_of
from .windows import numbered

# An address: a local part of letters, digits and . _ % + -, an @, labels of letters, digits and - that each end in a dot,
# and a top-level name of two letters or more. All ASCII.
LOCAL, LABEL, TOP = r"[\w.%+-]+", r"[a-zA-Z\d-]+", r"[a-zA-Z]{2,}"
EMAIL = rf"^{LOCAL}@(?:{LABEL}\.)+{TOP}$"
# Separators of names that read as spaces, digits of a phone number, width and start of surrogate numbers.
SEPARATORS = "_@-"
DIGITS = 10
ID_WIDTH, ID_START = 3, 100


def name_parts(full_name: Column) -> tuple[Column, Column]:
    """First and last token, separators _ @ - read as spaces; the last of a single token is empty (Q16)."""
    spaced = F.trim(F.regexp_replace(F.translate(F.coalesce(full_name, F.lit("")), SEPARATORS, " " * len(SEPARATORS)), r"\s+", " "))
    tokens = F.split(spaced, " ")
    return F.get(tokens, F.lit(0)), F.when(F.size(tokens) > 1, F.element_at(tokens, -1)).otherwise("")


def email_of(column: Column) -> Column:
    return F.lower(F.trim(column))


def digits_of(column: Column) -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), "[^0-9]", "")


def contacts(df: DataFrame, name: str = "full_name", email: str = "email", phone: str = "phone", digits: int = DIGITS) -> DataFrame:
    """first_name, last_name, email, phone and a status: VALID with a first name, an address and enough digits (Q17)."""
    first, last = name_parts(F.col(name))
    out = df.withColumns({"first_name": first, "last_name": last, email: email_of(F.col(email)), phone: digits_of(F.col(phone))})
    valid = (F.length("first_name") > 0) & F.coalesce(F.col(email).rlike(EMAIL), F.lit(False)) & (F.length(phone) >= digits)
    return out.withColumn("status", F.when(valid, "VALID").otherwise("INVALID"))


def category_of(column: Column, mapping: Mapping[str, str]) -> Column:
    """The category of the first key that the value contains, without case; else the value with capitals (Q19)."""
    tests = [F.when(F.upper(column).contains(k.upper()), v) for k, v in mapping.items()]
    return F.coalesce(*tests, F.initcap(F.trim(column)))


def surrogate_ids(df: DataFrame, column: str, prefix: str, *order: str, width: int = ID_WIDTH, start: int = ID_START, bands: int = 0) -> DataFrame:
    """Missing ids as prefix + number (Q21), numbered among the missing, after the largest number that is taken, so none collides.

    No task holds all missing rows: they are numbered in bands. A number wider than `width` keeps all its digits.
    """
    number = F.regexp_extract(F.col(column), f"^{prefix}([0-9]+)$", 1).try_cast("long")
    most = df.agg(F.greatest(F.coalesce(F.max(number), F.lit(0)), F.lit(start).cast("long")).alias("_most")).withColumn("_one", F.lit(1))
    blank = F.col(column).isNull() | (F.trim(column) == "")
    out = numbered(df.filter(blank), "_row", *order, bands=bands).withColumn("_one", F.lit(1)).join(F.broadcast(most), "_one")
    number = (F.col("_row") + F.col("_most")).cast("string")
    made = out.withColumn(column, F.concat(F.lit(prefix), F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)))
    return df.filter(~blank).unionByName(made.select(*df.columns))


def clean_sales(df: DataFrame, formats: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd-MM-yyyy"), categories: Mapping[str, str] | None = None) -> DataFrame:
    """Dirty sales as text to typed, complete rows (Q19): salesperson, category, product, amount > 0 and a date are required."""
    clean = {
        "salesperson": F.initcap(F.regexp_replace(F.trim("salesperson"), r"\s+", " ")),
        "category": category_of(F.col("category"), categories or {}),
        "amount": F.trim("amount").try_cast("double"),
        "sale_date": date_of(F.trim("sale_date"), *formats),
        "region": F.coalesce(F.when(F.trim("region") != "", F.initcap(F.trim("region"))), F.lit("Unknown")),
        "email": F.when(F.coalesce(email_of(F.col("email")).rlike(EMAIL), F.lit(False)), email_of(F.col("email"))),
    }
    out = df.withColumns(clean)
    return out.filter((F.coalesce(F.col("salesperson"), F.lit("")) != "") & (F.col("amount") > 0) & F.col("sale_date").isNotNull())
