"""Column expressions for cleaning and derived measures. All are built-in functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Domains of the cleaned tables.
ORDER_STATUS = ("COMPLETED", "PENDING", "SHIPPED", "PROCESSING", "CANCELLED", "REFUNDED")
PAYMENT_METHODS = ("credit_card", "debit_card", "paypal", "apple_pay", "google_pay", "bank_transfer", "buy_now_pay_later")
EVENT_TYPES = ("page_view", "product_view", "add_to_cart", "remove_from_cart", "checkout", "purchase", "search", "wishlist_add", "review_submit")
EMAIL = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"


def as_date(as_of: dt.date | str) -> Column:
    return F.lit(str(as_of)).cast("date")


def strip(c: Column) -> Column:
    """All white space at both ends, tabs included."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_lower(c: Column) -> Column:
    return F.lower(strip(c))


def strip_upper(c: Column) -> Column:
    return F.upper(strip(c))


def strip_title(c: Column) -> Column:
    """Title case that starts anew after every non-letter (O'Brien), which initcap doesn't."""
    runs = F.regexp_extract_all(strip(c), F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def valid_email(c: Column) -> Column:
    """Checked on the raw value: padded addresses fail; null fails."""
    return F.coalesce(c.rlike(EMAIL), F.lit(False))


def to_number_or(c: Column, kind: str, default) -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def to_ts_or_null(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c.cast("string")), c.cast("string").try_cast("timestamp"))


def to_date_or_null(c: Column) -> Column:
    return c.cast("string").try_cast("date")


def age(born: Column, as_of) -> Column:
    return F.floor(F.datediff(as_date(as_of), born) / 365.25).cast("int")


def age_group(years: Column) -> Column:
    """Right-closed bands; ages outside (0, 150] and null ages have none."""
    return (
        F.when((years > 0) & (years <= 24), "18-24").when((years > 24) & (years <= 34), "25-34").when((years > 34) & (years <= 44), "35-44")
        .when((years > 44) & (years <= 54), "45-54").when((years > 54) & (years <= 150), "55+")
    )


def age_group_by_year(born: Column, as_of) -> Column:
    """Bands by difference of calendar years; null births fall into the last."""
    years = F.year(as_date(as_of)) - F.year(born)
    return F.when(years < 25, "18-24").when(years < 35, "25-34").when(years < 45, "35-44").when(years < 55, "45-54").otherwise("55+")


def half_up(c: Column, digits: int) -> Column:
    """A double rounded as SQL engines do, by its multiple of 10 ** ``digits``; Spark's own rounds the shortest decimal that reads as the double, which differs near halves."""
    return F.round(c * F.lit(10.0**digits)) / F.lit(10.0**digits)


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * 100, F.nullif(whole, F.lit(0))), digits)


def gross_margin_pct(price: Column, cost: Column) -> Column:
    return pct(price - cost, price)


def repair_cost(cost: Column, price: Column, factor: float = 0.5) -> Column:
    return F.when(cost < 0, price * F.lit(factor)).otherwise(cost)


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")).isin("true", "1", "yes"), F.lit(False))


def in_domain_or(c: Column, domain, default: str) -> Column:
    return F.when(c.isin(list(domain)), c).otherwise(F.lit(default))


def fill(c: Column, value) -> Column:
    return F.coalesce(c, F.lit(value))


def truncate(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def sentiment(rating: Column) -> Column:
    return (rating - 3) / 2


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def net_revenue(total: Column, discount: Column, shipping: Column) -> Column:
    """Total less discount and shipping, as the metric is defined, though totals are net of discount already."""
    return F.round(total - discount - shipping, 2)


def line_total(quantity: Column, price: Column, discount_pct: Column) -> Column:
    return F.round(quantity * price * (1 - discount_pct / 100), 2)


def date_key(d: Column) -> Column:
    return F.date_format(d, "yyyyMMdd").cast("int")


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(F.coalesce(first, F.lit("")), F.lit(" "), F.coalesce(last, F.lit(""))))
