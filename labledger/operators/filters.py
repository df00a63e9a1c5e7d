"""Row filters and predicates over the typed order table.

Predicates are plain Column expressions so Catalyst can push them into the
parquet scan (``PushedFilters``) or prune ``lab`` partitions of a snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labledger.functions.clean import strip

# The unrestricted role and its lab label.
ADMIN_LAB = "Admin"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def assigned(c) -> Column:
    """a key is assigned when not null and not blank."""
    c = _c(c)
    return c.isNotNull() & (c != "")


def is_pending(c="date_received", text: bool = False) -> Column:
    """F1 predicate: no received date. On the typed column it is a plain null test, which reaches the parquet scan;
    ``text``: raw text, where blank counts as none."""
    c = _c(c)
    return c.isNull() | (strip(c) == "") if text else c.isNull()


def _is_text(df: DataFrame) -> bool:
    return df.schema["date_received"].dataType.simpleString() == "string"


def pending_orders(df: DataFrame) -> DataFrame:
    """F1."""
    return df.filter(is_pending(text=_is_text(df)))


def received_orders(df: DataFrame) -> DataFrame:
    """the complement of F1."""
    return df.filter(~is_pending(text=_is_text(df)))


def visible_rows(df: DataFrame, lab: str | None) -> DataFrame:
    """the admin (``lab`` None or Admin) sees every row, anyone else their lab."""
    if lab is None or lab == ADMIN_LAB:
        return df
    return df.filter(F.col("lab") == F.lit(lab))


def pattern_match(c, pattern: str, literal: bool = False) -> Column:
    """case-insensitive contains; the text is a regex unless ``literal``.

    A null value never matches (the original turned null into the text "nan").
    """
    if literal:
        m = F.lower(_c(c)).contains(pattern.lower())
    else:
        m = _c(c).rlike("(?i)" + pattern)
    return F.coalesce(m, F.lit(False))


def source_equals(c, value: str) -> Column:
    """F5."""
    return F.coalesce(_c(c) == F.lit(value), F.lit(False))


def order_search_predicate(vendor: str | None = None, grant: str | None = None,
                           source: str = "All", status: str = "All", literal: bool = False) -> Column:
    """conjunction of the search box filters; empty text / "All" means no filter."""
    p = F.lit(True)
    if vendor:
        p = p & pattern_match("vendor", vendor, literal)
    if grant:
        p = p & pattern_match("grant", grant, literal)
    if source and source != "All":
        p = p & source_equals("po_source", source)
    if status == "Pending":
        p = p & is_pending()
    elif status == "Received":
        p = p & ~is_pending()
    return p


def order_search(df: DataFrame, **kw) -> DataFrame:
    return df.filter(order_search_predicate(**kw))


def order_search_counts(df: DataFrame, **kw) -> DataFrame:
    """F6 caption "showing k of n" in one aggregation."""
    return df.agg(F.count_if(order_search_predicate(**kw)).alias("shown"), F.count(F.lit(1)).alias("total"))


def priced_lines(df: DataFrame, price_col: str) -> DataFrame:
    """price (a number or its text) present and positive; text that is no number counts as none."""
    return df.filter(F.coalesce(F.col(price_col).try_cast("double") > 0, F.lit(False)))


def named_lines(df: DataFrame, col: str = "item", min_len: int = 3) -> DataFrame:
    """F8: name present with at least ``min_len`` characters."""
    return df.filter(F.col(col).isNotNull() & (F.length(col) >= min_len))


def dated_rows(df: DataFrame, *cols: str) -> DataFrame:
    """drop rows whose date (or any other given column) is null."""
    cols = cols or ("date_ordered",)
    return df.dropna(subset=list(cols))


def positive_totals(df: DataFrame) -> DataFrame:
    """F11."""
    return df.filter(F.col("total") > 0)


def min_support(df: DataFrame, keys: list[str], n: int, name: str = "n_rows") -> DataFrame:
    """keys having at least ``n`` rows (HAVING count >= n), with the count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) >= n)


# Validation messages, in rule order.
VALIDATION_RULES = [
    ("item", "Item name is required"),
    ("qty", "Quantity must be greater than 0"),
    ("unit_price", "Price must be greater than 0"),
    ("vendor", "Vendor name is required"),
]


def validation_reason(item="item", qty="qty", unit_price="unit_price", vendor="vendor") -> Column:
    """the first failing rule, or OK."""
    blank_item = _c(item).isNull() | (strip(item) == "")
    blank_vendor = _c(vendor).isNull() | (strip(vendor) == "")
    return (F.when(blank_item, VALIDATION_RULES[0][1])
             .when(F.coalesce(_c(qty) <= 0, F.lit(True)), VALIDATION_RULES[1][1])
             .when(F.coalesce(_c(unit_price) <= 0, F.lit(True)), VALIDATION_RULES[2][1])
             .when(blank_vendor, VALIDATION_RULES[3][1])
             .otherwise("OK"))


def validate_orders(df: DataFrame) -> DataFrame:
    """F13 as a column; split with ``reason == 'OK'``."""
    return df.withColumn("reason", validation_reason())
