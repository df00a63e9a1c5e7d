"""Cleaning, coercion and formatting as Column expressions.

All of these are native expressions (whole-stage codegen, no Python rows).
Raw exports arrive as text; each rule is applied once at the ingest boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from labledger.functions.numeric import np_round

# Texts recognised or produced by the original importers.
ITEM_SEPARATOR = " - "
VENDOR_NOISE = "Contract no value"
PACK_UNITS = ["EA", "CS"]
ORIGIN_PREFIX = "Original Req#:"
BLANK_IDS = ["", "*", "nan"]
# Date texts accepted after normalisation (ISO, and month-first with dashes).
DATE_PATTERNS = ["yyyy-M-d", "M-d-yyyy"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space of any kind at both ends (F.trim removes spaces only)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def line_total(qty, unit_price) -> Column:
    """round(qty x unit price, 2), decimal half-up (money); null beyond the money type."""
    return F.round(F.try_multiply(_c(qty).try_cast("decimal(18,4)"), _c(unit_price).try_cast("decimal(18,4)")), 2).try_cast("decimal(18,2)")


def coerce_amount(c) -> Column:
    """Text or number to double; unparsable, NaN or null -> 0."""
    d = F.expr("try_cast(NULL AS DOUBLE)") if c is None else _c(c).try_cast("double")
    return F.when(F.isnan(d), F.lit(0.0)).otherwise(F.coalesce(d, F.lit(0.0)))


def coerce_date(c) -> Column:
    """Text to date by the accepted patterns; anything else -> null."""
    s = _c(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(p)).cast("date") for p in DATE_PATTERNS])


def date_parts(c="date_ordered") -> list[Column]:
    """P5: year, calendar month start, Monday-start week."""
    d = _c(c)
    return [F.year(d).alias("year"), F.trunc(d, "month").alias("month_start"),
            F.date_trunc("week", d).cast("date").alias("week_start")]


def clean_item_name(c) -> Column:
    """Text before the first " - " (trimmed, <= 100 chars); without the
    separator the first 100 chars, trimmed. Null -> ""."""
    x = _c(c).cast("string")
    head = F.substring(strip(F.split_part(x, F.lit(ITEM_SEPARATOR), F.lit(1))), 1, 100)
    whole = strip(F.substring(x, 1, 100))
    return F.when(x.isNull(), F.lit("")).when(x.contains(ITEM_SEPARATOR), head).otherwise(whole)


def clean_vendor(c) -> Column:
    """First 100 chars; if the contract phrase is there, remove it and trim."""
    v = F.substring(_c(c).cast("string"), 1, 100)
    return (F.when(v.isNull(), F.lit(""))
             .when(v.contains(VENDOR_NOISE), strip(F.replace(v, F.lit(VENDOR_NOISE), F.lit(""))))
             .otherwise(v))


def integer_id_text(c) -> Column:
    """Number-looking id to integer text ("118490.0" -> "118490"); null or
    blank -> ""; anything unparsable -> null (to be quarantined)."""
    x = _c(c).cast("string")
    n = x.try_cast("double").try_cast("bigint")
    return F.when(x.isNull() | (strip(x) == ""), F.lit("")).otherwise(n.cast("string"))


def split_percent_text(c) -> Column:
    """Number -> "{:.0f}%" (ties to even); unparsable (e.g. "50%") -> ""."""
    x = _c(c).cast("string")
    d = x.try_cast("double")
    ok = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(ok, F.format_string("%.0f%%", np_round(d, 0))).otherwise(F.lit(""))


def normalize_date_text(c) -> Column:
    """P10: first space-separated token with "/" turned into "-"; null -> ""."""
    x = _c(c).cast("string")
    return F.when(x.isNull(), F.lit("")).otherwise(
        F.replace(F.split_part(x, F.lit(" "), F.lit(1)), F.lit("/"), F.lit("-")))


def parse_pack_qty(c) -> Column:
    """Strip pack units and blanks; empty, unparsable or NaN -> 1."""
    s = _c(c).cast("string")
    for u in PACK_UNITS:
        s = F.replace(s, F.lit(u), F.lit(""))
    d = strip(s).try_cast("double")
    return F.when(F.isnan(d), F.lit(1.0)).otherwise(F.coalesce(d, F.lit(1.0)))


def amount_fallbacks(qty, price, total) -> tuple[Column, Column, Column]:
    """Qty default 1, unit price default 0, total = given or qty x price.

    Returns typed columns: qty double, unit_price decimal(18,4), total decimal(18,2); a total beyond the money type is
    null, which the imports quarantine.
    """
    q = _c(qty).cast("string").try_cast("double")
    q = F.when(F.isnan(q), F.lit(None)).otherwise(q)
    q = F.coalesce(q, F.lit(1.0))
    p = F.coalesce(_c(price).cast("string").try_cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)"))
    t = F.coalesce(_c(total).cast("string").try_cast("decimal(18,2)"),
                   F.try_multiply(q.try_cast("decimal(18,4)"), p).try_cast("decimal(18,2)"))
    return q, p, t


def extract_origin_req(c) -> Column:
    """Text after "Original Req#:" up to the first ".", trimmed."""
    x = _c(c)
    return F.when(x.contains(ORIGIN_PREFIX),
                  strip(F.split_part(F.split_part(x, F.lit(ORIGIN_PREFIX), F.lit(2)), F.lit("."), F.lit(1))))


def origin_id(c) -> Column:
    """Inventory request id as text: no-break spaces removed, trimmed."""
    return strip(F.replace(_c(c).cast("string"), F.lit("\u00a0"), F.lit("")))


def is_blank_id(c) -> Column:
    x = _c(c)
    return x.isNull() | x.isin(*BLANK_IDS)


def origin_note(c) -> Column:
    """P14: "Original Req#: X" for a real id, "" for blank, "*" or "nan"."""
    o = origin_id(c)
    return F.when(is_blank_id(o), F.lit("")).otherwise(F.concat(F.lit(ORIGIN_PREFIX + " "), o))


def origin_key(c) -> Column:
    """Compare ids the way notes are read back (cut at the first ".")."""
    return strip(F.split_part(origin_id(c), F.lit("."), F.lit(1)))


def po_key(c) -> Column:
    """PO number as text, a trailing ".0" from a float column removed."""
    x = strip(_c(c).cast("string"))
    return F.when(x.endswith(".0"), F.substring(x, F.lit(1), F.length(x) - 2)).otherwise(x)


def money_text(c) -> Column:
    """P16: "$1,234.50" (presentation only)."""
    return F.concat(F.lit("$"), F.format_number(_c(c).cast("double"), 2))


def percent_text(c, signed: bool = True) -> Column:
    """P16: "+5.3%" or "12.3%" (presentation only)."""
    return F.format_string("%+.1f%%" if signed else "%.1f%%", _c(c).cast("double"))


# The unrestricted account and the fallback lab label.
UNKNOWN_LAB = "Unknown Lab"


def owner_to_lab(email, admin_email: str, home_domain: str | None, home_lab: str | None) -> Column:
    """Admin -> Admin; the home domain -> the home lab; otherwise the
    first label of the domain, capitalised, + " Lab"; no domain -> Unknown Lab.
    Without a home domain (None) no domain is special; ``owner_labs`` looks domains up in a table."""
    e = _c(email)
    dom = F.split_part(e, F.lit("@"), F.lit(2))
    first = F.split_part(dom, F.lit("."), F.lit(1))
    admin = F.when(e == F.lit(admin_email), F.lit("Admin"))
    known = admin if home_domain is None else admin.when(e.endswith("@" + home_domain), F.lit(home_lab))
    return (known.when(~e.contains("@"), F.lit(UNKNOWN_LAB))
             .otherwise(F.concat(F.initcap(first), F.lit(" Lab"))))
