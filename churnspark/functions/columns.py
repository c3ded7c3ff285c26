"""Column builders. All are native expressions, so they stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings of "no value" in the account export.
MISSING_SPELLINGS = ("", "N/A", "NA", "None", "none", "null", "NULL", "NaN", "None mentioned")

# Delimiters between products in one rollup cell. The export uses
# newlines; the compatible set leaves newline-separated cells whole.
PRODUCT_DELIMITERS = r"[;,\n]"
PRODUCT_DELIMITERS_COMPAT = r"[;,]"

# Fixed value: everything that is neither a letter nor a digit separates tokens.
TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_money(c) -> Column:
    """``$1,234.50`` or ``1234.5`` to DECIMAL(18,2); anything else to NULL."""
    return F.regexp_replace(col(c).cast("string"), r"[$,]", "").try_cast("decimal(18,2)")


def null_if_missing(c) -> Column:
    """NULL for every spelling of "no value"."""
    value = F.trim(col(c))
    return F.when(~value.isin(*MISSING_SPELLINGS), value)


def parse_date(c) -> Column:
    """``M/d/yyyy`` text to DATE, NULL if it is not one."""
    return F.try_to_date(col(c), "M/d/yyyy")


def truncate(c, n: int) -> Column:
    """First ``n`` characters, with an ellipsis only if something was cut."""
    text = col(c)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def slug(c) -> Column:
    return F.lower(F.regexp_replace(col(c), r"[ -]", "_"))


def dashed(c) -> Column:
    return F.lower(F.regexp_replace(col(c), " ", "-"))


def prettify(c) -> Column:
    """``multi_query`` to ``Multi Query``."""
    return F.initcap(F.regexp_replace(col(c), "_", " "))


def clamp(c, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(c)))


def word_count(c) -> Column:
    return F.regexp_count(col(c), F.lit(r"\S+")).cast("bigint")


def token_estimate(c) -> Column:
    """Rough model-token count of a text: 1.3 per word."""
    return F.floor(word_count(c) * F.lit(1.3)).cast("bigint")


def split_list(c, delimiters: str = PRODUCT_DELIMITERS) -> Column:
    """Delimited cell to an array of trimmed values without blanks or sentinels."""
    parts = F.transform(F.split(col(c), delimiters), lambda x: F.trim(x))
    return F.filter(parts, lambda x: ~x.isin("", "N/A", "None"))


def tokens(c) -> Column:
    """Lower-cased letter/digit runs, in order, with repeats."""
    return F.filter(F.split(F.lower(col(c)), TOKEN_SEPARATOR), lambda t: t != "")


def sentences(c) -> Column:
    """Pieces that end with ``.``, ``!`` or ``?`` before white space."""
    return F.split(F.regexp_replace(col(c), r"([.!?])\s+", "$1\u0001"), "\u0001")


def name_in_parentheses_question(c) -> Column:
    """Account name in a question such as ``plan for NAME (SMB)``; NULL without one."""
    # Fixed value: the pattern of questions that name an account.
    found = F.trim(F.regexp_extract(col(c), r"for ([^(]+)\s*\(", 1))
    return F.when(found != "", found)


def list_items(c, limit: int | None = None) -> Column:
    """Items of a numbered or dashed list, without their markers."""
    lines = F.transform(F.split(col(c), "\n"), lambda x: F.trim(x))
    marked = F.filter(lines, lambda x: x.rlike(r"^([0-9]|-)"))
    bare = F.transform(marked, lambda x: F.trim(F.regexp_replace(x, r"^([0-9]+[.)]?|-+)\s*", "")))
    items = F.filter(bare, lambda x: x != "")
    return F.slice(items, 1, limit) if limit else items


def text_lines(c) -> Column:
    """Non-blank lines of a text, trimmed."""
    return F.filter(F.transform(F.split(col(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def json_object_text(c) -> Column:
    """The JSON object inside a fenced block, else the text itself."""
    fenced = F.regexp_extract(col(c), r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.trim(col(c)))


def money0(c) -> Column:
    """``$1,234``, rounded half up."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast("decimal(28,0)"), 0))


def money2(c) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(col(c).cast("decimal(28,2)"), 2))


def percent0(share) -> Column:
    """``0.375`` to ``38%``, rounded half up."""
    return F.concat(F.floor(col(share) * 100 + 0.5).cast("string"), F.lit("%"))


def one_decimal(c) -> Column:
    """Number as text with one decimal."""
    return F.round(col(c), 1).cast("decimal(18,1)").cast("string")


def day(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def days_from(as_of, n) -> Column:
    """Day ``n`` days after (before, if negative) ``as_of`` as ``yyyy-MM-dd``."""
    return day(F.date_add(col(as_of).cast("date"), n if isinstance(n, Column) else F.lit(n)))


def pick(*branches, default=None) -> Column:
    """CASE from (condition, value) pairs."""
    expr = None
    for condition, value in branches:
        value = value if isinstance(value, Column) else F.lit(value)
        expr = F.when(condition, value) if expr is None else expr.when(condition, value)
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def present(*entries) -> Column:
    """Array of the entries that are not NULL, in order."""
    return F.array_compact(F.array(*entries))
