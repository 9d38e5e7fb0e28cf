"""Scalar cleaning expressions (C1-C12). Each maps columns to columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace as Unicode defines it, as one regex class that Java and RE2 both read
WS_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WS_CHARS = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
         0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)
# Texts that mean "no value" (fixed values)
NULL_TOKENS = ["", "None", "null", "NULL"]
TS_CODE = r"^[0-9]{6}\.(SH|SZ|BJ)$"
#: The same code with as many digits as a key needs, for sources that number more than a million securities.
LONG_TS_CODE = r"^[0-9]{6,}\.(SH|SZ|BJ)$"


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both ends."""
    return F.btrim(col, F.lit(WS_CHARS))


def let(col: Column, use) -> Column:
    """``use(col)`` with ``col`` bound once.

    Written out, a value that is used several times is expanded each time, and
    a record with many parsed fields then generates one method so large that
    the JVM runs it uncompiled (over 100 microseconds per row).
    """
    return F.get(F.transform(F.array(col), use), F.lit(0))


def _present(trimmed: Column) -> Column:
    return F.when(~trimmed.isin(NULL_TOKENS), trimmed)


def clean_str(col: Column) -> Column:
    """Trimmed text, NULL for the null tokens."""
    return let(strip(col.cast("string")), _present)


def upper_trim(col: Column) -> Column:
    """C2."""
    return F.upper(clean_str(col))


def _read_date(text: Column) -> Column:
    compact = F.when(
        text.rlike(r"^\d{8}$"),
        F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)),
    )
    dashed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text)
    return F.coalesce(compact, dashed).try_cast("date")


def parse_date(col: Column) -> tuple[Column, Column]:
    """``(date, bad)``; ``bad`` marks a value that is present but unreadable."""
    text = clean_str(col)
    return let(text, _read_date), let(text, lambda t: t.isNotNull() & _read_date(t).isNull())


def _read_decimal(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("decimal(38,6)")


def decimal_or_null(col: Column) -> tuple[Column, Column]:
    """C4: ``(decimal, bad)``; thousands separators are dropped, NULL never becomes 0."""
    text = clean_str(col)
    return let(text, _read_decimal), let(text, lambda t: t.isNotNull() & _read_decimal(t).isNull())


def _read_code(text: Column, form: str) -> Column:
    return F.when(text.rlike(form), text)


def valid_ts_code(col: Column, form: str = TS_CODE) -> tuple[Column, Column]:
    """``(code, bad)``; a missing code is bad too. ``form`` is the pattern of a code."""
    code = let(upper_trim(col), lambda t: _read_code(t, form))
    return code, code.isNull()


def generated(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Adds columns that are computed once a row.

    A plain column is expanded into each of its uses; ``let`` prevents that, but
    the JVM interprets it. Columns of a generator are compiled.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def read_fields(
    df: DataFrame, source: Callable[[str], Column], kinds: Mapping[str, str], code_form: str = TS_CODE
) -> DataFrame:
    """C1-C5 for all fields of a record, each read once: adds ``_<name>`` and ``_<name>_bad``.

    ``source(name)`` is the raw value of a field, ``kinds`` names what it is:
    text, code, date or number. The results are those of ``clean_str``,
    ``valid_ts_code``, ``parse_date`` and ``decimal_or_null``; a text is never bad.
    """
    trimmed = generated(df, {f"_{name}_text": strip(source(name).cast("string")) for name in kinds})
    text = {name: _present(F.col(f"_{name}_text")) for name in kinds}
    read = {
        "text": lambda n: text[n],
        "code": lambda n: _read_code(F.upper(text[n]), code_form),
        "date": lambda n: _read_date(text[n]),
        "number": lambda n: _read_decimal(text[n]),
    }
    values = generated(trimmed, {f"_{n}": read[kind](n) for n, kind in kinds.items()})
    bad = {
        "text": lambda n: F.lit(False),
        "code": lambda n: F.col(f"_{n}").isNull(),
        "date": lambda n: text[n].isNotNull() & F.col(f"_{n}").isNull(),
        "number": lambda n: text[n].isNotNull() & F.col(f"_{n}").isNull(),
    }
    return values.withColumns({f"_{n}_bad": bad[kind](n) for n, kind in kinds.items()}).drop(*[f"_{n}_text" for n in kinds])


def map_value(col: Column, mapping: Mapping[str, str], default: Column | None = None) -> Column:
    """Closed mapping with a default."""
    pairs = [F.lit(item) for pair in mapping.items() for item in pair]
    mapped = F.try_element_at(F.create_map(*pairs), col)
    return mapped if default is None else F.coalesce(mapped, default)


def exchange_code(explicit: Column, ts_code: Column, by_suffix: Mapping[str, str]) -> Column:
    """An explicit known exchange wins over the one named by the code suffix."""
    known = F.upper(clean_str(explicit))
    return F.coalesce(
        F.when(known.isin(list(by_suffix.values())), known),
        map_value(F.element_at(F.split(ts_code, r"\."), -1), by_suffix),
    )


def first_non_null(*cols: Column) -> Column:
    """C7."""
    return F.coalesce(*[clean_str(c) for c in cols])


def normalize_ws(col: Column) -> Column:
    """Whitespace runs become one space, ends trimmed."""
    return strip(F.regexp_replace(col, WS_CLASS + "+", " "))


def contains_ci(col: Column, query: str) -> Column:
    """Literal, case-insensitive contains; ``%`` and ``_`` carry no meaning."""
    return F.contains(F.lower(col), F.lower(F.lit(query)))


def is_complete_fy(period_end: Column, value: Column) -> Column:
    """A year ending December 31 with a value."""
    return (F.month(period_end) == 12) & (F.dayofmonth(period_end) == 31) & value.isNotNull()


# Spellings of the declared transforms (fixed values)
CURRENCY_NAMES = {"CNY": "CNY", "RMB": "CNY", "人民币": "CNY", "USD": "USD", "HKD": "HKD"}
TRUE_WORDS = ["1", "Y", "YES", "TRUE", "T"]
FALSE_WORDS = ["0", "N", "NO", "FALSE", "F"]


def apply_transform(col: Column, name: str) -> Column:
    """C11: transform named by the dataset registry."""
    text = clean_str(col)
    if name == "trim":
        return text
    if name == "upper_trim":
        return F.upper(text)
    if name == "lower_trim":
        return F.lower(text)
    if name == "parse_date":
        return parse_date(col)[0]
    if name == "decimal_or_null":
        return decimal_or_null(col)[0]
    if name == "integer_or_null":
        return F.replace(text, F.lit(","), F.lit("")).try_cast("bigint")
    if name == "normalize_url":
        lowered = F.lower(text)
        full = F.when(lowered.rlike("^https?://"), text).otherwise(F.concat(F.lit("http://"), text))
        host = F.lower(F.regexp_extract(full, r"^(?i:https?://[^/]+)", 0))
        rest = F.regexp_replace(full, r"^(?i:https?://[^/]+)", "")
        return F.regexp_replace(F.concat(host, rest), "/+$", "")
    if name == "normalize_currency":
        return map_value(F.upper(text), CURRENCY_NAMES, F.upper(text))
    if name == "bool_from_source":
        word = F.upper(text)
        return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)
    if name == "normalize_exchange":
        word = F.upper(text)
        return map_value(word, {"SH": "SSE", "SZ": "SZSE", "BJ": "BSE"}, word)
    if name == "normalize_industry_level":
        word = F.upper(text)
        return F.when(word.rlike("^[123]$"), F.concat(F.lit("L"), word)).otherwise(word)
    raise ValueError(f"unknown transform {name!r}")


def validation_reasons(exchange: Column, list_date: Column, delist_date: Column) -> Column:
    """Reasons of the declared checks, empty when all hold."""
    return F.array_compact(
        F.array(
            F.when(~exchange.isin("SSE", "SZSE", "BSE"), F.lit("exchange not in set")),
            F.when(list_date > delist_date, F.lit("list_date after delist_date")),
        )
    )
