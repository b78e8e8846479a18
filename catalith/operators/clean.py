"""Cleaning: headers, text, dates, duplicates, numbers, in that order.

Duplicates are judged before numbers are validated, so a gross of 0 still counts
as a filled cell there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith import fixed
from catalith.functions import text as tx
from catalith.functions import values as vl
from catalith.operators.dedup import EXAMPLES, dedup_counters, is_text, remove_duplicates
from catalith.operators.reports import count_where, long_report, union_reports


def header_names() -> dict[str, str]:
    """Accepted header -> stored name, for spaced and underscored headers."""
    names = {}
    for header in fixed.RAW_HEADERS:
        stored = fixed.SHORT_NAMES.get(header, header.lower().replace(" ", "_"))
        names[header] = stored
        names[header.replace(" ", "_")] = stored
    return names


def applied_names(df: DataFrame) -> dict[str, str]:
    names = header_names()
    return {column: names[column] for column in df.columns if column in names}


def rename_headers(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(applied_names(df))


def _text_columns(df: DataFrame) -> list[str]:
    return [c for c in fixed.STRING_COLUMNS if c in df.columns]


def _with_standard_text(df: DataFrame, prefix: str) -> DataFrame:
    """Standard forms as ``prefix + column``.

    One step per projection: each refers to the step before more than once, and
    Spark then evaluates that step only once.
    """
    columns = _text_columns(df)
    named = {c: F.col(prefix + c) for c in columns}
    out = df.withColumns(
        {prefix + c: tx.collapse_spaces(F.col(c).cast("string")) for c in columns}
    ).withColumns({prefix + c: tx.null_sentinels(cell) for c, cell in named.items()})
    if "mpaa_rating" in columns:
        label = f"{prefix}mpaa_rating"
        out = out.withColumn(label, tx.canonical_rating(F.col(label)))
    return out


def standardize_strings(df: DataFrame) -> DataFrame:
    return _with_standard_text(df, "")


def _strings_counters(df: DataFrame, prefix: str) -> list:
    counters = []
    for column in _text_columns(df):
        old = F.col(column).cast("string")
        new = F.col(prefix + column)
        changed = count_where(~old.eqNullSafe(new))
        nulled = count_where(old.isNotNull() & new.isNull())
        counters.append(("strings_normalized", column, changed, None))
        counters.append(("sentinels_nulled", column, nulled, None))
    if "title" in df.columns:
        # Read as text, a numeric title is known by its shape.
        title = F.col("title")
        numeric = (
            title.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z") if is_text(df, "title") else title.isNotNull()
        )
        counters.append(("titles_stringified", "", count_where(numeric), None))
    return counters


def _with_parsed_date(
    df: DataFrame, layouts: Sequence[str] = fixed.DATE_LAYOUTS
) -> DataFrame:
    """``_raw``, the collapsed date text, and ``_date``, what it says."""
    raw = tx.collapse_spaces(F.col("release_date").cast("string"))
    return df.withColumn("_raw", raw).withColumn("_date", vl.parse_date(F.col("_raw"), layouts))


def parse_release_dates(
    df: DataFrame,
    last_year: int = fixed.LAST_GENUINE_YEAR,
    layouts: Sequence[str] = fixed.DATE_LAYOUTS,
) -> DataFrame:
    """``release_date`` as a date with its century put right, and ``release_year``."""
    if "release_date" not in df.columns:
        return df
    return (
        _with_parsed_date(df, layouts)
        .withColumn("release_date", vl.undo_century(F.col("_date"), last_year))
        .withColumn("release_year", F.year("release_date"))
        .drop("_raw", "_date")
    )


def _dates_counters(last_year: int) -> list:
    raw, date = F.col("_raw"), F.col("_date")
    first = vl.parse_date(raw, fixed.DATE_LAYOUTS[:1])
    return [
        ("dates_parsed", "", count_where(date.isNotNull()), None),
        ("dates_by_fallback", "", count_where(date.isNotNull() & first.isNull()), None),
        ("dates_unparseable", "", count_where((raw != "") & date.isNull()), None),
        ("dates_century_corrected", "", count_where(F.year(date) > last_year), None),
    ]


def century_examples(
    df: DataFrame,
    order: str = "row_pos",
    last_year: int = fixed.LAST_GENUINE_YEAR,
    n: int = EXAMPLES,
) -> DataFrame:
    """The first rows (of renamed, standardised input) whose century was moved."""
    year = F.year("_date")
    return (
        _with_parsed_date(df)
        .where(year > last_year)
        .orderBy(order)
        .limit(n)
        .select(
            F.coalesce("title", F.lit("")).alias("title"),
            F.col("_raw").alias("raw"),
            year.cast("string").alias("from_year"),
            (year - 100).cast("string").alias("to_year"),
        )
    )


def _numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in fixed.NUMERIC_BOUNDS if c in df.columns]


def _with_numbers(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns(
        {
            prefix + c: vl.to_number(F.col(c), is_text(df, c))
            for c in _numeric_columns(df)
        }
    )


def validate_numerics(df: DataFrame) -> DataFrame:
    """Unreadable, out-of-range and placeholder values become NULL."""
    checked = {}
    for column in _numeric_columns(df):
        number = F.col(column)
        valid = vl.in_bounds(number, *fixed.NUMERIC_BOUNDS[column])
        if column in fixed.ZERO_MEANS_MISSING:
            valid = valid & (number != 0)
        checked[column] = F.when(valid, number)
    return _with_numbers(df, "").withColumns(checked)


def _numeric_counters(df: DataFrame, prefix: str) -> list:
    counters = []
    for column in _numeric_columns(df):
        number = F.col(prefix + column)
        unread = count_where(F.col(column).isNotNull() & number.isNull())
        outside = count_where(~vl.in_bounds(number, *fixed.NUMERIC_BOUNDS[column]))
        counters.append(("numeric_coerced", column, unread, None))
        counters.append(("numeric_out_of_range", column, outside, None))
        if column in fixed.ZERO_MEANS_MISSING:
            counters.append(("numeric_zero_as_missing", column, count_where(number == 0), None))
    return counters


def deduplicated(
    df: DataFrame, order: str = "row_pos", last_year: int = fixed.LAST_GENUINE_YEAR
) -> DataFrame:
    """The stage up to and with duplicates; numbers are still as they came."""
    return (
        df.transform(rename_headers)
        .transform(standardize_strings)
        .transform(parse_release_dates, last_year)
        .transform(remove_duplicates, order)
    )


def clean(
    df: DataFrame, order: str = "row_pos", last_year: int = fixed.LAST_GENUINE_YEAR
) -> DataFrame:
    """The whole stage. ``order`` is the column that holds the input position."""
    return validate_numerics(deduplicated(df, order, last_year))


def cleaning_report(
    df: DataFrame,
    order: str = "row_pos",
    last_year: int = fixed.LAST_GENUINE_YEAR,
    kept: DataFrame | None = None,
) -> DataFrame:
    """Counters of the stage for raw input ``df``.

    One pass over the raw rows and one over those kept. Pass ``kept``, the stored
    result of :func:`deduplicated`, to spare doing that again.
    """
    renamed = rename_headers(df)
    kept = deduplicated(df, order, last_year) if kept is None else kept
    rows_in = df.select(F.count(F.lit(1)).alias("n")).scalar()
    everything = F.count(F.lit(1))
    marked = _with_standard_text(renamed, "_new_")
    raw_counters = [
        ("rows_in", "", everything, None),
        *[("columns_renamed", old, None, new) for old, new in applied_names(df).items()],
        *_strings_counters(renamed, "_new_"),
    ]
    if "release_date" in renamed.columns:
        marked = _with_parsed_date(marked)
        raw_counters += _dates_counters(last_year)
    kept_counters = [
        *dedup_counters(kept, rows_in),
        ("rows_out", "", everything, None),
        *_numeric_counters(kept, "_number_"),
    ]
    return union_reports(
        long_report(marked, "cleaning", raw_counters),
        long_report(_with_numbers(kept, "_number_"), "cleaning", kept_counters),
    )
