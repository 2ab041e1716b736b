"""Column expressions shared by the operators. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts tried after ISO 8601, each with a pattern that all texts of the layout match.
# A failed parse costs an exception, so other texts are not tried.
DATE_FORMATS = {
    "M/d/yyyy": "/.*/", "yyyy/M/d": "/.*/", "d-MMM-yyyy": "-.*-", "M/d/yyyy H:mm": "/.*/.* .*:",
    "MMM d, yyyy": " .*, ", "MMMM d, yyyy": " .*, ", "d MMM yyyy": " .* ", "d MMMM yyyy": " .* ",
    "dd.MM.yyyy": "\\..*\\.", "yyyyMMdd": "^[^A-Za-z]*$"}


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\v\f"))


def normalise_header(c: Column) -> Column:
    return F.regexp_replace(strip(F.lower(c)), r"[\s_\-]+", " ")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def tokens(c: Column) -> Column:
    """Lower-case runs of letters a-z and digits, in text order."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def to_double(c: Column) -> Column:
    """Number in a text column, null when it is none. NaN counts as missing."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def float_or(c: Column, default: float = 0.0) -> Column:
    return F.coalesce(to_double(c), F.lit(default))


def text_or(c: Column, default: str = "N/A") -> Column:
    return F.coalesce(F.nullif(strip(c.cast("string")), F.lit("")), F.lit(default))


def one_of(c: Column, domain: list[str], default: str) -> Column:
    low = F.lower(c)
    return F.when(low.isin(*domain), low).otherwise(F.lit(default))


def parse_time(c: Column) -> Column:
    """Zone-free timestamp from text, null when no known layout fits."""
    return F.coalesce(
        c.try_cast("timestamp_ntz"),
        *[F.when(F.rlike(c, F.lit(f"(?s){shape}")), F.try_to_timestamp(c, F.lit(f))).cast("timestamp_ntz")
          for f, shape in DATE_FORMATS.items()],
    )


def as_instant(c: Column) -> Column:
    """Zone-free time taken as UTC, as the instant that watermarks and windows need."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), c).cast("timestamp")


def as_local(c: Column) -> Column:
    """The zone-free UTC time of an instant."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), c.cast("timestamp_ntz"))


def iso_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")


def fixed(c: Column, digits: int) -> Column:
    """Fixed-point text; exact binary ties go to the even digit."""
    return F.replace(F.format_number(c, digits), F.lit(","), F.lit(""))


def grouped(c: Column, digits: int) -> Column:
    """Fixed-point text with thousands separators."""
    return F.format_number(c, digits)


def exact_round(c: Column, digits: int) -> Column:
    """Rounds the exact binary value, ties to even; decimal-looking ties such as 2.675 differ
    from ``round``, which goes by the shortest decimal text. Only numbers near a tie go through text."""
    scaled = c * F.lit(10.0 ** digits)
    clear = (F.abs(scaled) < 1e12) & (F.abs(F.abs(scaled - F.floor(scaled)) - 0.5) > 1e-4)
    return F.when(clear, F.rint(scaled) / F.lit(10.0 ** digits)).otherwise(fixed(c, digits).try_cast("double"))


def scaled_round(c: Column, digits: int) -> Column:
    """Rounds after scaling, ties to even, as array libraries do."""
    factor = 10.0**digits
    return F.rint(c * factor) / factor


def contains_text(c: Column, needle: str) -> Column:
    """Case-insensitive containment; the needle is taken literally."""
    return F.contains(F.lower(c), F.lit(needle.lower()))
