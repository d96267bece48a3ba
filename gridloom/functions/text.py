"""Column expressions for sheet text: stations, names, cell values and timestamps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cell texts and names as they occur in the monitoring sheets.
STATUS_WORDS = ("maint", "calib", "power", "link", "warm", "ref", "fail", "off")
NULL_WORDS = ("", "nan", "na", "null", "none")
STATIONS = ("BHATAGAON", "AIIMS", "IGKV", "SILTARA")
HEADER_CELL = r"(?i)^\s*date\s*&\s*time\s*$"
SHEET_NAME = r"^\d{1,2}$"
SHARED_SUFFIXES = ("AIIM", "AIIMS")
NUMERIC_DATE = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})(?:[ T]+(\d.*))?$"
SHORT_DATE = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})(?:[ T]+(\d.*))?$"
YEAR_FIRST_DATE = r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[ T]+(\d.*))?$"
YEAR_OR_MONTH = r"^\d{4}(-\d{1,2})?$"
COMPACT_DATE = r"^(\d{4})(\d{2})(\d{2})$"
COMPACT_TIME = r"^(\d{4})(\d{2})(\d{2})[ T]+(\d{2}):?(\d{2})$"
COMPACT_SECONDS = r"^(\d{4})(\d{2})(\d{2})[ T]+(\d{2}):?(\d{2}):?(\d{2})$"
WORDED_DATE = r"^\d.*[A-Za-z]{2}|^[A-Za-z]{3,9}[-, ]+\d"
WORDED_FORMATS = (
    "d/M/yyyy h:mm:ss a",
    "d/M/yyyy h:mm a",
    "d MMM yyyy H:mm:ss",
    "d MMM yyyy H:mm",
    "d MMM yyyy h:mm a",
    "d MMM yyyy",
    "d MMMM yyyy H:mm:ss",
    "d MMMM yyyy H:mm",
    "d MMMM yyyy h:mm a",
    "d MMMM yyyy",
)
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
SERIAL_RANGE = (20_000.0, 70_000.0)
SERIAL_DAYS_TO_1970 = 25_569


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squeeze(c: Column | str) -> Column:
    """Trim and collapse runs of white space."""
    return F.regexp_replace(F.regexp_replace(col(c), r"^\s+|\s+$", ""), r"\s+", " ")


def station_from_path(path: Column | str, known: Sequence[str] = STATIONS, noise: str = "DCR") -> Column:
    """Station of a file from the first folder of its path relative to the data root."""
    top = F.upper(F.split_part(col(path), F.lit("/"), F.lit(1)))
    words = F.filter(F.regexp_extract_all(top, F.lit("([A-Z]+)"), 1), lambda w: w != F.lit(noise))
    longest = F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))
    bare = F.replace(F.trim(top), F.lit(" "), F.lit("_"))
    branches = [F.when(F.contains(top, F.lit(k)), F.lit(k)) for k in known]
    return F.coalesce(*branches, F.nullif(longest, F.lit("")), F.nullif(bare, F.lit("")), F.lit("UNKNOWN"))


def header_name(cell: Column | str, sheet_column: Column) -> Column:
    """Variable name of a header cell; blanks are named after the 1-based sheet column."""
    return F.coalesce(F.nullif(squeeze(cell), F.lit("")), F.concat(F.lit("COL_"), sheet_column.cast("string")))


def clean_value(
    cell: Column | str, status: Sequence[str] = STATUS_WORDS, null_words: Sequence[str] = NULL_WORDS
) -> Column:
    """Measurement in a cell: status texts, null words, non-numbers and non-finite numbers become null."""
    text = F.lower(F.trim(col(cell)))
    return plain_number(F.when(~text.isin(*null_words) & ~text.rlike("|".join(status)), text))


def plain_number(text: Column) -> Column:
    """Finite number written as digits; a cast alone would also take ``1.5d``, ``inf`` or ``nan``."""
    number = F.when(F.trim(text).rlike(PLAIN_NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def parse_timestamp(cell: Column | str) -> Column:
    """Wall-clock time of a cell: day-first dates, ISO, worded dates, then serial days counted from 1899-12-30.

    The shape of the text decides how it is read; day-first is tried before month-first. Casts give null on a
    mismatch, so only worded dates, which are rare, go through pattern parsing.
    """
    text = F.trim(col(cell))

    def read(pattern: str, order: str) -> Column:
        return F.trim(F.regexp_replace(text, pattern, order)).try_cast("timestamp_ntz")

    def shaped(pattern: str, *orders: str) -> Column:
        return F.when(text.rlike(pattern), F.coalesce(*[read(pattern, o) for o in orders]))

    worded = F.regexp_replace(F.regexp_replace(text, r"[-,]", " "), r"^(\d+)[ /](\d+)[ /](\d+)", "$1/$2/$3")
    worded = F.initcap(F.regexp_replace(worded, r"\s+", " "))
    # Month first, month alone, two-digit years: rewritten as day, month and a year of four digits.
    for shape, order in (
        (r"^([A-Za-z]{3,9}) (\d{1,2}) (\d{2}(?:\d{2})?)(?= |$)", "$2 $1 $3"),
        (r"^([A-Za-z]{3,9}) (\d{4})$", "1 $1 $2"),
        (r"^(\d{1,2} [A-Za-z]{3,9}) ([0-5]\d|6[0-8])(?= |$)", "$1 20$2"),
        (r"^(\d{1,2} [A-Za-z]{3,9}) (\d{2})(?= |$)", "$1 19$2"),
    ):
        worded = F.regexp_replace(worded, shape, order)
    tries = [F.try_to_timestamp(worded, F.lit(f)).cast("timestamp_ntz") for f in WORDED_FORMATS]
    # Two-digit years from 69 on lie in the last century.
    recent = F.regexp_extract(text, SHORT_DATE, 3) < "69"
    serial = plain_number(text)
    in_range = (serial > SERIAL_RANGE[0]) & (serial < SERIAL_RANGE[1])
    micros = F.round((serial - SERIAL_DAYS_TO_1970) * 86_400_000_000.0).cast("bigint")
    return F.coalesce(
        shaped(NUMERIC_DATE, "$3-$2-$1 $4", "$3-$1-$2 $4"),
        shaped(YEAR_FIRST_DATE, "$1-$2-$3 $4", "$1-$3-$2 $4"),
        shaped(YEAR_OR_MONTH, "$0"),
        F.when(recent, shaped(SHORT_DATE, "20$3-$2-$1 $4", "20$3-$1-$2 $4")).otherwise(shaped(SHORT_DATE, "19$3-$2-$1 $4", "19$3-$1-$2 $4")),
        shaped(COMPACT_DATE, "$1-$2-$3"),
        shaped(COMPACT_TIME, "$1-$2-$3 $4:$5"),
        shaped(COMPACT_SECONDS, "$1-$2-$3 $4:$5:$6"),
        F.when(text.rlike(WORDED_DATE), F.coalesce(*tries)),
        F.when(in_range, F.timestamp_micros(micros).cast("timestamp_ntz")),
    )


def canonical_name(name: Column | str, station: Column | str, suffixes: Sequence[str] = SHARED_SUFFIXES) -> Column:
    """Variable name without the spelling variants and station suffixes found in sheets."""
    own = F.upper(col(station))
    text = F.upper(squeeze(name))
    for variant, plain in (("PM 2.5", "PM2.5"), ("PM2_5", "PM2.5"), ("PM 10", "PM10")):
        text = F.replace(text, F.lit(variant), F.lit(plain))
    text = F.trim(F.substring_index(text, "__", 1))
    tail = F.trim(F.substring_index(text, "_", -1))
    is_suffix = F.contains(text, F.lit("_")) & (
        (tail == own) | (tail == F.replace(own, F.lit(" "), F.lit(""))) | tail.isin(*suffixes)
    )
    head = F.trim(F.regexp_replace(text, "_[^_]*$", ""))
    text = F.when(is_suffix, head).otherwise(text)
    letters = F.regexp_replace(own, "[^A-Z]", "")
    glued = (letters != "") & F.endswith(text, letters) & (F.length(text) > F.length(letters) + 1)
    stem = F.left(text, F.length(text) - F.length(letters))
    return F.when(glued, F.trim(F.regexp_replace(stem, "^[_ ]+|[_ ]+$", ""))).otherwise(text)
