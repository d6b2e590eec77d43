"""Column helpers; all stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wavemill import constants as C

NAME_FORMAT = "yyyy-MM-dd'T'HH-mm-ss"


def round_half_even(x: Column, digits: int = 3) -> Column:
    """Ties go to the even digit, decided on the scaled double."""
    scale = float(10**digits)
    return F.rint(x * F.lit(scale)) / F.lit(scale)


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den, and 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def recording_stamp(ts: Column) -> Column:
    """Timestamp text used in recording names."""
    return F.date_format(ts, NAME_FORMAT)


def path_date(path: Column, folder_chars: int = 6) -> Column:
    """Date part of ``<folder>/<19 chars>_<task>.edf``, by position."""
    return F.substring(path, folder_chars + 2, 19)


def path_task(path: Column, folder_chars: int = 6) -> Column:
    """Task part of ``<folder>/<19 chars>_<task>.edf``, by position."""
    start = folder_chars + 22
    return path.substr(F.lit(start), F.length(path) - (start - 1) - 4)


def path_participant(path: Column) -> Column:
    return F.substring_index(path, "/", 1)


def configuration_label(width: Column, channels: Column) -> Column:
    """``"{width}Hz width {n or all} channels"``; an empty list means all."""
    size = F.when(F.size(channels) == 0, F.lit("all")).otherwise(F.size(channels).cast("string"))
    return F.concat(width.cast("string"), F.lit("Hz width "), size, F.lit(" channels"))


def scans_per_block(rate: Column) -> Column:
    """Block size for a sampling rate, with the default for unknown rates."""
    pairs = [F.lit(v) for kv in C.SCANS_PER_BLOCK.items() for v in kv]
    return F.coalesce(
        F.try_element_at(F.create_map(*pairs), rate.cast("int")), F.lit(C.DEFAULT_SCANS_PER_BLOCK)
    )


def lookup_with_default(key: Column, table: dict, default) -> Column:
    """Look a key up in a small literal map."""
    pairs = [F.lit(v) for kv in table.items() for v in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def task_family(task: Column) -> Column:
    """Family of a task by its four-letter prefix."""
    head = F.substring(task, 1, 4)
    return (
        F.when(head == "imag", F.lit("imagery"))
        .when(head == "real", F.lit("real"))
        .otherwise(F.lit("observation"))
    )


def to_sorted_json(fields: dict[str, Column]) -> Column:
    """JSON object with keys in alphabetical order; NULL fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
