"""Date text helpers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common date pattern letters and their Spark spelling.
PATTERN_LETTERS = {
    "yyyy": "yyyy",
    "yy": "yy",
    "MMMM": "MMMM",
    "MMM": "MMM",
    "MM": "MM",
    "M": "M",
    "dddd": "EEEE",
    "ddd": "EEE",
    "dd": "dd",
    "d": "d",
    "HH": "HH",
    "H": "H",
    "hh": "hh",
    "h": "h",
    "mm": "mm",
    "m": "m",
    "ss": "ss",
    "s": "s",
    "fffffff": "SSSSSSS",
    "ffffff": "SSSSSS",
    "fff": "SSS",
    "ff": "SS",
    "f": "S",
    "tt": "a",
    "zzz": "xxx",
    "K": "XXX",
}
_TOKEN = re.compile(r"'[^']*'|([A-Za-z])\1*|[^A-Za-z']+")
ISO_PATTERN = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def spark_pattern(pattern: str) -> str:
    """Translate a pattern such as ``yyyy-MM-dd dddd tt``."""
    parts = []
    for match in _TOKEN.finditer(pattern):
        token = match.group(0)
        if match.group(1) is None:
            parts.append(token)
        elif token in PATTERN_LETTERS:
            parts.append(PATTERN_LETTERS[token])
        else:
            parts.append(f"'{token}'")
    return "".join(parts)


# One-letter formats and what they stand for; R and u show the time in UTC.
_STANDARD = {
    "d": "MM/dd/yyyy",
    "D": "dddd, dd MMMM yyyy",
    "f": "dddd, dd MMMM yyyy HH:mm",
    "F": "dddd, dd MMMM yyyy HH:mm:ss",
    "g": "MM/dd/yyyy HH:mm",
    "G": "MM/dd/yyyy HH:mm:ss",
    "m": "MMMM dd",
    "o": "yyyy-MM-ddTHH:mm:ss.fffffffzzz",
    "r": "ddd, dd MMM yyyy HH:mm:ss 'GMT'",
    "s": "yyyy-MM-ddTHH:mm:ss",
    "t": "HH:mm",
    "T": "HH:mm:ss",
    "u": "yyyy-MM-dd HH:mm:ss'Z'",
    "y": "yyyy MMMM",
}
_SAME = {"M": "m", "O": "o", "R": "r", "Y": "y"}
_PART = re.compile(r"'([^']*)'|\"([^\"]*)\"|\\(.)|%(?=.)|([A-Za-z])\4*|(.)", re.S)
_CLOCK = r"^([^:]*\d:\d\d(?::\d\d(?:[.,]\d+)?)?)\s*([Zz]|[+-]\d\d(?::?\d\d)?)?$"


def format_datetime(iso: Column, pattern: str, on_error: str = "fail") -> Column:
    """ISO text formatted, in the offset that it names (else the session's).

    Patterns are .NET's: letters such as ``yyyy MMM dddd HH mm ss fffffff FFF tt t zzz zz z K g``,
    quoted or escaped text, and the one-letter formats. All seven digits of a fraction count.
    Text that is no date fails, or with ``null`` is null.
    """
    text = F.btrim(iso)
    clock = text.rlike(_CLOCK)
    body = F.when(clock, F.regexp_extract(text, _CLOCK, 1)).otherwise(text)
    wall = F.replace(body, F.lit(","), F.lit(".")).try_cast("timestamp_ntz")
    if on_error == "fail":
        refusal = F.raise_error(F.concat(F.lit("not a date: "), iso)).cast("timestamp_ntz")
        wall = F.coalesce(wall, F.when(iso.isNotNull(), refusal))
    named = F.when(clock, F.regexp_extract(text, _CLOCK, 2)).otherwise("")
    digits = F.regexp_replace(named, ":", "")
    offset = (
        F.when(F.upper(named) == "Z", "+00:00")
        .when(named != "", F.concat(F.substring(digits, 1, 3), F.lit(":"), F.rpad(F.substring(digits, 4, 2), 2, "0")))
        .otherwise(F.date_format(wall.cast("timestamp"), "xxx"))
    )
    fraction = F.substring(F.rpad(F.regexp_extract(body, r"[.,](\d+)$", 1), 7, "0"), 1, 7)
    if len(pattern) == 1:
        pattern = _SAME.get(pattern, pattern)
        if pattern not in _STANDARD:
            raise ValueError(f"'{pattern}' is no date format")
        if pattern in "ru":
            wall = F.convert_timezone(offset, F.lit("UTC"), wall)
        pattern = _STANDARD[pattern]
    parts = [_date_part(m, wall, offset, fraction) for m in _PART.finditer(pattern)]
    shown = F.concat(*[p for p in parts if p is not None])
    return F.when(wall.isNotNull(), shown)


def _date_part(match: re.Match, wall: Column, offset: Column, fraction: Column) -> Column | None:
    token = match.group(0)
    if match.group(4) is None:
        literal = next((g for g in (match.group(i) for i in (1, 2, 3, 5)) if g is not None), None)
        return F.lit(literal) if literal else None
    letter, n = token[0], len(token)
    if letter in "fF" and n <= 7:
        digits = F.substring(fraction, 1, n)
        return digits if letter == "f" else F.rtrim(digits, F.lit("0"))
    if letter == "z":
        hours = F.substring(offset, 1, 3)
        return [F.regexp_replace(hours, r"(?<=[+-])0", ""), hours, offset][min(n, 3) - 1]
    if letter == "K":
        return offset
    if letter == "g":
        return F.lit("A.D.")
    if letter == "t":
        half = F.date_format(wall, "a")
        return F.substring(half, 1, 1) if n == 1 else half
    if letter == "y" and n != 2:
        return (F.year(wall) % 100).cast("string") if n == 1 else F.format_string(f"%0{n}d", F.year(wall))
    spelled = PATTERN_LETTERS.get(token if n <= 4 else letter * {"M": 4, "d": 4}.get(letter, 2))
    # a lone letter would be read as a format of its own
    return F.date_format(wall, spelled) if spelled else F.lit(token)


def now_iso() -> Column:
    """The query's start time in the session time zone."""
    return F.date_format(F.current_timestamp(), ISO_PATTERN)


def utc_now_iso() -> Column:
    shifted = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")
    )
    return F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
