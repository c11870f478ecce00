"""Text operations on a column; array columns are treated per element.

Null text reads as empty text, so every function gives a value for every row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.entities import name2codepoint

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftframe.expressions import WHITE_SPACE, TransformError


def _text(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


# A letter whose upper case stays one letter, and a stand-in from
# the private-use area that upper-casing leaves alone.
SHARP_S, STAND_IN = "\u00df", "\ue0df"


def upper(column) -> Column:
    """Letter by letter: a sharp s stays as it is instead of becoming SS."""
    text = _text(column)
    kept = F.translate(F.upper(F.translate(text, SHARP_S, STAND_IN)), STAND_IN, SHARP_S)
    return F.when(text.contains(SHARP_S), kept).otherwise(F.upper(text))


def lower(column) -> Column:
    return F.lower(_text(column))


def trim(column) -> Column:
    """Unicode white space off both ends."""
    return F.btrim(_text(column), F.lit(WHITE_SPACE))


def trim_start(column) -> Column:
    return F.ltrim(_text(column), F.lit(WHITE_SPACE))


def trim_end(column) -> Column:
    return F.rtrim(_text(column), F.lit(WHITE_SPACE))


def substring(column, start: int = 0, length: int | None = None) -> Column:
    """From a zero-based start; start and length are clamped to the text."""
    text = _text(column)
    begin = F.lit(max(start, 0) + 1)
    return F.substring(text, begin, F.length(text) if length is None else F.lit(max(length, 0)))


def replace(column, find: str, replacement: str = "") -> Column:
    if find == "":
        raise TransformError("replace needs a text to find")
    return F.replace(_text(column), F.lit(find), F.lit(replacement))


def split(column, separator: str = ",") -> Column:
    if separator == "":
        return F.array(_text(column))
    return F.split(_text(column), "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def join(column, separator: str = ",") -> Column:
    """Array to text; null elements read as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.array_join(F.transform(column, lambda x: x.cast("string")), separator, "")


def _pad_char(char: str | None) -> str:
    return char[0] if char else " "


def pad_left(column, width: int, char: str | None = None) -> Column:
    text = _text(column)
    return F.when(F.length(text) < width, F.lpad(text, width, _pad_char(char))).otherwise(text)


def pad_right(column, width: int, char: str | None = None) -> Column:
    text = _text(column)
    return F.when(F.length(text) < width, F.rpad(text, width, _pad_char(char))).otherwise(text)


def truncate(column, length: int, ellipsis: str = "…") -> Column:
    """At most ``length`` characters, the last of which are the ellipsis."""
    text = _text(column)
    kept = F.substring(text, 1, max(0, length - len(ellipsis)))
    return F.when(F.length(text) <= length, text).otherwise(F.concat(kept, F.lit(ellipsis)))


def format_text(column, template: str = "{0}") -> Column:
    """``{0}`` and ``{item}`` in the template stand for the value."""
    text = _text(column)
    once = F.replace(F.lit(template), F.lit("{0}"), text)
    return F.replace(once, F.lit("{item}"), text)


def regex_match(column, pattern: str) -> Column:
    return _text(column).rlike(pattern)


def regex_replace(column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(_text(column), pattern, replacement)


def capturing_groups(pattern: str) -> int:
    """How many numbered groups a regular expression has."""
    plain = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)
    return len(re.findall(r"\((?!\?)|\(\?<(?![=!])", plain))


def regex_extract(column, pattern: str, group: int = 0) -> Column:
    """The group's text; null without a match or such a group."""
    text = _text(column)
    if group > capturing_groups(pattern):
        return F.lit(None).cast("string")
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def base64_encode(column) -> Column:
    # some Spark settings break the text into lines
    return F.replace(F.base64(F.encode(_text(column), "UTF-8")), F.lit("\r\n"), F.lit(""))


def base64_decode(column, on_error: str = "fail") -> Column:
    text = _text(column)
    if on_error == "null":
        return F.decode(F.try_to_binary(text, F.lit("base64")), "UTF-8")
    return F.decode(F.to_binary(text, F.lit("base64")), "UTF-8")


def url_encode(column) -> Column:
    """Percent-encoding that keeps only letters, digits and ``-_.~``."""
    encoded = F.url_encode(_text(column))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def url_decode(column) -> Column:
    """Percent-decoding; a plus sign and a stray percent sign stay."""
    text = _text(column)
    prepared = F.replace(text, F.lit("+"), F.lit("%2B"))
    prepared = F.regexp_replace(prepared, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.coalesce(F.try_url_decode(prepared), text)


# The characters written as named entities, ampersand first.
HTML_ENTITIES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))


def html_encode(column) -> Column:
    """Named entities for mark-up, numeric ones for characters 160 to 255 and
    for characters beyond the basic plane."""
    encoded = _text(column)
    for found, wanted in HTML_ENTITIES:
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    special = r"[\x{A0}-\x{FF}\x{10000}-\x{10FFFF}]"
    # cut before every special character: it leads its piece
    pieces = F.transform(
        F.split(encoded, f"(?={special})"),
        lambda p: F.when(
            p.rlike(f"^{special}"),
            F.concat(F.lit("&#"), F.ascii(p).cast("string"), F.lit(";"), F.substring(p, F.lit(2), F.length(p))),
        ).otherwise(p),
    )
    return F.when(encoded.rlike(special), F.array_join(pieces, "")).otherwise(encoded)


_ENTITY = re.compile(r"&(?:#(\d{1,8})|#[xX]([0-9a-fA-F]{1,7})|([A-Za-z][A-Za-z0-9]*));")


def _character(entity: re.Match[str]) -> str:
    decimal, hexadecimal, name = entity.groups()
    if name is not None:
        code = 39 if name == "apos" else name2codepoint.get(name)
    else:
        code = int(decimal) if decimal is not None else int(hexadecimal, 16)
    if code is None or 0xD800 <= code <= 0xDFFF or code > 0x10FFFF:
        return entity.group(0)
    return chr(code)


@F.pandas_udf(T.StringType())
def _html_unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: _ENTITY.sub(_character, t))


def html_decode(column) -> Column:
    """Named (HTML 4) and numeric entities back to characters; an entity has to
    end in a semicolon, unknown ones stay."""
    return _html_unescape(_text(column))


def hash_text(column, algorithm: str = "sha256") -> Column:
    """Lower-case hex digest of the UTF-8 bytes."""
    text = _text(column)
    name = algorithm.lower()
    if name == "sha256":
        return F.sha2(text, 256)
    if name == "sha512":
        return F.sha2(text, 512)
    if name == "md5":
        return F.md5(text)
    if name == "sha1":
        return F.sha1(text)
    raise TransformError(f"unknown hash algorithm '{algorithm}'")


def new_guid() -> Column:
    return F.uuid()


OPERATIONS: dict[str, Callable[..., Column]] = {
    "upper": upper,
    "lower": lower,
    "trim": trim,
    "trimstart": trim_start,
    "trimend": trim_end,
    "substring": substring,
    "replace": replace,
    "split": split,
    "padleft": pad_left,
    "padright": pad_right,
    "truncate": truncate,
    "format": format_text,
    "regexmatch": regex_match,
    "regexreplace": regex_replace,
    "regexextract": regex_extract,
    "base64encode": base64_encode,
    "base64decode": base64_decode,
    "urlencode": url_encode,
    "urldecode": url_decode,
    "htmlencode": html_encode,
    "hash": hash_text,
}


def apply_operation(column: Column, operation: str, over_array: bool = False, **parameters) -> Column:
    """An operation by name, on text or on every element of an array."""
    name = operation.lower()
    if name == "newguid":
        return new_guid()
    if name == "join":
        return join(column, **parameters)
    if name == "htmldecode":
        if over_array:
            raise TransformError("explode the array before htmldecode: it runs on whole columns")
        return html_decode(column)
    if name not in OPERATIONS:
        raise TransformError(f"unknown operation '{operation}'")
    operate = OPERATIONS[name]
    if over_array:
        return F.transform(column, lambda x: operate(x, **parameters))
    return operate(column, **parameters)
