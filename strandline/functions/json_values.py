"""JSON with the numbers as they were written, and its canonical form, as Catalyst expressions.

VARIANT keeps a number's value but not its text: the point of ``2.0``, the sign of ``-0.0`` and digits beyond 38 are
gone. ``parsed`` therefore turns each number into a marked string before the text becomes a VARIANT, and everything that
reads such values (``number_text``, ``plain_string``, ``canonical_json``) knows the mark. Nothing here runs Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.terms import _col, _unicode, float_text, once

#: Begins the string that stands for a number. Strings of the data that begin with NUL get a second one.
NUL, MARK = "\x00", "\x00n"

_REST = r'[^"\\]*+(?:\\.[^"\\]*+)*+"'
_NUMBER = r"-?+(?:(?:0|[1-9][0-9]*+)(?:\.[0-9]++)?+(?:[eE][+-]?+[0-9]++)?+|Infinity)|NaN"
#: What stands before the next number (strings as a whole), then the number. Possessive: no backtracking at any length.
_NUMBERS = rf'(?s)\G((?:[^"0-9\-NI]++|"{_REST})*+)({_NUMBER})'
_NUL_STRINGS = rf'(?s)\G((?:[^"]++|"(?!\\u0000){_REST})*+)"\\u0000({_REST})'
#: In compact JSON: a marked number, a string that begins with two NULs, an escape, a character beyond ASCII.
_SPECIAL = r'(?s)"\\u0000n[-+.0-9A-Za-z]++"|"\\u0000\\u0000|\\(?:u[0-9A-Fa-f]{4}|.)|[^ -~]'


def marked(text: Column | str) -> Column:
    """A JSON text whose numbers are marked strings."""
    c = _col(text)
    c = F.when(F.contains(c, F.lit("\\u0000")), F.regexp_replace(c, _NUL_STRINGS, '$1"\\\\u0000\\\\u0000$2')).otherwise(c)
    return F.regexp_replace(c, _NUMBERS, '$1"\\\\u0000n$2"')


def _alone(whole: Column) -> Column:
    """The first of exactly two members of a VARIANT list, else null: the parser passes over what follows a value, so a text
    is parsed as a list's first member, before another."""
    return once(whole, lambda v: F.when(F.variant_get(v, "$[1]", "variant").isNotNull() & F.variant_get(v, "$[2]", "variant").isNull(), F.variant_get(v, "$[0]", "variant")))


def parsed(text: Column | str) -> Column:
    """The VARIANT of a JSON text, numbers marked; a text that is no JSON is an error, null gives null."""
    c = _col(text)
    found = _alone(F.parse_json(F.concat(F.lit("["), marked(c), F.lit(",0]"))))
    wrong = F.raise_error(F.concat(F.lit("not a JSON text: "), F.substring(c, 1, 200))).cast("variant")
    return F.when(c.isNotNull(), F.coalesce(found, wrong))


def try_parsed(text: Column | str) -> Column:
    """The VARIANT of a JSON text with its numbers as they are; null for a text that is no JSON."""
    return _alone(F.try_parse_json(F.concat(F.lit("["), _col(text), F.lit(",0]"))))


def is_number(text: Column) -> Column:
    return text.startswith(F.lit(MARK))


def number_text(text: Column) -> Column:
    """What a marked string has behind its mark."""
    return F.substring(text, len(MARK) + 1, 2**31 - 1)


def is_whole(number: Column) -> Column:
    return number.rlike(r"\A-?[0-9]+\z")


def plain_string(text: Column) -> Column:
    """A string of the data as it was."""
    return F.when(text.startswith(F.lit(NUL + NUL)), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def whole_text(number: Column) -> Column:
    """A whole number of any length as Python writes it."""
    return F.when(number == "-0", "0").otherwise(number)


def number_json(number: Column) -> Column:
    """A number as Python's encoder writes it."""
    x = float_text(number.cast("double"))
    named = F.when(x == "nan", "NaN").when(x == "inf", "Infinity").when(x == "-inf", "-Infinity").otherwise(x)
    return F.when(is_whole(number), whole_text(number)).otherwise(named)


def _code(c: Column) -> Column:
    n = F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("long")
    two = n - 0x10000
    pair = F.concat(_unicode(F.shiftright(two, 10) + 0xD800), _unicode(two.bitwiseAND(0x3FF) + 0xDC00))
    return F.when(n < 0x10000, _unicode(n)).otherwise(pair)


def canonical_json(value: Column | str) -> Column:
    """A VARIANT made by ``parsed`` as ASCII JSON with sorted keys and no spaces, numbers in Python's form.

    VARIANT keeps an object's keys sorted, so its own compact text needs only numbers, escapes and characters beyond ASCII
    put right. Keys are in the order of UTF-16 units (which differs from that of code points only between keys of which
    one has U+E000 to U+FFFF where the other has a character beyond the basic plane)."""
    return once(F.to_json(_col(value)), _put_right)


def _put_right(text: Column) -> Column:
    def one(x: Column) -> Column:
        number = F.regexp_extract(x, r'\A"\\u0000n(.*)"\z', 1)
        return (
            F.when(x.startswith('"\\u0000n'), number_json(number)).when(x.startswith('"'), F.lit('"\\u0000'))
            .when(x.startswith("\\u"), F.lower(x)).when(x.startswith("\\"), x).otherwise(_code(x))
        )

    special = F.transform(F.regexp_extract_all(text, F.lit(_SPECIAL), F.lit(0)), one)
    between = F.split(text, _SPECIAL, -1)
    whole = F.array_join(F.zip_with(between, special, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(text.rlike(r"[^ -~]|\\"), whole).otherwise(text)
