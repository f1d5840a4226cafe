"""RDF terms as Catalyst expressions: identifiers, literals and their escaping. No Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces of the exported data.
VOCAB = "https://w3id.org/biolink/vocab/"
IDENTIFIERS = "https://identifiers.org/"
SLOT_NS = "https://w3id.org/kgx/slot/"
NODE_NS = "https://w3id.org/kgx/node/"
ENUM_NS = "https://w3id.org/biolink/enum/"
TRAVERSAL_NS = "https://w3id.org/kgx/traversal/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
XSD = "http://www.w3.org/2001/XMLSchema#"
IS_A = VOCAB + "is_a"

#: What an IRI begins with, and the prefix of the vocabulary's own terms.
PLAIN, OWN = ("http://", "https://", "urn:"), "biolink:"
CURIE_PYTHON = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]+$"
#: The same with Python's whitespace and anchors spelled for Java.
CURIE = r"(?U)\A[A-Za-z][A-Za-z0-9+.-]*:[^\s\x1c-\x1f]+\n?\z"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is computed once however often ``f`` looks at it (branches of a CASE do not share)."""
    return F.transform(F.array(c), f)[0]


def _swap(c: Column, *pairs: tuple[str, str]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def percent_encode(c: Column | str, safe: str = "") -> Column:
    """RFC 3986 encoding of UTF-8 bytes; ``safe`` may add ``:`` and ``/`` to letters, digits and ``-._~``."""
    c, kept = _col(c), [x for x in safe if x in ":/"]
    out = _swap(F.url_encode(c), ("+", "%20"), ("*", "%2A"), ("%7E", "~"))
    out = _swap(out, *((f"%{ord(x):02X}", x) for x in kept))
    # most ids need nothing encoded: one look instead of six passes
    return F.when(c.rlike(r"\A[A-Za-z0-9._~" + "".join(kept) + r"-]*\z"), c).otherwise(out)


def curie_to_iri(c: Column | str) -> Column:
    """IRIs stay; ``biolink:`` terms go to the vocabulary unencoded; the rest is encoded."""
    c = _col(c)
    plain = c.startswith(PLAIN[0]) | c.startswith(PLAIN[1]) | c.startswith(PLAIN[2])
    own = F.concat(F.lit(VOCAB), F.substring(c, len(OWN) + 1, 2**31 - 1))
    return F.when(plain, c).when(c.startswith(OWN), own).otherwise(F.concat(F.lit(IDENTIFIERS), percent_encode(c, ":/")))


def raw_ids(iri: Column | str) -> Column:
    """An array of the ids that ``curie_to_iri`` may have turned into ``iri``: itself, a term of the vocabulary, and an identifier
    with and without percent-encoding. Not each of them leads back; whoever uses them checks that."""
    c = _col(iri)
    own, other = (F.when(c.startswith(ns), F.concat(F.lit(pre), F.substring(c, len(ns) + 1, 2**31 - 1))) for ns, pre in ((VOCAB, OWN), (IDENTIFIERS, "")))
    return F.array_distinct(F.array_compact(F.array(c, own, F.try_url_decode(F.replace(other, F.lit("+"), F.lit("%2B"))))))


def named_by(value: object) -> str | None:
    """For one value in Python, by the same rules: the IRI of a CURIE or web address, else None."""
    if not isinstance(value, str) or not (value.startswith(PLAIN[:2]) or re.match(CURIE_PYTHON, value)):
        return None
    if value.startswith(PLAIN):
        return value
    return VOCAB + value.removeprefix(OWN) if value.startswith(OWN) else IDENTIFIERS + quote(value, safe=":/")


def is_curie(c: Column | str) -> Column:
    return _col(c).rlike(CURIE)


def iri_escape(c: Column | str) -> Column:
    return _swap(_col(c), ("\\", "%5C"), (">", "%3E"), ("<", "%3C"))


def resource(c: Column | str) -> Column:
    return F.concat(F.lit("<"), iri_escape(c), F.lit(">"))


def normalize_iri(c: Column | str) -> Column:
    """Strip one pair of angle brackets."""
    c = _col(c)
    return F.when(c.startswith("<") & c.endswith(">") & (F.length(c) >= 2), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)


def iri_term(c: Column | str) -> Column:
    return F.concat(F.lit("<"), _col(c), F.lit(">"))


def custom_slot_iri(c: Column | str) -> Column:
    return F.concat(F.lit(SLOT_NS), percent_encode(_swap(_col(c), (" ", "_"))))


def enum_value_iri(enum: Column | str, value: Column | str) -> Column:
    return F.concat(F.lit(ENUM_NS), percent_encode(enum, "/"), F.lit("/"), percent_encode(value))


def _unicode(unit: Column) -> Column:
    return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(unit)), 4, "0"))


def json_text(c: Column | str) -> Column:
    """A JSON string in ASCII: quotes, backslashes, control and all non-ASCII characters escaped, those beyond
    the basic plane as two units. Plain ids take the short way."""
    c = _col(c)
    short = _swap(c, ("\\", "\\\\"), ('"', '\\"'), ("\b", "\\b"), ("\f", "\\f"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))

    def run(x: Column) -> Column:
        # the units of UTF-16 are the escapes' numbers
        units = F.regexp_replace(F.lower(F.hex(F.encode(x, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(x.rlike(r"\A[ -~]"), x).otherwise(units)

    # whole runs at a time, not characters
    slow = F.array_join(F.transform(F.regexp_extract_all(short, F.lit("[ -~]+|[^ -~]+"), F.lit(0)), run), "")
    return F.concat(F.lit('"'), F.when(c.rlike(r"\A[ !#-\[\]-~]*\z"), c).otherwise(slow), F.lit('"'))


def reverse_iri(edge_id: Column | str) -> Column:
    """Name of an edge's reverse alias: hash of its canonical JSON."""
    return F.concat(F.lit(TRAVERSAL_NS + "reverse/"), F.sha2(F.concat(F.lit('{"reverse_traversal_of":'), json_text(edge_id), F.lit("}")).cast("binary"), 256))


def plain_literal(c: Column | str) -> Column:
    return F.concat(F.lit('"'), _swap(_col(c), ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), F.lit('"'))


def typed_literal(text: Column, kind: str) -> Column:
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}{kind}>'))


def _digits(c: Column) -> Column:
    """The shortest digits that read back as the same double, as ``d.dE-n`` or ``ddd.d``. The JVM's own text of a double may have
    too many before version 19; Spark brings Jackson, whose writer has not."""
    text = F.java_method(F.lit("com.fasterxml.jackson.core.io.schubfach.DoubleToDecimal"), F.lit("toString"), c)
    return F.when((F.abs(c) < 1e-320) & (c != 0), once(text, lambda t: _one_digit(c, t))).otherwise(text)


def _one_digit(c: Column, text: Column) -> Column:
    # it writes two digits at least; among the smallest numbers of all, one may do
    first, second = F.regexp_extract(text, r"(\d)\.(\d)E", 1), F.regexp_extract(text, r"(\d)\.(\d)E", 2)
    power, minus = F.regexp_extract(text, r"E-(\d+)$", 1).try_cast("int"), F.when(text.startswith("-"), "-").otherwise("")
    up = (first.try_cast("int") + F.when(second.try_cast("int") >= 5, 1).otherwise(0)).cast("string")
    one = F.when(up == "10", F.concat(minus, F.lit("1.0E-"), (power - 1).cast("string"))).otherwise(F.concat(minus, up, F.lit(".0E-"), power.cast("string")))
    return F.when(text.rlike(r"^-?\d\.[1-9]E-\d+$") & (one.try_cast("double") == c), one).otherwise(text)


def float_text(c: Column | str) -> Column:
    """Shortest round-trip text in Python's style."""
    return once(F.struct(_col(c).cast("double").alias("x"), _digits(_col(c).cast("double")).alias("text")), lambda v: _python_style(v["x"], v["text"]))


def _python_style(c: Column, text: Column) -> Column:
    size = F.abs(c)
    e = F.regexp_extract(text, r"E(-?)(\d+)$", 2)
    sign = F.when(text.rlike(r"E-"), F.lit("-")).otherwise(F.lit("+"))
    exp = F.concat(F.regexp_replace(F.regexp_extract(text, r"^(.*)E", 1), r"\.0$", ""), F.lit("e"), sign, F.lpad(e, F.greatest(F.length(e), F.lit(2)), F.lit("0")))
    dec = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"0+$", "")
    dec = F.when(dec.endswith("."), F.concat(dec, F.lit("0"))).otherwise(dec)
    return (
        F.when(F.isnan(c), F.lit("nan")).when(c == float("inf"), F.lit("inf")).when(c == float("-inf"), F.lit("-inf"))
        .when((size >= 1e16) | ((size < 1e-4) & (size > 0)), exp)
        .when((size >= 1e7) | ((size < 1e-3) & (size > 0)), dec).otherwise(text)
    )


def literal(kind: str, c: Column | str) -> Column:
    """Rendering by type: boolean, integer, double or string."""
    c = _col(c)
    if kind == "boolean":
        return typed_literal(c.cast("string"), "boolean")
    if kind == "integer":
        return typed_literal(c.cast("string"), "integer")
    if kind == "double":
        return typed_literal(float_text(c), "double")
    return plain_literal(c)


def strip_typed_literal(c: Column | str) -> Column:
    """``"x"^^<...>`` and ``"x"`` give x; anything else (language tags too) passes through."""
    c = _col(c)
    typed = F.regexp_extract(c, r'(?s)^"(.*)"\^\^<.*>$', 1)
    return F.when(c.rlike(r'(?s)^".*"\^\^<.*>$'), typed).when(c.rlike(r'(?s)^".*"$') & (F.length(c) >= 2), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(c)
