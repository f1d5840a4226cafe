import hashlib
import json

import pytest
from pyspark.sql import functions as F

from strandline.functions import terms as T
from strandline.operators import flatten

ODD = ["", "a:b", "A:1 2", "x:é~*+%/:", "biolink:Gene", "http://x/y z", "urn:uuid:1", "1:x", "a b:c", "a:b\n", "a:b\n\n", "a:\x1c", "a:\u00a0", 'q"\\\n\r\tz', "<a>", "日本:x"]


def rows(spark, values, *exprs, kind="string"):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(*exprs).collect()]


#: value: IRI, whether it is a CURIE, custom slot, enumeration value.
NAMED = {
    "a:b": ("https://identifiers.org/a:b", True, "https://w3id.org/kgx/slot/a%3Ab", "https://w3id.org/biolink/enum/a%3Ab/a%3Ab"),
    "A:1 2": ("https://identifiers.org/A:1%202", False, "https://w3id.org/kgx/slot/A%3A1_2", "https://w3id.org/biolink/enum/A%3A1%202/A%3A1%202"),
    "x:é~*+%/:": ("https://identifiers.org/x:%C3%A9~%2A%2B%25/:", True, "https://w3id.org/kgx/slot/x%3A%C3%A9~%2A%2B%25%2F%3A", "https://w3id.org/biolink/enum/x%3A%C3%A9~%2A%2B%25/%3A/x%3A%C3%A9~%2A%2B%25%2F%3A"),
    "biolink:Ship": ("https://w3id.org/biolink/vocab/Ship", True, "https://w3id.org/kgx/slot/biolink%3AShip", "https://w3id.org/biolink/enum/biolink%3AShip/biolink%3AShip"),
    "http://x/y z": ("http://x/y z", False, "https://w3id.org/kgx/slot/http%3A%2F%2Fx%2Fy_z", "https://w3id.org/biolink/enum/http%3A//x/y%20z/http%3A%2F%2Fx%2Fy%20z"),
    "urn:q:7": ("urn:q:7", True, "https://w3id.org/kgx/slot/urn%3Aq%3A7", "https://w3id.org/biolink/enum/urn%3Aq%3A7/urn%3Aq%3A7"),
    "1:x": ("https://identifiers.org/1:x", False, "https://w3id.org/kgx/slot/1%3Ax", "https://w3id.org/biolink/enum/1%3Ax/1%3Ax"),
    "": ("https://identifiers.org/", False, "https://w3id.org/kgx/slot/", "https://w3id.org/biolink/enum//"),
}
#: Odd ends: whether these are CURIEs.
ENDS = {"a:b\n": True, "a:b\n\n": False, "a:\x1c": False, "a:\u00a0": False, "日本:x": False, "a b:c": False, "a:": False}


def test_identifiers(spark):
    got = rows(spark, list(NAMED), T.curie_to_iri("v"), T.is_curie("v"), T.custom_slot_iri("v"), T.enum_value_iri("v", "v"))
    assert dict(zip(NAMED, got)) == NAMED
    assert [r[0] for r in rows(spark, list(ENDS), T.is_curie("v"))] == list(ENDS.values())
    # the same rule for one value in Python
    for v, (iri, curie, *_) in NAMED.items():
        assert T.named_by(v) == (iri if curie or v.startswith("http") else None)
    assert [T.named_by(v) is not None for v in ENDS] == list(ENDS.values()) and T.named_by(3) is None


def test_json_text(spark):
    values = [*ODD, "plain id:1", "é", "𝄞 clef", "\x00\x1f\x7f", "tab\tnl\n", "\b\f\r", "'/<>&"]
    for v, (text, name) in zip(values, rows(spark, values, T.json_text("v"), T.reverse_iri("v"))):
        assert text == json.dumps(v)
        assert name == "https://w3id.org/kgx/traversal/reverse/" + hashlib.sha256(json.dumps({"reverse_traversal_of": v}, separators=(",", ":")).encode()).hexdigest()


def test_literals_round_trip(spark):
    got = rows(spark, ODD, T.strip_typed_literal(T.plain_literal("v")), T.normalize_iri(T.iri_term("v")), T.resource("v"))
    for v, (a, b, c) in zip(ODD, got):
        esc = v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
        assert a == esc and b == v and c == "<" + v.replace("\\", "%5C").replace(">", "%3E").replace("<", "%3C") + ">"


def test_float_text(spark):
    xs = [0.0, 1.0, -2.5, 1e7, 12345678.25, 1e15, 1e16, 1.5e300, 1e-3, 0.00012, 1e-5, 2.5e-7, float("nan"), float("inf"), float("-inf")]
    assert [r[0] for r in rows(spark, xs, T.float_text("v"), kind="double")] == [str(x) for x in xs]


def test_values_and_lists(spark):
    df = spark.createDataFrame([("p", json.dumps({"a": True, "b": 1, "c": 1.0, "d": "1", "e": None, "f": [None, ["x", 2]], "g": [], "h": {"id": "A:1"}}))], "k string, t string")
    flat = flatten.fan_out(flatten.attributes(df, "k", "t"), "k").select("attr", "idx", flatten.scalar_kind("value").alias("kind"), flatten.render_scalar("value").alias("o"))
    got = {(r["attr"], r["idx"], r["kind"]): r["o"] for r in flat.collect()}
    assert got[("a", 0, "boolean")].startswith('"true"^^') and got[("c", 0, "double")].startswith('"1.0"^^') and got[("b", 0, "integer")].startswith('"1"^^')
    assert got[("f", 0, "null")] == '"None"' and got[("f", 0, "string")] == '"x"' and got[("f", 1, "integer")].startswith('"2"')
    assert not [k for k in got if k[0] in "eg"] and ("h", 0, "object") in got


def test_nested_nodes(spark):
    rec = {"crew": [{"id": "CREW:7", "x": {"deep": "é"}}, {"id": "no curie"}, [{"id": "http://a b"}]]}
    frame = spark.createDataFrame([("urn:e", json.dumps(rec)), ("urn:none", None), ("urn:blank", "  ")], "parent_iri string, value string")
    got = {(r["key"], r["child"]): r for r in flatten.nested_nodes(frame).collect()}
    assert sorted((r["key"], r["idx"]) for r in got.values()) == [("crew", 0), ("crew", 0), ("crew", 1), ("x", 0)]
    own = "https://identifiers.org/CREW:7"
    assert {r["child_iri"] for r in got.values()} >= {own, "http://a b", generated_id(own, "x", {"deep": "é"}, 0), generated_id("urn:e", "crew", {"id": "no curie"}, 1)}
    # neither operator passes over a text that is no JSON; nulls and blanks have nothing
    assert flatten.attributes(frame, "parent_iri", "value").count() == 1
    bad = spark.createDataFrame([("urn:e", "{half")], "parent_iri string, value string")
    for op in (lambda: flatten.nested_nodes(bad), lambda: flatten.attributes(bad, "parent_iri", "value")):
        with pytest.raises(Exception):
            op().collect()


def generated_id(parent, key, value, index):
    text = json.dumps({"index": index, "key": key, "parent_id": parent, "value": value}, sort_keys=True, separators=(",", ":"))
    return T.NODE_NS + hashlib.sha256(text.encode()).hexdigest()


def test_lists_of_any_depth(spark):
    deep = "deep"
    for _ in range(12):
        deep = [deep]
    text = json.dumps({"a": [deep, 5]})
    got = flatten.fan_out(flatten.attributes(spark.createDataFrame([("k", text)], "k string, t string"), "k", "t"), "k")
    assert sorted((r["idx"], r["o"]) for r in got.select("idx", flatten.render_scalar("value").alias("o")).collect()) == [(0, '"deep"'), (1, f'"5"^^<{T.XSD}integer>')]
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("__")]


def test_typed_values(spark):
    got = rows(spark, ["1"], T.literal("boolean", F.lit(True)), T.literal("integer", F.lit(3)), T.reverse_iri("v"))
    assert got[0][0] == f'"true"^^<{T.XSD}boolean>' and got[0][1] == f'"3"^^<{T.XSD}integer>'


def test_json_text_of_a_long_text_is_json_and_fast(spark):
    import time

    texts = ["".join(chr(i) for i in range(0xD800)) + "\U0001f600\U0010ffff é\x7f\\u00e9", "né à la façon\n\"x\" " * 60_000, "\x00", "é", "漢字" * 3]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    began = time.time()
    got = [r[0] for r in df.select(T.json_text("t")).collect()]
    assert got == [json.dumps(t) for t in texts] and time.time() - began < 15
