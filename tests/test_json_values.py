"""Numbers as written and canonical JSON against Python's own parser and encoder."""

import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from strandline.functions import json_values as J
from strandline.functions import terms as T
from strandline.operators import flatten

from test_terms import generated_id

NUMBERS = ["0", "-0", "-0.0", "0.0", "2.0", "1.50", "1e23", "2E+23", "5e-324", "-4.9E-324", "1e-323", "5e-323", "12345678901234567890.0", "1" * 43, "-" + "9" * 60, "1e999", "-1e999", "1e5", "1E-7", "123456789.125", "9007199254740993", "NaN", "Infinity", "-Infinity", "0.0001", "0.00001", "1e16", "123456789012345680"]


def plain(text):
    """How a number of JSON is rendered."""
    v = json.loads(text)
    return f'"{v}"^^<{T.XSD}{"integer" if isinstance(v, int) else "double"}>'


def canonical(text):
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def test_numbers_keep_their_text(spark):
    df = spark.createDataFrame([(x, json.dumps({"a": "#"}).replace('"#"', x)) for x in NUMBERS], "k string, t string")
    got = {r["k"]: r["o"] for r in flatten.attributes(df, "k", "t").select("k", flatten.render_scalar("value").alias("o")).collect()}
    assert got == {x: plain(x) for x in NUMBERS}
    kinds = {r[0]: r[1] for r in flatten.attributes(df, "k", "t").select("k", flatten.scalar_kind("value")).collect()}
    assert kinds["2.0"] == kinds["1e5"] == kinds["12345678901234567890.0"] == "double" and kinds["1" * 43] == "integer"


def test_doubles_equal_python(spark):
    r = random.Random(2)
    bits = [struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(60_000)]
    xs = bits + [r.random() * 10 ** r.randint(-12, 22) for _ in range(30_000)] + [round(r.random() * 1e6, r.randint(0, 5)) for _ in range(8_000)]
    xs += [k * 5e-324 for k in range(1, 2000)] + [float(f"1e{e}") for e in range(-323, 309)] + [float(f"2e{e}") for e in range(-323, 308)] + [2.0**-44, 9007199254740993.0]
    text = spark.createDataFrame([("\n".join(map(repr, xs)),)], "t string").select(F.explode(F.split("t", "\n")).alias("t")).select("t", F.col("t").cast("double").alias("x"))
    wrong = text.where(F.col("t") != T.float_text("x")).select("t", T.float_text("x")).limit(5).collect()
    assert wrong == []


ODD = [
    '{"b":1,"a":{"z":[1.50,-0.0,[{}],[]],"é":"ü \\u00e9 \\ud83d\\ude00 \U0001f600 \\" \\\\ \\/ \\b\\f\\n\\r\\t \\u001f \\u007f"},"":null,"t":true,"f":false}',
    '{"a":"\\u0000n12","b":"\\u0000","\\u0000n5":{"\\u0000":"x"},"c":":\\"\\u0000n5\\"","d":"\\\\\\"\\u0000n7"}',
    '{"k":1,"k":{"x":2,"x":3}}',
    ' {"n" : [ 1 , 2.0 , "3" , -4e5 ] , "s" : "a 5 -6 \\"7\\" N I" } ',
    '{"dash-key 1":"x","NaN":NaN,"I":[Infinity,-Infinity]}',
    '{"quoted":"\\"12\\": 13, [14]","slash":"\\\\"}',
]


def test_canonical_text(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    r = random.Random(8)

    def some(depth):
        kind = r.randrange(7 if depth else 4)
        if kind < 4:
            return [r.choice([None, True, False]), r.randrange(-(10**r.randrange(1, 30)), 10**20), r.uniform(-1, 1) * 10 ** r.randrange(-30, 30), "".join(r.choice('a"\\\x01\x1f\x7f/é漢😀 \n0-N') for _ in range(r.randrange(8)))][kind]
        if kind == 4:
            return [some(depth - 1) for _ in range(r.randrange(4))]
        return {"".join(r.choice("abé\n\"0") for _ in range(r.randrange(4))): some(depth - 1) for _ in range(r.randrange(5))}

    texts = ODD + [json.dumps({"v": some(4)}, ensure_ascii=bool(i % 2)) for i in range(400)] + [json.dumps({"big": 'x"y1 ' * 100_000, "n": -0.0})]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", J.canonical_json(J.parsed("t")).alias("c")).collect()
    for t, c in got:
        assert c == canonical(t)
    for bad in ("01", "1.", "- 1", "+1", "1 2", '{"a":1e}', "nan", '{"a":.5}'):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(J.canonical_json(J.parsed("t"))).collect()


def plain_nested(parent, record, skip=()):
    out = []

    def walk(parent, key, value, i):
        if isinstance(value, list):
            for j, x in enumerate(value):
                walk(parent, key, x, j)
        elif isinstance(value, dict):
            child = T.named_by(value.get("id")) or generated_id(parent, key, value, i)
            out.append((parent, key, i, child, json.dumps(value, sort_keys=True, separators=(",", ":"))))
            for k, v in value.items():
                if k not in ("id", "category"):
                    walk(child, k, v, 0)

    for k, v in record.items():
        if k not in skip:
            walk(parent, k, v, 0)
    return out


def test_nested_records_equal_plain_version(spark):
    records = [("urn:1", ODD[0]), ("urn:2", ODD[1]), ("urn:3", ODD[2]), ("urn:4", '{"id":{"a":1},"skip":{"b":2},"x":[[{"id":"A:1","y":{"n":1.0}},{"id":5}],{"category":{"c":1},"z":[{"q":[{"r":-0.0}]}]}]}'), ("urn:5", "{}"), ("urn:6", None), ("urn:7", '{"x":[]}')]
    records += [("urn:1", ODD[0])]  # a repeated row
    df = spark.createDataFrame(records, "parent_iri string, value string")
    got = flatten.nested_nodes(df, ("skip",))
    want = [x for p, t in records if t for x in plain_nested(p, json.loads(t), ("skip",))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan
    assert flatten.nested_nodes(df.limit(0)).count() == 0
