"""The converter and the command line on a small graph of ships and harbours, against the full set of triples
computed by hand-written rules below."""

import gzip
import hashlib
import json
from pathlib import Path

import pytest

from strandline import cli
from strandline.sources.archive import write_archive

VOCAB, IDS, RDF = "https://w3id.org/biolink/vocab/", "https://identifiers.org/", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS, ENUM, SLOT, NODE = "http://www.w3.org/2000/01/rdf-schema#", "https://w3id.org/biolink/enum/", "https://w3id.org/kgx/slot/", "https://w3id.org/kgx/node/"
WAY, XSD = "https://w3id.org/kgx/traversal/", "http://www.w3.org/2001/XMLSchema#"

NODES = [
    {"id": "SHIP:9", "category": ["biolink:Vessel", "biolink:Ferry"], "name": "Ängön \"II\"", "deck plan": [[4, [7.5]], None, "aft"], "retired": None},
    {"id": "PORT:a/b c", "category": "biolink:Harbour", "open": False, "berths": {"id": "not a name", "list": [1]}},
]
EDGES = [
    {"id": "urn:call:1", "subject": "SHIP:9", "predicate": "biolink:calls_at", "object": "PORT:a/b c", "season": "summer", "like": "biolink:berths_at", "papers": ["DOI:10/x"]},
    {"id": "CALL:2", "subject": "SHIP:9", "predicate": "biolink:calls_at", "object": "PORT:a/b c", "season": "monsoon"},
]
TABLES = {
    "element": [
        ("season", "slot", "season", "biolink:season", None, "SeasonEnum"), ("biolink:berths_at", "slot", "berths at", "biolink:berths_at", None, None),
        ("biolink:Ferry", "class", "ferry", None, "biolink:Ferry", None), ("biolink:Vessel", "class", "vessel", None, "biolink:Vessel", None),
    ],
    "parent": [("biolink:Ferry", "biolink:Vessel"), ("biolink:calls_at", "biolink:visits")],
    "ancestor": [("biolink:Ferry", "biolink:Vessel")],
    "enum_value": [("SeasonEnum", "summer")],
    "enum_parent": [("SeasonEnum", "summer", "warm half")],
}


def expected():
    """Every triple of the graph above, as N-Triples lines."""
    ship, port, child = IDS + "SHIP:9", IDS + "PORT:a/b%20c", None
    iri, integer = (lambda x: f"<{x}>"), (lambda x: f'"{x}"^^<{XSD}integer>')
    canonical = json.dumps({"index": 0, "key": "berths", "parent_id": port, "value": {"id": "not a name", "list": [1]}}, sort_keys=True, separators=(",", ":"))
    child = NODE + hashlib.sha256(canonical.encode()).hexdigest()
    out = {
        (ship, SLOT + "name", '"Ängön \\"II\\""'), (ship, SLOT + "deck_plan", integer(4)), (ship, SLOT + "deck_plan", f'"7.5"^^<{XSD}double>'), (ship, SLOT + "deck_plan", '"None"'), (ship, SLOT + "deck_plan", '"aft"'),
        (port, SLOT + "open", f'"false"^^<{XSD}boolean>'), (port, SLOT + "berths", iri(child)), (child, SLOT + "list", integer(1)),
        (ship, RDF + "type", iri(VOCAB + "Ferry")), (ship, VOCAB + "is_a", iri(VOCAB + "Ferry")),
    }
    for raw, e, season in (("urn:call:1", "urn:call:1", iri(ENUM + "SeasonEnum/summer")), ("CALL:2", IDS + "CALL:2", '"monsoon"')):
        out |= {
            (ship, VOCAB + "calls_at", iri(port)), (e, RDF + "type", iri(RDF + "Statement")), (e, RDF + "type", iri(WAY + "TraversalEdge")), (e, RDF + "subject", iri(ship)),
            (e, RDF + "predicate", iri(VOCAB + "calls_at")), (e, RDF + "object", iri(port)), (e, WAY + "traversal_from", iri(ship)), (e, WAY + "traversal_to", iri(port)), (e, VOCAB + "season", season),
        }
        r = WAY + "reverse/" + hashlib.sha256(json.dumps({"reverse_traversal_of": raw}, separators=(",", ":")).encode()).hexdigest()
        out |= {
            (r, RDF + "type", iri(WAY + "TraversalEdge")), (r, RDF + "type", iri(WAY + "ReverseTraversalEdge")), (r, WAY + "traverses", iri(e)),
            (r, WAY + "traversal_from", iri(port)), (r, WAY + "traversal_to", iri(ship)),
        }
    out |= {("urn:call:1", SLOT + "like", iri(VOCAB + "berths_at")), ("urn:call:1", SLOT + "papers", iri(IDS + "DOI:10/x"))}
    # the ontology terms that are touched, and those above them
    for name in ("Ferry", "Vessel"):
        out |= {(VOCAB + name, RDF + "type", iri(RDFS + "Class")), (VOCAB + name, RDFS + "label", f'"{name.lower()}"')}
    out |= {(VOCAB + x, RDF + "type", iri(RDF + "Property")) for x in ("calls_at", "visits", "berths_at")} | {(VOCAB + "berths_at", RDFS + "label", '"berths at"')}
    out |= {(VOCAB + "Ferry", RDFS + "subClassOf", iri(VOCAB + "Vessel")), (VOCAB + "calls_at", RDFS + "subPropertyOf", iri(VOCAB + "visits"))}
    summer, warm = ENUM + "SeasonEnum/summer", ENUM + "SeasonEnum/warm%20half"
    out |= {(summer, RDFS + "label", '"summer"'), (warm, RDFS + "label", '"warm half"'), (summer, VOCAB + "is_a", iri(warm))}
    return sorted(f"<{s}> <{p}> {o} ." for s, p, o in out)


def lines_of(folder, kind="gz"):
    import zstandard

    opened = gzip.open if kind == "gz" else zstandard.open
    return sorted(x.rstrip("\n") for p in Path(folder).glob(f"*.{kind}*") if not p.name.startswith(".") for x in opened(p, "rt"))


def converted(spark, tmp_path, nodes, edges, tables=None, reverse=False, codec="gzip"):
    from strandline.operators.convert import ONTOLOGY

    for name, rows in (tables or {}).items():
        spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ONTOLOGY[name])).write.parquet(f"{tmp_path}/onto/{name}.parquet")
    write_archive(f"{tmp_path}/a.tar.zst", {"nodes.jsonl": [json.dumps(x) for x in nodes], "edges.jsonl": [json.dumps(x) for x in edges]})
    cli.convert(spark, f"{tmp_path}/a.tar.zst", f"{tmp_path}/out", reverse, f"{tmp_path}/onto" if tables else None, codec)
    return f"{tmp_path}/out"


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return converted(spark, tmp_path_factory.mktemp("ships"), NODES, EDGES, TABLES, True, "zstd")


def test_every_triple(graph):
    assert lines_of(f"{graph}/triples", "zst") == expected()


def test_no_ontology_and_no_edges(spark, tmp_path):
    got = lines_of(converted(spark, tmp_path, NODES, []) + "/triples")
    known = {f"<{IDS}SHIP:9> <{VOCAB}is_a> <{VOCAB}{c}> ." for c in ("Ferry", "Vessel")}
    assert known <= set(got) and not [x for x in got if "Statement" in x or "subClassOf" in x]


def answer(folder):
    return "".join(p.read_text() for p in sorted(Path(folder).glob("part-*")))


def test_answer_of_the_command_line(spark, graph, tmp_path, capsys):
    """CURIE endpoints, sorted keys, pages, properties, counts: one JSON object over ordered parts."""
    cli.main(["paths", "SHIP:9", "PORT:a/b c", "1", "--graph", graph, "--output", f"{tmp_path}/o", "--include-properties", "--page-size", "1"])
    said = json.loads(capsys.readouterr().out)
    text = answer(f"{tmp_path}/o/answer")
    doc = json.loads(text)
    ship, port = IDS + "SHIP:9", IDS + "PORT:a/b%20c"
    assert (doc["start"], doc["end"], doc["path_length"], doc["path_count"], doc["skipped_malformed_rows"]) == (ship, port, 1, 2, 0)
    assert list(doc) == ["end", "paths", "path_count", "path_length", "query_time_ms", "skipped_malformed_rows", "properties", "start"]
    assert said["pages"] == 2 and doc["query_time_ms"] == said["query_time_ms"]
    assert [p["steps"] for p in doc["paths"]] == [[{"direction": "forward", "edge": e, "predicate": VOCAB + "calls_at"}] for e in sorted([IDS + "CALL:2", "urn:call:1"])]
    want = {}
    for line in expected():
        s, p, o = line[1:-2].split("> ", 2)
        if s in (ship, port, "urn:call:1", IDS + "CALL:2") and p[1:] not in (RDF + "subject", RDF + "predicate", RDF + "object"):
            want.setdefault(s, []).append({"predicate": p[1:], "value": o[1:-1] if o.startswith("<") else o})
    by = lambda v: sorted(v, key=lambda x: (x["predicate"], x["value"]))
    assert {k: by(v) for k, v in doc["properties"].items()} == {k: by(v) for k, v in want.items()} and list(doc["properties"]) == sorted(want)
    assert sorted(p.name for p in Path(f"{tmp_path}/o/pages").glob("page=*")) == ["page=0", "page=1"]
    # without paths, and with a limit
    cli.main(["paths", "SHIP:9", "SHIP:9", "1", "--graph", graph, "--output", f"{tmp_path}/none", "--include-subclasses"])
    assert json.loads(answer(f"{tmp_path}/none/answer"))["paths"] == []
    cli.main(["paths", "SHIP:9", "SHIP:9", "2", "--graph", graph, "--output", f"{tmp_path}/two", "--limit", "3"])
    two = json.loads(answer(f"{tmp_path}/two/answer"))
    assert two["path_count"] == len(two["paths"]) == 3 and two["paths"][0]["node1"] == {"id": port, "label": None} and two["paths"][0]["steps"][0]["next_node"] == port


def test_timing_grid(spark, graph, tmp_path):
    assert cli.parser().parse_args(["paths", "a", "b", "2", "--graph", "g", "--output", "o"]).page_size == 100_000
    cli.main(["bench", "SHIP:9", "PORT:a/b c", "--graph", graph, "--output", f"{tmp_path}/b", "--path-lengths", "1", "3", "--page-sizes", "2", "5"])
    record = json.loads(spark.read.text(f"{tmp_path}/b/record").first()[0])
    assert [(x["path_length"], x["page_size"], x["path_count"]) for x in record["benchmarks"]] == [(1, 2, 2), (1, 5, 2), (3, 2, 8), (3, 5, 8)]
    assert all(x["result_size_bytes"] == len(answer(f"{tmp_path}/b/{x['path_length']}hop_{x['page_size']}/answer").encode()) for x in record["benchmarks"])
