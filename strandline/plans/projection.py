"""The fixed graph over the driver tables, and its stored adjacency."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from strandline.operators.graph import Adjacency
from strandline.sources.adjacency import open_adjacency, write_adjacency
from strandline.sources.shared import shared_dir


def _id(prefix: str, *cols: str):
    parts = [F.lit(prefix)]
    for i, c in enumerate(cols):
        parts += ([F.lit("-")] if i else []) + [F.col(c).cast("string")]
    return F.concat(*parts)


#: Edge prefix and id columns, subject, predicate, object, table, whether rows repeat.
EDGES = [
    ("urn:e:ord:", ("o_orderkey",), ("CUST:", "o_custkey"), "biolink:places", ("ORDER:", "o_orderkey"), "orders", False),
    ("urn:e:cn:", ("c_custkey",), ("CUST:", "c_custkey"), "biolink:located_in", ("NATION:", "c_nationkey"), "customer", False),
    ("urn:e:sn:", ("s_suppkey",), ("SUPP:", "s_suppkey"), "biolink:located_in", ("NATION:", "s_nationkey"), "supplier", False),
    ("urn:e:nr:", ("n_nationkey",), ("NATION:", "n_nationkey"), "biolink:subclass_of", ("REGION:", "n_regionkey"), "nation", False),
    ("urn:e:pt:", ("p_partkey",), ("PART:", "p_partkey"), "biolink:subclass_of", ("PTYPE:", "p_type"), "part", False),
    ("urn:e:op:", ("l_orderkey", "l_partkey"), ("ORDER:", "l_orderkey"), "biolink:contains", ("PART:", "l_partkey"), "lineitem", True),
    ("urn:e:ps:", ("l_partkey", "l_suppkey"), ("PART:", "l_partkey"), "biolink:supplied_by", ("SUPP:", "l_suppkey"), "lineitem", True),
]


#: Rows of numbers that one task compares, whatever the table's size: what is made of them is many times larger.
TASK_ROWS = 500_000


def _set(df: DataFrame) -> DataFrame:
    """``df`` without repeated rows. Where the session's tasks would hold more than ``TASK_ROWS``, it is dealt over more."""
    tasks = -(-df.count() // TASK_ROWS)
    return df.repartition(tasks, *df.columns).distinct() if tasks > df.sparkSession.sparkContext.defaultParallelism else df.distinct()


def edges(spark: SparkSession, sf_dir: str, unique: bool = False) -> DataFrame:
    """The edge table; ``unique`` leaves out repeated rows where they are still numbers (every one of them is also in the
    subject or object, so different numbers are different edges)."""
    out = None
    for pre, ids, s, p, o, name, repeats in EDGES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        need = dict.fromkeys((*ids, s[1], o[1]))
        df = _set(df.select(*need)) if repeats or unique else df.select(*need)
        one = df.select(_id(pre, *ids).alias("edge"), _id(*s).alias("s"), F.lit(p).alias("p"), _id(*o).alias("o"))
        out = one if out is None else out.unionByName(one)
    return out


def numbers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """The oriented edges as numbers: ``kind`` (two for each of ``EDGES``, forward and reverse), the first node's ``x``, the last one's ``y``
    and the ``text`` of an end that is no number; and what makes the columns of an oriented edge of them. Rows may repeat."""
    out, at, shape = None, {c: [] for c in ("f", "edge", "pred", "t")}, {}
    texts: tuple[list[int], list[int]] = ([], [])
    for pre, ids, s, p, o, name, _ in EDGES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        number = {c: isinstance(df.schema[c].dataType, IntegralType) for c in (s[1], o[1])}
        text = F.coalesce(*(F.lit(None).cast("string") if number[c] else F.col(c).cast("string") for c in number))
        ways = []
        for here, there in ((s, o), (o, s)):
            kind = len(at["f"])
            for c, x in (("f", here[0]), ("edge", pre), ("pred", p), ("t", there[0])):
                at[c].append(x)
            for side, (_, c) in enumerate((here, there)):
                if not number[c]:
                    texts[side].append(kind)
            # every number of an id is one of the ends'
            shape.setdefault(tuple((here[1], there[1]).index(c) for c in ids), []).append(kind)
            x, y = (F.col(c).cast("long") if number[c] else F.lit(None).cast("long") for c in (here[1], there[1]))
            ways.append(F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), text.alias("text")))
        one = df.select(F.explode(F.array(*ways)).alias("e")).select("e.*")
        out = one if out is None else out.unionByName(one)
    kind = F.col("kind")
    of = {c: F.array(*map(F.lit, values))[kind] for c, values in at.items()}
    ends = [F.when(kind.isin(own), F.col("text")).otherwise(F.col(c).cast("string")) for c, own in zip(("x", "y"), texts)]
    joined = {places: [ends[places[0]], *(x for i in places[1:] for x in (F.lit("-"), ends[i]))] for places in shape}
    edge = F.coalesce(*(F.when(kind.isin(own), F.concat(of["edge"], *joined[places])) for places, own in shape.items()))
    return out, {
        "f": F.concat(of["f"], ends[0]), "dir": F.when(kind % 2 == 0, "forward").otherwise("reverse"), "edge": edge, "pred": of["pred"], "t": F.concat(of["t"], ends[1]),
    }


def edges_sql() -> str:
    parts = []
    for pre, ids, s, p, o, name, repeats in EDGES:
        cols = ", ".join(dict.fromkeys((*ids, s[1], o[1])))
        src = f"(SELECT DISTINCT {cols} FROM {name})" if repeats else name
        key = " || '-' || ".join(f"CAST({c} AS VARCHAR)" for c in ids)
        parts.append(f"SELECT '{pre}' || {key} AS edge, '{s[0]}' || CAST({s[1]} AS VARCHAR) AS s, '{p}' AS p, '{o[0]}' || CAST({o[1]} AS VARCHAR) AS o FROM {src}")
    return " UNION ALL ".join(parts)


def node_ids(spark: SparkSession, sf_dir: str, sides: tuple[str, ...] = ("s", "o")) -> DataFrame:
    """``id``: the edges' subjects, objects or both, each once. No edge is made for that: ids of unlike prefixes differ, so what is
    compared is the numbers under a prefix (texts, where a table has texts), first in each scan."""
    ends = dict.fromkeys((*(s if side == "s" else o), name) for _, _, s, _, o, name, _ in EDGES for side in sides)
    tables = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for _, _, name in ends}
    texts = {prefix for prefix, c, name in ends if not isinstance(tables[name].schema[c].dataType, IntegralType)}
    out = None
    for prefix, c, name in ends:
        number, text = (F.lit(None).cast("long"), F.col(c).cast("string")) if prefix in texts else (F.col(c).cast("long"), F.lit(None).cast("string"))
        # an id without a number is the same null under every prefix
        one = tables[name].select(F.when(F.col(c).isNotNull(), prefix).alias("prefix"), number.alias("number"), text.alias("text"))
        out = one if out is None else out.unionByName(one)
    return out.distinct().select(F.concat("prefix", F.coalesce(F.col("number").cast("string"), "text")).alias("id"))


def graph_ids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """``v``: ids of edges, their subjects and predicates, each once and none null; and what such an id begins with. Like
    ``node_ids``, this compares numbers: the three kinds of id, and the tables' edges, differ by what they begin with."""
    starts = [x for pre, _, s, p, *_ in EDGES for x in (pre, s[0], p)]
    out, used = node_ids(spark, sf_dir, ("s",)).toDF("v"), None
    for pre, ids, _, p, _, name, _ in EDGES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out = out.unionByName(_set(df.select(*ids)).select(_id(pre, *ids).alias("v")))
        one = df.select(F.lit(p).alias("v")).limit(1)  # a table without rows has no predicate
        used = one if used is None else used.unionByName(one)
    return out.unionByName(used.distinct()).where("v is not null"), list(dict.fromkeys(starts))


_STORED: dict[tuple[str, str], str] = {}


def adjacency(spark: SparkSession, sf_dir: str) -> Adjacency:
    """The oriented edges, written once per application and input to the shared folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        path = f"{shared_dir(spark)}/adjacency-{uuid.uuid4().hex}"
        rows, made = numbers(spark, sf_dir)
        write_adjacency(rows, path, made=made)
        _STORED[key] = path
    return open_adjacency(spark, _STORED[key])
