"""Exact-length, direction-agnostic walks between two endpoints.

The adjacency holds both orientations, so a hop can be read from either side. Half of the hops start at
the first endpoint, half (directions flipped) at the last; both halves begin with a filter on ``f`` that reaches the Parquet
scan (files are sorted by ``f``), and they meet in the middle in one equi-join. Lifting an endpoint by one
stored subclass edge joins a candidate table instead of multiplying branches.

``reduced_paths`` first finds the nodes that lie on complete walks, by semi-joins of nodes alone, and joins only edges
between those; ``count_paths`` adds up walks per node and hop and lists none.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.terms import json_text
from strandline.operators.graph import EDGE, Adjacency
from strandline.sources.shared import stored

SUBCLASS = "biolink:subclass_of"

#: So many candidates of a lifted endpoint go into the scan's filter as a list; more are joined.
LISTED = 1000

EXACT = "decimal(38,0)"


def columns(k: int, lifted: bool) -> list[str]:
    out = []
    for i in range(1, k + 1):
        out += [f"dir{i}", f"edge{i}", f"pred{i}"] + ([f"node{i}"] if i < k else [])
    return out + (["match0", "subclass_edge0", f"match{k}", f"subclass_edge{k}"] if lifted else [])


def opened(adjacency: Adjacency | DataFrame) -> Adjacency:
    return adjacency if isinstance(adjacency, Adjacency) else Adjacency(adjacency)


def candidates(edges: DataFrame | Adjacency, endpoint: str, subclass: str = SUBCLASS) -> DataFrame:
    """The endpoint itself (no witness) and every subject of a subclass edge to it, from an edge table or from the
    adjacency, where those edges stand together."""
    none = F.lit(None).cast("string")
    if isinstance(edges, Adjacency):
        below = edges.rows.where((F.col("f") == endpoint) & (F.col("dir") == "reverse") & (F.col("pred") == subclass)).select(F.col("t").alias("s"), "edge")
    else:
        below = edges.where((F.col("p") == subclass) & (F.col("o") == endpoint))
    own = below.sparkSession.range(1).select(F.lit(endpoint).alias("n"), none.alias("match"), none.alias("via"))
    return own.unionByName(below.select(F.col("s").alias("n"), F.col("s").alias("match"), F.col("edge").alias("via")))


class _Ends:
    """Both endpoints' candidates; those of a lifted one are looked up once. Up to ``LISTED`` of them come to the driver and
    go into the scan's filter; more stay a table that is joined."""

    def __init__(self, adjacency: Adjacency, start: str, end: str, k: int, edges: DataFrame | None, lift: tuple[bool, bool], subclass: str):
        self.spark, self.lifted, self.k, self.nodes = adjacency.rows.sparkSession, any(lift), k, (start, end)
        self.tables, self.listed = [], []
        for endpoint, up in zip((start, end), lift):
            table, few = None, [endpoint]
            if up:
                table = candidates(adjacency if edges is None else edges, endpoint, subclass).distinct()
                rows = table.limit(LISTED + 1).collect()
                few = sorted({r["n"] for r in rows}) if len(rows) <= LISTED else None
                if few:
                    table = F.broadcast(self.spark.createDataFrame(rows, table.schema))
            self.tables.append(table)
            self.listed.append(few)

    def narrowed(self, side: int, df: DataFrame, key: str) -> DataFrame:
        """The rows of ``df`` that can stand at this end, where few enough are listed for the scan; else all, since whoever asks
        joins the table of candidates, and one join does."""
        few = self.listed[side]
        if few is None:
            return df
        return df.where(F.col(key) == few[0]) if len(few) == 1 else df.where(F.col(key).isin(few))

    def at(self, side: int, df: DataFrame, key: str) -> DataFrame:
        """``df`` at this end, with its witness columns if any endpoint is lifted."""
        i, table = (0, self.k)[side], self.tables[side]
        df = self.narrowed(side, df, key)
        if table is not None:
            return df.join(table.select(F.col("n").alias(key), F.col("match").alias(f"match{i}"), F.col("via").alias(f"subclass_edge{i}")), key)
        none = F.lit(None).cast("string")
        return df.withColumns({f"match{i}": none, f"subclass_edge{i}": none}) if self.lifted else df

    def counted(self, side: int) -> DataFrame:
        """(n, ways): each node that can stand at this end, with the number of its different witnesses."""
        table = self.tables[side]
        if table is None:
            return self.spark.range(1).select(F.lit(self.nodes[side]).alias("n"), F.lit(1).cast(EXACT).alias("ways"))
        return table.groupBy("n").agg(F.count("*").cast(EXACT).alias("ways"))


def _hop(rows: DataFrame, i: int, backwards: bool = False) -> DataFrame:
    way = F.when(F.col("dir") == "forward", "reverse").otherwise("forward") if backwards else F.col("dir")
    here, there = (f"node{i}", f"f{i}") if backwards else (f"f{i}", f"node{i}")
    slot = [F.col("slot").alias(f"slot{i}")] if "slot" in rows.columns else []
    return rows.select(F.col("f").alias(here), way.alias(f"dir{i}"), F.col("edge").alias(f"edge{i}"), F.col("pred").alias(f"pred{i}"), F.col("t").alias(there), *slot)


def _joined(own: Adjacency, ends: _Ends, hops: dict[int, DataFrame], k: int) -> DataFrame:
    """The walks over ``hops`` (edges by hop), from both ends to the middle."""
    middle = (k + 1) // 2
    walk = ends.at(0, _hop(hops[1], 1), "f1")
    for i in range(2, middle + 1):
        walk = own.onto(walk, f"node{i - 1}", _hop(hops[i], i), f"f{i}", f"slot{i}")
    if middle == k:
        return ends.at(1, walk, f"node{k}")
    back = ends.at(1, _hop(hops[k], k, True), f"node{k}")
    for i in range(k - 1, middle, -1):
        back = own.onto(back, f"f{i + 1}", _hop(hops[i], i, True), f"node{i}", f"slot{i}")
    return walk.join(back, F.col(f"node{middle}") == F.col(f"f{middle + 1}"))


def find_paths(
    adjacency: Adjacency | DataFrame, start: str, end: str, k: int, limit: int | None = None, offset: int | None = None, edges: DataFrame | None = None,
    lift_start: bool = False, lift_end: bool = False, subclass: str = SUBCLASS,
) -> DataFrame:
    """Distinct walks of exactly ``k`` hops. ``limit`` and ``offset`` apply to the order of all columns. Subclass edges come
    from ``edges`` if given, else from the adjacency."""
    if k < 1:
        raise ValueError("a path has at least one hop")
    own = opened(adjacency)
    ends = _Ends(own, start, end, k, edges, (lift_start, lift_end), subclass)
    walk = _joined(own, ends, dict.fromkeys(range(1, k + 1), own.rows), k)
    return _cut(walk.select(*columns(k, ends.lifted)).distinct(), limit, offset)


def _cut(out: DataFrame, limit: int | None, offset: int | None) -> DataFrame:
    if limit is not None or offset:
        out = in_order(out)
        out = out.offset(offset) if offset else out
        out = out.limit(max(limit, 0)) if limit is not None else out
    return out


def _spread(own: Adjacency, nodes: DataFrame, column: str = "n") -> DataFrame:
    """(f, t) of the edges at ``nodes``."""
    hop = own.rows.select("f", "t", *(["slot"] if "slot" in own.rows.columns else []))
    return own.onto(nodes.select(F.col(column).alias("__n")), "__n", hop, "f", "slot").select("f", "t")


def levels(adjacency: Adjacency | DataFrame, start: str, end: str, k: int, edges: DataFrame | None = None, lift_start: bool = False, lift_end: bool = False, subclass: str = SUBCLASS) -> list[DataFrame]:
    """The nodes ``n`` at each place (0 to ``k``) of complete walks, and no others: reached from both ends up to the
    middle, then taken back to the ends. Every set is stored, so a join knows how small it is."""
    own = opened(adjacency)
    return _levels(own, _Ends(own, start, end, k, edges, (lift_start, lift_end), subclass), k)


def _levels(own: Adjacency, ends: _Ends, k: int) -> list[DataFrame]:
    middle, found = (k + 1) // 2, {}
    for side, places in ((0, range(0, middle + 1)), (1, range(k, middle - 1, -1))):
        own_set = None
        for place in places:
            if own_set is None:
                own_set = ends.counted(side).select("n")
            else:
                own_set = _spread(own, own_set).select(F.col("t").alias("n")).distinct()
            own_set = found[side, place] = stored(own_set, "level")
    out = {middle: stored(found[0, middle].join(found[1, middle], "n", "left_semi"), "level")}
    for side, places in ((0, range(middle - 1, -1, -1)), (1, range(middle + 1, k + 1))):
        for place in places:
            back = _spread(own, out[place + 1 if side == 0 else place - 1]).select(F.col("t").alias("n")).distinct()
            out[place] = stored(found[side, place].join(back, "n", "left_semi"), "level")
    return [out[i] for i in range(k + 1)]


def reduced_hops(adjacency: Adjacency | DataFrame, at: list[DataFrame]) -> dict[int, DataFrame]:
    """By hop, the edges between the nodes of two neighbouring ``levels``: each lies on a complete walk. Rows of the half
    that is joined backwards are kept as they are stored, by their later node."""
    own, k = opened(adjacency), len(at) - 1
    middle, out = (k + 1) // 2, {}
    for i in range(1, k + 1):
        f, t = (at[i - 1], at[i]) if i <= middle else (at[i], at[i - 1])
        rows = own.rows.join(f.select(F.col("n").alias("f")), "f", "left_semi")
        out[i] = rows.join(t.select(F.col("n").alias("t")), "t", "left_semi").select(*own.rows.columns)
    return out


def reduced_paths(
    adjacency: Adjacency | DataFrame, start: str, end: str, k: int, limit: int | None = None, offset: int | None = None, edges: DataFrame | None = None,
    lift_start: bool = False, lift_end: bool = False, subclass: str = SUBCLASS,
) -> DataFrame:
    """``find_paths`` after a full reduction: no wide row exists that does not end in a walk. Worth its passes over
    the nodes where many half-walks lead nowhere."""
    if k < 1:
        raise ValueError("a path has at least one hop")
    own = opened(adjacency)
    ends = _Ends(own, start, end, k, edges, (lift_start, lift_end), subclass)
    hops = reduced_hops(own, _levels(own, ends, k))
    walk = _joined(own, ends, hops, k)
    return _cut(walk.select(*columns(k, ends.lifted)).distinct(), limit, offset)


def count_paths(
    adjacency: Adjacency | DataFrame, start: str, end: str, k: int, edges: DataFrame | None = None, lift_start: bool = False, lift_end: bool = False, subclass: str = SUBCLASS,
) -> DataFrame:
    """One row: start, end, path_length, path_count (38 digits; more is an error), without listing a walk.

    Walks are added up per node, hop by hop from both ends, and multiplied where the halves meet, so what is shuffled are
    nodes with one number each. Repeated rows of the adjacency count once, edges that share an id as the edges they are."""
    if k < 1:
        raise ValueError("a path has at least one hop")
    own = opened(adjacency)
    if not own.distinct:
        own = Adjacency(own.rows.select(*EDGE).distinct(), None, True)
    ends, middle, halves = _Ends(own, start, end, k, edges, (lift_start, lift_end), subclass), (k + 1) // 2, []
    hop = own.rows.select("f", "t", *(["slot"] if "slot" in own.rows.columns else []))
    for side, hops in ((0, middle), (1, k - middle)):
        ways = ends.counted(side)
        for i in range(hops):
            reached = own.onto(ways, "n", ends.narrowed(side, hop, "f") if not i else hop, "f", "slot")
            ways = reached.groupBy(F.col("t").alias("n")).agg(F.sum("ways").cast(EXACT).alias("ways"))
        halves.append(ways)
    met = halves[0].join(halves[1].withColumnRenamed("ways", "more"), "n")
    total = F.coalesce(F.sum((F.col("ways") * F.col("more")).cast(EXACT)), F.lit(0)).cast(EXACT)
    return met.agg(total.alias("path_count")).select(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(k).cast("long").alias("path_length"), "path_count")


def in_order(paths: DataFrame) -> DataFrame:
    return paths.orderBy(*[F.col(c).asc_nulls_first() for c in paths.columns])


def paged(paths: DataFrame, page_size: int) -> DataFrame:
    """``paths`` with ``nth`` (from 0, in the order of all columns) and ``page``. The sorted rows are stored once; a
    row's number is its place in its range and the sizes of the ranges before it, so no task counts them all."""
    if page_size < 1:
        raise ValueError("a page has at least one row")
    part = F.spark_partition_id()
    rows = in_order(paths).withColumn("__part", part).withColumn("__at", F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33))
    rows = stored(rows, "paths")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over one row a range
    base = rows.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    nth = (F.col("__at") + F.col("__base")).alias("nth")
    out = rows.join(base, "__part").select(*paths.columns, nth)
    return out.withColumn("page", F.floor(F.col("nth") / page_size).cast("long"))


def branch_union(edges: DataFrame, start: str, end: str, k: int) -> DataFrame:
    """The literal form: one chain of joins for each of the 2**k direction patterns. A test oracle."""
    out = None
    for pattern in product(("forward", "reverse"), repeat=k):
        walk = None
        for i, d in enumerate(pattern, 1):
            f, t = ("s", "o") if d == "forward" else ("o", "s")
            e = edges.select(F.col(f).alias(f"f{i}"), F.lit(d).alias(f"dir{i}"), F.col("edge").alias(f"edge{i}"), F.col("p").alias(f"pred{i}"), F.col(t).alias(f"node{i}"))
            e = e.where(F.col("f1") == start) if i == 1 else e
            e = e.where(F.col(f"node{k}") == end) if i == k else e
            walk = e if walk is None else walk.join(e, F.col(f"node{i - 1}") == F.col(f"f{i}"))
        walk = walk.select(*columns(k, False))
        out = walk if out is None else out.unionByName(walk)
    return out.distinct()


def document(k: int, lifted: bool) -> Column:
    """One path as a JSON object with sorted keys: inner nodes, steps and, where there are any, witnesses."""
    def step(i: int) -> Column:
        parts = [F.lit('{"direction":'), json_text(f"dir{i}"), F.lit(',"edge":'), json_text(f"edge{i}")]
        parts += [F.lit(',"next_node":'), json_text(f"node{i}")] if i < k else []
        return F.concat(*parts, F.lit(',"predicate":'), json_text(f"pred{i}"), F.lit("}"))

    fields = {f"node{i}": F.concat(F.lit('{"id":'), json_text(f"node{i}"), F.lit(',"label":null}')) for i in range(1, k)}
    fields["steps"] = F.concat(F.lit("["), F.concat_ws(",", *(step(i) for i in range(1, k + 1))), F.lit("]"))
    if lifted:
        for name, c in (("start_witness", "match0"), ("start_subclass_edge", "subclass_edge0"), ("end_witness", f"match{k}"), ("end_subclass_edge", f"subclass_edge{k}")):
            fields[name] = json_text(c)
    # a null field (no witness) leaves no key behind
    return F.concat(F.lit("{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), fields[name]) for name in sorted(fields))), F.lit("}"))


def documents(paths: DataFrame, k: int) -> DataFrame:
    """One JSON document a path."""
    return paths.select(document(k, "match0" in paths.columns).alias("document"))


def resources(paths: DataFrame, k: int, start: str, end: str, predicates: bool = True) -> DataFrame:
    """Endpoints, inner nodes, edges and (unless left out) predicates on the paths, each once. The endpoints
    are there without any path too."""
    parts = [F.col(f"node{i}") for i in range(1, k)] + [F.col(f"{c}{i}") for i in range(1, k + 1) for c in ("edge", *(["pred"] if predicates else []))]
    ends = paths.sparkSession.range(1).select(F.explode(F.array(F.lit(start), F.lit(end))).alias("resource"))
    return paths.select(F.explode(F.array(*parts)).alias("resource")).unionByName(ends).distinct()


def resource_list(paths: DataFrame, k: int, start: str, end: str) -> DataFrame:
    """The resources whose properties go with the paths, in order."""
    return resources(paths, k, start, end, predicates=False).orderBy("resource")


def summary(paths: DataFrame, start: str, end: str, k: int, malformed: Column | None = None) -> DataFrame:
    """One row of counts. ``malformed`` marks rows that are no path (see ``records.bindings``): they are counted apart."""
    bad = F.coalesce(malformed, F.lit(False)) if malformed is not None else F.lit(False)
    counts = paths.agg(F.count_if(~bad).alias("path_count"), F.count_if(bad).alias("skipped_malformed_rows"))
    return counts.select(F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(k).cast("long").alias("path_length"), "path_count", "skipped_malformed_rows")
