"""The registered queries of this folder: thin digests of the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.common import prepare, shared_dir, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.decontaminate import find_overlaps

    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), pat AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM pat
), win AS (
  SELECT doc_id, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, greatest(len(w) - k + 2, 1))) AS i FROM dw, ks WHERE len(w) >= k)
), hits AS (SELECT win.doc_id, win.i, win.k, pat.item_id FROM win JOIN pat ON win.k = pat.k AND win.p = pat.p
), cover AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(i.l, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN cover c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from strandline.llm.token_store import read_store, write_store

    path = f"{shared_dir(spark)}/token-store-{uuid.uuid4().hex}"
    write_store(table(spark, sf_dir, "documents"), path, _tokenizer("byte_bpe_50k.json"))
    return read_store(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth
  FROM (SELECT doc_id, i, array_slice(b, i, i + 99) AS s FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS i FROM d))
), c AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 100, true) AS fresh FROM w WHERE nth > 1
), r AS (
  SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM c) GROUP BY doc_id, g
), edges AS (
  SELECT doc_id, s, e FROM r UNION ALL SELECT doc_id, octet_length(b) + 1, octet_length(b) + 1 FROM d
), k AS (
  SELECT e.doc_id, string_agg(hex(array_slice(b, a, s - 1)), '' ORDER BY a) AS h
  FROM (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s, e), 1) AS a, s FROM edges) e JOIN d USING (doc_id) WHERE s > a GROUP BY e.doc_id
), n AS (SELECT doc_id, sum(e - s) AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(h, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.quality import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.secrets import scan, train

    docs = table(spark, sf_dir, "documents")
    return scan(docs, train(docs)).select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), F.coalesce(F.array_max(F.transform("secrets", lambda x: x["score"])), F.lit(0.0)).alias("top_score"), F.transform("secrets", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))).alias("spans"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.jaccard import link_documents

    return link_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + least(4, len(w)) - 1), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)
), u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r AS (
  WITH RECURSIVE t(d, c) AS (
    SELECT doc_id, doc_id FROM documents
    UNION SELECT u.b, t.c FROM t JOIN u ON u.a = t.d WHERE t.c < u.b
  ) SELECT d, min(c) AS c FROM t GROUP BY d
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.d = d.doc_id
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.toxicity import assess

    return assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.langid import assess

    return assess(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.neighbours import search

    return search(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))[0]


def _op11_sql(k: int = 8, rounds: int = 10) -> str:
    """One pair of tables a round: assignment and moved centroids."""
    sql = f"""WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM kept ORDER BY h, v LIMIT {k})
)"""
    for i in range(rounds + 1):
        sql += f""", a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, c, d FROM (SELECT k.*, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM kept k, c{i} c)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)"""
        if i < rounds:
            sql += f""", m{i} AS (
  SELECT c, list((CAST(s AS BIGINT) - (((CAST(s AS BIGINT) % n) + n) % n)) // n ORDER BY j) AS v
  FROM (SELECT c, j, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS j FROM a{i}) GROUP BY c, j) GROUP BY c
), c{i + 1} AS MATERIALIZED (SELECT c, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} USING (c))"""
    return sql + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  (SELECT sha256(array_to_string(f.v, ',')) FROM c{rounds} f WHERE f.c = a{rounds}.c) AS centroid_sha256
FROM a{rounds}"""


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.fim import transform

    found = transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *(F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d
), c AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(list_slice(u, 1, least(h1 % (n + 1), h2 % (n + 1))), '') AS a, array_to_string(list_slice(u, least(h1 % (n + 1), h2 % (n + 1)) + 1, greatest(h1 % (n + 1), h2 % (n + 1))), '') AS b,
    array_to_string(list_slice(u, greatest(h1 % (n + 1), h2 % (n + 1)) + 1, n), '') AS z FROM s
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""


def op13_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.llm.fertility import assess

    import public_tokenizers

    return assess(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}

    def ready(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return f(spark, sf_dir)

        return run

    return {k: ready(f) for k, f in sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0]))}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": OP1_SQL, "op2_suffix_dedup": OP2_SQL, "op6_ngram_join": OP6_SQL, "op11_centroids": _op11_sql(), "op12_fill_in_middle": OP12_SQL}
