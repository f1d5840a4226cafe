"""The pipeline's stages and the whole of it against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import BASE, brute_components

P = pytest.importorskip("public_tokenizers")
cp = pytest.importorskip("corpus_pipeline")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, toxicity string"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash") for d, t in rows], COLUMNS)


def kept(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def near(rows):
    """Row-wise: of each group the row with the smallest id, null ids last."""
    comp = {i: c for i, (_, c) in brute_components({i: t for i, (_, t) in enumerate(rows)}, 5, 80).items()}
    best = {}
    for i, (d, _) in enumerate(rows):
        c = comp[i]
        if c not in best or (d is None, d or 0) < (rows[best[c]][0] is None, rows[best[c]][0] or 0):
            best[c] = i
    return Counter(rows[i] for i in best.values())


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(200)]
    near_by = [" ".join(base), " ".join(base[:165]), " ".join([*base[:150], *(f"v{i}" for i in range(50))])]  # 161 and 146 of 196 shingles
    rows = [(2, near_by[1]), (1, near_by[0]), (3, near_by[2]), (5, "same id other text one"), (5, "not at all like it two"), (7, "a row twice over here"), (7, "a row twice over here"), (None, near_by[0]), (None, "no id at all here once"), (None, "no id at all here once"), (8, None), (9, ""), (9, ""), (10, " .. ")]
    got = cp.near_duplicates(spark, frame(spark, rows), BASE)
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    # null and empty texts have no shingles: all their rows stay
    assert kept(got) == near(rows)
    assert kept(got)[9, ""] == 2 and kept(got)[1, near_by[0]] == 1 and kept(got)[5, rows[3][1]] == kept(got)[5, rows[4][1]] == 1


def test_toxicity_and_decontamination_go_by_row(spark):
    from strandline.llm import toxicity

    labels, docs = spark.read.parquet(f"{BASE}/labels.parquet"), spark.read.parquet(f"{BASE}/documents.parquet")
    model = toxicity.train(docs, labels)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    s = model.score(pa.array([t for _, t in rows], pa.string()))
    rows += [(None, rows[int(np.argmax(s))][1]), (rows[0][0], rows[int(np.argmax(s))][1]), (5, None), (5, "")]
    s = model.score(pa.array([t for _, t in rows], pa.string()))
    got = cp.toxicity(spark, frame(spark, rows), BASE)
    assert kept(got) == Counter(r for r, x in zip(rows, s) if x < 0.7) and "toxicity" in got.columns
    item = spark.read.parquet(f"{BASE}/benchmark.parquet").first()["text"]
    rows = [(1, item), (1, "clean words"), (None, "lead " + item), (None, "fine"), (2, None), (3, "")]
    assert kept(cp.decontamination(spark, frame(spark, rows), BASE)) == Counter([rows[1], rows[3], rows[4], rows[5]])


def test_empty_table_and_no_shared_folder(spark):
    empty = frame(spark, [])
    for name, stage in cp.STAGES:
        assert stage(spark, empty, BASE).count() == 0, name


def test_pipeline(spark):
    """The end result equals what plain loops over the documents leave."""
    from tokenizers import Tokenizer

    from strandline.llm import secrets, toxicity

    docs, labels = spark.read.parquet(f"{BASE}/documents.parquet"), spark.read.parquet(f"{BASE}/labels.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    s = toxicity.train(docs, labels).score(pa.array([t for _, t in rows], pa.string()))
    rows = [r for r, x in zip(rows, s) if x < 0.7]
    rows = sorted(near(rows))
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = set()
    for r in spark.read.parquet(f"{BASE}/benchmark.parquet").collect():
        w = fold(r["text"])
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}
    rows = [(d, t) for d, t in rows if not any(tuple(w[i : i + n]) in windows for w in [fold(t)] for n in sizes for i in range(len(w) - n + 1))]
    left = spark.createDataFrame(rows, "doc_id long, text string")
    scanner = secrets.train(left)
    tok, want = Tokenizer.from_file(P.path("word_bpe_49k.json")), Counter()
    for d, t in rows:
        b, at, parts = (t or "").encode(), 0, []
        for i, j, _ in scanner.secrets(scanner.candidates(pa.array([t], pa.string()))[0]):
            parts += [b[at:i], b"[SECRET]"]
            at = j
        ids = tok.encode(b"".join([*parts, b[at:]]).decode(), add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), 2048):
            piece = ids[k : k + 2048]
            want[d, k // 2048, k, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    got = cp.run(spark, BASE)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secret_scan", "best_fit_packing"]
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got.collect()) == want
    used = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("top"))
    assert used.where("n <> top or n > 2048").count() == 0
