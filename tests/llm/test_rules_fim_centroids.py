"""Operators 11 to 13 against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import centroids, fertility, fim, queries
from strandline.llm.common import prepare

P = pytest.importorskip("public_tokenizers")
VOCAB = (P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def ready(spark):
    prepare(spark)
    return spark


# 11 ------------------------------------------------------------------------------------------
def plain_clusters(rows, k=8, dims=64, rounds=10, scale=1024, seed=3):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    sha = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    cents = [v for _, v in sorted(kept, key=lambda r: (sha(r[0]), r[1]))[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [min((dist(v, c), j) for j, c in enumerate(cents)) for _, v in kept]

    for _ in range(rounds):
        got = assign()
        for j in range(len(cents)):
            own = [v for (_, v), (_, a) in zip(kept, got) if a == j]
            if own:
                cents[j] = [sum(x) // len(own) for x in zip(*own)]
    got = assign()
    total = sum(d for d, _ in got)
    inertia = [sum(d for d, a in got if a == j) for j in range(len(cents))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted((str(i), j, d, inertia[j], total, digest[j]) for (i, _), (d, j) in zip(kept, got))


def clusters(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, v int, h string")
    return sorted((str(r[0]), *r[1:]) for r in centroids.cluster(df, **kw)[0].collect())


def test_clusters_equal_plain_rounds(ready):
    r = np.random.default_rng(7)
    centers = r.normal(size=(5, 64)) * [3.0] * 64
    rows = [(int(i), [float(x) for x in centers[i % 5] + r.normal(size=64) * 0.4]) for i in range(150)]
    rows += [(7, rows[7][1])] * 3 + [(None, rows[9][1]), (500, None), (501, [1.0] * 63), (502, [float("nan")] * 64), (503, [None] + [1.0] * 63), (504, [float("inf")] * 64), (505, [])]
    rows += [(600 + i, [float(i % 2)] * 64) for i in range(8)]  # ties
    assert clusters(ready, rows) == plain_clusters(rows)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_fewer_vectors_than_centroids(ready, n):
    rows = [(i, [float(i)] * 64) for i in range(n)]
    assert clusters(ready, rows) == plain_clusters(rows)


def test_equal_vectors_leave_centroids_empty(ready):
    rows = [(i, [0.5] * 64) for i in range(20)]
    got = clusters(ready, rows)
    assert got == plain_clusters(rows)
    assert {r[1] for r in got} == {0}


def test_components_beyond_a_long_are_an_error(ready):
    with pytest.raises(Exception, match="a component beyond"):
        clusters(ready, [(1, [1e300] * 64)])


@given(st.integers(1, 9), st.integers(0, 2**32 - 1))
@settings(max_examples=40, deadline=None)
def test_partial_distances_find_the_nearest(k, seed):
    r = np.random.default_rng(seed)
    x, c = r.integers(-4, 5, (60, 64)), r.integers(-4, 5, (k, 64))
    x[:10], c[k // 2] = c[0], c[0]
    which, best = centroids.nearest(x, c, r.permutation(64))
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (which == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()


# 12 ------------------------------------------------------------------------------------------
def plain_fim(text, key):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text or "")
    n, t = len(units), text or ""
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return t, n, "plain", None, None
    if h4 % 100 < 20:
        return f"<S>{s}<P>{p}<M>{m}", n, "spm", len(p), len(m)
    return f"<P>{p}<S>{s}<M>{m}", n, "psm", len(p), len(m)


def test_fim_equals_plain_version(ready):
    r = random.Random(5)
    texts = ["".join(r.choice("ab Z\n\t<>é漢😀 -") for _ in range(r.randrange(60))) for _ in range(300)]
    rows = [(i, t, "own", 3) for i, t in enumerate(texts)]
    rows += [(None, "a null id", "x", 1), (900, None, "x", 1), (901, "", "x", 1), (902, "has <M> inside", "x", 1), (903, "same", "x", 1), (903, "same", "x", 1), (-4, "negative id", "x", 1), (905, "é" * 3_000_000, "x", 1)]
    df = ready.createDataFrame(rows, "doc_id long, text string, form string, n int")
    got = fim.transform(df).select("doc_id", "text", "form", "fim.*").toDF("doc_id", "text", "own", "output", "n", "form", "p", "m", "sha", "again").collect()
    assert len(got) == len(rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for g in got:
        assert (g["output"], g["n"], g["form"], g["p"], g["m"]) == plain_fim(g["text"], g["doc_id"])
        assert g["sha"] == sha(g["output"]) and g["again"] == sha(g["text"] or "")
    assert {g["form"] for g in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0


@given(st.text(alphabet="ab <PSM>\n", max_size=40), st.integers(0, 10**6))
@settings(max_examples=300, deadline=None)
def test_fim_round_trip(text, key):
    output, _, form, _, _ = fim.rearrange(text, str(key))
    assert fim.restore(output, form) == text


# 13 ------------------------------------------------------------------------------------------
def plain_base(text):
    t = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(covered)


def base(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    return fertility.measured(df, *VOCAB)


def test_base_counts_equal_plain_version(ready):
    r = random.Random(3)
    some = ["a", "b", "cé", "#x", "漢", "<", "d e", "f g"]
    texts = ["".join(r.choice(some) + r.choice([" ", "\n", "\t", "  ", "\r\n", "\x0b"]) for _ in range(r.randrange(60))) for _ in range(120)]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "x y", None, 1), (800, None, "en", 1), (801, "", "en", 1), (802, " \n ", "en", 1), (803, "one\none", "en", 1), (803, "one\none", "en", 1)]
    got = base(ready, rows).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), *plain_base(t)) for i, t, _, _ in rows)
    assert sorted((str(g["doc_id"]), g["n_words"], g["word_chars"], g["n_symbols"], g["n_dup_lines"], g["n_repeat_words"]) for g in got) == want


def test_token_measures_are_those_of_the_libraries(ready):
    import base64

    import sentencepiece
    import tiktoken

    piece = sentencepiece.SentencePieceProcessor(model_file=VOCAB[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCAB[1], "rb"))}
    byte = tiktoken.Encoding("own", pat_str=VOCAB[2], mergeable_ranks=ranks, special_tokens={})
    rows = [(1, "The quick brown fox.\nThe fox ran.", "en", 1), (2, "漢字 \U0001F984 ᚠᚡ x", None, 1), (3, "Быстрая лиса", None, 1), (4, "y" * 2500, "en", 1)]
    for g in base(ready, rows).collect():
        words = dict((i, t) for i, t, _, _ in rows)[g["doc_id"]].split()
        parts = [w[i : i + 1000] for w in words for i in range(0, len(w), 1000)]
        ids = [x for w in parts for x in piece.encode(w)]
        share = [ids.count(x) / len(ids) for x in set(ids)]
        assert (g["n_tokens"], g["n_byte_tokens"]) == (len(ids), sum(len(byte.encode_ordinary(" " + w)) for w in parts))
        assert g["n_fallback"] == sum(piece.is_byte(x) or piece.is_unknown(x) for x in ids)
        assert abs(g["token_entropy"] + sum(p * math.log2(p) for p in share)) < 1e-9
        assert g["script"] == {1: "latin", 2: "han", 3: "cyrillic", 4: "latin"}[g["doc_id"]]


def test_long_texts_are_read_in_blocks(ready):
    words = [f"w{i % 5000}" for i in range(400_000)]
    text = " ".join(words) + "\n" + "z" * 1_500_000 + "\n" + " ".join(words[:6])
    g = base(ready, [(1, text, "en", 1)]).first()
    assert (g["n_words"], g["n_repeat_words"]) == (400_007, 400_006)
    assert sum(fertility.word_blocks(b"a b  c", 1), []) == [b"a", b"b", b"c"]


SOME = ["the", "of", "and", "people", "water", "river", "morning", "little", "walked", "green", "another", "because", "between", "winter", "garden", "stone"]


def prose(r, n):
    return " ".join(r.choice(SOME) + r.choice(["", "", "s", ","]) for _ in range(n))


def test_bands_reject_odd_texts_and_keep_the_rest(ready):
    r = random.Random(11)
    rows = [(i, prose(r, 200), "en", 1) for i in range(150)]
    rows += [(1000 + i, prose(r, 200).upper(), "en", 1) for i in range(5)]
    rows += [(2000 + i, " ".join("".join(r.choice("qxzjkvw0123456789") for _ in range(9)) for _ in range(80)), "en", 1) for i in range(5)]
    rows += [(3000 + i, rows[0][1], "en", 1) for i in range(300)]  # copies do not move a band
    rows += [(4000, "too few words", "en", 1), (4001, "one two three four five six " * 9, "en", 1), (4002, None, "en", 1), (4003, "Ein anderer Satz in einer seltenen Sprache mit genug Worten hier", "de", 1)]
    df = ready.createDataFrame(rows, "doc_id long, text string, lang string, n_words int").repartition(3)
    got = {g["doc_id"]: g for g in fertility.assess(df, *VOCAB).collect()}
    assert len(got) == len(rows)
    assert sum(not got[i]["kept"] for i in range(150)) <= 3
    assert not any(got[i]["kept"] for i in range(1000, 1005)) and not any(got[i]["kept"] for i in range(2000, 2005))
    assert len({got[i]["kept"] for i in [0, *range(3000, 3300)]}) == 1
    assert [got[i]["base_failed"] for i in (4000, 4001, 4002, 4003)] == [True, True, True, False] and got[4003]["kept"]
    assert fertility.assess(df.limit(0), *VOCAB).count() == 0


def test_registered_queries_give_the_contract_columns(ready, tmp_path):
    d = str(tmp_path)
    ready.createDataFrame([(1, "a b", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    ready.createDataFrame([(1, [0.1] * 64, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    q = queries.queries()
    assert dict(q["op11_centroids"](ready, d).dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}
    types = dict(q["op13_fertility"](ready, d).dtypes)
    assert {k: types[k] for k in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")} == {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"}
    assert dict(q["op12_fill_in_middle"](ready, d).dtypes)["middle_chars"] == "bigint"
