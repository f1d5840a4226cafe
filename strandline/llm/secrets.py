"""Operator 5: secret scan with a random forest that removes false positives.

Candidates are runs of at least eight characters ``[0-9A-Za-z+/_-]`` that hold a digit and a letter, and
values of any characters that are assigned to a name like ``password`` or ``api_key`` (six characters or more, in
quotes up to the closing one on the line, else up to white space), of any length. Each is described by its length, character classes, entropy, the mean
log-probability of its character transitions under a model of ordinary words, the share covered by dictionary words
(found by one pass of an automaton over the candidate, whatever its length), path signs and the neighbouring
words. A random forest (bootstrap rows, random feature subsets, flattened trees) trained from labelled findings
decides. Findings that overlap become one.

Labelled findings are a table (before string, candidate string, after string, label int), of which ``train`` takes at
most ``max_findings`` rows in the order of a hash. No such table is among the inputs. The default one is synthetic:
``findings`` writes ``n`` rows from a seed (keys, tokens and passwords in assignments against checksums,
identifiers, paths, versions, placeholders and prose), so a held-out share of it only measures the generator; the
tests therefore use findings written by hand. The dictionary and transitions are counted over all rows' whole
texts: tasks count words, Spark adds them up, and only the most frequent words and one matrix reach the driver.

Null, empty and candidate-free texts have no findings; empty tables give no rows; a score of exactly the threshold counts as
a secret. Candidates of a long text are described and scored in blocks of 4,096 or 1 MB. Repeated rows are scanned alike; other columns pass
through ``redact`` unchanged.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import class_words, col, counts_before, discard, lowest, prepare, slices, stored, text_bytes

_SEP = np.ones(256, bool)
_SEP[48:58] = _SEP[65:91] = _SEP[97:123] = False
_SEP[[43, 45, 47, 95]] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
NEAR = 32
#: Words beside secrets, and words that mark placeholders or public values.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "api", "key", "auth", "bearer", "credential", "private", "access")
BENIGN = ("example", "sample", "dummy", "test", "placeholder", "your", "sha256", "sha1", "md5", "commit", "checksum", "uuid", "version", "order", "invoice", "isbn", "digest", "hash", "build", "image")
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "sk-", "sk_live_", "xox", "AIza", "eyJ", "glpat-")
_WORD = re.compile(r"[a-z]{3,}")
_RUN = re.compile(r"[a-z]+")
#: A value assigned to a name that is like a secret's.
_VALUE = re.compile(
    rb"""(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["']?[ \t]*(?:=>|:=|=|:)[ \t]*"""
    rb"""(?:"([^"\n]{6,}+)"|'([^'\n]{6,}+)'|([^\s"',;]{6,}+))""",
    re.IGNORECASE,
)


def _alphabet(c: str) -> int:
    o = ord(c)
    return o - 97 if 97 <= o < 123 else o - 65 + 26 if 65 <= o < 91 else 52 if 48 <= o < 58 else 53


@dataclass
class Lexicon:
    """Character transitions and dictionary of ordinary words."""

    steps: np.ndarray
    words: frozenset[str]

    @classmethod
    def learn(cls, docs: DataFrame, most: int = 20_000) -> Lexicon:
        """From every text of ``docs``: the ``most`` frequent words, the transitions inside all words."""
        spark = docs.sparkSession

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: Counter[str] = Counter()
            for b in slices(batches):
                for t in col(b, "text").to_pylist():
                    if t:
                        counts.update(m[0] for m in _WORD.finditer(t.lower()))
                if len(counts) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])
                    counts.clear()
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["w", "n"])

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            m = np.zeros(54 * 54, np.int64)
            for b in slices(batches, "w"):
                data, offs = text_bytes(col(b, "w"))
                inside = np.ones(len(data), bool)
                inside[offs[1:] - 1] = False
                at = np.flatnonzero(inside)
                times = np.repeat(col(b, "n").to_numpy(), np.diff(offs))[at]
                np.add.at(m, (data[at].astype(np.int64) - 97) * 54 + data[at + 1] - 97, times)
            own = np.flatnonzero(m)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(m[own])], names=["k", "n"])

        known = sorted({*KEYWORDS, *BENIGN, "user", "section", "chapter", "number", "server", "node", "page", "data"})
        words = stored(docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "lexicon")
        m = np.ones(54 * 54)
        for w in known:
            for a, b in zip(w, w[1:]):
                m[_alphabet(a) * 54 + _alphabet(b)] += 1
        for r in words.mapInArrow(step, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
            m[r["k"]] += r["n"]
        m = m.reshape(54, 54)
        more = spark.createDataFrame([(w, 1) for w in known], "w string, n long")
        top = words.unionByName(more).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
        discard(words)
        return cls(np.log(m / m.sum(1, keepdims=True)), frozenset(r["w"] for r in top if len(r["w"]) >= 4))

    @cached_property
    def automaton(self):
        import ahocorasick

        auto = ahocorasick.Automaton()
        for w in self.words:
            auto.add_word(w, len(w))
        if self.words:
            auto.make_automaton()
        return auto

    def __getstate__(self) -> dict:
        return {"steps": self.steps, "words": self.words}

    def covered(self, low: str) -> int:
        """Letters of ``low`` covered by the longest dictionary word of each of its letter runs."""
        if not self.words:
            return 0
        best, total = 0, 0
        letters = _RUN.finditer(low)
        run = next(letters, None)
        for end, size in self.automaton.iter(low):
            while run is not None and run.end() <= end:
                total, best, run = total + best, 0, next(letters, None)
            best = max(best, size)
        return total + best


_CODE = np.array([_alphabet(chr(i)) for i in range(128)])
_HEX, _OPEN = np.zeros(128, bool), np.zeros(128, bool)
_HEX[[ord(c) for c in "0123456789abcdefABCDEF"]] = True
_OPEN[[ord(c) for c in " .(){}[]<>$"]] = True
#: Candidates, and characters of them, that are described and scored together.
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 20


def features(rows: list[tuple[str, str, str]], lex: Lexicon) -> np.ndarray:
    """One row of numbers for each (before, candidate, after); what depends on single characters is counted for all of
    them at once."""
    cands = [c for _, c, _ in rows]
    n = np.fromiter(map(len, cands), np.int64, len(cands))
    points = np.frombuffer("".join(cands).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.repeat(np.arange(len(cands)), n)
    ascii_ = np.minimum(points, 127).astype(np.int64)  # 127 is as unlike letters and digits as all beyond it
    code = _CODE[ascii_]
    kind = np.digitize(code, [26, 52, 53])
    per = lambda mask: np.bincount(own[mask], minlength=len(cands)).astype(float)
    safe = np.maximum(n, 1)
    key, count = np.unique(own * (1 << 21) + points, return_counts=True)
    share = count / safe[key >> 21]
    entropy = np.bincount(key >> 21, weights=-share * np.log2(share), minlength=len(cands))
    inside = own[1:] == own[:-1]
    step = np.bincount(own[1:][inside], weights=lex.steps[code[:-1][inside], code[1:][inside]], minlength=len(cands)) / np.maximum(n - 1, 1)
    turns = np.bincount(own[1:][inside & (kind[1:] != kind[:-1])], minlength=len(cands))
    hexa = per(_HEX[ascii_]) == n
    out = []
    for before, cand, after in rows:
        low, b, a = cand.lower(), before.lower(), after.lower()
        near = re.findall(r"[a-z]+", b)[-3:]
        out.append([
            lex.covered(low) / max(len(cand), 1),
            float(bool(re.search(r"[/\\.]$", b)) or a[:1] in "/."), float("://" in b or "www." in b),
            float(any(k in w for w in near for k in KEYWORDS)), float(any(k in b or k in low for k in BENIGN)), float(b.rstrip(" \"'")[-1:] in ("=", ":")), float(b[-1:] in "\"'" and b != ""),
            float(cand.startswith(PREFIXES)), float(b[-1:] in "+@(#" and b != ""), float(a[:1] in "@(#" and a != ""),
            float(cand[:1] in "<${[(%*"), float(b[-1:] in "\"'" and a[:1] in "\"'" and a != "" and b != ""),
        ])
    text = np.array(out, float).reshape(-1, 12).T
    return np.stack([
        n, per(kind == 0) / safe, per(kind == 1) / safe, per(kind == 2) / safe, per(kind == 3) / safe, entropy, step, text[0], hexa, turns / safe,
        per(points == ord("/")), per(points == ord("-")), per(points == ord("_")), np.isin(n, (32, 40, 64)), *text[1:11], per(_OPEN[ascii_]) / safe, text[11],
    ], 1).astype(float)


def findings(n: int = 4000, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """A fixed set of labelled findings."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    syllable = ["an", "er", "the", "ti", "on", "re", "st", "in", "sh", "al", "do", "ment", "que", "ung"]
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(word() for _ in range(k))
    digit = lambda s: s if any(c.isdigit() for c in s) else s[:-1] + rng.choice("23456789")
    out = []
    for i in range(n):
        head, tail = prose(rng.randint(2, 5)) + " ", " " + prose(3)
        if i % 2:
            name = rng.choice(["password", "token", "api_key", "secret", "access_key", "auth_token", "passwd", "pwd"])
            sign = rng.choice(["=", " = ", ": ", "=\"", " = \"", ": '"])
            shape = rng.randrange(10)
            if shape >= 7:  # passwords of letters, digits or any characters
                quote = rng.choice(["\"", "'", ""])
                c = rng.choice([
                    lambda: "".join(word() for _ in range(rng.randint(3, 5)))[:28], lambda: pick(string.ascii_letters, rng.randint(9, 24)), lambda: pick(string.digits, rng.randint(8, 20)),
                    lambda: pick(alnum + "!@#%^&*?~", rng.randint(8, 20)), lambda: word().capitalize() + rng.choice("!@#%&*") + pick(string.digits, 2) + rng.choice("!$?") + word(),
                ])()
                out.append((head + name + rng.choice(["=", " = ", ": ", ":"]) + quote, c if len(c) >= 8 else c + pick(alnum, 8), quote + tail, 1))
            elif shape == 0:
                bare = rng.random() < 0.6
                c = "AKIA" + digit(pick(string.ascii_uppercase + "234567", 16))
                out.append((head if bare else head + name + sign, c, tail, 1))
            elif shape == 1:
                out.append((head, "ghp_" + digit(pick(alnum, 36)), tail, 1))
            elif shape == 2:
                out.append((head, "sk-" + digit(pick(alnum, rng.choice([32, 48]))), tail, 1))
            elif shape == 3:
                out.append((head + name + sign, digit(pick(alnum + "+/", 40)), rng.choice(["\"", "'", ""]) + tail, 1))
            elif shape == 4:
                out.append((head + name + sign, digit(pick(alnum, rng.randint(10, 24))), rng.choice(["\"", "'", ""]) + tail, 1))
            else:
                out.append((head + name + sign, "a" + digit(pick(hexa, rng.choice([16, 17, 18, 20, 32, 39, 40, 64]) - 1)) if rng.random() < 0.5 else digit(pick(hexa, rng.choice([18, 32, 40]))), rng.choice(["\"", "'", ""]) + tail, 1))
        else:
            shape = rng.randrange(16)
            c, b, a = word() + str(rng.randint(10, 99999)) + word(), head, tail
            if shape == 0:
                b, c = head + rng.choice(["commit ", "sha1: ", "sha256:", "md5 ", "checksum = ", "digest: "]), digit(pick(hexa, rng.choice([32, 40, 64])))
            elif shape == 1:
                c = "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
                b = head + rng.choice(["uuid ", "id: ", "https://site.org/item/", ""])
            elif shape == 2:
                b, c = head + "https://www." + word() + ".org/", word() + "/" + word() + "-" + str(rng.randint(1, 999)) + "/" + word()
            elif shape == 3:
                c = "v" + str(rng.randint(1, 20)) + "-" + word() + "-" + str(rng.randint(1, 2024))
            elif shape == 4:
                b, c = head + rng.choice(["password = \"", "api_key: ", "token=", "secret="]), rng.choice(["YOUR_API_KEY_", "example-token-", "changeme-", "test_password_", "placeholder-value-"]) + str(rng.randint(1, 999))
            elif shape == 5:
                b, c = head + rng.choice(["order ", "invoice ", "isbn ", "build "]), rng.choice(["INV-", "PO", "B", "ISBN"]) + pick(string.digits, rng.randint(8, 13))
            elif shape == 6:
                c, a = word() + "_" + word() + str(rng.randint(1, 99)), rng.choice([".py", ".txt", "(", "@mail.org"]) + tail
            elif shape == 7:
                b, c = head + "/usr/lib/", word() + str(rng.randint(2, 9)) + "/" + word() + "/" + word() + "-" + str(rng.randint(1, 9))
            elif shape == 8:
                b, c = head + "data:image/png;base64,", "iVBORw0KGgo" + pick(alnum + "+/", rng.randint(20, 60))
            elif shape == 9:
                c = str(rng.randint(1990, 2030)) + "-" + rng.choice(["jan", "feb", "may", "oct"]) + "-" + str(rng.randint(1, 28))
            elif shape == 10:
                c = word() + word() + str(rng.randint(0, 9))
            elif shape >= 12:  # what stands behind such a name in prose and code
                b = head + rng.choice(["password", "token", "secret", "api_key", "credentials"]) + rng.choice([": ", "=", " = ", ": "])
                c = rng.choice([
                    lambda: rng.choice(["required", "optional", "string", "<password>", "${PASSWORD}", "os.environ[key]", "getpass.getpass()", "{{ token }}", "undefined", "settings.SECRET", "********", "[hidden]"]),
                    lambda: word() + word() + rng.choice(["", ".", ")"]), lambda: rng.choice(["your_password", "YOUR_TOKEN", "change_me", "example_key"]), lambda: "$" + word().upper() + "_TOKEN",
                ])()
                out.append((b, c if len(c) >= 6 else c + "ation", a, 0))
                continue
            out.append((b, c if len(c) >= 8 else c + word() + "-" + word(), a, 0))
    return out


@dataclass
class RandomForest:
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        rows, z = np.arange(len(x)), np.zeros(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = f[node]
                node = np.where(k < 0, node, 2 * node + 1 + (x[rows, np.maximum(k, 0)] > t[node]))
            z += v[node]
        return z / len(self.value)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, tried: int = 6, seed: int = 9) -> RandomForest:
    """Bootstrap trees by Gini gain over ``tried`` random features a node."""
    rng = np.random.default_rng(seed)
    nodes = 2 ** (depth + 1) - 1
    all_f, all_t, all_v = np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes))
    for t in range(trees):
        rows = rng.integers(0, len(x), len(x))
        stack = [(0, 0, rows)]
        while stack:
            node, level, own = stack.pop()
            p = y[own].mean()
            all_v[t, node] = p
            if level == depth or len(own) < 6 or p in (0, 1):
                continue
            best = (1e-7, -1, 0.0)
            for k in rng.permutation(x.shape[1])[:tried]:
                order = np.argsort(x[own, k], kind="stable")
                v, s = x[own[order], k], np.cumsum(y[own[order]])
                cut = np.flatnonzero(v[1:] > v[:-1])
                if not len(cut):
                    continue
                n, m = cut + 1.0, len(own)
                left, right = s[cut] / n, (s[-1] - s[cut]) / (m - n)
                gain = p * (1 - p) - (n * left * (1 - left) + (m - n) * right * (1 - right)) / m
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (gain[i], int(k), (v[cut[i]] + v[cut[i] + 1]) / 2)
            if best[1] < 0:
                continue
            all_f[t, node], all_t[t, node] = best[1], best[2]
            right = x[own, best[1]] > best[2]
            stack += [(2 * node + 1, level + 1, own[~right]), (2 * node + 2, level + 1, own[right])]
    return RandomForest(all_f, all_t, all_v, depth)


@dataclass
class Scanner:
    lexicon: Lexicon
    forest: RandomForest
    threshold: float = 0.5

    def candidates(self, texts: pa.Array) -> list[list[tuple[int, int, float]]]:
        """Per text: (start, end, score) of each candidate, byte offsets in the UTF-8 text."""
        data, offs = text_bytes(texts)
        out: list[list[tuple[int, int, float]]] = [[] for _ in range(len(offs) - 1)]
        if not len(data):
            return out
        s, e, doc = class_words(data, offs, _SEP)
        held = lambda flags: counts_before(flags, data, e) > counts_before(flags, data, s)
        ok = np.flatnonzero((e - s >= 8) & held(_DIGIT) & held(_ALPHA))
        spans = set(zip(doc[ok].tolist(), s[ok].tolist(), e[ok].tolist()))
        raw = data.tobytes()
        # values: a line feed between texts keeps matches inside them
        apart = np.insert(data, offs[1:-1], 10).tobytes()
        edges = offs + np.arange(len(offs))
        for m in _VALUE.finditer(apart):
            a, b = m.span(m.lastindex)
            d = int(np.searchsorted(edges, a, "right")) - 1
            spans.add((d, a - d, b - d))
        spans = sorted(spans)
        at = 0
        while at < len(spans):
            # about so many rows and characters, or one candidate
            rows, held, end = [], 0, at
            while end < len(spans) and end - at < BLOCK_ROWS and (end == at or held + spans[end][2] - spans[end][1] <= BLOCK_CHARS):
                d, a, b = spans[end]
                before = raw[max(int(offs[d]), a - NEAR) : a].decode("utf-8", "ignore")
                after = raw[b : min(int(offs[d + 1]), b + NEAR)].decode("utf-8", "ignore")
                rows.append((before, raw[a:b].decode("utf-8", "replace"), after))
                held, end = held + b - a, end + 1
            for (d, a, b), p in zip(spans[at:end], self.forest.score(features(rows, self.lexicon))):
                base = int(offs[d])
                out[d].append((a - base, b - base, float(p)))
            at = end
        return out

    def secrets(self, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        """Candidates above the threshold, overlapping ones united."""
        out: list[tuple[int, int, float]] = []
        for s, e, p in found:
            if p < self.threshold:
                continue
            if out and s < out[-1][1]:
                a, b, q = out[-1]
                out[-1] = (a, max(b, e), max(p, q))
            else:
                out.append((s, e, p))
        return out


def train(docs: DataFrame, labelled: DataFrame | None = None, max_findings: int = 20_000) -> Scanner:
    """Lexicon from every text; forest from labelled findings (see above), at most ``max_findings`` of them."""
    prepare(docs.sparkSession)
    lex = Lexicon.learn(docs)
    rows = findings()
    if labelled is not None:
        h = F.xxhash64("before", "candidate", "after")
        sound = labelled.where("candidate is not null and label is not null and candidate <> ''").withColumn("h", h)
        rows = [tuple(r) for r in lowest(sound, F.col("h"), max_findings).orderBy("h").limit(max_findings).select(F.coalesce("before", F.lit("")), "candidate", F.coalesce("after", F.lit("")), "label").collect()]
        if not rows:
            raise ValueError("no labelled findings")
    x = features([(b[-NEAR:], c, a[:NEAR]) for b, c, a, _ in rows], lex)
    return Scanner(lex, grow(x, np.array([float(r[3] > 0) for r in rows])))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """Per document: doc_id, n_candidates, secrets (array of start, end, score; byte offsets)."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            found = m.candidates(col(b, "text"))
            hits = [[{"start": s, "end": e, "score": p} for s, e, p in m.secrets(f)] for f in found]
            yield pa.RecordBatch.from_arrays([col(b, "doc_id").cast(pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array(hits, kind)], names=["doc_id", "n_candidates", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_candidates long, secrets array<struct<start:long,end:long,score:double>>")


def redact(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; ``n_chars``, if there, follows the
    changed texts."""
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            chars = b.schema.get_field_index("n_chars")
            texts, sizes = b.column(at).to_pylist(), b.column(chars).to_pylist() if chars >= 0 else None
            changed = False
            for i, f in enumerate(m.candidates(b.column(at))):
                hits = [(s, e) for s, e, _ in m.secrets(f)]
                if hits:
                    raw, parts, last = texts[i].encode(), [], 0
                    for s, e in hits:
                        parts += [raw[last:s], mark.encode()]
                        last = e
                    texts[i] = b"".join([*parts, raw[last:]]).decode()
                    changed = True
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            if changed:
                cols = list(b.columns)
                cols[at] = pa.array(texts, b.schema.field(at).type)
                if sizes is not None:
                    cols[chars] = pa.array(sizes, b.schema.field(chars).type)
                b = pa.RecordBatch.from_arrays(cols, schema=b.schema)
            yield b

    return docs.mapInArrow(run, schema)
