"""Secret scans: candidates by format, false positives removed by a random forest.

Candidates are long tokens of the alphabets that keys are written in, found in
whole texts: ``[A-Za-z0-9+/_-]{16,}`` (and closing ``=``) with at least one
digit or a change from small to capital letters.  For each one the forest sees

* its length, its Shannon entropy, shares of digits, capitals, hex digits and
  other signs;
* its character transitions: how often the class changes from one character to
  the next, the longest run, the share of repeated neighbours, and the mean log
  probability of its letter pairs in plain words;
* dictionary coverage: the share of its letters inside common words;
* its path: whether the source looks like a test, an example or a lock file;
* neighbouring words: an assignment right before it, words like token, key or
  password near it, or commit, sha, uuid, checksum, md5.

The trees are grown (Gini impurity, bootstrap, a random share of the features
at each node) from labelled findings.  ``fit`` takes such a table; without one
it takes :func:`labelled_findings`, a seeded set of true and false findings of
both kinds of formats.

Defined results: null or empty texts have no finding; repeated documents give
their findings each; a token of over ``LONG`` characters is one finding like others, with
the highest score of the windows of ``WINDOW`` characters that cover it, so a key
inside it is judged by its own characters; an empty table gives an empty result.  Only the id, text and path
columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import _text as T
from lattica.llm._io import table

LONG = 512  # characters of a token up to which it is described as one
WINDOW, STEP = 64, 16  # of longer ones
THRESHOLD = 0.5
TREES = 40
DEPTH = 8

TOKEN = re.compile(rb"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
_GATE = "[A-Za-z0-9+/_-]{16}"  # a text without it has no candidate
_NEAR = re.compile(r"token|secret|key|passw|pwd|auth|bearer|credential|private|login", re.I)
_NOT = re.compile(r"commit|sha\d*|md5|uuid|guid|checksum|digest|hash|revision|build|example|sample|dummy|placeholder|version", re.I)
_ASSIGN = re.compile(r"[=:]\s*[\"']?$")
_QUIET = re.compile(r"test|example|sample|mock|fixture|lock|vendor|doc", re.I)

#: Common words for the dictionary coverage.
WORDS = (
    "the and for with that this from have not are was user name data file path test example value string token secret "
    "password public private license version general about which their there other after before between under over "
    "world config default number index table query result error message request response server client service system "
    "index page html http https www com org net admin account account process function class object method return import"
).split()
_WORDS = sorted({w for w in WORDS if len(w) >= 3}, key=len, reverse=True)
_COVER = re.compile("|".join(_WORDS))
_PAIRS: dict[str, float] = {}
for _w in WORDS:
    for _p in zip(_w, _w[1:], strict=False):
        _PAIRS["".join(_p)] = _PAIRS.get("".join(_p), 0) + 1
_TOTAL = sum(_PAIRS.values())

FEATURES = ("length", "entropy", "digits", "capitals", "hex", "signs", "changes", "run", "repeats", "pairs", "cover", "path", "assigned", "near", "against", "quoted", "distinct")


def _class(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def describe(token: str, before: str, after: str, path: str) -> list[float]:
    """Features of a candidate; ``before`` and ``after`` are its neighbourhood."""
    t = token
    n = max(1, len(t))
    count: dict[str, int] = {}
    for c in t:
        count[c] = count.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in count.values())
    kinds = [_class(c) for c in t]
    run = longest = 1
    for a, b in zip(t, t[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    low = t.lower()
    letters = [p for p in (low[i : i + 2] for i in range(len(low) - 1)) if p.isalpha()]
    pairs = sum(math.log((_PAIRS.get(p, 0) + 0.5) / (_TOTAL + 338)) for p in letters) / max(1, len(letters))
    cover = sum(len(m) for m in _COVER.findall(low)) / n
    return [
        math.log(max(1, len(token))),
        entropy,
        sum(k == 0 for k in kinds) / n,
        sum(k == 2 for k in kinds) / n,
        sum(c in "0123456789abcdef" for c in low) / n,
        sum(k == 3 for k in kinds) / n,
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        longest,
        sum(a == b for a, b in zip(t, t[1:], strict=False)) / n,
        pairs,
        cover,
        float(bool(_QUIET.search(path or ""))),
        float(bool(_ASSIGN.search(before))),
        float(bool(_NEAR.search(before))),
        float(bool(_NOT.search(before) or _NOT.search(after[:16]))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        len(count) / n,
    ]


def labelled_findings(seed: int = 11, size: int = 4000) -> list[tuple]:
    """(token, before, after, path, label): true and false findings, half of each."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    word = lambda: pick(WORDS)
    hexes, b64, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda abc, n: "".join(abc[int(i)] for i in rng.integers(0, len(abc), n))
    noise = lambda: " ".join(word() for _ in range(int(rng.integers(0, 4))))
    out = []
    for i in range(size):
        path = pick(["src/app.py", "conf/settings.yml", "web", f"src{i % 30}", "crawl", "tests/fixture.json", "docs/example.md"])
        up = rng.random() < 0.15
        if i % 2:
            token = pick([lambda: draw(hexes, pick([32, 40, 48, 64])), lambda: draw(b64, int(rng.integers(24, 88))), lambda: "AKIA" + draw("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: pick(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + draw(alnum, int(rng.integers(20, 40)))])()
            name = pick(["token", "api_key", "secret", "password", "auth_token", "access_key", "aws_secret", "key", "client_secret", "private_key"])
            lead = pick([f'{name} = "', f"{name}='", f"{name}: ", f'"{name}": "', f"{name}=", "Authorization: Bearer "])
            before, after = f"{noise()} {lead}", ('"' if lead.endswith('"') else "'" if lead.endswith("'") else "") + f" {noise()}"
            if rng.random() < 0.2 and token[:2] not in ("AK", "gh", "sk", "xo", "gl"):
                before = f"{noise()} {name} "
        else:
            kind = int(rng.integers(7))
            token, before = (
                (draw(hexes, 40), f"{noise()} commit "),
                (f"{draw(hexes, 8)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 4)}-{draw(hexes, 12)}", f"{noise()} uuid "),
                ("_".join(word() for _ in range(int(rng.integers(3, 7)))), pick([noise(), f'{noise()} {word()} = "', "key: "])),
                (word() + "".join(word().title() for _ in range(int(rng.integers(2, 5)))) + draw("0123456789", int(rng.integers(0, 3))), noise()),
                (pick("xX0-=_*A1") * int(rng.integers(16, 60)), pick([f'{noise()} token = "', f"{noise()} password: ", noise()])),
                (draw("0123456789", int(rng.integers(16, 24))), noise()),
                ("/".join(word() for _ in range(int(rng.integers(3, 8)))), f"{noise()} https://www.{word()}.org/"),
            )[kind]
            after = ('"' if before.endswith('"') else "") + f" {noise()}"
            before = before if before.endswith(('"', "/", " ")) else before + " "
        out.append((token.upper() if up else token, before.upper() if up else before, after.upper() if up else after, path, i % 2))
    return out


class Forest:
    """Binary trees in arrays: feature (-1: leaf), threshold, left child, right child, share of label 1."""

    def __init__(self, trees):
        self.trees = trees

    def probability(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for f, t, left, right, p in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                feat = f[at]
                inner = feat >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feat, 0)] <= t[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += p[at]
        return out / max(1, len(self.trees))


def _grow(x, y, rng, depth):
    nodes: list[list] = []

    def build(rows, d):
        k = len(nodes)
        p = float(y[rows].mean()) if len(rows) else 0.5
        nodes.append([-1, 0.0, k, k, p])
        if d == 0 or len(rows) < 6 or p in (0.0, 1.0):
            return k
        best = (p * (1 - p) - 1e-7, None, None)
        for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1])) + 1), replace=False):
            v = x[rows, f]
            order = np.argsort(v, kind="stable")
            v, c = v[order], np.cumsum(y[rows][order])
            n = np.arange(1, len(v) + 1)
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            nl, cl = n[cut], c[cut]
            nr, cr = len(v) - nl, c[-1] - cl
            g = (cl * (1 - cl / nl) + cr * (1 - cr / nr)) / len(v)
            j = int(g.argmin())
            if g[j] < best[0]:
                best = (g[j], int(f), float((v[cut[j]] + v[cut[j] + 1]) / 2))
        if best[1] is None:
            return k
        go = x[rows, best[1]] <= best[2]
        nodes[k][0], nodes[k][1] = best[1], best[2]
        nodes[k][2] = build(rows[go], d - 1)
        nodes[k][3] = build(rows[~go], d - 1)
        return k

    build(rng.integers(0, len(x), len(x)), depth)
    a = list(zip(*nodes, strict=True))
    return np.array(a[0]), np.array(a[1]), np.array(a[2]), np.array(a[3]), np.array(a[4])


def fit(findings=None, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> Forest:
    """findings: rows (token, before, after, path, label), a bounded labelled set."""
    findings = labelled_findings() if findings is None else list(findings)
    if not findings:
        return Forest([])
    x = np.array([describe(*r[:4]) for r in findings])
    y = np.array([r[4] for r in findings], float)
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y, rng, depth) for _ in range(trees)])


def windows(token: str):
    """Lists of at most 4,096 windows that cover a token, each one once in its list."""
    starts = [*range(0, len(token) - WINDOW, STEP), len(token) - WINDOW]
    for k in range(0, len(starts), 4096):
        yield list(dict.fromkeys(token[i : i + WINDOW] for i in starts[k : k + 4096]))


def judge(forest: Forest, token: str, before: str, after: str, path: str) -> float:
    """The score of a long token: the highest one of its windows."""
    return max(float(forest.probability(np.array([describe(w, before, after, path) for w in part])).max()) for part in windows(token))


def scan(docs: DataFrame, forest: Forest, id_col: str = "doc_id", path_col: str | None = "source") -> DataFrame:
    """id, start and end (code points), token_sha256, score of every candidate; the token itself is not repeated."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # TREES trees of at most 2**(DEPTH+1) nodes
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), "text")

    def run(batches):
        model = shared.value
        for batch in batches:
            hit = pc.fill_null(pc.match_substring_regex(batch.column("text"), _GATE), False)
            batch = pa.RecordBatch.from_arrays([c.filter(hit) for c in batch.columns], names=batch.schema.names)
            for part, data, off in T.text_blocks([batch]):
                ids, paths = part.column("doc_id").to_pylist(), part.column("path").to_pylist()
                out, feats, long = [], [], {}
                for i in range(part.num_rows):
                    raw = data[off[i] : off[i + 1]].tobytes()
                    chars, seen = 0, 0
                    for m in TOKEN.finditer(raw):
                        s, e = m.span()
                        chars += len(raw[seen:s].decode("utf-8", "ignore"))
                        seen = s
                        t = m.group().decode()
                        if not (re.search("[0-9]", t) or re.search("[a-z][A-Z]", t)):
                            continue
                        before = raw[max(0, s - 64) : s].decode("utf-8", "ignore")
                        after = raw[e : e + 32].decode("utf-8", "ignore")
                        if len(t) > LONG:
                            long[len(feats)] = judge(model, t, before, after, paths[i])
                        feats.append(describe(t if len(t) <= LONG else "", before, after, paths[i]))
                        out.append((ids[i], chars, chars + len(t), hashlib.sha256(m.group()).hexdigest()))
                if out:
                    p = model.probability(np.array(feats))
                    for k, score in long.items():
                        p[k] = score
                    c = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.string()), pa.array(p, pa.float64())],
                        names=["doc_id", "start", "end", "token_sha256", "score"],
                    )

    return rows.mapInArrow(run, "doc_id long, start long, end long, token_sha256 string, score double")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict."""
    out = scan(table(spark, sf_dir, "documents"), fit())
    return out.withColumn("secret", F.col("score") >= THRESHOLD)
