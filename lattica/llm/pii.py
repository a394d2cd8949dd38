"""Personal data by candidate gradient boosting (DataFrame functions only).

Base spans follow four fixed patterns, leftmost and not overlapping for each
kind; a match that fails its test (octets, Luhn, number of digits) is dropped.

On top of these, generators of high recall propose spans of each kind, from
greedy runs to single groupings (``[at]`` and ``(dot)`` in addresses, ``[.]``,
other separators, numbers without a plus sign, numbers that stand side by side);
proposals may overlap.  Each candidate has ``BITS`` yes/no features of its
format and of the text around it.  Boosted trees of depth two learn which
candidates are true, from a seeded labelled set: no table labels personal data,
so :func:`labelled_texts` writes true spans of many forms, and things that look
like them (dates, versions, order numbers, keys ...), into made-up sentences.  A
candidate is true if it is exactly a span of its kind.  Counts of (kind,
features, fold) are all that training reads.  Trees are fitted on three quarters
of the set; on the rest scores are calibrated (shares of true candidates in bins
of the score, made monotone), and for each kind the threshold is the lowest
calibrated score whose candidates reach ``PRECISION``.  A kind without enough
evidence adds nothing.  Of the candidates that pass and touch no base span,
those of the highest score are added, none overlapping; base spans always stay.

Everything is computed inside each row by built-in functions, in one pass over
the texts; only counts of the labelled set are shuffled.  Positions are code
points, ends exclusive.

Defined results: a null text counts as empty and has no spans; repeated
documents get a row each; an empty table gives an empty result.  Only doc_id and
text are read.  ``redact`` keeps all columns, whatever their names; ``find``
leaves out columns called like those that it adds.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm._io import table

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.9
ROUNDS = 30
RATE = 0.3
BINS = 20
EVIDENCE = 20  # candidates in a calibration fold that a threshold must rest on

#: Fixed patterns.  Each starts at the start of a run (or where the last match
#: ended), which gives the same matches as without that but in linear time.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"

#: High-recall forms: for each kind greedy runs, then forms of known grouping that may lie inside of a run.
LOOSE = {
    "email": [r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]+(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]+)++"],
    "ip": [r"(?<![0-9])[0-9]{1,4}(?:(?:\.|\[\.\]|\(\.\)|,)[0-9]{1,4}){3}"],
    "card": [
        r"[0-9](?:[\x20._/-]?[0-9]){11,22}",
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20._/-][0-9]{4}){3}|[0-9]{4}[\x20._/-][0-9]{6}[\x20._/-][0-9]{5})(?![0-9])",
    ],
    "phone": [
        r"(?:\+|00)?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,16}",
        r"(?<![0-9])(?:(?:\+|00)[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    ],
}
_WORDS_NEAR = r"(?i)(mail|contact|write|tel|phone|call|fax|mobile|cell|card|visa|pay|account|iban|host|server|addr|\bip\b)[^a-z]*$"
_NOT_NEAR = r"(?i)(version|release|order|item|invoice|isbn|serial|total|section|page|ticket|build|\bno\b|\bid\b|\bv)[^a-z]*$"
BITS = 18
TEXTS = 6_000  # of the labelled set
SEED = 17


def _let(value, body):
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


_SPANS = "array<struct<s:int,e:int,m:string>>"


def _matches(text, pattern):
    """s, e, m of all matches: gaps between matches and their texts give the positions."""

    def build(x):
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

        def step(acc, i):
            m = F.element_at(x["found"], i)
            s = acc["at"] + F.length(F.element_at(x["gaps"], i))
            return _let(
                F.struct(s.alias("s"), (s + F.length(m)).alias("e"), m.alias("m")),
                lambda span: F.struct(span["e"].alias("at"), F.concat(acc["out"], F.array(span)).alias("out")),
            )

        return F.aggregate(F.sequence(F.lit(1), F.size(x["found"])), zero, step, lambda acc: acc["out"])

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(_SPANS)
    return _let(found, lambda f: F.when(F.size(f) == 0, empty).otherwise(_let(F.struct(f.alias("found"), F.split(text, pattern, -1).alias("gaps")), build)))


def _digits(m):
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind, m):
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(m), lambda d: F.length(d).between(13, 19) & F.call_function("luhn_check", d))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _gate(kind, text):
    """A cheap test that every text with a match or a candidate passes."""
    if kind == "email":
        return F.contains(text, F.lit("@")) | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))
    return text.rlike("[0-9]")


def _base(text, kind):
    spans = _matches(text, BASE[kind])
    if kind != "email":
        spans = F.filter(spans, lambda x: _valid(kind, x["m"]))
    return F.when(_gate(kind, text), spans).otherwise(F.array().cast(_SPANS))


def _feature_bits(kind, text, span):
    m, s, e = span["m"], span["s"], span["e"]
    before = F.when(s > 0, F.substring(text, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24)))).otherwise("")
    after = F.substring(text, e + 1, F.lit(2))

    def bits(v):
        d = _digits(v["m"])
        if kind == "ip":
            sound = v["m"].rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$")
        elif kind == "card":
            sound = F.length(d).between(13, 19) & F.call_function("luhn_check", d)
        elif kind == "phone":
            sound = v["m"].rlike(r"^(?:(?:\+|00)?[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")
        else:
            sound = v["m"].rlike(r"[\x20.)\]][A-Za-z]{2,6}$")
        tests = [
            sound,
            v["m"].rlike(r"[0-9][^0-9A-Za-z][^0-9]*[0-9]"),  # groups of digits
            F.length(d) >= 9,
            F.length(d) >= 12,
            F.length(d) >= 16,
            v["m"].rlike(r"[()]"),
            v["m"].rlike(r"[\[\]]"),
            v["m"].rlike(r"\x20"),
            v["m"].rlike(r"[._/,-]"),
            v["m"].rlike(r"^(?:\+|00)"),
            F.length(v["m"]) > 24,
            (v["b"] == "") | v["b"].rlike(r"[\s(<\"'=:]$"),
            (v["a"] == "") | v["a"].rlike(r"^[\s.,;:!?)>\"'](?:$|[^0-9])"),
            v["b"].rlike(r"[0-9][\x20.-]?$"),  # a number goes before
            v["a"].rlike(r"^[\x20.-]?[0-9]"),  # a number follows
            v["b"].rlike(_WORDS_NEAR),
            v["b"].rlike(_NOT_NEAR),
            v["b"].rlike(r"[A-Za-z]$"),
        ]
        out = F.lit(0)
        for k, t in enumerate(tests):
            out = out + F.when(t, F.lit(1 << k)).otherwise(F.lit(0))
        return out

    return _let(F.struct(m.alias("m"), before.alias("b"), after.alias("a")), bits)


_CANDS = "array<struct<kind:int,s:int,e:int,code:int,base:boolean>>"


def _touches(x, spans):
    """Two references to ``spans``: with one, the optimiser would move its regular expressions into the lambda."""
    return (F.size(spans) > 0) & F.exists(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))


def _candidate(number, text, own):
    return lambda x: F.struct(F.lit(number).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _feature_bits(KINDS[number], text, x).alias("code"), _touches(x, own).alias("base"))


def with_spans(docs: DataFrame) -> DataFrame:
    """Adds _pii_<kind>: the base spans, and _cands: the candidates of all kinds with features and whether they touch base spans of their kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.withColumns({f"_pii_{k}": _base(text, k) for k in KINDS})
    parts = []
    for i, k in enumerate(KINDS):
        own = F.col(f"_pii_{k}")
        for pattern in LOOSE[k]:
            loose = F.when(_gate(k, text), _matches(text, pattern)).otherwise(F.array().cast(_SPANS))
            parts.append(F.transform(loose, _candidate(i, text, own)))
    return out.withColumn("_cands", F.array_distinct(F.concat(*parts).cast(_CANDS)))


# ---- the labelled set ---------------------------------------------------------------------


def _luhn(digits: str) -> int:
    """The sum whose last digit is 0 for a sound number."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))


def labelled_texts(n: int = TEXTS, seed: int = SEED) -> list[dict]:
    """Made-up texts with their true spans: {"text", "spans": [{"kind", "s", "e"}]}, the same for a seed."""
    rnd = random.Random(seed)
    dig = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rnd.choice("aeiounrstlmdhcgpbk") for _ in range(rnd.randint(2, 9)))

    def email():
        user = rnd.choice([word(), f"{word()}.{word()}", word() + dig(2), f"{word()}.{dig(2)}"])
        at = rnd.choice(["@"] * 3 + ["[at]", "(at)", " [at] ", " (at) "])
        dot = "." if at == "@" and rnd.random() < 0.8 else rnd.choice([".", "[dot]", "(dot)", " [dot] ", " (dot) "])
        return user + at + rnd.choice([word(), f"mail{dig(1)}{dot}{word()}"]) + dot + rnd.choice(["com", "org", "net", "example", "de", "fr"])

    def ip():
        return rnd.choice([".", ".", ".", "[.]", "(.)"]).join(str(rnd.randint(1, 254)) for _ in range(4))

    def card():
        body = rnd.choice("3456") + dig(14)
        if body[0] == "3":
            body = body[:14]
        number = next(body + str(c) for c in range(10) if _luhn(body + str(c)) % 10 == 0)
        cut = [(0, 4), (4, 10), (10, 15)] if len(number) == 15 else [(i, i + 4) for i in range(0, 16, 4)]
        return number if rnd.random() < 0.5 else rnd.choice(" -._/").join(number[i:j] for i, j in cut)

    def phone():
        a, b, c = dig(3), dig(3), dig(4)
        start = rnd.choice(["+1 ", f"+{rnd.randint(20, 99)} ", f"00{rnd.randint(20, 99)} ", f"{rnd.randint(1, 9)} ", "", "+1-"])
        return start + rnd.choice([f"({a}) {b}-{c}", f"{a} {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"])

    true = [email, ip, card, phone]
    near = [["mail ", "contact: ", "write to "], ["host ", "server ", "addr=", "ip "], ["card ", "visa ", "pay with ", "account "], ["call ", "tel. ", "phone: ", "mobile "]]
    false = [
        lambda: f"{word()}@{rnd.randint(0, 20)}.{rnd.randint(0, 20)}.{rnd.randint(0, 99)}",  # package and version
        lambda: f"{rnd.randint(2, 50)} @ {rnd.randint(1, 99)}.{dig(2)}",  # amount and price
        lambda: rnd.choice(["version ", "release ", "v"]) + ".".join(str(rnd.randint(0, 30)) for _ in range(4)),
        lambda: rnd.choice(["section ", "page ", "build "]) + ".".join(str(rnd.randint(0, 4000)) for _ in range(4)),
        lambda: ".".join(str(rnd.randint(256, 999)) for _ in range(4)),
        lambda: ",".join(str(rnd.randint(0, 999)) for _ in range(rnd.randint(4, 6))),
        lambda: rnd.choice(["", "order ", "serial ", "id "]) + rnd.choice("123456789") + dig(rnd.randint(7, 21)),
        lambda: f"{rnd.randint(1990, 2030)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d} {dig(2)}.{dig(2)}.{dig(2)}",
        lambda: f"{rnd.randint(1990, 2030)}{rnd.randint(1, 12):02d}{rnd.randint(1, 28):02d}{dig(6)}",
        lambda: f"isbn 978-{dig(1)}-{dig(2)}-{dig(6)}-{dig(1)}",
        lambda: "".join(rnd.choice("0123456789abcdef" + "0123456789" * 3) for _ in range(rnd.choice([32, 40]))),
        lambda: " ".join(str(rnd.randint(0, 9999)) for _ in range(rnd.randint(4, 9))),
        lambda: f"{rnd.randint(1, 9)},{dig(3)},{dig(3)}.{dig(2)}",
        lambda: f"{dig(4)} {dig(4)} {dig(4)} {dig(4)}",
        lambda: f"item {dig(rnd.randint(6, 9))}x sold",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rnd.randint(2, 5)):
            text += " ".join(word() for _ in range(rnd.randint(0, 6))) + rnd.choice([" ", " ", ". ", ", ", "\n"]) if rnd.random() < 0.8 else ""
            if rnd.random() < 0.5:
                kind = rnd.randrange(4)
                text += rnd.choice(near[kind]) if rnd.random() < 0.4 else ""
                value = true[kind]()
                spans.append({"kind": kind, "s": len(text), "e": len(text) + len(value)})
                text += value
            else:
                text += rnd.choice(false)()
            text += rnd.choice([" ", " ", " ", ". ", ", ", "\n"])  # the next one may follow at once
        out.append({"text": text, "spans": spans})
    return out


# ---- learning, on counts ------------------------------------------------------------------


class Boosted:
    """For one kind: trees (bit a, bit b, four leaf values), the first score, calibration and threshold."""

    def __init__(self, start, trees, threshold):
        self.start, self.trees, self.threshold = start, trees, threshold

    def raw(self, code: int) -> float:
        return self.start + sum(v[2 * (code >> a & 1) + (code >> b & 1)] for a, b, v in self.trees)

    def score(self, code):
        """As a column: the boosted score of the feature code."""
        total = F.lit(float(self.start))
        for a, b, v in self.trees:
            at = F.when(code.bitwiseAND(F.lit(1 << a)) != 0, F.lit(2)).otherwise(F.lit(0)) + F.when(code.bitwiseAND(F.lit(1 << b)) != 0, F.lit(1)).otherwise(F.lit(0))
            total = total + F.element_at(F.lit([float(x) for x in v]), at + 1)
        return total


def _boost(counts: dict[int, tuple[float, float]], rounds: int, rate: float):
    """counts: feature code -> (true, false)"""
    pos, neg = sum(p for p, _ in counts.values()), sum(n for _, n in counts.values())
    start = math.log((pos + 1) / (neg + 1))
    score = dict.fromkeys(counts, start)
    trees = []
    if not pos or not neg:
        return start, trees
    for _ in range(rounds):
        grad = {}
        for c, (p, n) in counts.items():
            q = 1 / (1 + math.exp(-max(-35.0, min(35.0, score[c]))))
            grad[c] = (p - (p + n) * q, (p + n) * q * (1 - q))
        best = (1e-9, None)
        for a in range(BITS):
            for b in range(a + 1, BITS):
                g, h = [0.0] * 4, [1.0] * 4
                for c, (x, y) in grad.items():
                    k = 2 * (c >> a & 1) + (c >> b & 1)
                    g[k] += x
                    h[k] += y
                gain = sum(x * x / y for x, y in zip(g, h, strict=True))
                if gain > best[0] + 1e-12:
                    best = (gain, (a, b, [rate * x / y for x, y in zip(g, h, strict=True)]))
        if best[1] is None:
            break
        a, b, v = best[1]
        trees.append(best[1])
        for c in score:
            score[c] += v[2 * (c >> a & 1) + (c >> b & 1)]
    return start, trees


def _threshold(model: Boosted, counts: dict[int, tuple[float, float]], precision: float):
    """Lowest score at which the calibrated share of true candidates reaches ``precision``."""
    rows = sorted((model.raw(c), p, n) for c, (p, n) in counts.items())
    total = sum(p + n for _, p, n in rows)
    if total < EVIDENCE or not sum(p for _, p, _ in rows):
        return None
    bins: list[list[float]] = []  # least score, true, all
    for s, p, n in rows:
        if bins and (bins[-1][0] == s or bins[-1][2] < total / BINS):
            bins[-1][1] += p
            bins[-1][2] += p + n
        else:
            bins.append([s, p, p + n])
    merged: list[list[float]] = []  # pool adjacent violators
    for b in bins:
        merged.append(list(b))
        while len(merged) > 1 and merged[-2][1] * merged[-1][2] > merged[-1][1] * merged[-2][2]:
            _, p, n = merged.pop()
            merged[-1][1] += p
            merged[-1][2] += n
    return next((s for s, p, n in merged if n >= EVIDENCE and p / n >= precision), None)


def labelled_candidates(spark, n: int = TEXTS, seed: int = SEED) -> DataFrame:
    """(number, kind, code, base, true) of all candidates in the labelled set; its size is a parameter."""
    rows = [(i, r["text"], [(x["kind"], x["s"], x["e"]) for x in r["spans"]]) for i, r in enumerate(labelled_texts(n, seed))]
    made = spark.createDataFrame(rows, "number int, text string, truth array<struct<kind:int,s:int,e:int>>")
    texts = with_spans(made)
    return texts.select("number", "truth", F.explode("_cands").alias("c")).select(
        "number", "c.kind", "c.code", "c.base", F.exists("truth", lambda t: (t["kind"] == F.col("c.kind")) & (t["s"] == F.col("c.s")) & (t["e"] == F.col("c.e"))).alias("true")
    )


_fitted: dict = {}


def fit(spark, precision: float = PRECISION, rounds: int = ROUNDS, rate: float = RATE) -> list[Boosted]:
    """One model for each kind, from the counts of the labelled set; once for each choice of parameters, as the set is fixed."""
    key = (precision, rounds, rate)
    if key not in _fitted:
        rows = labelled_candidates(spark)
        counts = rows.groupBy("kind", "code", (F.col("number") % 4 == 0).alias("held")).agg(F.sum(F.col("true").cast("long")).alias("pos"), F.count("*").alias("all")).collect()
        out = []
        for k in range(len(KINDS)):
            fold = [{}, {}]
            for r in counts:
                if r["kind"] == k:
                    fold[r["held"]][r["code"]] = (r["pos"], r["all"] - r["pos"])
            start, trees = _boost(fold[0], rounds, rate)
            m = Boosted(start, trees, None)
            m.threshold = _threshold(m, fold[1], precision)
            out.append(m)
        _fitted[key] = out
    return _fitted[key]


def _least(threshold):
    return lambda v: F.when(v >= F.lit(float(threshold)), -v)


_TAKEN = "array<struct<low:double,s:int,e:int,kind:int>>"


def selected(spans: DataFrame, models: list[Boosted]) -> DataFrame:
    """Replaces _cands by _added (s, e, kind): the candidates that are taken."""
    x = "_cands"

    def free(c):
        out = ~c["base"]
        for k in KINDS:
            out = out & ~_touches(c, F.col(f"_pii_{k}"))
        return out

    def scored(c):
        low = F.lit(None).cast("double")  # minus the score, if it passes
        for i, m in enumerate(models):
            if m.threshold is not None:
                low = F.when(c["kind"] == i, _let(m.score(c["code"]), _least(m.threshold))).otherwise(low)
        return F.struct(low.alias("low"), c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))

    best = F.array_sort(F.filter(F.transform(F.filter(x, free), scored), lambda c: c["low"].isNotNull()))
    step = lambda acc, c: F.when(F.exists(acc, lambda y: (y["s"] < c["e"]) & (c["s"] < y["e"])), acc).otherwise(F.concat(acc, F.array(c)))
    none = F.array().cast(_TAKEN)
    kept = F.when(F.size(x) == 0, none).otherwise(F.aggregate(best.cast(_TAKEN), none, step))
    ordered = F.array_sort(F.transform(kept, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["kind"].alias("kind"))))
    return spans.withColumn("_added", ordered).drop("_cands")


def find(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """``docs`` with _pii_<kind> (base spans) and _added (spans of the method)."""
    docs = docs.drop("_cands", "_added", *[f"_pii_{k}" for k in KINDS])
    return selected(with_spans(docs), fit(docs.sparkSession, precision))


def _listed(kind, spans):
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def _keyed(kind):
    return lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), F.lit(kind).alias("kind"))


def _is(kind):
    return lambda x: x["kind"] == kind


def redact(docs: DataFrame, precision: float = PRECISION) -> DataFrame:
    """The same rows and columns, each span of ``text`` replaced by [EMAIL], [IP], [CARD] or [PHONE]; null stays null."""
    found = find(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), precision)
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    flat = F.concat(
        *[F.transform(F.col(f"_pii_{k}"), _keyed(i)) for i, k in enumerate(KINDS)],
        F.transform("_added", lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("e"), x["kind"].alias("kind"))),
    )
    found = found.withColumn("_flat", F.array_sort(flat))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        new = F.concat(acc["out"], F.array(F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.concat(F.lit("["), F.element_at(names, x["kind"] + 1), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], -x["e"]).alias("at"), F.when(x["s"] < acc["at"], acc["out"]).otherwise(new).alias("out"))

    done = F.aggregate("_flat", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    found = found.withColumn("text", F.when(F.size("_flat") == 0, F.col("text")).otherwise(done))
    return found.select(*[F.col("text") if c.lower() == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [_listed(k, F.col(f"_pii_{k}")) for k in KINDS]
    names = F.array(*map(F.lit, KINDS))
    more = F.transform("_added", lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["s"].cast("string"), x["e"].cast("string")))
    everything = _all_spans()
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[F.size(f"_pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.concat(*base), ","), 256).alias("base_sha256"),
        everything.alias("spans"),
        F.size(more).cast("long").alias("n_added"),
    )


def _all_spans():
    """Base and added spans as text, by kind as listed, then start."""
    parts = []
    for i, k in enumerate(KINDS):
        own = F.transform(F.col(f"_pii_{k}"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        new = F.transform(F.filter("_added", _is(i)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        parts.append(_listed(k, F.array_sort(F.concat(own, new))))
    return F.array_join(F.concat(*parts), ",")
