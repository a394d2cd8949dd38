"""Structural parsing of record strings as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.cleaning import known, tokens
from lattica.schema import UNKNOWN

def _none() -> Column:
    return F.array().cast("array<string>")


def sections(c: Column) -> Column:
    """Struct of token arrays left, agents, right of ``a>b>c``; no ``>``: all left; else not three: all empty."""
    parts = F.split(c, ">")
    three, one = F.size(parts) == 3, F.size(parts) == 1
    pick = lambda k: tokens(F.element_at(parts, k))
    return F.struct(
        F.when(three | one, pick(1)).otherwise(_none()).alias("left"),
        F.when(three, pick(2)).otherwise(_none()).alias("agents"),
        F.when(three, pick(3)).otherwise(_none()).alias("right"),
    )


def parse_fixed(c: Column, width: int = 6) -> Column:
    """struct(status, message, parts): exactly one ``>>`` and ``width`` tokens on its left."""
    halves = F.split(c, ">>")
    left = tokens(F.element_at(halves, 1))
    good = F.coalesce(F.size(halves) == 2, F.lit(False))
    return F.when(
        good & (F.size(left) == width), F.struct(F.lit("ok").alias("status"), F.lit("").alias("message"), left.alias("parts"))
    ).otherwise(
        F.when(good, F.struct(F.lit("unexpected_left_token_count").alias("status"), F.concat(F.lit(f"expected {width} left tokens, found "), F.size(left).cast("string")).alias("message"), _none().alias("parts"))).otherwise(
            F.struct(F.lit("malformed").alias("status"), F.lit("expected exactly one >> separator").alias("message"), _none().alias("parts"))
        )
    )


def substrate_condition(left: Column, substrates: int = 2, least: int = 3) -> Column:
    """The first tokens as substrate, the rest as condition; null with fewer than ``least``."""
    return F.when(F.size(left) >= least, F.struct(F.slice(left, 1, substrates).alias("substrate"), F.slice(left, substrates + 1, F.greatest(F.size(left) - substrates, F.lit(0))).alias("condition")))


def assemble(left: Column, right: Column) -> Column:
    """P4."""
    return F.concat_ws(">>", F.array_join(left, "."), F.array_join(right, "."))


def classify(c: Column, rules: list[tuple[str, list[str]]], default: str = "unclassified") -> Column:
    """P5: the first rule with a substring of ``c`` wins; matching ignores case."""
    low = F.lower(c)
    out = F.lit(default)
    for label, needles in reversed(rules):
        hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(n.lower())) for n in needles])
        out = F.when(F.coalesce(hit, F.lit(False)), F.lit(label)).otherwise(out)
    return out


def repair_roles(parts: Column, rules: list[tuple[str, list[str]]], roles: list[str], fallback: str | None = None) -> Column:
    """struct(status, one column for each role).

    Each role takes the one token that is classified as it; ``fallback`` takes a
    single leftover.  A role with no token or several leaves the order as it is.
    """
    classes = F.transform(parts, lambda x: F.struct(x.alias("t"), classify(x, rules).alias("c")))
    own = {r: F.filter(classes, _is(r)) for r in roles}
    left = F.filter(classes, lambda x: ~x["c"].isin(*roles))
    got = {}
    for r in roles:
        one = F.when(F.size(own[r]) == 1, own[r][0]["t"])
        if r == fallback:
            one = F.coalesce(one, F.when((F.size(own[r]) == 0) & (F.size(left) == 1), left[0]["t"]))
        got[r] = one
    complete = reduce(lambda a, b: a & b, [got[r].isNotNull() for r in roles]) & (F.size(parts) == len(roles))
    place = {r: F.get(parts, F.lit(i)) for i, r in enumerate(roles)}
    same = reduce(lambda a, b: a & b, [got[r] == place[r] for r in roles])
    status = F.when(F.size(parts) != len(roles), "invalid_or_unresolved").when(~complete, "ambiguous").when(same, "valid").otherwise("repaired")
    return F.struct(status.alias("status"), *[F.when(complete, got[r]).otherwise(place[r]).alias(r) for r in roles])


def _is(label):
    return lambda x: x["c"] == label


def recover(existing: Column, repaired: Column, parsed: Column) -> Column:
    """The first known of the three, else UNKNOWN."""
    nulled = lambda c: F.when(known(c), c)
    return F.coalesce(nulled(existing), nulled(repaired), nulled(parsed), F.lit(UNKNOWN))


def mismatch(flags: dict[str, Column]) -> Column:
    """Names of the true flags joined by ``_and_``; ``ok`` if none is."""
    joined = F.concat_ws("_and_", *[F.when(c, F.lit(n)) for n, c in flags.items()])
    return F.when(joined == "", "ok").otherwise(joined)


def recovery_summary(df: DataFrame, status_cols: list[str], value_cols: list[str]) -> DataFrame:
    """Rows (section, field, value): status counts, then distinct and known values of each column.

    Each status column is counted in one grouped pass over (column, status) pairs.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("string").alias("field")) for c in status_cols])
    out = df.select(F.explode(pairs).alias("x")).groupBy("x.section", "x.field").agg(F.count("*").alias("value"))
    for what, agg in (("distinct", lambda c: F.count_distinct(F.when(known(F.col(c)), F.col(c)))), ("known", lambda c: F.count_if(known(F.col(c))))):
        one = df.agg(*[agg(c).alias(f"v{i}") for i, c in enumerate(value_cols)])
        items = F.array(*[F.struct(F.lit(what).alias("section"), F.lit(c).alias("field"), F.col(f"v{i}").alias("value")) for i, c in enumerate(value_cols)])
        out = out.unionByName(one.select(F.explode(items).alias("x")).select("x.section", "x.field", "x.value"))
    return out


def format_profile(df: DataFrame, c: str) -> DataFrame:
    """P10: counts of the shapes of a string column."""
    x = F.col(c)
    return df.agg(
        F.count("*").alias("n_rows"), F.count_if(x.contains(">")).alias("with_arrow"), F.count_if(F.size(F.split(x, ">")) == 3).alias("two_arrows"),
        F.count_if(x.contains(".")).alias("with_dot"), F.count_if(x.rlike("Cl|Br|I|F")).alias("with_halogen"), F.count_if(x.contains("N")).alias("with_n"),
    )


def stress_keys(left: Column, right: Column) -> tuple[Column, Column]:
    """(product key in order, reactant key of sorted tokens); UNKNOWN where empty."""
    key = lambda a: F.coalesce(F.nullif(F.array_join(a, "."), F.lit("")), F.lit(UNKNOWN))
    return key(right), key(F.array_sort(left))


def permuted(df: DataFrame, tokens_col: str, copies: int, seed: int, id_col: str) -> DataFrame:
    """Each row ``copies`` times, its tokens in an order given by hashes of (seed, id, copy, place)."""
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    keyed = F.transform(tokens_col, lambda x, i: F.struct(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.col("copy").cast("string"), i.cast("string")), 256).alias("k"), x.alias("t")))
    return rows.withColumn(tokens_col, F.array_sort(keyed)["t"])


#: The columns that apply_parse adds, in this order.
PARSED = ("parse_status", "parse_message", "substrate", "condition", "product", "assembled")


def apply_parse(df: DataFrame, c: str, width: int = 6, substrates: int = 2) -> DataFrame:
    """The table with the columns of PARSED; token lists are joined by dots, empty where the record is malformed."""
    fixed, right = parse_fixed(F.col(c), width), tokens(F.element_at(F.split(F.col(c), ">>"), -1))
    out = df.withColumn("_f", fixed)
    good = F.col("_f.status") == "ok"
    parts = F.col("_f.parts")
    added = {
        "parse_status": F.col("_f.status"), "parse_message": F.col("_f.message"), "substrate": F.array_join(F.slice(parts, 1, substrates), "."),
        "condition": F.array_join(F.slice(parts, substrates + 1, max(width - substrates, 1)), "."), "product": F.when(good, F.array_join(right, ".")).otherwise(""),
        "assembled": F.when(good, assemble(parts, right)).otherwise(""),
    }
    return out.withColumns(added).drop("_f").select(*[x for x in df.columns if x not in PARSED], *PARSED)


def stress_table(df: DataFrame, left: str, right: str) -> DataFrame:
    """The table with product_key and reactant_key, the groups of the stress splits; sources.io.write_fresh is its sink."""
    product, reactant = stress_keys(F.col(left), F.col(right))
    return df.withColumns({"product_key": product, "reactant_key": reactant})
