"""Chat formatting with cumulative-snapshot collapse (DataFrame functions only).

Logs often hold every state of a growing conversation.  A logged conversation
is dropped when it is the proper prefix of a longer one, and of conversations
that are equal the one of the smallest conv_id stays; what remains is rendered.

The test is on rolling hashes.  The prefix hash of the first k turns is that of
the first k-1 turns XOR the hash of (k, role, text), twice with different seeds
(128 bits).  All proper prefixes of all conversations, made distinct, are
anti-joined with the whole conversations; no conversation is compared with
another one, however many share their first turns.

A conversation may be of any length: turns are ranked and hashed in chunks of
``CHUNK`` turn numbers whose sizes and hashes are then carried forward, and
rendered in rows of ``RENDER`` turns each (``part`` 0, 1, ...), so no task
gathers a whole one.

Defined results: turns are ordered by (turn, role, text), nulls first; a null
role or text counts as empty; rows repeated with the same conv_id, turn, role
and text count once; rows whose conv_id is null are one conversation.  An empty
table gives an empty result.  Only these four columns are read, so other
columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm._io import table
from lattica.llm._store import save

CHUNK = 1024
RENDER = 256
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _others():
    return [F.col("conv_id").alias("other_id"), F.col("chunk").alias("other_chunk")]


def _same_chunk():
    return F.col("conv_id").eqNullSafe(F.col("other_id")) & F.col("chunk").eqNullSafe(F.col("other_chunk"))


def ranked_turns(turns: DataFrame) -> DataFrame:
    """conv_id, chunk, pos (from 1), role, text; repeated rows are gone."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    w = Window.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    again = F.lag("turn").over(w).eqNullSafe(F.col("turn")) & (F.lag("role").over(w) == F.col("role")) & (F.lag("text").over(w) == F.col("text"))
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False))).where("not again")
    rows = rows.withColumn("local", F.row_number().over(w))
    sizes = rows.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*_others(), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    return rows.join(sizes, _same_chunk()).select("conv_id", "chunk", (F.col("skip") + F.col("local")).alias("pos"), "role", "text")


def prefix_hashes(ranked: DataFrame) -> DataFrame:
    """conv_id, pos, h1, h2: the rolling hash of the first ``pos`` turns."""
    rows = ranked.select("conv_id", "chunk", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "role", "pos").alias("b"))
    w = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"a": F.bit_xor("a").over(w), "b": F.bit_xor("b").over(w)})
    ends = rows.groupBy("conv_id", "chunk").agg(F.max_by("a", "pos").alias("ea"), F.max_by("b", "pos").alias("eb"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ends = ends.select(*_others(), F.coalesce(F.bit_xor("ea").over(before), zero).alias("ea"), F.coalesce(F.bit_xor("eb").over(before), zero).alias("eb"))
    return rows.join(ends, _same_chunk()).select("conv_id", "pos", F.col("a").bitwiseXOR(F.col("ea")).alias("h1"), F.col("b").bitwiseXOR(F.col("eb")).alias("h2"))


def maximal(hashes: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that stay."""
    whole = hashes.groupBy("conv_id").agg(F.max("pos").alias("n_turns"), F.max_by("h1", "pos").alias("w1"), F.max_by("h2", "pos").alias("w2"))
    groups = whole.groupBy("n_turns", "w1", "w2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    ends = whole.select(F.col("conv_id").alias("end_id"), "n_turns")
    inner = hashes.join(ends, hashes["conv_id"].eqNullSafe(ends["end_id"]) & (F.col("pos") < F.col("n_turns")), "left_semi")
    inner = inner.select(F.col("pos").alias("p"), F.col("h1").alias("p1"), F.col("h2").alias("p2")).distinct()
    return groups.join(inner, (F.col("n_turns") == F.col("p")) & (F.col("w1") == F.col("p1")) & (F.col("w2") == F.col("p2")), "left_anti").select("conv_id", "n_turns", "n_copies")


def collapse_and_render(turns: DataFrame, start: str = START, middle: str = MIDDLE, end: str = END) -> DataFrame:
    """conv_id, part, n_turns, n_copies, chat: the rendered turns of each maximal conversation."""
    ranked = ranked_turns(turns)
    hashes = save(prefix_hashes(ranked), "prefixes")  # four numbers a turn, read three times
    kept = maximal(hashes).withColumnRenamed("conv_id", "kept_id")
    rows = ranked.join(kept, ranked["conv_id"].eqNullSafe(kept["kept_id"]))
    piece = F.concat(F.lit(start), "role", F.lit(middle), "text", F.lit(end))
    rows = rows.select("conv_id", F.floor((F.col("pos") - 1) / RENDER).alias("part"), "n_turns", "n_copies", F.struct("pos", piece.alias("s")).alias("piece"))
    out = rows.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))  # at most RENDER
    return out.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("pieces.s"), "").alias("chat"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(table(spark, sf_dir, "conversations"))


OP1_SQL = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM t),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS turns, count(*) AS n_turns FROM r GROUP BY conv_id),
g AS (SELECT min(conv_id) AS conv_id, turns, any_value(n_turns) AS n_turns, count(*) AS n_copies FROM c GROUP BY turns),
kept AS (
  SELECT * FROM g WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.n_turns > g.n_turns AND c.turns[1 : g.n_turns] = g.turns))
SELECT r.conv_id, (pos - 1) // 256 AS part, n_turns, n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS chat
FROM r JOIN kept ON r.conv_id IS NOT DISTINCT FROM kept.conv_id
GROUP BY r.conv_id, (pos - 1) // 256, n_turns, n_copies
"""
