"""Preference formatting by DataFrame functions alone: the longest common turn prefix of a chosen and a rejected conversation
becomes the prompt, written once; what follows on each side becomes that side's completion, with what training must not see masked.

The result has a row for each rendered turn, in place, so no conversation, however long, is gathered in one row or task: a
trainer reads the rows of a pair by part and turn. Where the sides first differ is found from hashes of turns; texts move once.

Rows of one side and turn (repeats) are compared as a bag and stay rows of their own. Null role or text counts as empty; a null
turn comes first; rows without pair or side are left out. A pair with one side only is no pair and gives nothing; equal sides
give a prompt alone. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_TURN = -(2**63)
TRAINED = ("assistant", "gpt", "bot")


def turns(conversations: DataFrame) -> DataFrame:
    """(pair_id, rejected, turn, role, text) made of a table of conversations, each of which is the chosen side of a pair of its number.

    The rejected side has the same turns, but its last reply is the last one of the neighbour (of 2i that of 2i + 1, and the
    other way round). Of rows of one turn the greatest text counts as the reply, and all replies of that turn are replaced.
    Without a reply in both there is no pair.
    """
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("pair_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text").where("pair_id is not null")
    place, said = F.coalesce("turn", F.lit(FIRST_TURN)), F.coalesce("text", F.lit(""))
    trained = F.lower("role").isin(*TRAINED)
    last = rows.where(trained).groupBy("pair_id").agg(F.max(F.struct(place.alias("turn"), said.alias("text"))).alias("last"))
    swapped = last.select(F.col("pair_id").alias("n"), F.col("last.text").alias("reply"))
    swap = last.select("pair_id", F.col("last.turn").alias("at")).join(swapped, F.col("pair_id").bitwiseXOR(F.lit(1)) == F.col("n")).drop("n")
    both = rows.join(swap, "pair_id").withColumn("rejected", F.explode(F.array(F.lit(False), F.lit(True))))
    text = F.when(F.col("rejected") & trained & (place == F.col("at")), F.col("reply")).otherwise(F.col("text"))
    return both.select("pair_id", "rejected", "turn", "role", text.alias("text"))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """(pair_id, part, completion, other, turn, role, rendered, masked_chars) from (pair_id, rejected, turn, role, text).

    part is prompt, chosen or rejected. completion names the completion that a row is of and other the one it is paired with;
    both are null in a prompt, which is the pair's. The first masked_chars code points of rendered carry no loss: all of a prompt and of
    other speakers' turns, the header of a turn that is trained.
    """
    rows = pairs.where(F.col("pair_id").isNotNull() & F.col("rejected").isNotNull()).select(
        "pair_id", "rejected", F.coalesce("turn", F.lit(FIRST_TURN)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    hashes = [F.xxhash64(F.lit(seed), "role", "text").cast("decimal(20,0)") for seed in (1, 2)]
    side = lambda value, rejected: F.when(F.col("rejected") == rejected, value)
    bag = [x for r in (False, True) for x in (F.count(side(F.lit(1), r)).alias(f"n{r}"), *[F.sum(side(h, r)).alias(f"h{i}{r}") for i, h in enumerate(hashes)])]
    bags = rows.groupBy("pair_id", "turn").agg(*bag)
    same = F.lit(True)
    for c in ("n", "h0", "h1"):
        same = same & F.col(f"{c}False").eqNullSafe(F.col(f"{c}True"))
    cut = bags.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("cut"), F.sum("nFalse").alias("a"), F.sum("nTrue").alias("b")).where("a > 0 and b > 0").select("pair_id", "cut")
    common = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    part = F.when(common, "prompt").when(F.col("rejected"), "rejected").otherwise("chosen")
    header = F.concat(F.lit("<|"), F.lower("role"), F.lit("|>\n"))
    rendered = F.concat(header, F.col("text"), F.lit("\n"))
    free = ~common & F.lower("role").isin(*TRAINED)
    joined = rows.join(cut, "pair_id").where(~(common & F.col("rejected")))
    named = lambda a, b: F.when(~common, F.concat_ws(":", "pair_id", F.when(F.col("rejected"), a).otherwise(b)))
    pair = named("rejected", "chosen").alias("completion"), named("chosen", "rejected").alias("other")
    return joined.select("pair_id", part.alias("part"), *pair, F.nullif("turn", F.lit(FIRST_TURN)).alias("turn"), "role", rendered.alias("rendered"), F.when(free, F.length(header)).otherwise(F.length(rendered)).cast("long").alias("masked_chars"))


def report(conversations: DataFrame) -> DataFrame:
    return format_pairs(turns(conversations))


SQL = r"""
WITH c AS (
  SELECT conv_id AS pair_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
replies AS (
  SELECT pair_id, turn AS place, text FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn DESC, text DESC) AS r FROM c WHERE lower(role) IN ('assistant', 'gpt', 'bot')) WHERE r = 1),
swaps AS (SELECT a.pair_id, a.place, b.text AS reply FROM replies a JOIN replies b ON b.pair_id = xor(a.pair_id, 1)),
t AS (
  SELECT pair_id, 0 AS side, turn, role, text FROM c SEMI JOIN swaps USING (pair_id)
  UNION ALL SELECT pair_id, 1, turn, role, CASE WHEN lower(role) IN ('assistant', 'gpt', 'bot') AND turn = place THEN reply ELSE text END FROM c JOIN swaps USING (pair_id)),
bags AS (
  SELECT pair_id, turn, list_sort(list(role || chr(1) || text) FILTER (side = 0)) AS a, list_sort(list(role || chr(1) || text) FILTER (side = 1)) AS b
  FROM t GROUP BY ALL),
cuts AS (
  SELECT pair_id, min(turn) FILTER (a IS DISTINCT FROM b) AS cut FROM bags GROUP BY 1 HAVING count(a) > 0 AND count(b) > 0),
placed AS (
  SELECT t.*, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' WHEN side = 1 THEN 'rejected' ELSE 'chosen' END AS part,
         '<|' || lower(role) || '|>' || chr(10) AS header
  FROM t JOIN cuts USING (pair_id))
SELECT pair_id, part, CASE WHEN part <> 'prompt' THEN pair_id || ':' || part END AS completion,
       CASE part WHEN 'chosen' THEN pair_id || ':rejected' WHEN 'rejected' THEN pair_id || ':chosen' END AS other,
       nullif(turn, -9223372036854775808) AS turn, role, header || text || chr(10) AS rendered,
       CASE WHEN part <> 'prompt' AND lower(role) IN ('assistant', 'gpt', 'bot') THEN length(header) ELSE length(header || text || chr(10)) END AS masked_chars
FROM placed WHERE NOT (part = 'prompt' AND side = 1)
"""
