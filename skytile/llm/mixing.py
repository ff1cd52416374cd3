"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's token share p becomes a weight proportional to p ** a. Bisection finds the exponent a in [0, 1]:
the flattest mix whose largest repetition stays at or below ``max_repeat`` and, if a target entropy is given,
whose entropy does not pass it. Every source is used at least once in full, so nothing is dropped; smaller
sources are repeated. A source's budget is then realised as whole passes plus a part of one more: its
documents lie in hashed blocks, the blocks are permuted, whole blocks are taken while the budget lasts,
and inside the block where it ends documents are taken in hashed order.

Null sources form a source of their own; null or empty texts have no tokens and are used as often as
their place in the permutation says; a source without any token is used once. Repeated rows share one place
in the order and are taken together. Empty tables give no rows. Other columns are kept as they are, but for those
named ``mix_epoch`` and ``mix_weight``, which are replaced. Sources are a list of at most ``MOST_SOURCES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skytile.session import free_prefix

#: Documents in a block on average.
BLOCK_DOCS = 2048
#: Sources whose plan, a row each, goes to all tasks; more raise an error.
MOST_SOURCES = 100_000
STEPS = 50
MAX_REPEAT = 2.0
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    return F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))


def exponent(p: Column, max_repeat: float = MAX_REPEAT, target_entropy: float | None = None) -> Column:
    """The exponent for an array column of token shares (as long as the list of sources), found by bisection."""

    def over(a: Column) -> Column:  # true: too flat
        bad = F.pow(F.array_max(p) / F.array_min(p), F.lit(1.0) - a) > F.lit(float(max_repeat))
        if target_entropy is not None:
            z = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.pow(x, a))
            bad = bad | (F.aggregate(p, F.lit(0.0), lambda s, x: s - F.pow(x, a) / z * F.ln(F.pow(x, a) / z)) > F.lit(float(target_entropy)))
        return bad

    state = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")),
        lambda s, _: F.when(over((s["lo"] + s["hi"]) / 2), F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    return F.when(F.size(p) == 0, F.lit(1.0)).when(over(F.lit(0.0)), state["hi"]).otherwise(F.lit(0.0))


def weights(sources: DataFrame, max_repeat: float = MAX_REPEAT, target_entropy: float | None = None) -> DataFrame:
    """Per source (source_key, tokens, blocks): repeat, token budget, full passes, the rest and the weight.

    The sources are gathered into one array, as long as the list of sources, and dealt out again.
    """
    one = sources.agg(F.array_sort(F.collect_list(F.struct("source_key", "tokens", "blocks"))).alias("sources"))
    many = F.raise_error(F.lit(f"more than {MOST_SOURCES} sources"))
    one = one.withColumn("sources", F.when(F.size("sources") <= MOST_SOURCES, F.col("sources")).otherwise(many))
    one = one.withColumn("full", F.filter("sources", lambda s: s["tokens"] > 0)).withColumn("sum", F.aggregate("full", F.lit(0).cast("long"), lambda a, s: a + s["tokens"]))
    one = one.withColumn("p", F.transform("full", lambda s: s["tokens"].cast("double") / F.col("sum"))).withColumn("top", F.array_max(F.transform("full", lambda s: s["tokens"])))
    one = one.withColumn("alpha", exponent(F.col("p"), max_repeat, target_entropy))

    def planned(s: Column) -> Column:
        repeat = F.when(s["tokens"] > 0, F.round(F.pow(F.col("top") / s["tokens"], F.lit(1.0) - F.col("alpha")), 9)).otherwise(F.lit(1.0))
        return F.struct(s["source_key"].alias("source_key"), s["tokens"].alias("tokens"), s["blocks"].alias("blocks"), repeat.alias("repeat"), F.floor(repeat * s["tokens"] + 0.5).cast("long").alias("budget"))

    one = one.withColumn("plan", F.transform("sources", planned)).withColumn("all_budget", F.aggregate("plan", F.lit(0).cast("long"), lambda a, s: a + s["budget"]))
    w = one.select("alpha", "all_budget", F.inline("plan"))
    w = w.withColumn("passes", F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens")).cast("long")).otherwise(F.lit(1).cast("long")))
    w = w.withColumn("rest", F.col("budget") - F.col("passes") * F.col("tokens"))
    return w.withColumn("weight", F.when(F.col("all_budget") > 0, F.round(F.col("budget") / F.col("all_budget"), 9)).otherwise(F.lit(0.0)))


def mix(docs: DataFrame, max_repeat: float = MAX_REPEAT, target_entropy: float | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = SEED, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """``docs`` with each row as often as the mix asks, plus ``mix_epoch`` (from 0) and ``mix_weight``."""
    key = F.coalesce(F.concat(F.lit("s:"), F.col(source_col).cast("string")), F.lit("null"))
    light = docs.select(key.alias("source_key"), F.col(id_col).alias("_id"), word_count(F.col(text_col)).alias("tokens"))
    sources = light.groupBy("source_key").agg(F.sum("tokens").alias("tokens"), F.ceil(F.count("*") / block_docs).cast("long").alias("blocks"))
    w = weights(sources, max_repeat, target_entropy)

    def block(doc, blocks):
        return F.pmod(F.conv(F.substring(_hash(F.lit(seed), doc), 1, 8), 16, 10).cast("long"), blocks)

    def order(passes, source, b):
        return _hash(F.lit(seed), passes, source, b)

    def place(doc):
        return _hash(F.lit(seed), F.lit("doc"), doc)

    placed = light.join(w.select("source_key", "blocks", "passes", "rest"), "source_key").where("rest > 0").withColumn("block", block(F.col("_id"), F.col("blocks")))
    per_block = placed.groupBy("source_key", "block").agg(F.sum("tokens").alias("tokens"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
    per_block = per_block.withColumn("block_key", order(F.col("passes"), F.col("source_key"), F.col("block")))
    # Where a source's budget ends: first the group of blocks, by the start of their keys, then the block in it.
    per_block = per_block.withColumn("part", F.substring("block_key", 1, 3))

    def first_beyond(rows: DataFrame, order: str, *more: str) -> DataFrame:
        """Per source the first row whose running sum of tokens, after ``before``, passes the rest, with the sum before it."""
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source_key").orderBy(order))
        beyond = rows.withColumn("upto", upto).where("upto > rest")
        return beyond.groupBy("source_key").agg(F.min(F.struct("upto", order, "tokens", "rest", *more)).alias("e")).select("source_key", f"e.{order}", (F.col("e.upto") - F.col("e.tokens")).alias("before"), "e.rest", *[f"e.{c}" for c in more])

    parts = per_block.groupBy("source_key", "part").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"), F.lit(0).cast("long").alias("before"))
    inside = per_block.join(first_beyond(parts, "part").select("source_key", "part", "before"), ["source_key", "part"])
    ends = first_beyond(inside, "block_key", "block").select("source_key", F.col("block_key").alias("end_key"), "block", (F.col("rest") - F.col("before")).alias("left"))
    last = placed.join(ends, ["source_key", "block"]).groupBy("source_key", place(F.col("_id")).alias("place")).agg(F.sum("tokens").alias("tokens"), F.first("left").alias("left"))
    cuts = (
        last.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source_key").orderBy("place"))).where("upto <= left")
        .groupBy("source_key").agg(F.max("place").alias("end_place"))
    )
    ends = ends.drop("block")
    plan = w.join(ends, "source_key", "left").join(cuts, "source_key", "left")
    p = free_prefix(docs, start="mix")
    plan = plan.select(F.col("source_key").alias(f"{p}own"), F.struct("blocks", "passes", "rest", "weight", "end_key", "end_place").alias(f"{p}plan"))

    # The plan has a row per source, as the array of sources above, so documents stay where they are.
    out = docs.withColumn(f"{p}source", key).join(F.broadcast(plan), F.col(f"{p}source") == F.col(f"{p}own"))
    m, doc = F.col(f"{p}plan"), F.col(id_col)
    doc_key = order(m["passes"], F.col(f"{p}source"), block(doc, m["blocks"]))
    inside = (m["rest"] > 0) & (m["end_key"].isNull() | (doc_key < m["end_key"]) | ((doc_key == m["end_key"]) & F.coalesce(place(doc) <= m["end_place"], F.lit(False))))
    times = m["passes"] + F.when(inside, 1).otherwise(0)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("mix_weight", "mix_epoch")], m["weight"].alias("mix_weight"), F.explode(F.sequence(F.lit(0).cast("long"), times - 1)).alias("mix_epoch"))


def op8_temperature_mix(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "mix_epoch", "mix_weight")


OP8_SQL = r"""
with recursive light as (
  select doc_id, source, coalesce('s:' || source, 'null') as k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as tokens from documents
), s as (select k, sum(tokens)::bigint as tokens, ceil(count(*) / 2048.0)::bigint as blocks from light group by k),
m as (select max(tokens)::double / sum(tokens) as pmax, min(tokens)::double / sum(tokens) as pmin, max(tokens) as top from s where tokens > 0),
b(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1, case when pow(m.pmax / m.pmin, 1 - (lo + hi) / 2) > 2.0 then (lo + hi) / 2 else lo end,
         case when pow(m.pmax / m.pmin, 1 - (lo + hi) / 2) > 2.0 then hi else (lo + hi) / 2 end from b, m where i < 50
), a as (select case when pow(m.pmax / m.pmin, 1) > 2.0 then hi else 0.0 end as alpha, top from b, m where i = 50),
w1 as (select s.*, case when tokens > 0 then round(pow(a.top / tokens, 1 - alpha), 9) else 1.0 end as rep from s, a),
w2 as (select *, floor(rep * tokens + 0.5)::bigint as budget from w1),
w3 as (select *, case when tokens > 0 then floor(budget / tokens)::bigint else 1 end as passes from w2),
w as (select *, budget - passes * tokens as rest, round(budget / (sum(budget) over ()), 9) as weight from w3),
d as (
  select l.*, w.passes, w.rest, w.weight, ('0x' || substr(md5('17|' || doc_id), 1, 8))::bigint % w.blocks as block, md5('17|doc|' || doc_id) as place from light l join w using (k)
), d2 as (select *, md5('17|' || passes || '|' || k || '|' || block) as block_key from d),
pb as (select k, block, block_key, rest, sum(tokens) as tokens from d2 where rest > 0 group by all),
run as (select *, sum(tokens) over (partition by k order by block_key) as upto from pb),
ends as (select k, min_by(block_key, (upto, block_key)) as end_key, min_by(rest - upto + tokens, (upto, block_key)) as left_over from run where upto > rest group by k),
cut as (
  select k, max(place) as end_place from (
    select d2.k, place, left_over, sum(d2.tokens) over (partition by d2.k order by place) as upto from d2 join ends on d2.k = ends.k and d2.block_key = ends.end_key
  ) where upto <= left_over group by k
), t as (
  select doc_id, source, weight, passes + case when rest > 0 and (end_key is null or block_key < end_key or (block_key = end_key and place <= end_place)) then 1 else 0 end as n
  from d2 left join ends using (k) left join cut using (k)
)
select doc_id, source, unnest(range(0, n)) as mix_epoch, weight as mix_weight from t
"""
