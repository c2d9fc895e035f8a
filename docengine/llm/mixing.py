"""Operator 3: mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Native: DataFrame functions only.

1. Sizes.  Words are counted once per row; all decisions are made on the narrow table of (key, source, size).
2. Blocks.  A source's rows are dealt by hash into blocks, as many as its share of all words asks for; rows of two or more
   blocks' words are blocks of their own.  The numbers of output shards and of blocks follow the number of words.
3. Quotas.  A source's target is filled with its blocks in permuted order: whole rounds first, then each block that still
   fits, then rows of one cut block that still fit.
4. Tree.  A binary tree over the output shards splits the quotas: at every node a uniformly random half of the drawn blocks
   (all ranked by a keyed hash) goes left, so the counts per source on either side follow the multivariate
   hypergeometric law and always add up to the exact quotas.
5. Draws.  Each shard draws its disjoint run of the source's permuted blocks.  A block lies in one shard with all its copies, so
   a text moves once; a row is taken as often as its block is drawn there.  Rows are shuffled inside their shard by a keyed hash.

Windows over all sources and all blocks hold one row per source or block, about 16 per shard, never documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

WORD = r"[^\x20\x09-\x0D]+"
#: Weights by the source's place in code-point order, repeating (null comes last).
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
#: Words of an output shard, fewest levels of the tree, and blocks for each shard.
SHARD_WORDS = 20_000_000
LEVELS = 3
PER_SHARD = 16
#: How often blocks, and rows of the cut block, that still fit are looked for.
PASSES = 3


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> with weight and target.  Water-filling in closed form.

    Sources, sorted by size over weight, are capped at ``most`` times their size one after the other; the
    first level at which no further source would exceed its cap is the one that resharing reaches.
    One row per source goes through the windows here, never a document.
    """
    by = W.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by) - 1) % n + 1).cast("int"))
    s = sizes.withColumn("weight", w)
    order = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    all_ = W.partitionBy()
    s = s.withColumn("left", share * F.sum("source_size").over(all_) - most * F.coalesce(F.sum("source_size").over(upto), F.lit(0)))
    s = s.withColumn("left_w", F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    s = s.withColumn("level", F.col("left") / F.col("left_w"))
    s = s.withColumn("place", F.row_number().over(order)).withColumn("open", most * F.col("source_size") > F.col("level") * F.col("weight"))
    s = s.withColumn("water", F.min(F.when(F.col("open"), F.struct("place", "level"))).over(all_)["level"])
    cap = most * F.col("source_size")
    target = F.when(F.col("water").isNull(), cap).otherwise(F.least(cap, F.col("water") * F.col("weight"))).cast("double")
    return s.select("source", "source_size", "weight", target.alias("target"))


def _name(value: Column) -> Column:
    """A string for each value, null included."""
    return F.coalesce(F.concat(F.lit("v"), value.cast("string")), F.lit("n"))


def _rand(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]).cast("binary"))


def _block(kid: Column, size: Column, source_size: Column, blocks: Column) -> Column:
    """A row's block; one with twice the words of a block, or more, is its own."""
    dealt = (F.conv(F.substring(_rand("deal", kid), 1, 8), 16, 10).cast("long") % blocks).cast("string")
    return F.when(size * blocks >= 2 * source_size, F.when(size > 0, F.concat(F.lit("k"), kid))).otherwise(dealt)


def _fit(rows: DataFrame, by: list[str], order: list[str], words: str, room: Column) -> DataFrame:
    """Add ``fits``: rows taken in order while they fit into ``room``, then again among those left; and ``left``, the room left."""
    within, at = W.partitionBy(*by), W.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("fits", F.lit(False)).withColumn("left", room)
    for _ in range(PASSES):
        may = ~F.col("fits") & (F.col(words) <= F.col("left"))
        out = out.withColumn("may", may).withColumn("run", F.sum(F.when(F.col("may"), F.col(words)).otherwise(0)).over(at))
        out = out.withColumn("new", F.col("may") & (F.col("run") <= F.col("left")))
        out = out.withColumn("left", F.col("left") - F.coalesce(F.sum(F.when(F.col("new"), F.col(words))).over(within), F.lit(0)))
        out = out.withColumn("fits", F.col("fits") | F.col("new"))
    return out.drop("may", "run", "new")


def split_tree(units: DataFrame, levels: int) -> DataFrame:
    """(name, unit) -> (name, unit, shard): 2**levels shards; units of a name are numbered in permuted order from 1."""
    split = units.select("name", "unit", F.lit(0).alias("node"))
    for level in range(levels):
        at = W.partitionBy("node")
        rank = F.row_number().over(at.orderBy(_rand(f"split{level}", F.col("node"), F.col("name"), F.col("unit")), "name", "unit"))
        split = split.withColumn("right", (rank * 2 > F.count("*").over(at) + F.col("node") % 2).cast("int"))
        split = split.select("name", "unit", (F.col("node") * 2 + F.col("right")).alias("node"))
    # The tree gives each shard its quota of a source; shards in order draw the next units of the source's permuted blocks.
    return split.select("name", F.row_number().over(W.partitionBy("name").orderBy("node", "unit")).alias("unit"), F.col("node").alias("shard"))


def mix_sizes(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kid, source, size) -> the plan: sources, drawn blocks, and rows taken from cut blocks (all written tables).

    sources: (name, source_size, target, blocks); blocks: (name, block, copies, shard, cut); taken: (name, kid), once more than
    their block's copies.
    """
    totals = rows.groupBy(F.col("source")).agg(F.sum("size").alias("source_size"))
    sources = materialize(source_targets(totals, weights, share, most).withColumn("name", _name(F.col("source"))), "sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    levels = LEVELS
    while shard_words << levels < share * total:
        levels += 1
    blocks = F.greatest(F.lit(1), F.ceil(F.lit(float(PER_SHARD << levels)) * F.col("source_size") / F.lit(float(max(total, 1))))).cast("long")
    sources = sources.select("name", "source_size", "target", blocks.alias("blocks"))
    r = rows.select("kid", _name(F.col("source")).alias("name"), "size").join(sources, "name")
    r = r.withColumn("block", _block(F.col("kid"), F.col("size"), F.col("source_size"), F.col("blocks")))
    b = materialize(r.groupBy("name", "block").agg(F.sum("size").alias("words")).where("block is not null"), "blocks").join(sources, "name")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    b = b.withColumn("rounds", rounds).withColumn("order", _rand("block", F.col("name"), F.col("block")))
    b = _fit(b, ["name"], ["order", "block"], "words", F.col("target") - F.col("rounds") * F.col("source_size"))
    # One of the blocks left is cut, a block of many rows.
    open_ = ~F.col("fits") & (F.substring("block", 1, 1) != "k")
    first = F.row_number().over(W.partitionBy("name").orderBy(F.when(open_, 0).otherwise(1), "order", "block"))
    b = b.withColumn("cut", open_ & (first == 1) & (F.col("left") > 0))
    b = b.withColumn("copies", (F.col("rounds") + F.col("fits").cast("int")).cast("int"))
    drawn = materialize(b.where("copies > 0 or cut").withColumn("unit", F.row_number().over(W.partitionBy("name").orderBy("order", "block"))), "drawn")
    shards = split_tree(drawn.select("name", "unit"), levels)
    plan = materialize(drawn.join(shards, ["name", "unit"]).select("name", "block", "copies", "shard", F.when(F.col("cut"), F.col("left")).alias("cut")), "plan")
    inside = r.select("kid", "name", "block", "size").join(plan.where("cut is not null").select("name", "block", "cut"), ["name", "block"])
    inside = inside.groupBy("name", "kid", "cut").agg(F.sum("size").alias("size")).withColumn("order", _rand("row", F.col("kid")))
    taken = materialize(_fit(inside, ["name"], ["order", "kid"], "size", F.col("cut")).where("fits").select("name", "kid"), "taken")
    return sources, plan, taken


def _decide(rows: DataFrame, plan: tuple[DataFrame, DataFrame, DataFrame], name: Column, kid: Column, block) -> DataFrame:
    """Rows with _size, _source_size, _target, _copies and _shard (null for rows not taken) beside their own columns."""
    sources, blocks, taken = plan
    s = sources.select(F.col("name").alias("_s_name"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("blocks").alias("_s_blocks"))
    b = blocks.select(F.col("name").alias("_b_name"), F.col("block").alias("_b_block"), F.col("copies").alias("_b_copies"), F.col("shard").alias("_b_shard"), F.col("cut").isNotNull().alias("_b_cut"))
    t = taken.select(F.col("name").alias("_t_name"), F.col("kid").alias("_t_kid"))
    out = rows.withColumn("_name", name).withColumn("_kid", kid).join(s, F.col("_name") == F.col("_s_name"))
    out = out.withColumn("_block", block(F.col("_kid"), F.col("_source_size"), F.col("_s_blocks")))
    out = out.join(b, (F.col("_name") == F.col("_b_name")) & (F.col("_block") == F.col("_b_block")), "left")
    out = out.join(t, F.col("_b_cut") & (F.col("_name") == F.col("_t_name")) & (F.col("_kid") == F.col("_t_kid")), "left")
    out = out.withColumn("_copies", F.coalesce(F.col("_b_copies") + F.col("_t_kid").isNotNull().cast("int"), F.lit(0)))
    return out.withColumn("_shard", F.when(F.col("_copies") > 0, F.col("_b_shard")))


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Decide how often every row is taken, and into which output shard.

    Returns ``docs`` with _source_size, _target, _copies (0, 1 or 2), _shard (null if not taken) and _order (the local shuffle
    key).  Null text has size 0; null source is a source of its own, last in order; rows with one key (null is a key) are taken
    alike; empty input gives an empty result; extra columns pass through whatever their names, but for these five and other
    names from ``OWN``, which are replaced or dropped.
    """
    own = [c for c in docs.columns if c in OWN]
    docs = docs.drop(*own)
    sizes = docs.select(_name(F.col(f"`{key}`")).alias("kid"), F.col(f"`{source}`").alias("source"), word_count(F.col(f"`{text}`")).alias("size"))
    plan = mix_sizes(materialize(sizes, "sizes"), weights, share, most, shard_words)

    def block(kid: Column, source_size: Column, blocks: Column) -> Column:
        # A text has at most as many words as every other byte of it, so most are not counted again.
        short = (F.octet_length(F.coalesce(F.col(f"`{text}`"), F.lit(""))) + 1) * blocks < 4 * source_size
        return F.when(short, _block(kid, F.lit(0), F.lit(1), blocks)).otherwise(_block(kid, word_count(F.col(f"`{text}`")), source_size, blocks))

    out = _decide(docs, plan, _name(F.col(f"`{source}`")), _name(F.col(f"`{key}`")), block)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "_source_size", "_target", "_copies", "_shard", _rand("shuffle", F.col("_kid")).alias("_order"))


OWN = {"_name", "_kid", "_block", "_source_size", "_target", "_copies", "_shard", "_order", "_s_name", "_s_blocks", "_b_name", "_b_block", "_b_copies", "_b_shard", "_b_cut", "_t_name", "_t_kid"}


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = materialize(docs.select("doc_id", _name(F.col("doc_id")).alias("kid"), "source", word_count("text").alias("size")), "sizes")
    plan = mix_sizes(rows.select("kid", "source", "size"))
    m = _decide(rows, plan, _name(F.col("source")), F.col("kid"), lambda kid, source_size, blocks: _block(kid, F.col("size"), source_size, blocks))
    return m.select("doc_id", F.col("size").cast("long").alias("size"), F.col("_source_size").cast("long").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("size")).cast("long").alias("taken"), F.col("_shard").cast("int").alias("shard"))


def _fit_sql(source: str, out: str, by: str, order: str, words: str, room: str) -> str:
    """The passes of ``_fit`` as a chain of common table expressions."""
    steps = [f"{out}_0 AS (SELECT *, false AS fits, CAST({room} AS DOUBLE) AS rest FROM {source})"]
    for k in range(PASSES):
        steps.append(f"{out}_{k}r AS (SELECT *, sum(CASE WHEN NOT fits AND {words} <= rest THEN {words} ELSE 0 END) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS run FROM {out}_{k})")
        steps.append(f"{out}_{k}n AS (SELECT *, NOT fits AND {words} <= rest AND run <= rest AS fresh FROM {out}_{k}r)")
        steps.append(f"{out}_{k + 1} AS (SELECT * EXCLUDE (fits, rest, run, fresh), fits OR fresh AS fits, rest - coalesce(sum(CASE WHEN fresh THEN {words} END) OVER (PARTITION BY {by}), 0) AS rest FROM {out}_{k}n)")
    return ",\n".join([*steps, f"{out} AS (SELECT * FROM {out}_{PASSES})"])


def _tree_sql() -> str:
    """Three levels of the tree: enough for tables of up to eight shards' words."""
    steps = ["n0 AS (SELECT name, unit, 0 AS node FROM drawn)"]
    for k in range(LEVELS):
        steps.append(f"m{k} AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY md5(concat_ws('|', 'split{k}', node, name, unit)), name, unit) AS rank, count(*) OVER (PARTITION BY node) AS many FROM n{k})")
        steps.append(f"n{k + 1} AS (SELECT name, unit, node * 2 + CASE WHEN rank * 2 > many + node % 2 THEN 1 ELSE 0 END AS node FROM m{k})")
    return ",\n".join([*steps, f"shards AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY node, unit) AS unit, node AS shard FROM n{LEVELS})"])


OP3_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('v' || doc_id, 'n') AS kid, coalesce('v' || source, 'n') AS name,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size
  FROM documents),
s AS (
  SELECT source, name, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM d GROUP BY source, name),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER o, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0::DOUBLE)) AS level
  FROM s WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT name, source_size,
         least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM l WHERE 2.0 * source_size > level * weight ORDER BY source_size / weight, source ASC NULLS LAST LIMIT 1), 1e300::DOUBLE) * weight)::DOUBLE AS target,
         greatest(1, CAST(ceil({PER_SHARD << LEVELS}::DOUBLE * source_size / greatest(sum(source_size) OVER (), 1)::DOUBLE) AS BIGINT)) AS blocks
  FROM l),
r AS (
  SELECT d.doc_id, d.kid, d.name, d.size, t.source_size, t.target,
         CASE WHEN size * blocks >= 2 * source_size THEN CASE WHEN size > 0 THEN 'k' || kid END
              ELSE CAST(CAST('0x' || substr(md5('deal|' || kid), 1, 8) AS BIGINT) % blocks AS VARCHAR) END AS block
  FROM d JOIN t ON d.name = t.name),
b AS (
  SELECT name, block, any_value(source_size) AS source_size, any_value(target) AS target, CAST(sum(size) AS BIGINT) AS words,
         CASE WHEN any_value(source_size) > 0 THEN CAST(floor(any_value(target) / any_value(source_size)) AS INTEGER) ELSE 0 END AS rounds,
         md5('block|' || name || '|' || block) AS place
  FROM r WHERE block IS NOT NULL GROUP BY name, block),
{_fit_sql("b", "f", "name", "place, block", "words", "target - rounds * source_size")},
c AS (
  SELECT *, NOT fits AND block[1] <> 'k' AND rest > 0
            AND row_number() OVER (PARTITION BY name ORDER BY CASE WHEN NOT fits AND block[1] <> 'k' THEN 0 ELSE 1 END, place, block) = 1 AS cut,
         rounds + CASE WHEN fits THEN 1 ELSE 0 END AS copies
  FROM f),
drawn AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY place, block) AS unit FROM c WHERE copies > 0 OR cut),
{_tree_sql()},
plan AS (SELECT drawn.name, block, copies, cut, rest, shard FROM drawn JOIN shards ON drawn.name = shards.name AND drawn.unit = shards.unit),
i AS (
  SELECT r.name, kid, CAST(sum(size) AS BIGINT) AS size, any_value(rest) AS room, md5('row|' || kid) AS place
  FROM r JOIN plan ON r.name = plan.name AND r.block = plan.block AND cut GROUP BY r.name, kid),
{_fit_sql("i", "g", "name", "place, kid", "size", "room")},
z AS (
  SELECT r.doc_id, r.size, r.source_size, r.target, plan.shard, coalesce(plan.copies + CASE WHEN plan.cut AND g.kid IS NOT NULL THEN 1 ELSE 0 END, 0) AS copies
  FROM r LEFT JOIN plan ON r.name = plan.name AND r.block = plan.block LEFT JOIN (SELECT name, kid FROM g WHERE fits) g ON r.name = g.name AND r.kid = g.kid)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CASE WHEN copies > 0 THEN CAST(shard AS INTEGER) END AS shard
FROM z
"""

QUERIES = {"op3_mix_sources": op3_mix_sources}
ORACLE = {"op3_mix_sources": OP3_SQL}
