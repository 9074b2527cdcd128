"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in
DataFrame and SQL functions only.

1. Documents belong to blocks by a hash of what they are (id, size, checksum and, of equal rows, a
   number), so that reruns and other partitionings agree. From the blocks' counts and the shards' sizes
   (at most one apart) the matrix of block-to-shard counts is drawn: block after block, shard after
   shard, a hypergeometric number, by inversion of its distribution. That is what a uniformly random
   permutation of all rows would give.
2. Each block is permuted locally (by a seeded hash): the first rows go to shard 0, as many as the
   matrix says, the next to shard 1 ...
3. Rows are exchanged and each shard is permuted again (by another hash): that order is the slot.

Orders within blocks and shards are found within ranges of their hash, whose counts are added up, so
that no block or shard is one task's work. Only the counts (``blocks * RANGES`` and ``shards *
RANGES`` numbers, whatever the input) come together in one task.

Rows that are equal in id, size and checksum can't be told apart in the result. They are counted and
then numbered (``numbered``), so that they too spread over blocks, shards and slots like others.

Law: ``rows``. Defined cases: a null text has no bytes and size 1; a null doc_id is an id like any
other; repeated rows are rows of their own; an empty table gives an empty result; other columns are
left out, so none can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from procure_spark.llm.common import table, written

BLOCKS, RANGES, SHARDS, SEED = 48, 256, 16, 20

#: Equal rows that are written out at once.
AT_ONCE = 4096

#: Standard deviations around the mean that the inversion covers; beyond lies less than a double's step.
SIGMAS = 9

#: ln(n!) by Stirling's series, exact to a double's precision from 16 on; below, of the product.
LN_FACTORIAL = """case when {n} < 16 then ln(aggregate(sequence(1, 16), 1D, (p, i) -> if(i <= {n}, p * i, p)))
 else ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1D / (12D * {n}) - 1D / (360D * pow({n}, 3)) + 1D / (1260D * pow({n}, 5)) end"""


def ln_choose(n: str, k: str) -> str:
    one = lambda x: f"({LN_FACTORIAL.format(n=f'cast(({x}) as double)')})"
    return f"({one(n)} - {one(k)} - {one(f'({n}) - ({k})')})"


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for the number of marked ones among ``drawn`` out of ``total``, by inversion at u.

    Names must be those of lambda variables or columns, not expressions, for they are repeated.
    Probabilities follow by their ratio from the first one that counts.
    """
    mean = f"(cast({drawn} as double) * {marked} / {total})"
    deviation = f"sqrt({mean} * (1D - cast({marked} as double) / {total}) * ({total} - {drawn}) / greatest({total} - 1, 1))"
    low = f"greatest(0L, {drawn} - ({total} - {marked}), cast(floor({mean} - {SIGMAS} * {deviation} - 9) as bigint))"
    high = f"least({drawn}, {marked}, cast(ceil({mean} + {SIGMAS} * {deviation} + 9) as bigint))"
    first = f"exp({ln_choose(marked, 'lo')} + {ln_choose(f'{total} - {marked}', f'{drawn} - lo')} - {ln_choose(total, drawn)})"
    ratio = f"(cast({marked} - x as double) * ({drawn} - x) / ((x + 1D) * ({total} - {marked} - {drawn} + x + 1D)))"
    step = f"named_struct('p', s.p * {ratio}, 'sum', s.sum + s.p, 'at', if(s.sum + s.p < {u}, x + 1, s.at))"
    fold = f"aggregate(sequence(lo, hi), named_struct('p', {first}, 'sum', 0D, 'at', lo), (s, x) -> {step}, s -> least(s.at, hi))"
    # One-element arrays bind lo and hi once.
    return f"transform(array({low}), lo -> transform(array({high}), hi -> {fold})[0])[0]"


def communication_matrix(counts: Column, shards: int, seed: int) -> Column:
    """counts: array of the blocks' row counts. An array per block, of how many go to each shard."""
    name = "__counts"
    rows = f"aggregate({name}, 0L, (a, b) -> a + b)"
    sizes = f"transform(sequence(0, {shards - 1}), s -> ({rows} div {shards}) + if(s < {rows} % {shards}, 1L, 0L))"
    u = f"((shiftrightunsigned(xxhash64(b, s, {seed}), 11) + 0.5D) / 9007199254740992D)"
    # While a block is dealt: what is left of it, of all shards from s on, and what each shard got.
    t, m, d = "t0", "m0", "d0"
    draw = f"if({d} = 0 or {m} = 0, 0L, {hypergeometric(t, m, d, 'u0')})"
    bound = f"transform(array(acc.left), {t} -> transform(array(left_of[s]), {m} -> transform(array(acc.block), {d} -> transform(array({u}), u0 -> {draw})[0])[0])[0])[0]"
    dealt = f"transform(array({bound}), g -> named_struct('left', acc.left - left_of[s], 'block', acc.block - g, 'got', array_append(acc.got, g)))[0]"
    one_block = f"aggregate(sequence(0, {shards - 1}), named_struct('left', aggregate(left_of, 0L, (a, c) -> a + c), 'block', {name}[b], 'got', cast(array() as array<bigint>)), (acc, s) -> {dealt}, acc -> acc.got)"
    next_block = f"transform(array(all.sizes), left_of -> transform(array({one_block}), got -> named_struct('sizes', zip_with(left_of, got, (x, y) -> x - y), 'matrix', array_append(all.matrix, got)))[0])[0]"
    fold = f"aggregate(sequence(0, size({name}) - 1), named_struct('sizes', {sizes}, 'matrix', cast(array() as array<array<bigint>>)), (all, b) -> {next_block}, all -> all.matrix)"
    return F.expr(f"transform(array({{}}), {name} -> {fold})[0]".format(counts))


def ranks(df: DataFrame, group: str, places: int, order: list[str], hash_col: str) -> DataFrame:
    """df with ``rank`` (from 0) of each row in its group by ``order``, which starts with hash_col.

    A group holds RANGES ranges of the hash; a rank is the count of the ranges before, plus the rank
    in the range. ``places``: the number of groups, which bounds the counts that are broadcast.
    """
    part = df.withColumn("__range", F.shiftrightunsigned(F.col(hash_col), 64 - (RANGES - 1).bit_length()).cast("int"))
    counts = part.groupBy(group, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0).cast("long")).alias("__before"))
    local = F.row_number().over(Window.partitionBy(group, "__range").orderBy(*order)).cast("long") - 1
    ranked = part.withColumn("__local", local).join(F.broadcast(starts), [group, "__range"])  # places * RANGES rows at most
    return ranked.withColumn("rank", F.col("__before") + F.col("__local")).drop("__range", "__local", "__before")


def numbered(rows: DataFrame) -> DataFrame:
    """rows with ``copy``, which numbers equal ones from 0: they are counted (with sums on the map side),
    and written out again a stretch at a time, so that no task holds them all."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    stretches = counted.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(AT_ONCE).cast("long"))))
    return stretches.withColumn("copy", F.explode(F.sequence("__from", F.least(F.col("__n"), F.col("__from") + AT_ONCE) - 1))).drop("__n", "__from")


def shard(df: DataFrame, id_col="doc_id", text_col="text", shards=SHARDS, blocks=BLOCKS, seed=SEED) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot); shard sizes differ by one row at most."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = numbered(df.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    hashed = lambda i: F.xxhash64(F.lit(seed + i), "doc_id", "size", "text_crc32", "copy")
    # Written once: counts and ranks see the same rows, and texts are read once.
    rows = written(rows.select("*", F.pmod(hashed(0), F.lit(blocks)).cast("int").alias("block"), hashed(1).alias("h1"), hashed(2).alias("h2")), "op3-rows")
    # One row: the blocks' counts as an array, and the matrix.
    ids = F.sequence(F.lit(0), F.lit(blocks - 1))
    counts = rows.groupBy("block").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("n"))
    counts = counts.select(F.transform(ids, lambda b: F.coalesce(F.try_element_at("n", b), F.lit(0).cast("long"))).alias("__counts"))
    matrix = counts.select(F.posexplode(communication_matrix("__counts", shards, seed)).alias("block", "gets"))
    # Ranks at which a block's rows go on to the next shard.
    ends = F.transform("gets", lambda _, i: F.aggregate(F.slice("gets", 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select("block", ends.alias("ends"))
    placed = ranks(rows, "block", blocks, ["h1", "doc_id", "text_crc32", "copy"], "h1").join(F.broadcast(matrix), "block")  # a row for each block
    placed = placed.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")).drop("rank", "ends", "block", "h1")
    # Written once, so that counts and ranks of the second permutation see the same exchange.
    placed = written(placed, "op3-exchanged")
    slots = ranks(placed, "shard", shards, ["h2", "doc_id", "text_crc32", "copy"], "h2")
    return slots.select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))


def op3_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
