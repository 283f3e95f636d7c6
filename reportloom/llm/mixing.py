"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of documents by a hash of the document's id.  A
source's target gives it whole passes over all its blocks and a rest, which is drawn
from a seeded permutation of its blocks; the last block drawn is cut into blocks again,
by another hash, until it holds no more than ``block_words``, and is then taken document
by document.  The exact number of block draws of each source is then split among the
output shards: a node of the tree hands half of its shards a multivariate
hypergeometric sample of its draws, until every leaf is one shard.  Leaves take
disjoint stretches of a source's permuted draws, and a shard is shuffled locally by a
seeded key.

The driver sees one row per source and block, at most ``max_blocks`` a source and cut,
never a document; the number of cuts grows with the logarithm of the source, and a task
walks documents of ``block_words`` words or a few more.  Everything is a function of the
seed and the rows, so reruns agree.

Defined results: a null text has size 0; sizes of 0 are never drawn; a null source is
a source of its own and comes last; null ids hash like any other value; repeated rows
are drawn together; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .stage import n_words

SALTS = 32
UNIT_SCHEMA = "skey string, block int, shards array<int>, tail_shard int, tail_words double"


def targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Words of each source: shares of all sizes by weight, none above ``cap`` times its size.

    What a capped source cannot take is reshared by weight among the others.
    """
    out = [0.0] * len(sizes)
    free, rest = [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free:
        per = rest / sum(weights[i] for i in free)
        over = [i for i in free if per * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = per * weights[i]
            break
        for i in over:
            out[i] = cap * sizes[i]
            rest -= out[i]
        free = [i for i in free if i not in set(over)]
    return out


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Draws of each source per shard: rows are shards, columns sources, sums are exact."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take, total = int(round(quotas.sum() * left / shards)), int(quotas.sum())
    drawn = np.zeros_like(quotas)
    for i, have in enumerate(quotas):  # one hypergeometric a source, conditioned on those before
        total -= int(have)
        if have and take:
            drawn[i] = rng.hypergeometric(int(have), total, take)
            take -= int(drawn[i])
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def _plan(blocks: dict[str, np.ndarray], goal: dict[str, float], shards: int, seed: int) -> list:
    """One row per block: the shards of its whole draws, and the shard and words of a partial one."""
    rng = np.random.default_rng(seed)
    draws: dict[str, list[tuple[int, bool]]] = {}
    tails: dict[str, float] = {}
    for key in sorted(blocks):
        words = blocks[key]
        size = int(words.sum())
        if not size or not goal[key]:
            continue
        passes = min(math.floor(goal[key] / size), int(goal[key] // size))
        rest = goal[key] - passes * size
        order = rng.permutation(len(words))
        reached = np.cumsum(words[order])
        whole = int(np.searchsorted(reached, rest, side="right"))
        deal = [(int(b), False) for _ in range(passes) for b in rng.permutation(len(words))]
        deal += [(int(b), False) for b in order[:whole]]
        left = rest - (reached[whole - 1] if whole else 0)
        if whole < len(order) and left > 0:
            deal.append((int(order[whole]), True))
            tails[key] = float(left)
        draws[key] = deal
    if not draws:
        return []
    keys = sorted(draws)
    leaves = split_tree(np.array([len(draws[k]) for k in keys], dtype=np.int64), shards, rng)
    plan: dict[tuple[str, int], list] = {}
    for i, key in enumerate(keys):
        owner = np.repeat(np.arange(shards), leaves[:, i])
        for shard, (block, partial) in zip(owner, draws[key]):
            row = plan.setdefault((key, block), [[], None, None])
            if partial:
                row[1], row[2] = int(shard), tails[key]
            else:
                row[0].append(int(shard))
    return [(key, block, *row) for (key, block), row in plan.items()]


def _first_fit(block: pd.DataFrame) -> pd.DataFrame:
    """The last draw of a source: in seeded order, every document that still fits.

    The smallest that does not is taken too where that comes nearer to the target.
    """
    block = block.sort_values(["tie", "id", "size"], kind="stable").reset_index(drop=True)
    left, words = float(block["tail_words"].iloc[0]), block["size"] * block["copies_of"]
    taken = np.zeros(len(block), dtype=bool)
    for i, own in enumerate(words):
        if own <= left:
            left -= own
            taken[i] = True
    if not taken.all():
        least = int(words[~taken].argmin())
        least = words[~taken].index[least]
        taken[least] = words[least] - left < left
    shard = int(block["tail_shard"].iloc[0])
    before = [[] if drawn is None else list(drawn) for drawn in block["shards"]]
    block["shards"] = [drawn + [shard] * int(new) for drawn, new in zip(before, taken)]
    return block


def _cut_again(
    tail: DataFrame, held: dict[str, int], block_words: int, max_blocks: int, seed: int
) -> tuple[DataFrame, dict[str, int]]:
    """The last blocks cut into blocks: those that fit whole are drawn, one is the last block now.

    ``held`` has the words of the last blocks to cut; returned are those of the new ones that
    are smaller.  One that is not holds a single id, which no cut divides.
    """
    spark = tail.sparkSession
    cuts = spark.createDataFrame(
        [(n, min(max_blocks, -(-w // block_words))) for n, w in held.items()], "skey string, parts int"
    )
    part = F.when(F.col("tail_words") > 0, F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts")).cast("int"))
    parted = tail.join(cuts, "skey", "left").withColumn("part", part).drop("parts")
    words = F.sum(F.col("size") * F.col("copies_of")).alias("w")
    found = parted.filter("part IS NOT NULL").groupBy("skey", "part").agg(words, F.max("tail_words").alias("left")).collect()
    rng, fate, last = np.random.default_rng(seed), [], {}
    for n in sorted(held):
        own = sorted((r.part, int(r.w), float(r.left)) for r in found if r.skey == n)
        left, ended = own[0][2], False
        for i in rng.permutation(len(own)):
            number, size, _ = own[i]
            whole = not ended and size <= left
            fate.append((n, number, whole, None if whole or ended else left))
            if whole:
                left -= size
            elif not ended:
                ended = True
                if size < held[n]:
                    last[n] = size
    drawn = spark.createDataFrame(fate, "skey string, part int, whole boolean, rest double")
    before = F.coalesce("shards", F.array().cast("array<int>"))
    out = parted.join(drawn, ["skey", "part"], "left").withColumns(
        {
            "shards": F.when(F.col("whole"), F.concat(before, F.array("tail_shard"))).otherwise(F.col("shards")),
            "tail_words": F.when(F.col("part").isNull(), F.col("tail_words")).otherwise(F.col("rest")),
        }
    )
    return cut(out.select(tail.columns)), last


def draws(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = (1, 2, 3),
    cap: float = 3.0,
    shards: int = 64,
    block_words: int = 20_000,
    max_blocks: int = 1024,
    seed: int = 17,
) -> DataFrame:
    """One row per distinct (id, source, size): ``copies_of`` equal rows, and ``shards``.

    ``shards`` lists the output shard of every draw of the document.  ``weights``
    repeat over the sources in code point order, null last.
    """
    spark = docs.sparkSession
    named = docs.select(
        F.col(key).alias("id"),
        F.col(source).cast("string").alias("source"),
        F.coalesce(n_words() if size is None else size, F.lit(0)).cast("long").alias("size"),
    )
    units = cut(
        named.groupBy("id", "source", "size")
        .agg(F.count("*").alias("copies_of"))
        .withColumn("skey", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("~")))
    )
    # Null last: its key sorts after every "s..." by code point.
    words = F.sum(F.col("size") * F.col("copies_of"))
    totals = {r.skey: int(r.w) for r in units.groupBy("skey").agg(words.alias("w")).collect()}
    names = sorted(totals)
    goal = dict(
        zip(
            names,
            targets([totals[n] for n in names], [weights[i % len(weights)] for i in range(len(names))], cap),
        )
    )
    cuts = {n: max(1, min(max_blocks, -(-totals[n] // block_words))) for n in names}
    facts = spark.createDataFrame(
        [(n, totals[n], goal[n], cuts[n]) for n in names],
        "skey string, source_size long, target double, cuts int",
    )
    # One row a source on one side; salted, since a source may hold most documents.
    salted = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.lit(seed + 3), "id"), F.lit(SALTS)).cast("int")
    placed = units.withColumn("salt", salt).join(salted, ["skey", "salt"]).drop("salt").withColumn(
        "block", F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("cuts")).cast("int")
    )
    sums = {n: np.zeros(cuts[n], dtype=np.int64) for n in names}
    for r in placed.groupBy("skey", "block").agg(words.alias("w")).collect():
        sums[r.skey][r.block] = r.w
    plan = spark.createDataFrame(_plan(sums, goal, shards, seed), UNIT_SCHEMA)
    dealt = placed.join(plan, ["skey", "block"], "left").withColumn(
        "shards",
        F.when(F.col("size") > 0, F.col("shards")).otherwise(F.array().cast("array<int>")),
    )
    # Only the block at which a source's target ends is looked into.
    ending = F.coalesce((F.col("tail_words") > 0) & (F.col("size") > 0), F.lit(False))
    tail = cut(dealt.filter(ending))
    held = {r.skey: int(r.w) for r in tail.groupBy("skey").agg(words.alias("w")).collect()}
    level = 0
    while held := {n: w for n, w in held.items() if w > block_words}:
        level += 1
        tail, held = _cut_again(tail, held, block_words, max_blocks, seed + 16 * level)
    walked = (
        tail.filter(ending)
        .withColumn("tie", F.xxhash64(F.lit(seed + 1), "id"))
        .groupBy("skey", "block")
        .applyInPandas(_first_fit, dealt.withColumn("tie", F.lit(0).cast("long")).schema)
    )
    rest = dealt.filter(~ending).unionByName(tail.filter(~ending))
    kept = ["id", "source", "size", "copies_of", "source_size", "target", "shards"]
    return rest.select(kept).unionByName(walked.select(kept)).withColumn(
        "shards", F.coalesce("shards", F.array().cast("array<int>"))
    )


def mix(docs: DataFrame, *, key: str = "doc_id", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """``docs`` repeated and dropped as drawn, with ``mix_copy``, ``mix_shard`` and ``mix_order``.

    Columns of these three names are replaced.  Write it with
    ``repartition("mix_shard").sortWithinPartitions("mix_shard", "mix_order")`` to have every
    shard shuffled locally.
    """
    own = "mixed"  # the start of no column's name
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    drawn = draws(docs, key=key, source=source, seed=seed, **options).select(
        F.col("id").alias(f"{own}id"), F.col("source").alias(f"{own}source"), F.col("size").alias(f"{own}size"), F.col("shards").alias(f"{own}shards")
    )
    size = options.get("size")
    sized = docs.withColumn(f"{own}words", F.coalesce(n_words() if size is None else size, F.lit(0)).cast("long"))
    same = (
        F.col(f"{own}id").eqNullSafe(F.col(key))
        & F.col(f"{own}source").eqNullSafe(F.col(source).cast("string"))
        & (F.col(f"{own}size") == F.col(f"{own}words"))
    )
    order = F.xxhash64(F.lit(seed + 2), key, f"{own}copy")
    kept = [c for c in docs.columns if c.lower() not in ("mix_copy", "mix_shard", "mix_order")]
    return (
        sized.join(drawn.filter(F.size(f"{own}shards") > 0), same)
        .select(*docs.columns, F.posexplode(f"{own}shards").alias(f"{own}copy", f"{own}shard"))
        .select(*kept, F.col(f"{own}copy").alias("mix_copy"), F.col(f"{own}shard").alias("mix_shard"), order.alias("mix_order"))
    )
