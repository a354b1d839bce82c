"""Problem 9: mixing sources to target shares of the total size in tokens.

The total is the largest that every source can give its share of with ``max_repeats`` uses of a document.
A source gives whole passes and a part of one more.  Its documents lie in at most ``BLOCKS`` hash blocks of
sub-blocks of about ``DOCS_PER_BLOCK`` documents.  Block quotas are split exactly over groups of output shards
by a tree of multivariate hypergeometric draws on the driver; sub-blocks are split in the same way over the
shards of their group, each group in its own task.  Blocks are drawn without overlap in a permuted order, and
each shard is shuffled by hash.  The last block of a partial pass is cut at the sub-block, and within it at the
document, that meets the quota, so a share is off by less than one document per source.

Source labels are compared trimmed, in lower case, with blanks and dashes as underscores.  Documents with
null text, no tokens, or a source without target are not used; a target without documents is reported
with share 0.  Repeated ids count once with ``unique_ids=False``.  Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnsearch.llm.common import one_row_per_id, small_side
from tarnsearch.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from tarnsearch.session import write_shared

#: Blocks of one source and groups of shards that the driver plans; documents of a sub-block and of a shard.  A larger
#: table has more sub-blocks and shards, of the same size.
BLOCKS, GROUPS, DOCS_PER_BLOCK, DOCS_PER_SHARD = 1024, 256, 16, 200_000


def label(col: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")


def split_tree(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Blocks of each source (columns) for each shard (rows); every split is one multivariate hypergeometric draw."""
    if shards == 1:
        return quotas[None, :]
    left = shards // 2
    take = int(quotas.sum()) * left // shards
    drawn = rng.multivariate_hypergeometric(quotas, take, method="marginals")
    return np.vstack([split_tree(drawn, left, rng), split_tree(quotas - drawn, shards - left, rng)])


def quotas(totals: dict[str, int], targets: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Tokens of each source at the largest total that all sources with documents can reach."""
    usable = {s: t for s, (t, m) in targets.items() if totals.get(s) and t > 0 and m > 0}
    if not usable:
        return {}
    whole = min(targets[s][1] * totals[s] / t for s, t in usable.items())
    return {s: whole * t for s, t in usable.items()}


def mixture(docs: DataFrame, target: DataFrame, id_col="doc_id", text_col="text", source_col="source", *, vocabulary=f"{TOKENIZERS}/{VOCABULARY}", shards: int | None = None, seed=17, unique_ids=False) -> DataFrame:
    """(shard, position, doc_id, source, use_no, tokens): one row per use of a document."""
    spark = docs.sparkSession
    empty = "shard int, position int, doc_id long, source string, use_no int, tokens long"
    goal = {r[0]: (float(r[1]), int(r[2])) for r in target.where("source is not null and target_share is not null and max_repeats is not null").select(label(F.col("source")), "target_share", "max_repeats").collect()}
    named = one_row_per_id(docs, id_col, unique_ids).withColumn("_source", label(F.col(source_col))).where(F.col("_source").isin(list(goal)))
    sized = write_shared(token_counts(named, text_col, {id_col: "long", "_source": "string"}, vocabulary).where("tokens > 0").withColumnsRenamed({id_col: "doc_id", "_source": "source"}), "mix-sizes")
    have = {r["source"]: (int(r["tokens"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    quota = quotas({s: t for s, (t, _) in have.items()}, goal)
    if not quota:
        return spark.createDataFrame([], empty)
    n_blocks = {s: int(min(BLOCKS, max(1, have[s][1] // DOCS_PER_BLOCK))) for s in quota}
    n_subs = {s: int(max(1, have[s][1] // (n_blocks[s] * DOCS_PER_BLOCK))) for s in quota}
    per_source = lambda numbers: F.coalesce(*[F.when(F.col("source") == s, F.lit(n)) for s, n in numbers.items()])
    placed = sized.where(F.col("source").isin(list(quota))).withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed)), per_source(n_blocks)).cast("int"))
    placed = placed.withColumn("sub", F.pmod(F.xxhash64("doc_id", F.lit(seed + 3)), per_source(n_subs)).cast("int"))
    # at most BLOCKS rows per source
    sums: dict[str, dict[int, int]] = {s: {} for s in quota}
    for r in placed.groupBy("source", "block").agg(F.sum("tokens").alias("t")).collect():
        sums[r["source"]][r["block"]] = int(r["t"])
    rng = np.random.default_rng(seed)
    names = sorted(quota)
    uses: dict[str, list[tuple[int, int, float]]] = {}
    for s in names:
        passes = min(goal[s][1], int(quota[s] // have[s][0] + 1e-9))
        whole = [(b, u, np.inf) for u in range(1, passes + 1) for b in sorted(sums[s])]
        rest = quota[s] - passes * have[s][0]
        if rest >= 1 and passes < goal[s][1]:
            for b in rng.permutation(sorted(sums[s])):
                whole.append((int(b), passes + 1, np.inf if sums[s][b] <= rest else float(rest)))
                rest -= sums[s][b]
                if rest < 1:
                    break
        uses[s] = whole
    total_docs = sum(quota[s] / have[s][0] * have[s][1] for s in names)
    shards = shards or max(8, int(total_docs // DOCS_PER_SHARD))
    groups = min(shards, GROUPS)
    inner = -(-shards // groups)  # shards of a group
    per_shard = split_tree(np.array([len(uses[s]) for s in names], np.int64), groups, rng)
    plan = []
    for j, s in enumerate(names):
        order, at = rng.permutation(len(uses[s])), 0
        for g in range(groups):
            for k in order[at : at + per_shard[g, j]]:
                b, u, cap = uses[s][k]
                plan.append((s, b, u, g, None if np.isinf(cap) else cap))
            at += per_shard[g, j]
    # at most BLOCKS x max_repeats rows per source
    chosen = spark.createDataFrame(plan, "source string, block int, use_no int, grp int, cap double")
    drawn = placed.join(small_side(chosen, len(plan)), ["source", "block"])
    # one block of a source is cut: whole sub-blocks up to the one that crosses the quota, and there by document
    part = drawn.where("cap is not null")
    part_keys = ["source", "block", "use_no"]
    subs = part.groupBy(*part_keys, "sub").agg(F.sum("tokens").alias("_t"))
    before = Window.partitionBy(*part_keys).orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    subs = subs.withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    running = Window.partitionBy(*part_keys, "sub").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the document that crosses the quota stays when more than half of it is within
    summed = part.join(subs, [*part_keys, "sub"]).withColumn("_sum", F.col("_before") + F.sum("tokens").over(running))
    cut = summed.where(F.col("_sum") - F.col("tokens") / 2 <= F.col("cap")).drop("_sum", "_before")
    every = drawn.where("cap is null").unionByName(cut)
    if inner == 1:
        every = every.withColumn("shard", F.col("grp"))
    else:
        keys = ["grp", *part_keys, "sub"]
        every = every.join(_spread_group(every.select(keys).distinct(), keys, inner, seed), keys)
    shuffled = Window.partitionBy("shard").orderBy(F.xxhash64("doc_id", "use_no", F.lit(seed + 2)), "doc_id", "use_no")
    return every.withColumn("position", F.row_number().over(shuffled) - 1).select("shard", "position", "doc_id", "source", "use_no", "tokens")


def _spread_group(subs: DataFrame, keys: list[str], inner: int, seed: int) -> DataFrame:
    """Shard of every drawn sub-block: the tree again, over the ``inner`` shards of each group."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values(keys, ignore_index=True)
        rng = np.random.default_rng((seed, group))
        names, held = np.unique(pdf["source"].to_numpy(dtype=str), return_counts=True)
        counts = split_tree(held.astype(np.int64), inner, rng)
        shard = np.zeros(len(pdf), np.int64)
        for j, name in enumerate(names):
            mine = np.flatnonzero(pdf["source"].to_numpy(dtype=str) == name)
            shard[rng.permutation(mine)] = np.repeat(np.arange(inner), counts[:, j])
        return pdf.assign(shard=(group * inner + shard).astype("int32"))

    return subs.groupBy("grp").applyInPandas(run, "grp int, source string, block int, use_no int, sub int, shard int")


def document_uses(mixed: DataFrame) -> DataFrame:
    return mixed.groupBy("doc_id", "source").agg(F.count("*").cast("int").alias("uses"), F.max("tokens").alias("tokens"))


def share_report(mixed: DataFrame, target: DataFrame) -> DataFrame:
    """(source, target_share, documents, uses, tokens, actual_share, most_uses) for every target."""
    per_doc = document_uses(mixed)
    per = per_doc.groupBy("source").agg(F.count("*").alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"), F.max("uses").alias("most_uses"))
    goals = F.broadcast(target.where("source is not null").select(label(F.col("source")).alias("source"), "target_share"))
    joined = goals.join(per, "source", "left").fillna(0, ["documents", "uses", "tokens", "most_uses"])
    share = F.col("tokens") / F.sum("tokens").over(Window.partitionBy())  # one row per target
    return joined.withColumn("actual_share", F.round(F.coalesce(share, F.lit(0.0)), 6))
