"""Problem 8: filling containers of fixed capacity (minimum bin slack).

Items are spread by hash over windows of about ``window_items`` items.  Within a window the largest
remaining item opens a container and a bitset subset-sum over the remaining lengths finds the multiset
that fills it closest to capacity; the chosen counts are read back from the stages of the bitset, and the
same multiset is used again as long as the lengths last.  A text larger than the container is cut into
full parts and a rest; nothing else is split.

Null and empty texts (no tokens) are left out.  Equal sizes are taken in order of id and part.  Repeated
ids count once with ``unique_ids=False``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnsearch.llm.common import one_row_per_id
from tarnsearch.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from tarnsearch.session import write_shared

WINDOW_ITEMS = 16_384


def fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths that sum up to ``room`` or as little below it as possible."""
    reach, full = 1, (1 << (room + 1)) - 1
    stages: list[tuple[int, int, int]] = []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left > 0:
            n = min(step, left)
            stages.append((reach, length, n))
            reach |= (reach << (length * n)) & full
            left -= n
            step *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {}
    for before, length, n in reversed(stages):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + n
            at -= length * n
    return chosen


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers; every size is between 1 and ``capacity``."""
    items: dict[int, list[int]] = defaultdict(list)
    for i in range(len(sizes) - 1, -1, -1):
        items[sizes[i]].append(i)
    counts = {s: len(x) for s, x in items.items()}
    bins = []
    for largest in sorted(counts, reverse=True):
        while counts[largest]:
            counts[largest] -= 1
            chosen = fill(counts, capacity - largest)
            counts[largest] += 1
            chosen[largest] = chosen.get(largest, 0) + 1
            for _ in range(min(counts[s] // n for s, n in chosen.items())):
                bins.append([items[s].pop() for s in sorted(chosen, reverse=True) for _ in range(chosen[s])])
                for s, n in chosen.items():
                    counts[s] -= n
    return bins


def packed(docs: DataFrame, containers: DataFrame, id_col="doc_id", text_col="text", *, vocabulary=f"{TOKENIZERS}/{VOCABULARY}", window_items=WINDOW_ITEMS, unique_ids=False) -> DataFrame:
    """(container, bin, position, doc_id, part, first_token, tokens): bin numbers a container of its kind, position counts from 0."""
    import pandas as pd

    sizes = write_shared(token_counts(one_row_per_id(docs, id_col, unique_ids), text_col, {id_col: "long"}, vocabulary).where("tokens > 0"), "token-sizes").withColumnRenamed(id_col, "doc_id")
    kinds = [(r[0], int(r[1])) for r in containers.where("container is not null and capacity_tokens > 0").select("container", "capacity_tokens").distinct().collect()]
    if not kinds:
        return docs.sparkSession.createDataFrame([], "container string, bin long, position int, doc_id long, part int, first_token long, tokens int")
    spec = F.explode(F.array(*[F.struct(F.lit(n).alias("container"), F.lit(c).cast("long").alias("capacity")) for n, c in kinds])).alias("k")
    parts = sizes.select("doc_id", "tokens", spec).select("doc_id", "tokens", "k.*").withColumn("part", F.explode(F.sequence(F.lit(0), F.expr("cast((tokens - 1) div capacity as int)"))))
    parts = parts.select("container", "capacity", "doc_id", "part", F.least(F.col("capacity"), F.col("tokens") - F.col("part") * F.col("capacity")).cast("int").alias("tokens"))
    windows = {r[0]: max(1, -(-r[1] // window_items)) for r in parts.groupBy("container").count().collect()}
    per_kind = F.coalesce(*[F.when(F.col("container") == n, F.lit(w)) for n, w in windows.items()]) if windows else F.lit(1)
    keyed = parts.withColumn("window", F.pmod(F.xxhash64("doc_id", "part"), per_kind))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], ignore_index=True)
        capacity, window, name = int(pdf["capacity"].iloc[0]), int(pdf["window"].iloc[0]), pdf["container"].iloc[0]
        bins = pack(pdf["tokens"].tolist(), capacity)
        order = [i for b in bins for i in b]
        out = pdf.iloc[order]
        return pd.DataFrame(
            {
                "container": name,
                "bin": [(window << 24) + n for n, b in enumerate(bins) for _ in b],
                "position": [p for b in bins for p in range(len(b))],
                "doc_id": out["doc_id"].to_numpy(),
                "part": out["part"].to_numpy(),
                "first_token": out["part"].to_numpy().astype("int64") * capacity,
                "tokens": out["tokens"].to_numpy(),
            }
        )

    return keyed.groupBy("container", "window").applyInPandas(run, "container string, bin long, position int, doc_id long, part int, first_token long, tokens int")


def fill_report(placed: DataFrame, containers: DataFrame) -> DataFrame:
    """(container, bins, items, tokens, fill): share of the capacity that is used."""
    sums = placed.groupBy("container").agg(F.count_distinct("bin").alias("bins"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"))
    return sums.join(F.broadcast(containers.select("container", "capacity_tokens").distinct()), "container").select("container", "bins", "items", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill"))
