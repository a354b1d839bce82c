"""BM25 with field weights and an authority factor."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields by number and what an occurrence in each is worth.
FIELDS = {"title": 0, "body": 1, "anchor": 2}
WEIGHTS = {"title": 3.0, "body": 1.0, "anchor": 2.0}


@dataclass(frozen=True)
class Params:
    k1: float = 1.2
    b: float = 0.75
    authority_weight: float = 0.5

    @property
    def is_usable(self) -> bool:
        return all(math.isfinite(x) and x >= 0 for x in (self.k1, self.b, self.authority_weight))

    def checked(self) -> Params:
        if not self.is_usable:
            raise ValueError(f"parameters have to be finite and not negative: {self}")
        return self


def _num(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def idf(total_docs, doc_freq) -> Column:
    n, df = _num(total_docs), _num(doc_freq)
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def length_norm(params: Params, length, average) -> Column:
    return F.lit(1 - params.b) + F.lit(params.b) * _num(length) / F.greatest(_num(average), F.lit(1.0))


def saturation(params: Params, weighted, norm) -> Column:
    w = _num(weighted)
    return F.when(w > 0, w * (params.k1 + 1) / (w + params.k1 * _num(norm))).otherwise(F.lit(0.0))


def authority(params: Params, rank, total_docs) -> Column:
    r = _num(rank)
    return F.when(r > 0, 1 + params.authority_weight * F.log1p(r * _num(total_docs))).otherwise(F.lit(1.0))


def common_params(manifest: DataFrame) -> Params:
    """The parameters that all segments share; differing ones are refused."""
    rows = manifest.select("k1", "b", "authority_weight").distinct().limit(2).collect()
    if len(rows) != 1:
        raise ValueError("segments disagree on their parameters" if rows else "no segments")
    return Params(*rows[0]).checked()
