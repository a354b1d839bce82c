"""Scores of all queries on blocks of documents, inside a Python worker (Q2-Q5, K1).

Matches are never rows of a table: a query's scores on a block are an array, of which only the best are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MATCH = "qid string, shard int, doc_id long, score double"
#: The term of the row that holds a document's authority.
AUTHORITY = -1
#: Postings of a block; they bound a worker's memory.
_ROWS = 1 << 19
#: Locations are document, field and position in one number.
_FIELD, _DOC = 1 << 32, 1 << 39


@dataclass(frozen=True)
class Wanted:
    """Queries as numbers of terms and phrases."""

    qids: list
    ids: dict[str, int]
    phrases: list[tuple[int, ...]]
    phrase_words: frozenset[int]
    #: Of each query: the terms it names, those it excludes, the phrases it needs (None: it has none).
    each: list[tuple[list[int], list[int], list[int] | None]]

    @staticmethod
    def of(rows) -> Wanted:
        """From rows (qid, terms, excluded, phrases); queries that can't match anything are left out."""
        ids: dict[str, int] = {}
        number = lambda term: ids.setdefault(term, len(ids))
        phrases: dict[tuple[int, ...], int] = {}
        qids, each = [], []
        for r in rows:
            wholes = [p for p in r["phrases"] or [] if p]
            words = [t for t in dict.fromkeys([*(r["terms"] or []), *(w for p in wholes for w in p)]) if t is not None]
            excluded = [number(t) for t in set(r["excluded"] or []) if t is not None]
            named = [number(t) for t in words]
            if r["phrases"] and (not wholes or any(None in p for p in wholes)) or not named:
                continue
            needed = {phrases.setdefault(tuple(map(number, p)), len(phrases)) for p in wholes}
            qids.append(r["qid"])
            each.append((named, excluded, sorted(needed) if needed else None))
        return Wanted(qids, ids, list(phrases), frozenset(w for p in phrases for w in p), each)


def _holding(wanted: Wanted, doc, term, fields) -> list:
    """For each phrase the documents that hold it within one field (Q4, J4), ascending."""
    row, entries = pc.list_parent_indices(fields).to_numpy(), pc.list_flatten(fields)
    number, positions = pc.struct_field(entries, "field").to_numpy(), pc.struct_field(entries, "positions")
    entry, pos = pc.list_parent_indices(positions).to_numpy(), pc.list_flatten(positions).to_numpy()
    row, number = row[entry], number[entry]
    where, words = doc[row] * _DOC + number.astype(np.int64) * _FIELD + pos, term[row]
    order = np.lexsort((where, words))
    where, words = where[order], words[order]
    starts = np.searchsorted(words, np.arange(len(wanted.ids) + 1))
    out = []
    for phrase in wanted.phrases:
        places = sorted((where[starts[w] : starts[w + 1]] - i for i, w in enumerate(phrase)), key=len)
        at = places[0]
        for other in places[1:]:
            if len(at):
                at = at[other[np.minimum(np.searchsorted(other, at), len(other) - 1)] == at]
        out.append(np.unique(at // _DOC))
    return out


class _Best:
    """The best ``k`` documents of every query, ties by lowest id; documents are added in ascending order."""

    def __init__(self, wanted: Wanted, k: int, digits: int):
        self.wanted, self.k, self.digits = wanted, k, digits
        self.slack = 2 * 10.0**-digits
        self.kept: dict[int, tuple] = {}  # ids and scores, best first

    def add(self, table) -> None:
        """The rows of whole documents of one shard."""
        ids, doc = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        term, part = table["term"].to_numpy(), table["part"].to_numpy()
        factor = np.ones(len(ids))
        ranked = term == AUTHORITY
        factor[doc[ranked]] = part[ranked]
        holds = []
        if self.wanted.phrases:
            placed = np.flatnonzero(table["fields"].is_valid().to_numpy())
            holds = _holding(self.wanted, doc[placed], term[placed], table["fields"].combine_chunks().take(placed))
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(self.wanted.ids) + 1)).tolist()
        doc, part = doc[order], part[order]
        for q, (named, excluded, phrases) in enumerate(self.wanted.each):
            parts = [slice(starts[t], starts[t + 1]) for t in named if starts[t] < starts[t + 1]]
            if not parts or phrases and not all(len(holds[p]) for p in phrases):
                continue
            found, scores = self._scores([doc[p] for p in parts], [part[p] for p in parts], len(ids))
            for t in excluded:
                gone = doc[starts[t] : starts[t + 1]]
                scores[gone if found is None else np.isin(found, gone)] = 0
            for p in phrases or ():
                also = holds[p] if found is None else np.isin(found, holds[p])
                found, scores = holds[p] if found is None else found[also], scores[also]
            self._keep(q, ids if found is None else ids[found], scores * (factor if found is None else factor[found]))

    @staticmethod
    def _scores(docs, parts, n: int):
        """Sums by document: of all ``n`` (None), or of those found, where they are few."""
        docs, parts = (np.concatenate(x) if len(x) > 1 else x[0] for x in (docs, parts))
        if len(docs) * 16 > n:
            return None, np.bincount(docs, parts, n)
        found, at = np.unique(docs, return_inverse=True)
        return found, np.bincount(at, parts)

    def _keep(self, q: int, ids, scores) -> None:
        old = self.kept.get(q)
        full = old is not None and len(old[0]) == self.k
        least = old[1][-1] if full else 0.0
        over = np.flatnonzero(scores > max(least - self.slack, 0))
        if len(over) > 4 * self.k:
            some = scores[over]
            over = over[some >= np.partition(some, len(some) - self.k)[len(some) - self.k] - self.slack]
        score = np.round(scores[over], self.digits)
        if full:  # an equal score has a higher id
            over, score = over[score > least], score[score > least]
        if len(over):
            doc = ids[over]
            if old is not None:
                doc, score = np.append(old[0], doc), np.append(old[1], score)
            best = np.lexsort((doc, -score))[: self.k]
            self.kept[q] = doc[best], score[best]


def _blocks(batches) -> Iterator:
    """Tables of whole documents of one shard; rows come sorted by shard and document."""
    def parts(table):
        shard = table["shard"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
        return [(int(shard[a]), table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]) if b > a]

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _ROWS:
            table = pa.Table.from_batches(held)
            doc = table["doc_id"].to_numpy()
            other = np.flatnonzero(doc != doc[-1])
            whole = int(other[-1]) + 1 if len(other) else 0  # the last document may go on
            yield from parts(table.slice(0, whole))
            held, n = table.slice(whole).to_batches(), n - whole
    if n:
        yield from parts(pa.Table.from_batches(held))


def matcher(wanted: Wanted, k: int, digits: int):
    """For mapInArrow: rows (doc_id, shard, term, part, fields) sorted by shard and document become MATCH."""

    def matched(batches):
        qids = pa.array(wanted.qids, pa.string())

        def made(shard, best):
            numbers = np.repeat(np.array([*best.kept], np.int64), [len(d) for d, _ in best.kept.values()])
            docs, scores = (np.concatenate([np.empty(0, t), *(x[n] for x in best.kept.values())]) for n, t in enumerate((np.int64, np.float64)))
            return pa.RecordBatch.from_arrays([qids.take(pa.array(numbers)), pa.array(np.full(len(docs), shard, np.int32)), pa.array(docs), pa.array(scores)], names=["qid", "shard", "doc_id", "score"])

        shard, best = None, None
        for at, table in _blocks(batches) if k > 0 else ():
            if best is None or at != shard:
                if best is not None:
                    yield made(shard, best)
                shard, best = at, _Best(wanted, k, digits)
            best.add(table)
        if best is not None:
            yield made(shard, best)

    return matched
