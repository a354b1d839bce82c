"""Problem 6: records that share most of their word shingles.

Minima of many universal hashes over the distinct shingles of a text are cut into bands; texts that
agree in a whole band are candidates.  A byte of each of some minima is kept as signature and checks the
candidates; what is left is compared exactly on the shingles.  Classes come from the pairs by
alternating large-star and small-star.  Exact copies (equal shingle sets) are folded into one
representative before banding, so a group of copies never meets itself.

With four rows in 96 bands a pair at similarity 0.5 is missed with probability 0.002, at 0.6 with
1.7e-6.  Pairs (:func:`similar_pairs`) are all pairs of similar texts, so their number grows with the square
of a family of edited versions; a bucket of more than ``bucket_rows`` texts is cut into blocks by hash of the
id that meet in separate tasks, and nothing is dropped.  Classes (:func:`similar_groups`) need no pairs within
a class: in a bucket the least text meets the others, and then only texts of different classes meet
(:func:`star_links`).

Nulls and texts shorter than a shingle have no pairs and form classes of their own.  Repeated ids count
once with ``unique_ids=False``; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnsearch.functions.text import py_terms
from tarnsearch.llm.common import one_row_per_id, small_side
from tarnsearch.session import write_shared

BANDS, BAND_ROWS, SIGNATURE = 96, 4, 192

#: A link at similarity 0.8 fails the signature check with probability 1.4e-8 (2.5e-4 at 3.6).
LINK_DEVIATIONS = 6.0


class _Hashes(dict):
    """Hash of each term, remembered in a bounded table."""

    most = 500_000

    def __init__(self):
        import xxhash

        self.hash = xxhash.xxh3_64_intdigest

    def __missing__(self, term: str) -> int:
        h = self[term] = self.hash(term)
        return h


class Shingler:
    """64-bit hashes of the distinct runs of ``width`` terms of a text."""

    def __init__(self, width: int):
        self.width, self.known = width, _Hashes()
        self.hash = self.known.hash
        self.odd = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]

    def __call__(self, text: str | None) -> np.ndarray:
        terms = py_terms(text) if text else []
        n = len(terms) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > known.most:
            known.clear()
        h = np.fromiter(map(known.__getitem__, terms), np.uint64, len(terms))
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(self.width):
                out = (out ^ h[i : i + n]) * self.odd[i % 5]
                out ^= out >> np.uint64(31)
        return np.unique(out)


def _families(bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    n = bands * rows
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _sketcher(width: int, bands: int, rows: int, signature: int, seed: int):
    def sketch(batches):
        shingles = Shingler(width)
        a, b = _families(bands, rows, seed)
        mixer = np.random.default_rng(seed + 1).integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            ids, n_shingles, digests, sigs, keys = [], [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingles(text)
                if not len(s):
                    continue
                with np.errstate(over="ignore"):
                    # 32 bits are enough for minima, and twice as many fit a register
                    short = (s ^ (s >> np.uint64(32))).astype(np.uint32)
                    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
                    for at in range(0, len(s), 512):  # whole texts, in blocks that stay in the cache
                        low = np.minimum(low, (short[at : at + 512, None] * a + b).min(axis=0))
                    key = (low.reshape(bands, rows) * mixer).sum(axis=1)
                    key ^= key >> np.uint64(29)
                ids.append(i)
                n_shingles.append(len(s))
                digests.append(shingles.hash(s.tobytes()) & 0x7FFFFFFFFFFFFFFF)
                sigs.append(low[:signature].astype(np.uint8).tobytes())
                keys.append(key.view(np.int64))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * bands), pa.array(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_shingles, pa.int32()), pa.array(digests, pa.int64()), pa.array(sigs, pa.binary()), lists], names=["id", "n", "digest", "signature", "bands"])

    return sketch


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, signature: int, seed: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("digest", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_sketcher(width, bands, rows, signature, seed), schema)


def candidate_pairs(reps: DataFrame, bucket_rows: int) -> DataFrame:
    """(a, b) with a < b that agree in a band.

    Buckets are small once copies are folded.  A bucket of more than ``bucket_rows`` texts is cut into
    blocks by hash of the id, and every block meets every later block in a task of its own: all of its
    pairs are still made, but no task holds the bucket.
    """
    return _bucket_pairs(reps.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("key")), bucket_rows)


def _bucket_pairs(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"))
    large = write_shared(buckets.where(F.col("m") > bucket_rows), "large-buckets")
    n_large = large.count()
    rest = keyed.join(small_side(large.select("key"), n_large), "key", "left_anti") if n_large else keyed
    grouped = rest.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)

    def pairs_of(batches):
        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            left, right = [], []
            for s, e in zip(offsets[:-1], offsets[1:]):
                i, j = np.triu_indices(e - s, 1)
                left.append(flat[s + i])
                right.append(flat[s + j])
            l, r = (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64),) * 2
            both = np.unique(np.stack([l, r]), axis=1) if len(l) else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    pairs = grouped.select("ids").mapInArrow(pairs_of, "a long, b long")
    if n_large:
        block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("blocks")).cast("int")
        members = keyed.join(small_side(large, n_large), "key").withColumn("blocks", F.ceil(F.col("m") / bucket_rows).cast("int")).withColumn("block", block)
        later = F.explode(F.sequence(F.lit(0), F.col("block")))
        left = members.select("key", F.col("id").alias("x"), F.col("block").alias("bx"), F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("by"))
        right = members.select("key", F.col("id").alias("y"), F.col("block").alias("by"), later.alias("bx"))
        met = left.join(right, ["key", "bx", "by"]).where((F.col("bx") != F.col("by")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y")))
        pairs = pairs.unionByName(met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.distinct()


def _pairs_across(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    """(a, b) with a < b that share a ``key`` and differ in ``c``; work and rows grow with these pairs, not with all of a bucket.

    In a bucket of more than ``bucket_rows`` texts, those outside its largest class meet all others, both cut into
    blocks by hash of the id, and every two blocks meet in a task of their own.
    """
    buckets = keyed.groupBy("key").agg(F.count("*").alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key", "m")
    mixed = write_shared(keyed.join(buckets, "key"), "mixed-buckets")
    grouped = mixed.where(F.col("m") <= bucket_rows).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("c", "id"))).alias("texts"))

    def met(left, right):
        l, r = np.concatenate(left), np.concatenate(right)
        both = np.unique(np.stack([np.minimum(l, r), np.maximum(l, r)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    def pairs_of(batches):
        for batch in batches:
            lists = batch.column(0)
            classes, ids = (x.to_numpy() for x in lists.flatten().flatten())
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            left, right, held = [], [], 0
            for s, e in zip(offsets[:-1], offsets[1:]):
                after = np.searchsorted(classes[s:e], classes[s:e], "right")  # each text meets the classes after its own
                many = (e - s) - after
                left.append(np.repeat(ids[s:e], many))
                right.append(ids[s + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(after, many)])
                held += len(left[-1])
                if held > 1_000_000:
                    yield met(left, right)
                    left, right, held = [], [], 0
            if held:
                yield met(left, right)

    pairs = grouped.select("texts").mapInArrow(pairs_of, "a long, b long")
    large = mixed.where(F.col("m") > bucket_rows)
    if large.limit(1).count():
        sizes = large.groupBy("key", "c", "m").agg(F.count("*").alias("n"))
        main = sizes.groupBy("key", "m").agg(F.max(F.struct("n", "c")).alias("most"))
        blocks = lambda rows: F.ceil(rows / bucket_rows).cast("int")
        cut = main.select("key", F.col("most.c").alias("main"), blocks(F.col("m") - F.col("most.n")).alias("nx"), blocks(F.col("m")).alias("ny"))
        members = large.join(cut, "key")
        block = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
        left = members.where("c != main").select("key", F.col("id").alias("x"), F.col("c").alias("cx"), block(3, "nx").alias("bx"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("by"))
        right = members.select("key", F.col("id").alias("y"), F.col("c").alias("cy"), "main", block(5, "ny").alias("by"), F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("bx"))
        across = left.join(right, ["key", "bx", "by"]).where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))))
        pairs = pairs.unionByName(across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
    return pairs.distinct()


def _check_signatures(least: float):
    def check(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1)
                y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return check


def _compare(width: int):
    def compare(batches):
        shingles = Shingler(width)
        for batch in batches:
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                p, q = shingles(x), shingles(y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                out.append(common / max(1, len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return compare


def _folded(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int, signature: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of one representative per shingle set, and (id, rep) of every text that has shingles."""
    table = write_shared(sketches(docs, id_col, text_col, width, bands, rows, signature, seed), "sketches")
    first = table.groupBy("digest", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    repeated = write_shared(first.where("copies > 1"), "repeated-texts")
    n_repeated = repeated.count()
    members = table.select("id", "digest", "n").join(small_side(repeated.select("digest", "n", "rep"), n_repeated), ["digest", "n"], "left").select("id", F.coalesce("rep", "id").alias("rep"))
    copies = members.where("id != rep").select("id")
    return table.join(small_side(copies, n_repeated), "id", "left_anti") if n_repeated else table, members


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, signature: int, deviations: float = 3.6) -> DataFrame:
    """(a, b, similarity) of the candidates at or above ``similarity``: by signature, ``deviations`` below it, then exactly."""
    sigs = reps.select("id", "signature")
    checked = pairs.join(sigs.withColumnsRenamed({"id": "a", "signature": "sa"}), "a").join(sigs.withColumnsRenamed({"id": "b", "signature": "sb"}), "b")
    margin = deviations * float(np.sqrt(similarity * (1 - similarity) / signature))
    likely = write_shared(checked.select("a", "b", "sa", "sb").mapInArrow(_check_signatures(similarity - margin), "a long, b long"), "likely-pairs")
    involved = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(small_side(involved, 2 * likely.count()), "id", "left_semi")
    both = likely.join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").join(texts.withColumnsRenamed({"id": "b", "text": "tb"}), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(_compare(width), "a long, b long, similarity double").where(F.col("similarity") >= similarity)


def similar_classes(docs: DataFrame, id_col="doc_id", text_col="body", *, width=5, similarity=0.8, bands=BANDS, rows=BAND_ROWS, signature=SIGNATURE, bucket_rows=2000, seed=11, unique_ids=False) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a, b, similarity) at or above ``similarity``, and copies (id, rep) of every text that has shingles."""
    docs = one_row_per_id(docs, id_col, unique_ids)
    reps, members = _folded(docs, id_col, text_col, width, bands, rows, signature, seed)
    pairs = candidate_pairs(reps.select("id", "bands"), bucket_rows)
    return _verified(pairs, reps, docs, id_col, text_col, width, similarity, signature), members


def star_links(docs: DataFrame, id_col="doc_id", text_col="body", *, width=5, similarity=0.8, bands=BANDS, rows=BAND_ROWS, signature=SIGNATURE, bucket_rows=2000, seed=11, rounds=4, unique_ids=False) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that hold the classes together, and copies (id, rep); grows with the texts, not with the pairs of a class.

    In every bucket the least id meets the others.  Who isn't similar to it stays in the bucket for the next
    round, where the least of these meets the rest.  That leaves out pairs of texts that went in different
    rounds, so after ``rounds`` every two texts of a bucket that the links don't connect are paired.  What
    remains unmet is connected already: the links have the classes of all similar candidates.
    """
    docs = one_row_per_id(docs, id_col, unique_ids)
    reps, members = _folded(docs, id_col, text_col, width, bands, rows, signature, seed)
    waiting = reps.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("key"))
    found, known, shared = None, None, None
    for _ in range(rounds):
        leaders = waiting.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("m")).where("m > 1").drop("m")
        met = write_shared(waiting.join(leaders, "key").where("id != a").select("key", "a", F.col("id").alias("b")), "stars")
        if not met.limit(1).count():
            break
        if shared is None:  # the buckets that hold more than one text
            shared = met.select("key", F.col("b").alias("id")).unionByName(met.select("key", F.col("a").alias("id")).distinct())
        fresh = met.select("a", "b").distinct()
        if known is not None:
            fresh = fresh.join(known, ["a", "b"], "left_anti")
        fresh = write_shared(fresh, "star-pairs")
        if fresh.limit(1).count():
            links = write_shared(_verified(fresh, reps, docs, id_col, text_col, width, similarity, signature, LINK_DEVIATIONS).select("a", "b"), "star-links")
            found = links if found is None else found.unionByName(links)
            known = fresh if known is None else known.unionByName(fresh)
        waiting = write_shared(met.join(found, ["a", "b"], "left_anti").select(F.col("b").alias("id"), "key"), "waiting")
    if found is None:
        return members.where("false").select(F.col("id").alias("a"), F.col("rep").alias("b")), members
    linked = shared.join(connected_components(found), "id", "left").select("id", "key", F.coalesce("component", "id").alias("c"))
    rest = write_shared(_pairs_across(linked, bucket_rows).join(known, ["a", "b"], "left_anti"), "pairs-across")
    if rest.limit(1).count():
        found = found.unionByName(_verified(rest, reps, docs, id_col, text_col, width, similarity, signature, LINK_DEVIATIONS).select("a", "b"))
    return found, members


def similar_pairs(docs: DataFrame, id_col="doc_id", text_col="body", **options) -> DataFrame:
    """(doc_a, doc_b, similarity) with doc_a < doc_b.

    Every similar pair of different texts.  A group of exact copies is not multiplied out: its least id
    stands for it and is paired with each copy at similarity 1.
    """
    pairs, members = similar_classes(docs, id_col, text_col, **options)
    copies = members.where("id != rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "similarity")


def connected_components(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """(id, component): the least id reachable from each end of ``pairs``, by alternating large-star and small-star.

    Every round is written to the shared folder; a star keeps only edges to the least neighbour, so no
    node's neighbourhood is collected: its minimum is a plain aggregate.
    """
    edges = write_shared(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_from = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        least = small_from.groupBy("u").agg(F.min("v").alias("m"))
        linked = small_from.join(least, "u")
        edges = write_shared(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("the components have not settled")
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    return roots.unionByName(roots.select(F.col("component").alias("id"), "component").distinct())


def similar_groups(docs: DataFrame, id_col="doc_id", text_col="body", **options) -> DataFrame:
    """(doc_id, class_id, class_size): one row per document; the class is what links of similar texts and copies connect."""
    links, members = star_links(docs, id_col, text_col, **options)
    classes = connected_components(links).withColumnRenamed("id", "rep")
    ids = one_row_per_id(docs, id_col, options.get("unique_ids", False)).select(F.col(id_col).cast("long").alias("id"))
    known = members.join(classes, "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    placed = write_shared(ids.join(known, "id", "left").select(F.col("id").alias("doc_id"), F.coalesce("class_id", "id").alias("class_id")), "classes")
    sizes = placed.groupBy("class_id").agg(F.count("*").alias("class_size"))
    return placed.join(sizes, "class_id").select("doc_id", "class_id", "class_size")
