"""Near duplicates by SimHash and exact likeness of word shingles.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is at
least 0.8.  Copies meet by a digest first, so a text is worked on once.  Then three
rounds look for links, each among texts that the rounds before have not put into one
component, and each holds its pairs against the exact similarity:

1. the bit-sliced SimHash comparison, over fingerprints of the five-word shingles;
2. in each bucket of texts that share a shingle of their prefixes, everybody with the
   bucket's smallest id;
3. all pairs of a bucket whose sizes and folded parities allow the similarity.

Buckets are those of a prefix filter: sets that are alike share a shingle among the first
n - ceil(0.8 n) + 1 of each, under any order of all shingles, so no link is lost.  The
order is by hash, with the shingles that crowd the prefixes most last.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, drop_shuffle_files, materialise, parallelism, session
from .components import components
from .simhash_dedup import SEED, links, simhash_of

WIDTH, PERCENT, RADIUS = 5, 80, 3
#: A shingle in more prefixes than this is put behind the others, the most crowded so many.
CROWDED, MOST_CROWDED = 100, 65_536
#: Ids that are broadcast, 8 bytes each, at most.
SMALL_TABLE_ROWS = 1_000_000
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Parities that a bucket's rows carry, in bits.
FOLD = 512


def shingle_hashes(text: str, width: int = WIDTH) -> np.ndarray:
    """Hashes of the word shingles in order: words as in the SimHash operator, each
    hashed once, the hashes of a shingle's words combined by place.  A text with fewer
    words is one shingle, one without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(SEED)), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(h))):
        out = (out ^ (out >> np.uint64(29))) * ODD + h[k : k + n]
    out ^= out >> np.uint64(32)
    return out * ODD


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """Ascending hashes of the distinct shingles."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def prefix(hashes: np.ndarray, crowded: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first shingles of a set: one of them is shared with any set alike."""
    n = len(hashes)
    last = np.isin(hashes, crowded)
    return np.concatenate([hashes[~last], hashes[last]])[: n - -(-percent * n // 100) + 1]


def parities(hashes: np.ndarray, size: int | None = None) -> np.ndarray:
    """For each value of the hashes' last bits, whether an odd number of the set's
    hashes have it: bits, twice to four times as many as hashes by default."""
    size = size or max(64, 1 << (2 * len(hashes)).bit_length())
    return np.packbits(np.bincount(hashes.view(np.uint64) & np.uint64(size - 1), minlength=size).astype(np.uint8) & 1, bitorder="little")


def least_apart(a: bytes, b: bytes) -> int:
    """Hashes that are in one of two sets only, at least: their parities differ at a
    place only if some are there.  The longer bits are folded to the shorter's length."""
    few, many = sorted((np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)), key=len)
    many = np.bitwise_xor.reduce(many.reshape(-1, len(few)))
    return int(np.bitwise_count(few ^ many).sum())


def alike(s: np.ndarray, t: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether the sets are so alike; empty ones are."""
    both = len(s) + len(t) - len(np.union1d(s, t))
    return 100 * both >= percent * (len(s) + len(t) - both)


def _texts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row per distinct text: digest, id (the smallest), n, fp, prefix, odd, fold, text."""
    text = F.coalesce("text", F.lit(""))
    told = docs.select(F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    distinct = told.groupBy("digest").agg(F.min("id").alias("id"), F.first("text").alias("text"))
    none = np.zeros(0, np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fps, firsts, odd, fold = [], [], [none], [], []
            for x in batch.column(2).to_pylist():
                h = shingle_hashes(x, width)
                s = np.unique(h).view(np.int64)
                sizes.append(len(s))
                fps.append(simhash_of(h))
                firsts.append(prefix(s, none, percent) if len(s) else none)
                odd.append(parities(s).tobytes())
                fold.append(parities(s, FOLD).tobytes())
            ends = np.cumsum([0, *map(len, firsts[1:])])
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.binary()), batch.column(1), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(firsts))), pa.array(odd, pa.binary()), pa.array(fold, pa.binary()), batch.column(2)],
                ["digest", "id", "n", "fp", "prefix", "odd", "fold", "text"])

    return materialise(distinct.mapInArrow(mark, "digest binary, id long, n long, fp long, prefix array<long>, odd binary, fold binary, text string"), "texts")


def _prefixes(texts: DataFrame, crowded: np.ndarray, width: int, percent: int) -> DataFrame:
    """(h, n, id): the prefixes, the crowded shingles (ascending) last."""
    none = np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            firsts = []
            for plain, text in zip(batch.column(2), batch.column(3), strict=True):
                got = plain.values.to_numpy()
                # Without a crowded shingle in it a prefix is the same in both orders.
                firsts.append(prefix(shingle_set(text.as_py(), width), crowded, percent) if np.isin(got, crowded).any() else got)
            many = [len(f) for f in firsts]
            cols = [np.concatenate([none, *firsts]), np.repeat(batch.column(0).to_numpy(), many), np.repeat(batch.column(1).to_numpy(), many)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["h", "n", "id"])

    return texts.select("n", "id", "prefix", "text").where("n > 0").mapInArrow(run, "h long, n long, id long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int, name: str) -> DataFrame | None:
    """(a, b): the pairs (x, y) of ids whose exact similarity suffices; None without any.  Few pairs have
    their texts compared: the others' parities show that too many shingles differ."""
    pairs = materialise(pairs, f"{name}-pairs")
    if not pairs.limit(1).count():
        return None
    side = lambda x: texts.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("odd").alias(f"odd_{x}")).hint("merge")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, one, two = (c.to_pylist() for c in batch.columns[2:])
            keep = [least_apart(a, b) * (100 + percent) <= (i + j) * (100 - percent) for i, j, a, b in zip(n, m, one, two, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    weighed = pairs.join(side("y"), "y").join(side("x"), "x").select("x", "y", "n_x", "n_y", "odd_x", "odd_y")
    every, pairs = pairs, materialise(weighed.mapInArrow(near, "x long, y long").distinct(), f"{name}-near")
    discard(every)
    if not pairs.limit(1).count():
        return None
    ids = materialise(pairs.select(F.inline(F.array(F.struct(F.col("x").alias("i")), F.struct(F.col("y").alias("i"))))).distinct(), f"{name}-ids")
    few = F.broadcast(ids) if ids.count() <= SMALL_TABLE_ROWS else ids
    mine = texts.join(few, texts["id"] == F.col("i"), "left_semi").select("id", "text")
    right = pairs.join(mine.select(F.col("id").alias("y"), F.col("text").alias("right")).hint("merge"), "y")
    both = right.join(mine.select(F.col("id").alias("x"), F.col("text").alias("left")).hint("merge"), "x").select("x", "y", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, None
        for batch in batches:
            keep = []
            for left, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if left != last:  # pairs come in the order of their first text
                    last, s = left, shingle_set(left, width)
                keep.append(alike(s, shingle_set(right, width), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    found = materialise(both.mapInArrow(run, "a long, b long"), name)
    discard(pairs, ids)
    return found


def _pairs_apart(rows: DataFrame, percent: int) -> DataFrame:
    """(x, y): pairs of a bucket in different components whose sizes and folded parities
    allow the similarity.  ``rows`` has (h, n, id, root, fold)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: np.ndarray, folds: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
            for group, fold in zip(np.split(rows, cuts), np.split(folds, cuts), strict=True):
                n, ids, root = group[:, 1], group[:, 2], group[:, 3]
                if (root == root[0]).all():
                    continue
                ends = np.searchsorted(n, n * 100 // percent, "right")
                for i, end in enumerate(ends.tolist()):
                    apart = np.bitwise_count(fold[i + 1 : end] ^ fold[i]).sum(1, dtype=np.int64)
                    other = ids[i + 1 : end][(root[i + 1 : end] != root[i]) & (apart * (100 + percent) <= (n[i + 1 : end] + n[i]) * (100 - percent))]
                    if len(other):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ids[i])), pa.array(np.maximum(other, ids[i]))], ["x", "y"])

        rest, folds = np.zeros((0, 4), np.int64), np.zeros((0, FOLD // 64), np.uint64)
        for batch in batches:
            rest = np.concatenate([rest, np.column_stack([c.to_numpy() for c in batch.columns[:4]])])
            folds = np.concatenate([folds, np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint64).reshape(-1, FOLD // 64)])
            cut = int(np.searchsorted(rest[:, 0], rest[-1, 0])) if len(rest) else 0  # the last bucket may go on
            yield from pairs(rest[:cut], folds[:cut]) if cut else ()
            rest, folds = rest[cut:], folds[cut:]
        if len(rest):
            yield from pairs(rest, folds)

    dealt = rows.select("h", "n", "id", "root", "fold").repartition(parallelism(rows.sparkSession), "h").sortWithinPartitions("h", "n", "id")
    return dealt.mapInArrow(run, "x long, y long").distinct()


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")


def alike_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, radius: int = RADIUS, crowded_over: int = CROWDED) -> DataFrame:
    """One row per row: doc_id, component_id - the smallest id that a chain of links
    reaches.

    Null, empty and wordless texts are alike.  Rows that share an id are one document,
    alike to another if one of its texts is.  Rows without an id join the component of
    their copies and are alike to nobody else; they do not found one (component_id null
    if no copy has an id).  Repeated rows stay repeated, an empty table gives an empty
    result, other columns are ignored.
    """
    spark = session(docs)
    texts = _texts(docs, width, percent)
    drop_shuffle_files(spark)
    known = texts.where("id is not null")

    # Texts without a shingle have fingerprint zero: the round meets them there.
    marks = materialise(known.groupBy("fp").agg(F.min(F.struct("n", "id"))["id"].alias("rep")), "marks")
    same = known.join(marks.hint("merge"), "fp").where("id != rep").select(F.col("rep").alias("x"), F.col("id").alias("y"))
    near = links(marks, radius).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    first = _verified(same.union(near).distinct(), known, width, percent, "first-links")
    crowd = (known.select(F.explode("prefix").alias("h")).groupBy("h").count().where(F.col("count") > crowded_over)
             .orderBy(F.desc("count"), "h").limit(MOST_CROWDED).select("h").collect())
    bucket = Window.partitionBy("h")
    shared = materialise(_prefixes(known, np.sort(np.array([r[0] for r in crowd], np.int64)), width, percent)
                         .withColumn("size", F.count("*").over(bucket)).where("size > 1").drop("size"), "shared")

    drop_shuffle_files(spark)
    found = [first] if first is not None else []
    roots = components(first) if found else spark.createDataFrame([], "node long, root long")

    def with_links(more: DataFrame | None) -> DataFrame:
        if more is None:
            return roots
        found.append(more)
        return components(reduce(DataFrame.union, found))

    hub = _rooted(shared, roots).withColumn("hub", F.min(F.struct("id", "n", "root")).over(bucket)).where("hub.root != root")
    in_size = F.least("n", "hub.n") * 100 >= F.greatest("n", "hub.n") * percent
    roots = with_links(_verified(hub.where(in_size).select(F.col("hub.id").alias("x"), F.col("id").alias("y")).distinct(), known, width, percent, "second-links"))
    apart = _rooted(shared, roots).join(known.select("id", "fold").hint("merge"), "id")
    roots = with_links(_verified(_pairs_apart(apart, percent), known, width, percent, "third-links"))
    drop_shuffle_files(spark)
    classes = materialise(_rooted(texts.select("digest", "id"), roots).select("digest", F.col("root").alias("component_id")), "classes")
    discard(texts, marks, shared, *found)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    return marked.join(classes.hint("merge"), "digest").select("doc_id", "component_id")
