"""Near duplicates: SimHash fingerprints, linked by bit-sliced comparison.

Fingerprints are cut into radius + 2 blocks.  Two fingerprints that differ in at most
``radius`` bits agree in two blocks at least, so every link meets in one of the tables
that key fingerprints by a pair of blocks: no link is lost.  Only distinct fingerprints
travel, so copies - even if they are a third of all rows - are one row.  A bucket beyond
``split_over`` fingerprints is cut into chunks and every pair of chunks compared in a
group of its own.  Inside a bucket links become a spanning forest at once; the forests
of all buckets are contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bit_slices import Forest, near_pairs
from .common import materialise, parallelism, session, unused
from .components import components

SEED = 42
SPLIT_OVER = 16_384
SMALL_TABLE_ROWS = 100_000
#: Rows a task gathers before it compares the groups that are complete.
GATHER = 200_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of the word shingles: A-Z lower-cased, ASCII white space between words."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False))) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))


def simhash(text: str, width: int) -> int:
    """Bit b is set if more than half of the shingles' hashes have it; no words: zero."""
    return simhash_of(shingle_hashes(text, width))


def simhash_of(h: np.ndarray) -> int:
    """The fingerprint of hashes, repeats included."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 255):  # at most 255 ones fit a byte: sums stay in bytes
        ones += np.unpackbits(h[k : k + 255].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""
    session(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([simhash(x, width) for x in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column, radius: int) -> Column:
    """Array of keys, one for each pair of the radius + 2 blocks."""
    m = radius + 2
    edges = [64 * k // m for k in range(m + 1)]
    cut = lambda k: F.shiftrightunsigned(F.shiftleft(fp, 64 - edges[k + 1]), 64 - edges[k + 1] + edges[k])
    return F.array(*(F.xxhash64(F.lit(a), F.lit(b), cut(a), cut(b)) for a, b in combinations(range(m), 2)))


def links(nodes: DataFrame, radius: int, split_over: int = SPLIT_OVER) -> DataFrame:
    """(a, b): representatives of fingerprints whose links span the same components as
    all links within the radius.  ``nodes`` has (fp, rep), fingerprints distinct."""
    keyed = nodes.select(F.explode(block_keys(F.col("fp"), radius)).alias("key"), "fp", "rep")
    crowded = materialise(keyed.groupBy("key").count().where(F.col("count") > split_over)
                          .select("key", F.ceil(F.col("count") / split_over).cast("int").alias("chunks")), "crowded")
    n = crowded.count()
    if n:
        # A bucket's chunks: the row goes to the groups of its chunk with each chunk.
        keyed = (keyed.join(F.broadcast(crowded) if n <= SMALL_TABLE_ROWS else crowded, "key", "left")
                 .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
                 .withColumn("mine", F.pmod(F.xxhash64(F.lit("chunk"), "fp"), F.col("chunks")).cast("int"))
                 .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
                 .withColumn("part", F.least("mine", "other") * F.col("chunks") + F.greatest("mine", "other")))
    else:
        keyed = keyed.withColumn("part", F.lit(0))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        held = 0

        def groups(rows: np.ndarray) -> pa.RecordBatch | None:
            new = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            sizes = np.diff(np.concatenate([[0], new, [len(rows)]]))
            mine = np.repeat(sizes > 1, sizes)
            rows, sizes = rows[mine], sizes[sizes > 1]
            if not len(rows):
                return None
            forest = Forest(len(rows))
            for i, j in near_pairs(np.ascontiguousarray(rows[:, 2]).view(np.uint64), sizes, radius):
                forest.join(i, j)
            roots = forest.roots()
            hung = np.flatnonzero(roots != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[roots[hung], 3]), pa.array(rows[hung, 3])], ["a", "b"])

        for batch in batches:
            rest.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype(np.int64))
            held += len(rest[-1])
            if held >= GATHER:
                rows = np.concatenate(rest)
                same = (rows[:, :2] == rows[-1, :2]).all(1)
                cut = len(rows) - int(np.argmin(same[::-1])) if not same.all() else 0
                if cut and (out := groups(rows[:cut])):
                    yield out
                rest, held = [rows[cut:]], len(rows) - cut
        if held and (out := groups(np.concatenate(rest))):
            yield out

    dealt = keyed.select("key", F.col("part").cast("long").alias("part"), "fp", "rep")
    return (dealt.repartition(parallelism(nodes.sparkSession), "key", "part").sortWithinPartitions("key", "part")
            .mapInArrow(compare, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 3, split_over: int = SPLIT_OVER,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hex digits), component_id, fp.

    ``component_id`` is the smallest id that a chain of links reaches.  Null and
    wordless texts have fingerprint zero and link like any other.  Rows without an id
    join the component of their fingerprint but do not found one (component_id null if
    nobody else does).  Repeated rows stay repeated.  Other columns are ignored.
    """
    marked = materialise(fingerprints(docs, width, id_col, text_col), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    known = nodes.where("rep is not null")
    roots = components(links(known, radius, split_over))
    # Written, as in the components: the copies of one text may be split over tasks.
    classes = materialise(nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("root", "rep").alias("component_id")), "fingerprint-classes")
    return (marked.join(classes.hint("merge"), "fp")
            .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "fp"))


def keep_one(docs: DataFrame, width: int, radius: int) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the smallest id's.

    Where an id occurs on several rows, one row of it stays (the smallest by text, then
    by the other columns' JSON).  Rows without an id stay only if nobody with an id is
    in their component, one row of each text.
    """
    return keep_founders(docs, near_duplicates(docs, width, radius))


def keep_founders(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component in ``classes`` (doc_id,
    component_id), as in ``keep_one``."""
    found = materialise(classes, "classes")
    own, order = unused(docs, "own_id", "own_order")
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("doc_id").agg(F.count("*").alias("n"))
    stay = materialise(stay.select(F.col("doc_id").alias(own), "n"), "stay")
    # Always by shuffle: the ids that stay grow with the documents.
    kept = docs.join(stay.select(own).hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(own)), "left_semi")
    if stay.where("n > 1").limit(1).count():
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        one = [F.col("doc_id"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))]
        rank = F.row_number().over(Window.partitionBy(*one).orderBy("text", *([F.to_json(F.struct(*rest))] if rest else [])))
        kept = kept.withColumn(order, rank).where(F.col(order) == 1).drop(order)
    return kept
