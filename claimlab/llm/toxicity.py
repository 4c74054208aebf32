"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Every word of every example is a term.  Its weight is tf x idf x how strongly the word
goes with the label: tf is 1 + ln(count), idf ln((1 + N) / (1 + df)) with the frequencies
of all documents, and the last the likelihood-ratio statistic G of the word and the label
over the examples' distinct texts.  (With tf x idf alone the neighbours share a text's
subject, not its tone; the README has figures.)

Examples are sorted by their heaviest terms and cut into blocks; an inverted index keeps
each term's postings and its largest weight in every block.  A query adds up the weights
of common terms, for many texts in one product of matrices, and the postings of its
heaviest others; what the others can add at most is bounded block by block, and
only examples that may reach the k-th best are worked out in full.  The neighbours are
exact.  Votes weighted by nearness give the score; the neighbours are the evidence.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, drop_shuffle_files, held_out, materialise, session
from .labelled import training_rows

#: Bound: labelled documents to learn from.
TRAINING_ROWS = 20_000
NEIGHBOURS, BLOCK = 15, 64
PRIOR_WEIGHT = 0.5
#: The terms that are left to the bounds add at most so much of cosine.
SLACK = 0.05
#: Cosines are compared to so many decimals, ties go to the smaller id; one that rounds to
#: zero is none.
DECIMALS = 7
#: A term that more than one example in so many has is common; texts scored at a time.
FREQUENT, AT_ONCE = 8, 64
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z), any other ASCII sign parts them."""
    return text.encode().translate(_FOLD).split()


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct words, ascending, and how often each occurs."""
    got = Counter(words_of(text))
    h = np.fromiter(map(xxhash.xxh64_intdigest, got), np.uint64, len(got))
    order = np.argsort(h)
    return h[order], np.fromiter(got.values(), np.int64, len(got))[order]


def spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges one after the other, and the ranges' lengths."""
    n = ends - starts
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(n.sum()), n


def ends(places: np.ndarray, size: int) -> np.ndarray:
    """Where the entries of each place begin in a sorted list of places, and the end."""
    return np.concatenate([[0], np.cumsum(np.bincount(places, minlength=size))])


@dataclass
class Index:
    """Block-max inverted index over the examples' unit vectors."""

    words: np.ndarray  # hashes, ascending: the terms
    strength: np.ndarray  # idf x G by term
    ids: np.ndarray  # of the examples, in index order
    labels: np.ndarray
    rows: np.ndarray  # examples: where each one's terms begin, and the end
    row_terms: np.ndarray
    row_weights: np.ndarray
    prior: float  # share of label 1 among the examples

    def __getstate__(self) -> dict:
        """What travels: the examples' rows.  Whoever asks inverts them once."""
        return {f.name: getattr(self, f.name) for f in fields(self)}

    @cached_property
    def inverted(self) -> tuple[np.ndarray, ...]:
        """posts: where each term's postings begin, and the end; post_rows, post_weights;
        tops: where each term's blocks begin, and the end; top_blocks, top_weights: the
        largest weight in the block; peaks: in any block."""
        order = np.argsort(self.row_terms, kind="stable")  # rows ascend inside a term
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.rows))
        t, post_rows, post_weights = self.row_terms[order], row[order], self.row_weights[order]
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (post_rows[1:] // BLOCK != post_rows[:-1] // BLOCK)]) if len(t) else np.zeros(0, np.int64)
        most = np.maximum.reduceat(post_weights, new) if len(new) else post_weights
        peaks = np.zeros(len(self.words))
        np.maximum.at(peaks, t[new], most)
        return ends(t, len(self.words)), post_rows, post_weights, ends(t[new], len(self.words)), post_rows[new] // BLOCK, most, peaks

    posts, post_rows, post_weights, tops, top_blocks, top_weights, peaks = (property(lambda self, k=k: self.inverted[k]) for k in range(7))

    @cached_property
    def dense(self) -> np.ndarray:
        """A query's weights by term while it is worked out, else zeros."""
        return np.zeros(len(self.words))

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights of the unit vector) of a text; words that no example
        has weigh nothing, as do words that do not go with the label."""
        h, n = counted(text)
        at = np.searchsorted(self.words, h)
        known = np.flatnonzero(at < len(self.words))
        known = known[self.words[at[known]] == h[known]]
        return self.weigh(at[known], n[known])

    def weigh(self, terms: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(n)) * self.strength[terms]
        terms, w = terms[w > 0], w[w > 0]
        return terms, w / np.sqrt((w * w).sum()) if len(w) else w

    @cached_property
    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """(slot by term or -1, slots x examples): the weights of terms that more than one
        example in ``FREQUENT`` has, for a product of matrices."""
        which = np.flatnonzero(np.diff(self.posts) * FREQUENT > len(self.ids))
        slot, full = np.full(len(self.words), -1, np.int32), np.zeros((len(which), len(self.ids)), np.float32)
        slot[which] = np.arange(len(which))
        for k, t in enumerate(which.tolist()):
            a, b = self.posts[t], self.posts[t + 1]
            full[k, self.post_rows[a:b]] = self.post_weights[a:b]
        return slot, full

    def begun(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts x examples: cosines as far as the common terms go."""
        slot, full = self.common
        wanted = np.zeros((len(vectors), len(full)), np.float32)
        for row, (terms, weights) in zip(wanted, vectors, strict=True):
            at = slot[terms]
            row[at[at >= 0]] = weights[at >= 0]
        return wanted @ full

    def add(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Cosines as far as these terms go, by example."""
        at, n = spread(self.posts[terms], self.posts[terms + 1])
        return np.bincount(self.post_rows[at], self.post_weights[at] * np.repeat(weights, n), len(self.ids))

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, got: np.ndarray | None = None) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a positive cosine, ties by id.  ``got``:
        the text's row of ``begun``."""
        if not len(terms) or not len(self.ids):
            return []
        got = self.begun([(terms, weights)])[0] if got is None else got
        rare = self.common[0][terms] < 0
        most = np.where(rare, weights * self.peaks[terms], 0.0)
        order = np.argsort(-most, kind="stable")[: int(rare.sum())]
        rest, given, most = terms[order], weights[order], most[order]
        head = int(np.searchsorted(-(most.sum() - np.cumsum(most)), -SLACK)) + 1 if len(rest) else 0
        if head:
            got = got + self.add(rest[:head], given[:head])
        best = np.partition(got, -k)[-k] if len(got) > k else 0.0
        least = max(best - 1e-5, 1e-9)
        if head < len(rest):
            at, n = spread(self.tops[rest[head:]], self.tops[rest[head:] + 1])
            room = np.bincount(self.top_blocks[at], self.top_weights[at] * np.repeat(given[head:], n), -(-len(self.ids) // BLOCK))
            hits = np.flatnonzero(got + np.repeat(room, BLOCK)[: len(got)] >= least)
        else:
            hits = np.flatnonzero(got >= least)
        if len(hits) * 16 < len(got):
            self.dense[terms] = weights
            at, n = spread(self.rows[hits], self.rows[hits + 1])
            cosines = np.bincount(np.repeat(np.arange(len(hits)), n), self.row_weights[at] * self.dense[self.row_terms[at]], len(hits))
            self.dense[terms] = 0
        else:
            cosines = self.add(terms, weights)[hits]
        cosines = np.round(cosines, DECIMALS)
        hits, cosines = hits[cosines > 0], cosines[cosines > 0]
        first = np.lexsort((self.ids[hits], -cosines))[:k]
        return list(zip(cosines[first].tolist(), hits[first].tolist(), strict=True))

    def scores(self, texts: list[str]) -> list[tuple[float, list[tuple[float, int]]]]:
        vectors = [self.vector(t) for t in texts]
        return [self.voted(self.nearest(*v, got=row)) for v, row in zip(vectors, self.begun(vectors), strict=True)]

    def score(self, text: str) -> tuple[float, list[tuple[float, int]]]:
        """Votes weighted by nearness (the reciprocal of the cosine distance, softened),
        with the prior as one more voter; and the neighbours as evidence."""
        return self.voted(self.nearest(*self.vector(text)))

    def voted(self, near: list[tuple[float, int]]) -> tuple[float, list[tuple[float, int]]]:
        votes = [1 / (1.1 - min(c, 1.0)) for c, _ in near]
        given = sum(v * int(self.labels[i]) for v, (_, i) in zip(votes, near, strict=True))
        return (given + PRIOR_WEIGHT * self.prior) / (sum(votes) + PRIOR_WEIGHT), near


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """G of a word and the label: ``a`` of the ``n1`` texts with label 1 have the word,
    ``b`` of the ``n0`` others."""
    n, out = max(1, n1 + n0), np.zeros(len(a))
    for seen, expected in ((a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n)):
        some = seen > 0
        out[some] += 2 * seen[some] * np.log(seen[some] / expected[some])
    return np.where(out > 1e-9, out, 0.0)


def build_index(words: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray, copies: np.ndarray, rows: np.ndarray, terms: np.ndarray, n: np.ndarray) -> Index:
    """``rows``, ``terms`` and ``n`` hold the examples' terms and counts one after the
    other; ``copies`` is equal for equal texts, which count as one for G.  Arrays as long
    as all examples together have four bytes an entry and few live at a time."""
    _, once = np.unique(np.column_stack([copies, labels]), axis=0, return_index=True)
    first = np.zeros(len(ids), bool)
    first[once] = True
    sizes = np.diff(rows)
    a, b = (np.bincount(terms[np.repeat(first & (labels == y), sizes)], minlength=len(words)).astype(float) for y in (1, 0))
    strength = idf * likelihood_ratio(a, b, int((labels[first] == 1).sum()), int((labels[first] == 0).sum()))
    w = (1 + np.log(n.astype(np.float32))) * strength.astype(np.float32)[terms]
    row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
    length = np.sqrt(np.bincount(row, w * w, len(ids)))
    w /= np.where(length > 0, length, 1).astype(np.float32)[row]
    some = w > 0
    row, terms, w = row[some], terms[some].astype(np.int32), w[some]
    rows = ends(row, len(ids))
    # Examples with the same heaviest term stand together.
    top = np.zeros(len(ids), np.float32)
    np.maximum.at(top, row, w)
    at = np.flatnonzero(w == top[row])
    heaviest = np.full(len(ids), len(words))
    heaviest[row[at[::-1]]] = terms[at[::-1]]
    by = np.lexsort((ids, heaviest))
    del row, at, some
    moved = np.concatenate([[0], np.cumsum(np.diff(rows)[by])])
    new_terms, new_w = np.empty_like(terms), np.empty_like(w)
    for k in range(0, len(by), AT_ONCE):
        part = by[k : k + AT_ONCE]
        order, _ = spread(rows[part], rows[part + 1])
        new_terms[moved[k] : moved[k] + len(order)], new_w[moved[k] : moved[k] + len(order)] = terms[order], w[order]
    rows, terms, w = moved, new_terms, new_w
    return Index(words, strength, ids[by], labels[by], rows, terms, w, (float(labels.sum()) + 0.5) / (len(labels) + 1) if len(labels) else 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Index:
    """Examples and terms from at most ``most`` labelled rows, document frequencies from
    all documents.  The numbers of the examples' words come to the driver."""
    spark = session(docs)
    drop_shuffle_files(spark)  # and an earlier index
    train = training_rows(docs, labels, "toxic", most).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [counted(t) for t in texts]
            copies = np.array([xxhash.xxh64_intdigest(t.encode()) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(copies), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([n.astype("<u4").tobytes() for _, n in got], pa.binary())],
                                             ["doc_id", "label", "copy", "words", "n"])

    read = materialise(train.mapInArrow(vectors, "doc_id long, label int, copy long, words binary, n binary"), "toxic-examples")
    # A part at a time: the driver's JVM never holds all of them.
    ids, labels, copies, sizes, hashes, n = [], [], [], [], bytearray(), bytearray()
    for row in read.toLocalIterator():
        ids.append(row["doc_id"])
        labels.append(row["label"])
        copies.append(row["copy"])
        sizes.append(len(row["n"]) // 4)
        hashes += row["words"]
        n += row["n"]
    discard(read)
    ids, labels, copies, sizes = (np.array(x, np.int64) for x in (ids, labels, copies, sizes))
    hashes, n = np.frombuffer(hashes, "<u8"), np.frombuffer(n, "<u4")
    words = np.unique(hashes)
    terms = np.empty(len(hashes), np.int32)
    for k in range(0, len(hashes), 1 << 18):
        terms[k : k + (1 << 18)] = np.searchsorted(words, hashes[k : k + (1 << 18)])
    del hashes
    # Its size is bounded by the examples' words.
    shared = spark.sparkContext.broadcast(words)

    def having(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per task: texts, and texts that have each term."""
        words, texts = shared.value, 0
        found = np.zeros(len(words), np.int64)
        for batch in batches:
            texts += len(batch)
            for text in batch.column(0).to_pylist():
                h, _ = counted(text)
                at = np.searchsorted(words, h)
                at = at[at < len(words)]  # hashes ascend: those beyond are the last
                found[at[words[at] == h[: len(at)]]] += 1
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some].astype(np.int32)), pa.array(np.r_[texts, found[some]])], ["term", "n"])

    all_texts = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = materialise(all_texts.mapInArrow(having, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")), "toxic-frequencies")
    told = df.toArrow()
    discard(df)
    shared.destroy()
    drop_shuffle_files(spark)
    term, have = told["term"].to_numpy(), told["n"].to_numpy()
    frequency = np.zeros(len(words))
    frequency[term[term >= 0]] = have[term >= 0]
    idf = np.log((1 + have[term < 0].sum()) / (1 + frequency))
    return build_index(words, idf, ids, labels, copies, np.concatenate([[0], np.cumsum(sizes)]), terms, n)


def toxicity_scores(docs: DataFrame, index: Index, threshold: float = 0.5) -> DataFrame:
    """One row per row: doc_id, held_out, score, predicted, evidence array<struct<doc_id,
    cosine, label>>.

    Texts that share no weighty word with an example - empty and null ones too - score
    the rate of label 1.  Repeated rows stay repeated; an empty table gives an empty
    result; without examples every score is 0.
    """
    session(docs)
    # Its size is bounded by the examples' words.
    shared = docs.sparkSession.sparkContext.broadcast(index)
    evidence = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = [x for k in range(0, len(texts), AT_ONCE) for x in index.scores(texts[k : k + AT_ONCE])]
            shown = [[{"doc_id": int(index.ids[i]), "cosine": c, "label": int(index.labels[i])} for c, i in near] for _, near in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array(shown, evidence)], ["doc_id", "score", "evidence"])

    scored = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
              .mapInArrow(run, "doc_id long, score double, evidence array<struct<doc_id:long,cosine:double,label:int>>"))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
