"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences.

A text's paragraphs are its lines; a paragraph's leaves are its sentences, long ones cut
every ``LEAF`` code points.  A paragraph's digest is that of its leaves' digests, a
section's that of its paragraphs', the root that of the sections'.  Digests have 128 bits
and cover which level they stand for, so equal roots mean equal texts.  A section ends
after a paragraph whose digest is divisible by ``SECTION``: an insertion moves no later
section border.  Where roots differ, the branches that differ locate the edit.

The fingerprint's text form is ``root!section;section;...``, a section
``digest=paragraph/paragraph/...`` and a paragraph ``digest:leaf,leaf,...``; below the
root the first eight hex digits of a digest are shown, after a leaf's its length in base
36.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism, session

LEAF, SECTION = 64, 8
SENTENCE = re.compile(rf"[^.!?]{{1,{LEAF}}}[.!?]{{0,8}}|[.!?]{{1,8}}")
#: Ids that are looked at for each range of ids.
SAMPLED = 64


def base36(n: int) -> str:
    out = ""
    while True:
        n, r = divmod(n, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[r] + out
        if not n:
            return out


WIDTHS = [base36(n) for n in range(LEAF + 9)]

#: A branch: what is shown of its digest, its branches (leaves: their code points).
Branch = tuple[str, list]


def tree(text: str) -> tuple[str, list[Branch]]:
    """The root's digest and the sections: (shown digest, paragraphs), a paragraph
    (shown digest, leaves), a leaf its shown digest and length."""
    digest = xxhash.xxh3_128_digest
    sections, tops, paragraphs, below = [], [], [], []
    for line in text.split("\n"):
        pieces = SENTENCE.findall(line)
        whole = [digest(b"leaf" + x.encode()) for x in pieces]
        mine = digest(b"paragraph" + b"".join(whole))
        paragraphs.append((mine.hex()[:8], [d[:4].hex() + WIDTHS[len(x)] for d, x in zip(whole, pieces, strict=True)]))
        below.append(mine)
        if mine[0] % SECTION == 0:
            tops.append(digest(b"section" + b"".join(below)))
            sections.append((tops[-1].hex()[:8], paragraphs))
            paragraphs, below = [], []
    if paragraphs:
        tops.append(digest(b"section" + b"".join(below)))
        sections.append((tops[-1].hex()[:8], paragraphs))
    return digest(b"root" + b"".join(tops)).hex(), sections


def shown(marks: tuple[str, list[Branch]]) -> str:
    """The text form of a tree."""
    paragraph = lambda p: f"{p[0]}:{','.join(p[1])}"
    return f"{marks[0]}!{';'.join(f'{d}={'/'.join(map(paragraph, ps))}' for d, ps in marks[1])}"


def parsed(mark: str) -> tuple[str, list[Branch]]:
    """The tree of a text form."""
    root, _, body = mark.partition("!")
    paragraph = lambda p: (p.partition(":")[0], [x for x in p.partition(":")[2].split(",") if x])
    return root, [(s.partition("=")[0], [paragraph(p) for p in s.partition("=")[2].split("/")]) for s in body.split(";")]


def width(leaf: str) -> int:
    return int(leaf[8:], 36)


def fingerprint(text: str) -> str:
    return shown(tree(text))


def _apart(mine: list[Branch], theirs: list[Branch]) -> tuple[list[Branch], list[Branch]]:
    """The branches of either side that have no counterpart of equal digest."""
    few = Counter(d for d, _ in mine) & Counter(d for d, _ in theirs)
    if not few:
        return mine, theirs
    out = []
    for side in (mine, theirs):
        left, rest = few.copy(), []
        for branch in side:
            if left[branch[0]]:
                left[branch[0]] -= 1
            else:
                rest.append(branch)
        out.append(rest)
    return out[0], out[1]


def likeness(a: tuple[str, list[Branch]], b: tuple[str, list[Branch]]) -> float:
    """Share of the larger text's code points that lie in branches both trees have; 1 for
    equal roots, 0 if one is empty and the other not.  Descends only into sections, and
    then paragraphs, without a counterpart."""
    if a[0] == b[0]:
        return 1.0
    size = lambda t: sum(width(x) for _, ps in t[1] for _, xs in ps for x in xs)
    total = max(size(a), size(b))
    mine, theirs = _apart(a[1], b[1])
    mine, theirs = _apart([p for _, ps in mine for p in ps], [p for _, ps in theirs for p in ps])
    one, two = (Counter(x for _, xs in side for x in xs) for side in (mine, theirs))
    rest = sum(width(x) * n for x, n in (one - two if size(a) >= size(b) else two - one).items())
    return (total - rest) / total if total else 0.0


def differing(mark: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) numbers of ``mark`` where ``other`` differs, empty only for
    equal roots.

    Sections, then paragraphs, that agree from the begin and from the end are passed by
    their digests.  Of the paragraphs between, those without a counterpart of equal
    digest between the other's; all of them if each has one (moved or repeated); the one
    before the gap if there are none (deleted).
    """
    a, b = parsed(mark), parsed(other)
    if a[0] == b[0]:
        return []
    mine = [((i, k), d, s[0]) for i, s in enumerate(a[1]) for k, (d, _) in enumerate(s[1])]
    theirs = [d for _, ps in b[1] for d, _ in ps]

    def agreeing(x: list[str], y: list[str]) -> int:
        return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    def ends(step: int) -> int:
        """Paragraphs that agree from one end."""
        s = agreeing([d for d, _ in a[1]][::step], [d for d, _ in b[1]][::step])
        passed = sum(len(ps) for _, ps in a[1][::step][:s])
        return passed + agreeing([d for _, d, _ in mine][::step][passed:], theirs[::step][passed:])

    head = ends(1)
    tail = min(ends(-1), min(len(mine), len(theirs)) - head)
    middle, others = mine[head : len(mine) - tail], Counter(theirs[head : len(theirs) - tail])
    alone = []
    for place, d, _ in middle:
        if others[d]:
            others[d] -= 1
        else:
            alone.append(place)
    return alone or [place for place, _, _ in middle] or [mine[max(0, head - 1)][0]]


def edited(text: str, following: str) -> str:
    """The last half of the code points gives way to the first as many of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def bucket_of(key: tuple[Column, Column], bounds: list[tuple[int, int]]) -> Column:
    """How many of the ascending bounds are at most the key, by bisection in two constant
    arrays."""
    if not bounds:
        return F.lit(0)
    firsts, seconds = (F.split(F.lit(",".join(str(b[k]) for b in bounds)), ",").cast("array<bigint>") for k in range(2))
    halves = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)])

    def step(at: Column, half: Column) -> Column:
        a, b = F.get(firsts, at + half - 1), F.get(seconds, at + half - 1)
        return at + F.when((a < key[0]) | (a == key[0]) & (b <= key[1]), half).otherwise(0)

    return F.aggregate(halves, F.lit(0), step)


def with_following(docs: DataFrame, n: int) -> DataFrame:
    """Documents dealt into ``n`` ranges of (id, mark), each range followed by a copy of
    the first row of the next that has rows (the last by the first's), marked ``guest``.

    The driver sees ``SAMPLED`` keys a range and one row a range: what the same number
    of tasks costs it anyway.
    """
    spark = docs.sparkSession
    # A share of all ids, by their hash: the same rows whenever a task runs again.
    every = max(1, docs.count() // (SAMPLED * n))
    seen = sorted(tuple(r) for r in docs.where(F.pmod(F.xxhash64("mark", "id"), F.lit(every)) == 0).select("id", "mark").collect())
    bounds = sorted({seen[len(seen) * k // n] for k in range(1, n)}) if seen else []
    rows = docs.withColumn("bucket", bucket_of((F.col("id"), F.col("mark")), bounds))
    firsts = sorted((r["bucket"], *r["head"]) for r in rows.groupBy("bucket").agg(F.min(F.struct("id", "mark")).alias("head")).collect())
    heads = [(firsts[k - 1][0], i, mark) for k, (_, i, mark) in enumerate(firsts)]
    table = F.broadcast(spark.createDataFrame(heads, "bucket int, id long, mark long"))
    guests = docs.join(table, ["id", "mark"]).groupBy("bucket").agg(F.min(F.struct("id", "mark", "text")).alias("row"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests.select("row.*", "bucket", F.lit(True).alias("guest")))


def edit_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is the next row by (id, a hash of the text, text); after the last
    comes the first, and a lone document follows itself.  Null text counts as empty, a
    missing id as -2**63.  Repeated rows follow one another.  An empty table gives an
    empty result.  Other columns are ignored.
    """
    spark = session(docs)
    n = parallelism(spark)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_following(keyed.withColumn("mark", F.xxhash64("text")), n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # id, text, bucket, its tree: waits for its next row
        for batch in batches:
            out = []
            for i, text, bucket, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mark = tree(text)
                if held and held[2] == bucket:
                    new = edited(held[1], text)
                    changed = tree(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode()).hexdigest(), shown(held[3]), shown(changed), likeness(held[3], changed), likeness(held[3], mark)))
                held = None if guest else (i, text, bucket, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x)) for x in zip(*out, strict=True)], NAMES)

    dealt = rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "guest", "id", "mark", "text").select("id", "text", "bucket", "guest")
    return dealt.mapInArrow(run, SCHEMA)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
