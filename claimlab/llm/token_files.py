"""Token-id output: flat unsigned integer files with 64-bit document offsets.

Documents are dealt into shards by ranges of their id and sorted inside; each task
encodes one shard and writes three flat files, then renames them into place, so a task
that is run again replaces its own files with equal ones:

* ``NNNNNN.ids``     token ids, uint16 where the vocabulary allows, else uint32
* ``NNNNNN.offsets`` uint64, documents + 1 entries, in ids from the shard's begin
* ``NNNNNN.docs``    int64 document ids

A shard's base - the number of ids before it - is the prefix sum of the shard totals,
one row per shard.  Readers map the files into memory.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, posix_path, session, work_path

#: Words a generation holds, and the bytes of the longest that is held: with two
#: generations about 120 MB of a worker's memory, 240 MB if all words are of that length.
REMEMBERED, LONGEST = 300_000, 64
#: Bytes of text, and words, that go through at a time.
SLAB, AT_ONCE = 1 << 20, 4_096
#: The settings under which words can be encoded one by one.
WORDWISE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: ASCII signs but the apostrophe, of which tokens can begin, between a letter and white
#: space.  The first sign stands before the letter's test, which so runs at signs alone.
_SIGN = rb"[!-&(-/:-@\[-`{-~]"
STOPS = re.compile(rb"%b(?<=[a-z]%b)%b*(?=\s)" % (_SIGN, _SIGN, _SIGN))
#: Between words that are encoded together; its one token is in no word without it.
MARK = "\x01"
WHITE = re.compile(rb"[ \t\n\r\x0b\x0c]")
SHARD = "shard int, folder string, n_docs long, n_ids long"


class WordIds:
    """Ids of texts, as bytes, by words between ASCII white space.

    Under the settings ``WORDWISE`` white space only parts tokens, so a text's ids are
    those of its words.  The words of a batch that are not remembered are encoded in one
    call, with a mark between them; those with that mark inside go one by one.  Two forms
    are made one first, as the tokenizer would: ASCII capitals go, unless a combining mark
    might compose with one or a special string might be in the text, and signs between
    a letter and white space stand alone.  Two generations of words are remembered: a
    full one replaces the older.  Other tokenizers encode whole texts.
    """

    def __init__(self, path: str, dtype: str) -> None:
        self.library, told = library(path)
        self.dtype, self.known, self.older = dtype, {}, {}
        self.wordwise = (all(told.get(k) == v for k, v in WORDWISE.items())
                         and not any(WHITE.search(t["content"].encode()) or "<" not in t["content"] or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens", ())))
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.wordwise = self.wordwise and len(self.mark) == 1

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def words(self, data: bytes) -> list[bytes]:
        # 0xCC and 0xCD begin the combining marks U+0300 to U+036F.
        if b"<" not in data and b"\xcc" not in data and b"\xcd" not in data:
            data = STOPS.sub(rb" \g<0>", data.lower())
        return data.split()

    def learn(self, missing: set[bytes]) -> None:
        again = missing & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = missing - again
        odd = [w for w in new if MARK.encode() in w]
        self.known.update((w, self.whole(w.decode())) for w in odd)
        new, width = list(new.difference(odd)), np.dtype(self.dtype).itemsize
        for k in range(0, len(new), AT_ONCE):
            part = new[k : k + AT_ONCE]
            # In this form the library works no offsets out.
            got, = self.library.encode_batch_fast([f" {MARK} ".join([*(w.decode() for w in part), ""])], add_special_tokens=False)
            ids = np.array(got.ids, self.dtype)
            ends = (np.flatnonzero(ids == self.mark[0]) * width).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, (raw[a:b] for a, b in zip([0, *(e + width for e in ends)], ends, strict=False)), strict=True))

    def joined(self, parts: list[list[bytes]]) -> list[bytes]:
        need = set().union(*parts)
        missing = need - self.known.keys()
        if missing:
            if len(self.known) + len(missing) > REMEMBERED:
                self.older, self.known = self.known, {w: self.known[w] for w in need - missing}
            self.learn(missing)
        out = [b"".join(map(self.known.__getitem__, p)) for p in parts]
        for w in [w for w in missing if len(w) > LONGEST]:
            del self.known[w]
        return out

    def ids(self, text: str) -> Iterator[bytes]:
        """The ids of one text, in pieces: a long one is cut at white space."""
        if not self.wordwise:
            yield self.whole(text)
            return
        data, begin = text.encode(), 0
        while len(data) - begin > SLAB and (found := WHITE.search(data, begin + SLAB)):
            yield self.joined([self.words(data[begin : found.start()])])[0]
            begin = found.start()
        yield self.joined([self.words(data[begin:])])[0]

    def batch(self, texts: list[str]) -> Iterator[Iterator[bytes]]:
        """The pieces of each text's ids, short texts together."""
        group: list[str] = []
        for text in [*texts, None]:
            if group and (text is None or len(text) + sum(map(len, group)) > SLAB):
                if len(group) > 1 and self.wordwise:
                    yield from ([x] for x in self.joined([self.words(t.encode()) for t in group]))
                else:
                    yield from map(self.ids, group)
                group = []
            group.append(text)


@lru_cache(maxsize=1)
def library(path: str):
    """The tokenizer of a worker process and the settings in its file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.no_truncation()
    coder.no_padding()
    with open(path, "rb") as f:
        told = json.load(f)
    return coder, {k: told.get(k) for k in ("normalizer", "pre_tokenizer", "added_tokens")}


@lru_cache(maxsize=1)
def word_ids(path: str, dtype: str) -> WordIds:
    """The words a worker process remembers: tasks share them, as most are in any task."""
    return WordIds(path, dtype)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 1,
                      shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and write; returns the manifest: shard, folder, n_docs, n_ids, base.

    Null text counts as empty: only the end id.  Rows without an id come first as id
    -2**63.  Equal ids are ordered by a hash of their text, then the text, and shards
    may part them; repeated rows are written repeatedly.  An empty table gives an empty
    manifest.  Other columns are ignored.
    """
    from tokenizers import Tokenizer

    spark = session(docs)
    folder = folder or work_path(spark, "token-files")
    local = posix_path(folder)
    size = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    dtype = "<u2" if max(size - 1, end_id) < 2**16 else "<u4"
    n = shards or parallelism(spark)
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = keyed.withColumn("mark", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer_path, dtype)
        context = TaskContext.get()
        shard, item, end = context.partitionId(), np.dtype(dtype).itemsize, np.array([end_id], dtype).tobytes()
        os.makedirs(local, exist_ok=True)
        final = {kind: f"{local}/{shard:06d}.{kind}" for kind in ("ids", "offsets", "docs")}
        part = {kind: f"{path}.{context.taskAttemptId()}" for kind, path in final.items()}
        at = n_docs = 0
        with open(part["ids"], "wb") as ids, open(part["offsets"], "wb") as offsets, open(part["docs"], "wb") as names:
            offsets.write(np.uint64(0).tobytes())
            for batch in batches:
                ends = []
                for pieces in coder.batch(batch.column(1).to_pylist()):
                    at += sum(ids.write(got) for got in pieces) // item + 1
                    ids.write(end)
                    ends.append(at)
                offsets.write(np.array(ends, "<u8").tobytes())
                names.write(np.asarray(batch.column(0).to_numpy(), "<i8").tobytes())
                n_docs += len(ends)
        for kind, path in part.items():
            os.replace(path, final[kind]) if n_docs else os.remove(path)
        if n_docs:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "folder": [local], "n_docs": [n_docs], "n_ids": [at]})

    manifest = f"{folder}/manifest"
    (keyed.repartitionByRange(n, "id", "mark").sortWithinPartitions("id", "mark", "text").select("id", "text")
     .mapInArrow(write, SHARD).write.parquet(manifest))
    # One row per shard: the only rows that meet in a single task.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (spark.read.schema(SHARD).parquet(manifest)
            .withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))
            .withColumn("dtype", F.lit(dtype)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """One row per document from the mapped files: doc_id, start, n_tokens, ids_crc32.

    ``ids_crc32`` is over the ids as little-endian 32-bit integers, whatever the width
    in the files.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                stem = f"{row['folder']}/{row['shard']:06d}"
                ids = np.memmap(f"{stem}.ids", row["dtype"], "r")
                offsets = np.memmap(f"{stem}.offsets", "<u8", "r").astype(np.int64)
                names = np.memmap(f"{stem}.docs", "<i8", "r")
                for lo in range(0, len(names), 4096):
                    cut = offsets[lo : lo + 4097]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(np.asarray(names[lo : lo + 4096])), "start": pa.array(cut[:-1] + row["base"]),
                        "n_tokens": pa.array(np.diff(cut)), "ids_crc32": pa.array(crc, pa.int64())})

    few = parallelism(manifest.sparkSession)
    return manifest.repartition(few).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
