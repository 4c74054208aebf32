"""Token counts through a digest cache.

The cache is a Parquet folder of (content digest, tokenizer digest, count).  Texts are
digested where they lie; only digests travel to the join with the cache.  Texts whose
digest is unknown are made distinct (partial aggregation first, so a text with many
copies crosses the network once per map task at most), encoded once and appended.

The library encodes whole texts.  Only texts beyond ``SLAB`` characters are cut, where
the tokenizer's own settings allow it: a byte-level BPE without normaliser or prefix
space starts a new token at white space that follows anything else.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import exists, materialise, session, work_path

CACHE_SCHEMA = T.StructType([
    T.StructField("content_digest", T.BinaryType()),
    T.StructField("tokenizer_digest", T.StringType()),
    T.StructField("n_tokens", T.LongType()),
])
#: Longer texts are cut at white space: bounds what the library holds of one text.
SLAB = 1 << 20
WHITE = " \t\n\r\x0b\x0c"
CUT = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")


def slabs(text: str, size: int = SLAB) -> Iterator[str]:
    """Pieces of about ``size`` characters, each but the first beginning with the ASCII
    white space that parted it from the one before."""
    begin = 0
    while len(text) - begin > size and (found := CUT.search(text, begin + size)):
        yield text[begin : found.start()]
        begin = found.start()
    yield text[begin:]


class LibraryCounts:
    """Counts of the tokenizers library."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, "rb") as f:
            told = json.load(f)
        first = told.get("pre_tokenizer") or {}
        self.cuts = (told.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
                     and not any(set(t["content"]) & set(WHITE) or t.get("lstrip") or t.get("rstrip") for t in told.get("added_tokens", ())))

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [list(slabs(t)) if self.cuts else [t] for t in texts]
        found = iter(self.library.encode_batch_fast([p for ps in pieces for p in ps], add_special_tokens=False))
        return [sum(len(next(found)) for _ in ps) for ps in pieces]


class PieceCounts:
    """sentencepiece models encode whole texts."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(self.model.encode(t)) for t in texts]


@lru_cache(maxsize=1)
def encoder(path: str) -> LibraryCounts | PieceCounts:
    """The encoder of a worker process, the file's tables only: it remembers no texts."""
    return (PieceCounts if path.endswith(".model") else LibraryCounts)(path)


def tokenizer_digest(path: str) -> str:
    """Version of a tokenizer: digest of its file, and of the library that reads it."""
    import sentencepiece
    import tokenizers

    version = sentencepiece.__version__ if path.endswith(".model") else tokenizers.__version__
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + version.encode()).hexdigest()


#: Texts the library encodes at a time.
AT_ONCE = 16


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None,
                 over: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, was_cached.

    ``cache_path`` outlives the call: later calls with the same tokenizer look their
    texts up there.  The content's normal form is its text, null as empty (0 bytes,
    0 tokens): any other change could change the count.  Repeated rows and ids stay
    repeated.  An empty table gives an empty result.  Columns other than the two named
    are ignored.  ``was_cached``: an earlier call had stored the count.
    """
    spark = session(docs)
    cache_path = cache_path or work_path(spark, "token-cache")
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    base = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("content_digest"))
    contents = docs.select(digest.alias("content_digest"), text.alias("content"))

    def stored() -> DataFrame:
        """One count per digest, also if two runs appended the same text.  Written, so
        that both sides of a join with it are plain exchanges: Spark can then split the
        rows of a text with very many copies over tasks."""
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        mine = cache.where(F.col("tokenizer_digest") == version)
        return materialise(mine.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")

    before = stored().withColumn("was_cached", F.lit(True)) if exists(spark, cache_path) else None
    if before is not None:
        contents = contents.join(before, "content_digest", "left_anti")
    misses = contents.groupBy("content_digest").agg(F.first("content").alias("content"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [x for k in range(0, len(texts), AT_ONCE) for x in coder.counts(texts[k : k + AT_ONCE])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.binary()), pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())],
                ["content_digest", "tokenizer_digest", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    counted = base.join(stored().hint("merge"), "content_digest", "left")
    if before is not None:
        counted = counted.join(before.select("content_digest", "was_cached").hint("merge"), "content_digest", "left")
    else:
        counted = counted.withColumn("was_cached", F.lit(False))
    return counted.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"), F.coalesce("was_cached", F.lit(False)).alias("was_cached"))
