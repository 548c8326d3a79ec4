"""Operator 8: exact token counts, huge documents by overlap resynchronisation.

A document of more than CHUNK characters is encoded as chunks that overlap. Pre-tokens are
cut from left to right with a bounded look-ahead, so a pre-token boundary that lies far enough
before the end of a chunk whose own start is true is a boundary of the whole text; where the
next chunk has a boundary at the same character, both continue alike from there. The chunks
are spliced at such a place. If an overlap has none, the left chunk and the overlap are made
twice as large, until there is one or the chunk reaches the end of the text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, table, text_of, with_text

CHUNK, OVERLAP, LIMIT = 32768, 512, 1024
#: Characters of look-ahead that a boundary may depend on, besides special tokens.
LOOK = 8


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a .json file, once per worker. Paths without a folder are names
    of the public vocabulary files."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if os.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Tokenizer.from_file(path)


def boundaries(encoding) -> dict[int, int]:
    """Character at which each pre-token starts -> number of its first token."""
    out, before = {}, None
    for k, (word, (at, _)) in enumerate(zip(encoding.word_ids, encoding.offsets)):
        if word != before:
            out.setdefault(at, k)
            before = word
    return out


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int | None = None) -> int:
    """Tokens of a text by overlapping chunks: len(encode(text)), in memory for a few chunks."""
    if margin is None:
        margin = LOOK + max((len(t.content) for t in tok.get_added_tokens_decoder().values()), default=0)
    if len(text) <= chunk or overlap <= 2 * margin or chunk <= 2 * overlap:
        return len(tok.encode(text, add_special_tokens=False))
    encode = lambda a, b: tok.encode(text[a:b], add_special_tokens=False)
    total, begin, end, wide = 0, 0, chunk, overlap
    left, first, at = encode(0, end), 0, 0  # the chunk at hand; its first token that counts, and that token's place
    while end < len(text):
        start = end - wide
        stop = min(len(text), start + max(chunk, 2 * wide))
        right = encode(start, stop)
        mine = {begin + p: t for p, t in boundaries(left).items() if max(start, at) <= begin + p <= end - margin}
        shared = [(start + p, t) for p, t in boundaries(right).items() if start + p in mine]
        if shared:
            at, into = min(shared)
            total += mine[at] - first
            begin, end, left, first, wide = start, stop, right, into, overlap
        else:  # chunk and overlap double, so that all attempts together cost no more than the last one twice
            end = min(len(text), begin + 2 * (end - begin))
            wide = min(2 * wide, (end - begin) // 2)
            left = encode(begin, end)
    return total + len(left) - first


def _counted(path: str, chunk: int, overlap: int, text_col: str = "text"):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for b in batches(rows, 128):
            texts = [t or "" for t in text_of(b, text_col, pa.string()).to_pylist()]
            small = [k for k, t in enumerate(texts) if len(t) <= chunk]
            counts = [0] * len(texts)
            for k, e in zip(small, tok.encode_batch_fast([texts[k] for k in small], add_special_tokens=False)):
                counts[k] = len(e)
            for k, t in enumerate(texts):
                if len(t) > chunk:
                    counts[k] = spliced_count(tok, t, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64())], ["row", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, vocabulary: str, text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of each row (all, if not named) as the struct `row`, with n_tokens: the length of the library's encoding
    of the whole text without added begin, end or padding. Null and empty texts have none; special
    strings inside a text count as the library's default has it. Rows are counted alone."""
    rows = with_text(docs, text_col, carry)
    return rows.mapInArrow(_counted(vocabulary, chunk, overlap, text_col), T.StructType([rows.schema["row"], T.StructField("n_tokens", T.LongType())]))


def op8_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, vocabulary, carry=["doc_id", "n_bytes"])
    return counted.select("row.doc_id", "row.n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
