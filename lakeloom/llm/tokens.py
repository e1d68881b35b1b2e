"""Tokens: an encoder with a memory for frequent words, flat token files, and their separator scan.

The separator scan counts the tokens of documents in flat, unindexed token files: files are cut into blocks of bytes, each
block is searched for the end-of-document id as an array, and a prefix scan over the blocks of a file (how many
separators came before, where the last of them was) stitches documents that cross blocks.

Defined results: a null or empty text has no tokens (its separator stands alone); equal doc_ids are documents of their
own; an empty table gives no files and no rows; texts that spell a special token are ordinary text; other columns are
left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, scratch, written
from .files import commit, opened, temporary

#: Vocabulary: a name for public_tokenizers.path(), or a path.
TOKENIZER = "byte_bpe_50k"
#: Words with their tokens that one worker remembers.
REMEMBERED = 300_000
END_OF_DOCUMENT = 50_256
BLOCK_BYTES = 4 << 20
ROLL_BYTES = 512 << 20

# The code points with the Unicode property White_Space.
SPACES = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Byte-level BPE never joins across these parts, and never splits differently inside one for what stands around it.
PARTS = re.compile(f" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


@lru_cache(maxsize=2)
def loaded(name: str):
    """The tokenizer's ranks where a file of them lies beside it (the same ids, faster), and the tokenizer itself."""
    import base64
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = name if os.path.sep in name else public_tokenizers.path(f"{name}.json")
    ranks = os.path.splitext(path)[0] + ".tiktoken"
    full = Tokenizer.from_file(path)
    full.encode_special_tokens = True
    fast = None
    if os.path.exists(ranks):
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return full, fast


class Encoder(dict):
    """Token ids of texts. Itself the memory: part of a text -> its ids as bytes."""

    def __init__(self, name: str = TOKENIZER) -> None:
        super().__init__()
        self.full, self.fast = loaded(name)
        self.narrow = self.full.get_vocab_size() <= 1 << 16

    @staticmethod
    def is_narrow(name: str) -> bool:
        return loaded(name)[0].get_vocab_size() <= 1 << 16

    def __missing__(self, part: str) -> bytes:
        ids = self.fast.encode_ordinary(part) if self.fast else self.full.encode(part, add_special_tokens=False).ids
        out = np.array(ids, np.uint32).tobytes()
        if len(self) < REMEMBERED and len(part) <= 24:
            self[part] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        return np.frombuffer(b"".join(map(self.__getitem__, PARTS.findall(text))), np.uint32)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str | None = None, separator: int = END_OF_DOCUMENT, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Flat little-endian unsigned 16-bit files in folder, a separator after each document; returns file, ordinal, doc_id.

    A task writes what it scanned, in that order, so nothing is shuffled; a retried task scans and writes the same again.
    """
    name = tokenizer or TOKENIZER
    fs, path = opened(folder)
    fs.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, fs, path = Encoder(name), *opened(folder)
        if not encoder.narrow:
            raise ValueError("ids of more than 16 bits")
        task, number, size, ordinal, out, temp, file = TaskContext.get().partitionId(), 0, 0, 0, None, "", ""
        stop = np.array([separator], "<u2").tobytes()
        for batch in pieces(batches, 1):
            files, ordinals = [], []
            for text in batch.column(1).to_pylist():
                if out is None:
                    file = f"tokens-{task:06d}-{number:04d}.bin"
                    out, size, ordinal, temp = fs.open_output_stream(t := temporary(f"{path}/{file}")), 0, 0, t
                data = encoder.encode(text).astype("<u2").tobytes() + stop
                out.write(data)
                files.append(file)
                ordinals.append(ordinal)
                size, ordinal = size + len(data), ordinal + 1
                if size >= roll_bytes:
                    out.close()
                    commit(fs, temp, f"{path}/{file}")
                    out, number = None, number + 1
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
        if out is not None:
            out.close()
            commit(fs, temp, f"{path}/{file}")

    return written(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "file string, ordinal long, doc_id long"), "token-files")


def separator_scan(spark: SparkSession, folder: str, files: DataFrame, separator: int = END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal, first (token), n_tokens of each document in the token files named by the column file."""
    names = files.select("file").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                n = -(-fs.get_file_info(f"{path}/{file}").size // block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file] * n, pa.string()), pa.array(range(n), pa.int64())], names=["file", "block"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = opened(folder)
        for batch in batches:
            for file, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(f"{path}/{file}") as f:
                    data = np.frombuffer(f.read_at(min(block_bytes, f.size() - block * block_bytes), block * block_bytes), "<u2")
                found = np.flatnonzero(data == separator) + block * (block_bytes // 2)
                # the separator before each, none before the first
                last = pa.array(np.r_[0, found[:-1]] if len(found) else found, pa.int64(), mask=np.arange(len(found)) == 0)
                each = pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.StructArray.from_arrays([last, pa.array(found, pa.int64())], names=["last", "at"]))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([len(found)], pa.int64()), pa.array([int(found[-1]) if len(found) else None], pa.int64()), each], names=["file", "block", "n", "last", "found"])

    parts = spark.sparkContext.defaultParallelism * 4
    blocks = names.mapInArrow(cut, "file string, block long").repartition(parts, "file", "block")
    hits = blocks.mapInArrow(search, "file string, block long, n long, last long, found array<struct<last: bigint, at: bigint>>")
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    hits = hits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).withColumn("stop", F.coalesce(F.max("last").over(earlier), F.lit(-1)))
    each = hits.select("file", "before", "stop", F.posexplode("found").alias("k", "one"))
    first = F.coalesce(F.col("one.last"), F.col("stop")) + 1
    return each.select("file", (F.col("before") + F.col("k")).alias("ordinal"), first.alias("first"), (F.col("one.at") - first).alias("n_tokens"))


def token_counts(docs: DataFrame, tokenizer: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens of each document, read back from flat token files."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    files = write_token_files(docs, folder, tokenizer)
    # Both sides grow with the documents, so neither is broadcast.
    return files.hint("merge").join(separator_scan(spark, folder, files, block_bytes=block_bytes), ["file", "ordinal"]).select("doc_id", "n_tokens")
