"""Problem 8: token ids of the whole corpus, each distinct word encoded once.

1. Each task splits its texts into words and codes them by the block's own dictionary (a block is some thousand rows of
   one task); coded texts and dictionaries are written to the shared folder.
2. Dictionary rows are partitioned by word, so that all copies of a word meet in one task, which encodes it once.
3. Ids come back to the block, and each text's ids are looked up by position.
Only dictionaries, never one row per word of a text, are shuffled. ``decode`` goes back through an id-to-piece join.

Defined results: null and empty texts have an empty list; special tokens are ordinary text; a repeated row is encoded
again; ids of one text stand in the order of the text. A word in more blocks than ``BLOCKS_A_TASK`` goes to as many tasks
as there are such numbers of blocks, so that no word makes a task too large; it is encoded once in each of them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import written

TOKENIZERS = "/opt/tokenizers"
#: The published split of byte-level BPE; white space is the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Code points of text in a block; bounds the memory of a task, whatever the number of rows.
BLOCK_CHARS = 3_000_000
BLOCK_ROWS = 20_000
#: Rows that one word may bring to one task.
BLOCKS_A_TASK = 20_000


@lru_cache(maxsize=2)
def encoding(path: str):
    """The public vocabulary under path, read once per process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    # The split is done before: to the tokenizer each word is one piece.
    return tiktoken.Encoding("public", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


def _split(docs: DataFrame, id_col: str, text_col: str, block_chars: int) -> DataFrame:
    """Rows of two kinds: (block, id, codes, null, null) of a text and (block, null, null, word, code) of a dictionary."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, id {id_type}, codes array<int>, word string, code int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        part, serial = TaskContext.get().partitionId() << 32, 0

        def flush(ids, codes, lengths, words):
            n, m = len(codes), len(words)
            offsets = np.zeros(n + m + 1, np.int32)
            offsets[1 : n + 1] = np.cumsum(lengths)
            offsets[n + 1 :] = offsets[n]
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n + m, part + serial, np.int64)),
                    pa.concat_arrays([*ids, pa.nulls(m, ids[0].type)]),
                    lists,
                    pa.concat_arrays([pa.nulls(n, pa.string()), pa.array(list(words), pa.string())]),
                    pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(np.arange(m, dtype=np.int32))]),
                ],
                ["block", "id", "codes", "word", "code"],
            )

        ids, codes, lengths, words, chars = [], [], [], {}, 0
        for batch in batches:
            keys, begin = batch.column(0), 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = find(text) if text else ()
                codes.append(np.fromiter((words.setdefault(w, len(words)) for w in found), np.int32, len(found)))
                lengths.append(len(found))
                chars += len(text or "")
                if chars >= block_chars or len(codes) >= BLOCK_ROWS:
                    yield flush([*ids, keys.slice(begin, i + 1 - begin)], codes, lengths, words)
                    serial, begin = serial + 1, i + 1
                    ids, codes, lengths, words, chars = [], [], [], {}, 0
            if begin < batch.num_rows:
                ids.append(keys.slice(begin))
        if codes:
            yield flush(ids, codes, lengths, words)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _encode_words(words: DataFrame, path: str, salt: int) -> DataFrame:
    """(block, code, ids) from (block, word, code): all copies of a word meet in one task, or in salt ones, one after the other, and it is encoded once there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, ids = encoding(path).encode_ordinary, None, []
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            lists = []
            for word in coded.dictionary.to_pylist():
                if word != last:
                    last, ids = word, encode(word)
                lists.append(ids)
            taken = pa.array(lists, pa.list_(pa.int32())).take(coded.indices)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), taken], ["block", "code", "ids"])

    part = [F.pmod(F.xxhash64("block"), F.lit(salt))] if salt > 1 else []
    return words.repartition("word", *part).sortWithinPartitions("word").select("block", "word", "code").mapInArrow(run, "block long, code int, ids array<int>")


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", block_chars: int = BLOCK_CHARS, salt: int | None = None, lengths_only: bool = False) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens) with lengths_only."""
    split = written(_split(docs, id_col, text_col, block_chars))
    if salt is None:
        salt = 1 + split.select("block").distinct().count() // BLOCKS_A_TASK
    pieces = _encode_words(split.where("word is not null"), path, salt)
    texts = split.where("word is null").select("block", "id", "codes")
    id_type = docs.schema[id_col].dataType.simpleString()

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        codes = left.column("codes").combine_chunks()
        right = right.combine_chunks()
        flat, starts = codes.flatten().to_numpy(zero_copy_only=False), codes.offsets.to_numpy()
        lists = right.column("ids").combine_chunks()
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.chunk(0)
        values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        offsets = offsets - offsets[0] if len(offsets) else offsets
        n = right.num_rows
        begin, count = np.zeros(n, np.int64), np.zeros(n, np.int64)
        order = right.column("code").to_numpy()
        begin[order], count[order] = offsets[:-1], np.diff(offsets)
        each = count[flat]
        ends = np.concatenate([[0], np.cumsum(each)])
        starts = starts - starts[0]
        bounds = ends[starts]
        if lengths_only:
            return pa.table({"id": left.column("id"), "n_tokens": pa.array(np.diff(bounds), pa.int64())})
        at = np.arange(ends[-1]) - np.repeat(ends[:-1], each) + np.repeat(begin[flat], each)
        ids = pa.array(values[at] if len(at) else np.zeros(0, np.int32), pa.int32())
        return pa.table({"id": left.column("id"), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), ids)})

    schema = f"id {id_type}, n_tokens long" if lengths_only else f"id {id_type}, ids array<int>"
    out = texts.groupBy("block").cogroup(pieces.groupBy("block")).applyInArrow(look_up, schema)
    return out.withColumnRenamed("id", id_col)


def with_lengths(docs: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source, n_tokens) of every row of (doc_id, source, text)."""
    keyed = docs.select(F.struct("doc_id", "source").alias("key"), "text")
    return encode(keyed, "key", "text", path, lengths_only=True).select("key.doc_id", "key.source", "n_tokens")


def vocabulary(spark: SparkSession, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, piece) of the public vocabulary."""
    lines = spark.read.text(path).select(F.split("value", " ").alias("x"))
    return lines.select(F.col("x")[1].cast("int").alias("id"), F.unbase64(F.col("x")[0]).alias("piece"))


def decode(encoded: DataFrame, spark: SparkSession, id_col: str = "doc_id", path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """(id, text) through a join with the vocabulary, which a public tokenizer bounds to some 50,000 rows; an empty list gives ''."""
    keyed = encoded.withColumn("__row", F.monotonically_increasing_id()).select("__row", id_col, F.posexplode_outer("ids").alias("pos", "id"))
    pieces = F.broadcast(vocabulary(spark, path))
    joined = keyed.join(pieces, "id", "left").groupBy("__row", id_col).agg(F.sort_array(F.collect_list(F.struct("pos", F.hex("piece").alias("h")))).alias("x"))
    text = F.decode(F.unhex(F.array_join(F.transform("x", lambda p: F.coalesce(p["h"], F.lit(""))), "")), "UTF-8")
    return joined.select(id_col, text.alias("text"))
