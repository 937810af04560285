"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 7).

A global distinct-word shuffle: texts are cut into pre-tokens with positions, every distinct pre-token is
encoded once in the whole job, and its ids go back to the positions. Positions stay with their chunk of documents, in a
stored table; what is shuffled by word is one row for each distinct pre-token of a chunk. A pre-token that stands in every
chunk is joined back in groups of chunks, so no task gets more than ``GROUP`` rows of one word.

Null and empty texts give an empty list. White space is text. Special tokens are never made.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from . import textkernel as tk

#: Where the vocabulary files lie; any operator takes another path as a parameter.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")

#: The pattern that goes with the rank file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Characters of text in a chunk; a longer single document is a chunk of its own.
CHUNK_CHARS = 3_000_000

#: Chunks whose equal pre-tokens meet in one join key.
GROUP = 4096

_CHUNKS = "chunk long, docs binary, sizes binary, words array<string>, counts binary, positions binary"
_encoders: dict = {}


def rank_file(path: str) -> dict[bytes, int]:
    """The vocabulary of a tiktoken rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def encoder(path: str):
    """The tokenizer of a rank file, loaded once in a process."""
    if path not in _encoders:
        import tiktoken

        _encoders[path] = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=rank_file(path), special_tokens={})
    return _encoders[path]


def _chunk_row(chunk: int, keys: list, pieces: list[list[str]]) -> pa.RecordBatch:
    """A chunk's documents with their piece counts, its distinct pieces, and where each of them stands."""
    sizes = np.fromiter(map(len, pieces), np.int32, len(pieces))
    flat = pa.array([w for p in pieces for w in p], pa.large_string()).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False)
    n = len(flat.dictionary)
    order = np.argsort(codes, kind="stable")
    counts = np.bincount(codes, minlength=n).astype(np.int32)
    starts = np.cumsum(counts) - counts
    deltas = np.diff(order, prepend=0)
    deltas[starts] = order[starts]
    words = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), flat.dictionary.cast(pa.string()))
    binary = lambda x: pa.array([x], pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array([chunk], pa.int64()), binary(np.array(keys, np.int64).tobytes()), binary(sizes.tobytes()), words, binary(counts.tobytes()), binary(tk.packed(deltas))],
        names=["chunk", "docs", "sizes", "words", "counts", "positions"],
    )


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import regex
    from pyspark import TaskContext

    find = regex.compile(PATTERN).findall
    chunk = TaskContext.get().partitionId() << 32
    keys, pieces, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if size and size + len(text or "") > CHUNK_CHARS:
                yield _chunk_row(chunk, keys, pieces)
                chunk, keys, pieces, size = chunk + 1, [], [], 0
            keys.append(key)
            pieces.append(find(text) if text else [])
            size += len(text or "") + 1
    if keys:
        yield _chunk_row(chunk, keys, pieces)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = encoder(path)._core_bpe.encode_single_piece
        for b in batches:
            ids = [single(w.encode()) for w in b.column("word").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _rows(head: tuple[bytes, ...], lens: np.ndarray, flat: np.ndarray, key: str) -> pa.RecordBatch:
    """Put the ids of a chunk's pieces, ``lens`` of each, at their positions and cut the chunk into documents."""
    keys, sizes, counts = np.frombuffer(head[0], np.int64), np.frombuffer(head[1], np.int32), np.frombuffer(head[2], np.int32)
    n = int(sizes.sum(dtype=np.int64))
    piece, width = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        at = tk.unpacked(head[3]).astype(np.int64)
        total, first = np.cumsum(at), np.cumsum(counts) - counts
        at = total - np.repeat(total[first] - at[first], counts)
        piece[at] = np.repeat(np.cumsum(lens) - lens, counts)
        width[at] = np.repeat(lens, counts)
    begin = np.cumsum(width) - width
    values = flat[np.repeat(piece - begin, width) + np.arange(int(width.sum()))]
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    offsets = np.concatenate([begin, [len(values)]])[ends] if n else np.zeros(len(keys) + 1, np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)))], names=[key, "ids"]
    )


def _join_back(key: str):
    """A chunk's stored row, then the ids of its words in their order, to its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, lens, ids = None, None, [], []

        def done() -> pa.RecordBatch:
            none = np.zeros(0, np.int64)
            return _rows(head, np.concatenate([none, *lens]), np.concatenate([none, *ids]), key)

        for b in batches:
            chunks = b.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
            for x, y in zip(cuts, cuts[1:]):
                if x == y:
                    continue
                if chunks[x] != now:
                    if head:
                        yield done()
                    now, lens, ids = chunks[x], [], []
                    head = tuple(b.column(c)[x].as_py() for c in ("docs", "sizes", "counts", "positions"))
                    x += 1
                lists = b.column("ids").slice(x, y - x)
                ends = lists.offsets.to_numpy().astype(np.int64)
                lens.append(np.diff(ends))
                ids.append(lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]])
        if head:
            yield done()

    return run


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, group: int = GROUP) -> DataFrame:
    """(key, ids array<int>), one row for each input row.

    ``key`` must be a bigint and not null; equal keys give equal many rows. A null or an empty text has the
    empty list. Other columns are not looked at, whatever their names.
    """
    path = path or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).filter("k is not null")
    chunks = materialize(texts.mapInArrow(_cut, _CHUNKS))
    groups = max(1, -(-chunks.count() // group))
    words = chunks.select("chunk", F.pmod(F.xxhash64("chunk"), F.lit(groups)).cast("int").alias("part"), F.posexplode("words").alias("at", "word"))
    coded = words.select("word").distinct().mapInArrow(_encode(path), "word string, ids array<int>")
    if groups > 1:  # one row of a word for each group of chunks that has it
        coded = words.select("word", "part").distinct().join(coded, "word")
    else:
        coded = coded.withColumn("part", F.lit(0))
    ids = words.join(coded, ["word", "part"]).select("chunk", "at", "ids", *[F.lit(None).cast("binary").alias(c) for c in ("docs", "sizes", "counts", "positions")])
    heads = chunks.select("chunk", F.lit(-1).alias("at"), F.lit(None).cast("array<int>").alias("ids"), "docs", "sizes", "counts", "positions")
    both = heads.unionByName(ids).repartition("chunk").sortWithinPartitions("chunk", "at")
    return both.mapInArrow(_join_back(key), f"{key} long, ids array<int>")


def token_table(spark, path: str | None = None) -> DataFrame:
    """(id, piece binary): the vocabulary as a table of fixed size."""
    ranks = rank_file(path or f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken")
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "id int, piece binary")


def decode_corpus(coded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text): the ids back to text, by a join of positions with the token-byte table.

    The table is the vocabulary, of fixed size, so it may be broadcast. Positions are packed in blocks of
    1,024, so no aggregation buffer grows with the length of a text before its blocks are joined up.
    An empty or null list gives the empty text.
    """
    pieces = F.broadcast(token_table(coded.sparkSession, path))
    at = coded.select(key, F.posexplode(ids).alias("at", "id")).join(pieces, "id")
    block = at.groupBy(key, (F.col("at") / 1024).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("at", F.hex("piece").alias("h")))).alias("p")
    )
    block = block.select(key, "block", F.concat_ws("", F.col("p.h")).alias("h"))
    whole = block.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("block", "h"))).alias("p"))
    whole = whole.select(F.col(key).alias("_k"), F.decode(F.unhex(F.concat_ws("", F.col("p.h"))), "UTF-8").alias("text"))
    return coded.select(key).join(whole, F.col(key) == F.col("_k"), "left").select(key, F.coalesce("text", F.lit("")).alias("text"))
