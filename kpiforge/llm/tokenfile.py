"""Token-id files: documents as separately compressed frames under one trained dictionary.

File format (Parquet, so that any store Spark writes to can hold it; rows are
segments in ascending doc_id order):

* ``dictionary`` folder: one row (hash, width, end_id, dictionary); hash is the SHA-256 of the
  zstandard dictionary, width the bytes of one id (2 or 4, little-endian);
* ``segments`` folder: part, segment, first_doc, last_doc, n_docs, n_tokens, part_start (ids of the part
  before the segment), dict_hash, doc_ids (int64 array), counts (int64 array of ids per document),
  offsets (int64 array, one more than documents: where each frame begins), frames (each document
  compressed on its own).

One short document is read by its segment's row (first_doc and last_doc are
pushed down to the Parquet scan) and the decompression of its own frame.

The dictionary is a model fitted on a bounded sample: the ``DICTIONARY_SLICES``
slices of ``SLICE_BYTES`` with the smallest hashes, out of all slices of all
documents. Everything else covers every id of every document.

Defined results: a null text is empty; an empty text has the end id alone; a
text of any length is one frame; repeated rows are separate documents in
ascending order of doc_id, then the hash of their ids; a null doc_id comes first
(stored as the smallest long); an empty table gives no segments and no rows; extra
columns are ignored. The rows of one doc_id, equal ones too, are dealt over several
parts where they are many.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, map_text, scratch_path, ship_package, stage
from kpiforge.llm.vocab import encode_words, tokenizer
from kpiforge.llm.wordblocks import BatchEncoder, bare_spans, row_offsets

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
DICTIONARY_BYTES = 32 << 10
DICTIONARY_SLICES = 2048
SLICE_BYTES = 4096
SEGMENT_BYTES = 1 << 20  # compressed bytes after which a segment ends
LEVEL = 3
NO_ID = -(2**63)


@lru_cache(maxsize=2)
def _encoder(path: str) -> BatchEncoder:
    return BatchEncoder(bare_spans, lambda words: encode_words(path, words), fold=True)


def id_width(path: str) -> int:
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def encoded(docs: DataFrame, path: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """(doc_id, n_tokens, ids): the little-endian ids of every whole text, with the end id."""
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if id_width(path) == 2 else "<u4"
        for i, j, counts, rows, ids in _encoder(path).batch(batch.column(1)):
            off = row_offsets(counts, rows)
            flat = np.insert(ids.astype(kind), off[1:], end_id)
            size = flat.itemsize
            off = (off + np.arange(len(off))) * size
            raw = flat.tobytes()
            values = pa.array([raw[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(off) // size), values],
                ["doc_id", "n_tokens", "ids"])

    return map_text(docs, ["doc_id", "text"], "doc_id long, n_tokens long, ids binary", run)


def train_dictionary(tokens: DataFrame, slices: int = DICTIONARY_SLICES, slice_bytes: int = SLICE_BYTES,
                     size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the id arrays, from the slices with the smallest hashes.

    The slices are counted first, so that only those whose hash can be among
    the smallest leave their tasks: about 1.25 * slices of slice_bytes in all,
    at any input size. With too few samples to train on, the dictionary is the
    samples' own bytes (raw content).
    """
    long_enough = tokens.where("length(ids) >= 64")
    last = F.floor((F.length("ids") - 1) / slice_bytes).cast("int")
    total = long_enough.agg(F.sum(last + 1)).first()[0] or 1
    highest = min(2**63 - 1, int(1.25 * slices / total * 2**64) - 2**63)
    pieces = long_enough.select("doc_id", "ids", F.explode(F.sequence(F.lit(0), last)).alias("slice")).select(
        "doc_id", "slice", F.substring("ids", F.col("slice") * slice_bytes + 1, F.lit(slice_bytes)).alias("piece"))
    rows = (pieces.select(F.xxhash64("doc_id", "slice", "piece").alias("rank"), "piece")
            .where(F.col("rank") <= F.lit(highest)).orderBy("rank", "piece").limit(slices))
    samples = [bytes(r.piece) for r in rows.select("piece").collect()]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"\0" * 16


def _segment(rows: list[tuple[int, int, bytes]]) -> dict:
    sizes = [len(frame) for _, _, frame in rows]
    return {"first_doc": rows[0][0], "last_doc": rows[-1][0], "n_docs": len(rows),
            "n_tokens": sum(n for _, n, _ in rows),
            "doc_ids": np.array([d for d, _, _ in rows], "<i8").tobytes(),
            "counts": np.array([n for _, n, _ in rows], "<i8").tobytes(),
            "offsets": np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(),
            "frames": b"".join(frame for _, _, frame in rows)}


SEGMENTS = ("part int, segment int, first_doc long, last_doc long, n_docs long, n_tokens long, part_start long, "
            "dict_hash string, doc_ids binary, counts binary, offsets binary, frames binary")


def write_files(tokens: DataFrame, path: str, dictionary: bytes, width: int, end_id: int = END_ID) -> None:
    """Write the files of the format below ``path``, in ascending doc_id order; ``tokens`` is a written table."""
    spark = tokens.sparkSession
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, width, end_id, bytearray(dictionary))],
                          "hash string, width int, end_id int, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary))
        held, size, number, before = [], 0, 0, 0

        def flush():
            nonlocal held, size, number, before
            row = {"part": part, "segment": number, "part_start": before, "dict_hash": digest, **_segment(held)}
            before, number, held, size = before + row["n_tokens"], number + 1, [], 0
            names = [f.split()[0] for f in SEGMENTS.split(", ")]
            kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            return pa.RecordBatch.from_arrays(
                [pa.array([row[n]], kinds[f.split()[1]]) for n, f in zip(names, SEGMENTS.split(", "))], names)

        for batch in batches:
            for doc, n, ids in zip(*(batch.column(c) for c in range(3))):
                frame = pack.compress(ids.as_buffer())
                held.append((doc.as_py(), n.as_py(), frame))
                size += len(frame)
                if size >= SEGMENT_BYTES:
                    yield flush()
        if held:
            yield flush()

    ship_package(spark)
    # The place in the written table only tells equal rows apart, so that a range can end among them.
    keys = ["doc_id", "rank", "place"]
    ordered = tokens.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_tokens", "ids",
                            F.xxhash64("ids").alias("rank"), F.monotonically_increasing_id().alias("place"))
    ordered = ordered.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "n_tokens", "ids")
    ordered.mapInArrow(run, SEGMENTS).write.option("compression", "uncompressed").parquet(f"{path}/segments")


def _frames(row: dict, unpack: zstandard.ZstdDecompressor) -> Iterator[tuple[int, bytes]]:
    docs, cut = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["offsets"], "<i8").tolist()
    view = memoryview(row["frames"])
    for doc, a, b in zip(docs.tolist(), cut[:-1], cut[1:]):
        yield doc, unpack.decompress(view[a:b])


def _unpacker(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    head = spark.read.parquet(f"{path}/dictionary").first()
    return head.hash, head.width, bytes(head.dictionary)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files.

    start counts the ids of all documents before. A running total over the
    parts (one row per file) gives where each part begins.
    """
    digest, width, dictionary = _unpacker(spark, path)
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments")
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    base = broadcast_if_small(stage(
        parts.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base")), "part-starts"))
    rows = segments.join(base, "part").select(
        (F.col("base") + F.col("part_start")).alias("start"), "dict_hash", "doc_ids", "offsets", "frames")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                if row["dict_hash"] != digest:
                    raise ValueError("a segment was written under another dictionary")
                docs, counts, sums = [], [], []
                for doc, raw in _frames(row, unpack):
                    ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                    docs.append(None if doc == NO_ID else doc)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                counts = np.array(counts, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(row["start"] + np.cumsum(counts) - counts),
                     pa.array(counts), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    ship_package(spark)
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the named documents: only their segments are read, only their frames decompressed."""
    digest, width, dictionary = _unpacker(spark, path)
    wanted = set(doc_ids)
    near = F.lit(False)
    for doc in wanted:
        near = near | ((F.col("first_doc") <= doc) & (F.col("last_doc") >= doc))
    segments = spark.read.schema(SEGMENTS).parquet(f"{path}/segments").where(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for k in range(batch.num_rows):
                docs = np.frombuffer(batch.column("doc_ids")[k].as_py(), "<i8")
                cut = np.frombuffer(batch.column("offsets")[k].as_py(), "<i8")
                view = memoryview(batch.column("frames")[k].as_py())
                at = [i for i, d in enumerate(docs.tolist()) if d in wanted]
                ids = [np.frombuffer(unpack.decompress(view[cut[i]:cut[i + 1]]), f"<u{width}").astype(np.int64)
                       for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(docs[at]), pa.array(ids, pa.list_(pa.int64()))],
                                                 ["doc_id", "ids"])

    ship_package(spark)
    return segments.select("doc_ids", "offsets", "frames").mapInArrow(run, "doc_id long, ids array<long>")


def token_files(docs: DataFrame, path: str | None = None, tokenizer_path: str = TOKENIZER,
                end_id: int = END_ID) -> str:
    """Encode the documents into files below ``path`` (default: the shared scratch folder); returns the path."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "token-files")
    tokens = stage(encoded(docs, tokenizer_path, end_id), "tokens")
    write_files(tokens, path, train_dictionary(tokens), id_width(tokenizer_path), end_id)
    return path
