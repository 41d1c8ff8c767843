"""Token ids of whole texts in flat binary files: unsigned integers and 64-bit document offsets.

Layout of a data set in one folder, part by part in ascending doc_id order:

  part-00000.ids   little-endian unsigned ids, 16 bits where the vocabulary allows, else 32
  part-00000.off   little-endian 64-bit: n + 1 offsets in ids within the part
  part-00000.doc   little-endian 64-bit: the n doc_ids

A part holds one range of doc_ids. Its base, the ids in all parts before it, is a prefix sum over the
manifest (one row a part). Files appear under their final names by a rename when they are whole, so a
task that runs again writes the same files again. Readers map the files into memory where the folder
is a mounted one and read them through the file system's client elsewhere.

A part takes about PART_BYTES of text, a range of doc_id and, where many rows share an id, of their texts'
first 32 characters, hashes and places; its ids go to the file batch by batch, so a task holds one batch, and
readers take SLICE bytes of ids at a time.

Defined results: null and empty texts have the end id alone; texts of any length are written whole. Rows
that share an id follow each other by their text's first 32 characters and then by its hash, rows that are alike in any order. A null id sorts first and
reads back as null (stored as the least 64-bit integer). An empty table gives no part and an empty result.
Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, once, texts, tune

NULL_ID = -(2**63)
#: Bytes of text that a part takes, about.
PART_BYTES = 48 << 20
#: Bytes of ids that a reader takes at a time.
SLICE = 8 << 20


class ByteBpe:
    """Byte-level BPE ids as the tokenizers library gives them for its file.

    The same merges as tiktoken ranks run four times as fast and give the same ids: tests hold both against
    each other on every vocabulary string and every code point in several surroundings. Special tokens' strings inside texts are those tokens, the library's default.
    """

    def __init__(self, file: str, ranks_file: str, pattern: str, special: dict[str, int]):
        import base64

        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ids", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.size = max(*ranks.values(), *special.values()) + 1

    def ids(self, text: str) -> list[int]:
        return self.encoding.encode(text, allowed_special="all")


def folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder as Spark names it."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def _publish(where: fs.FileSystem, draft: str, path: str) -> None:
    try:
        where.move(draft, path)
    except OSError:  # not every store renames over what an earlier attempt of the task has left
        where.delete_file(path)
        where.move(draft, path)


def _get(where: fs.FileSystem, path: str, dtype: str) -> np.ndarray:
    if isinstance(where, fs.LocalFileSystem) and where.get_file_info(path).size:
        return np.memmap(path, dtype=dtype, mode="r")
    with where.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype)


def _slices(where: fs.FileSystem, path: str, dtype: str, off: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Documents i to j - 1 of a part and their ids, about SLICE bytes at a time: mapped where the folder is mounted, read from their place elsewhere."""
    width, n = np.dtype(dtype).itemsize, len(off) - 1
    step = SLICE // width
    cuts = [0, *(np.flatnonzero(np.diff(off[1:] // step)) + 1).tolist(), n]
    if isinstance(where, fs.LocalFileSystem) and where.get_file_info(path).size:
        whole = np.memmap(path, dtype=dtype, mode="r")
        yield from ((i, j, whole[off[i] : off[j]]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j)
        return
    with where.open_input_file(path) as f:
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i < j:
                yield i, j, np.frombuffer(f.read_at(int(off[j] - off[i]) * width, int(off[i]) * width), dtype)


def write(docs: DataFrame, uri: str, bpe: dict, end: int = 0) -> DataFrame:
    """Writes docs (doc_id, text) to the folder uri. Returns the manifest: part, n_docs, n_ids, base, bits."""
    spark = docs.sparkSession
    tune(spark)
    where, path = folder(uri)
    where.create_dir(path, recursive=True)
    plain = texts(docs, "doc_id", "text").select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), "text")
    size = plain.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    # rows of one id are dealt by their text's head and hash, equal rows by their place: no part takes all of them
    order = ["doc_id", "head", "hash", "at"]
    plain = plain.select("doc_id", "text", F.coalesce(F.substring("text", 1, 32), F.lit("")).alias("head"), F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("at"))
    sliced = plain.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = once(("byte-bpe", bpe["file"]), lambda: ByteBpe(**bpe))
        kind = np.dtype("<u2" if coder.size <= 1 << 16 else "<u4")
        part, (store, base), own = TaskContext.get().partitionId(), folder(uri), uuid.uuid4().hex
        names = {x: f"{base}/part-{part:05d}.{x}" for x in ("ids", "off", "doc")}
        n_docs = n_ids = 0
        with ExitStack() as stack:
            files = {}
            for batch in batches:
                if not files:
                    files = {x: stack.enter_context(store.open_output_stream(f"{path}.{own}")) for x, path in names.items()}
                    files["off"].write(np.zeros(1, "<i8").tobytes())
                found = [[*coder.ids(t or ""), end] for t in batch.column(1).to_pylist()]
                offsets = n_ids + np.cumsum([len(f) for f in found])
                files["ids"].write(np.array([i for f in found for i in f], kind).tobytes())
                files["off"].write(offsets.astype("<i8").tobytes())
                files["doc"].write(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                n_docs, n_ids = n_docs + len(found), int(offsets[-1])
        if not n_docs:
            return
        for path in names.values():
            _publish(store, f"{path}.{own}", path)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part]), "n_docs": pa.array([n_docs]), "n_ids": pa.array([n_ids]), "bits": pa.array([kind.itemsize * 8])})

    manifest = sliced.mapInArrow(run, "part long, n_docs long, n_ids long, bits long")
    manifest = Scratch(spark, "token-ids-manifest").keep(manifest, "parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part of PART_BYTES
    return manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files of the manifest's parts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = folder(uri)
        for batch in batches:
            for part, base, bits in zip(*(batch.column(c).to_pylist() for c in ("part", "base", "bits")), strict=True):
                name = f"{path}/part-{part:05d}"
                off, doc = (_get(store, f"{name}.{x}", "<i8") for x in ("off", "doc"))
                for i, j, ids in _slices(store, f"{name}.ids", f"<u{bits // 8}", off):
                    ends = (off[i : j + 1] - off[i]).tolist()
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:], strict=False)]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([d if d != NULL_ID else None for d in doc[i:j].tolist()], pa.int64()), "start": pa.array(base + off[i:j], pa.int64()),
                        "n_tokens": pa.array(np.diff(off[i : j + 1]), pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                    })

    spread = manifest.select("part", "base", "bits").repartition(max(1, manifest.count()), "part")
    return spread.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, bpe: dict, end: int = 0) -> DataFrame:
    """Writes docs to a new folder in the shared one and reads every document's row back from the files."""
    spark = docs.sparkSession
    uri = Scratch(spark, "token-ids").path("files")  # goes with the session
    return read(spark, uri, write(docs, uri, bpe, end))
