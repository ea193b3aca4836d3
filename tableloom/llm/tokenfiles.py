"""Token ids in files: frequency ranks in byte-aligned variable length, read back with table lookups.

A folder holds ``vocabulary.bin`` (the ids by falling frequency, as unsigned
32-bit integers) and one file for each range of documents, in ascending order.
A file is a run of blocks:

    magic "TLB1", then unsigned: documents 32, ids 64, control bytes 64, data bytes 64
    documents: doc_id int64, null flag int8, ids in this block int64, first ids here int8
    control bytes: two bits for each id, its number of data bytes less one, four ids in a byte from the low bits
    data bytes: the rank of each id, little-endian

A document of more ids than a block holds goes on in the next block.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tableloom.llm.tokens import VOCABULARY, encoder, joined
from tableloom.session import local_frame, materialise, scratch_dir

MAGIC = b"TLB1"
HEAD = struct.Struct("<4sIQQQ")
BLOCK = 1 << 18  # ids in a block, about
VOCABULARY_FILE = "vocabulary.bin"
IDS = "<u4"

_CODES = np.stack([(np.arange(256) >> (2 * k)) & 3 for k in range(4)], axis=1).astype(np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    r = ranks.astype(np.uint32)
    code = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, dtype=np.uint8)
    padded[: len(r)] = code
    four = padded.reshape(-1, 4)
    control = four[:, 0] | four[:, 1] << 2 | four[:, 2] << 4 | four[:, 3] << 6
    width = int(code.max()) + 1 if len(code) else 1
    used = np.arange(width, dtype=np.uint8)[None, :] <= code[:, None]
    return control.astype(np.uint8).tobytes(), r.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width][used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The numbers again: code lengths by table, then one read for each byte position."""
    code = _CODES[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(code.astype(np.int64) + 1)
    at = ends - code - 1
    raw = np.frombuffer(data, dtype=np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(code >= k)
        if not len(more):
            break
        ranks[more] |= raw[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


class _Writer:
    """Blocks into a file that gets its name when it is whole, so a repeated task leaves one whole file."""

    def __init__(self, path: str, code: Callable[[np.ndarray], tuple[bytes, bytes]]):
        self.system, self.path = _system(path)
        self.code, self.part = code, f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.system.open_output_stream(self.part, compression=None)
        self.documents, self.ids, self.held = [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        for k in range(0, len(ids), BLOCK):
            piece = ids[k : k + BLOCK]
            self.documents.append((doc_id or 0, doc_id is None, len(piece), k == 0))
            self.ids.append(piece)
            self.held += len(piece)
            if self.held >= BLOCK:
                self._flush()

    def _flush(self) -> None:
        if not self.documents:
            return
        self.block([np.array(c, dtype=k) for c, k in zip(zip(*self.documents), ("<i8", "i1", "<i8", "i1"), strict=True)], np.concatenate(self.ids))
        self.documents, self.ids, self.held = [], [], 0

    def block(self, documents: list[np.ndarray], ids: np.ndarray) -> None:
        """Write one whole block: the columns of its documents and all their ids."""
        control, data = self.code(ids)
        self.out.write(HEAD.pack(MAGIC, len(documents[0]), len(ids), len(control), len(data)))
        for column in documents:
            self.out.write(column.tobytes())
        self.out.write(control)
        self.out.write(data)

    def close(self) -> None:
        self._flush()
        self.out.close()
        self.system.move(self.part, self.path)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; every executor reaches it by itself."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path)


def _blocks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, bytes, bytes]]:
    system, name = _system(path)
    with system.open_input_stream(name, compression=None) as file:
        while head := file.read(HEAD.size):
            magic, docs, n, controls, size = HEAD.unpack(head)
            if magic != MAGIC:
                raise ValueError(f"{path} is not a token file")
            columns = [np.frombuffer(file.read(docs * w), dtype=k) for w, k in ((8, "<i8"), (1, "i1"), (8, "<i8"), (1, "i1"))]
            yield *columns, n, file.read(controls), file.read(size)


def _documents(path: str, decode: Callable[[bytes, bytes, int], np.ndarray]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Each document of a file with all its ids."""
    doc_id, parts = None, []
    for ids, nulls, lengths, firsts, n, control, data in _blocks(path):
        values = decode(control, data, n)
        ends = np.cumsum(lengths)
        for k, end in enumerate(ends.tolist()):
            if firsts[k] and parts:
                yield doc_id, np.concatenate(parts)
                parts = []
            doc_id = None if nulls[k] else int(ids[k])
            parts.append(values[end - lengths[k] : end])
    if parts:
        yield doc_id, np.concatenate(parts)


def _raw_code(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as they are, in two bytes each where they fit."""
    return b"", ids.astype("<u2" if not len(ids) or ids.max() < 1 << 16 else IDS).tobytes()


def _raw_decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if len(data) == 2 * n else IDS)


def _exists(path: str) -> bool:
    system, name = _system(path)
    return system.get_file_info(name).type == fs.FileType.File


def _remove(path: str) -> None:
    if _exists(path):
        system, name = _system(path)
        system.delete_file(name)


def _per_file(spark: SparkSession, names: list[str], work: Callable[[str], Iterator[tuple]], schema: str) -> DataFrame:
    """``work`` on each file, one task for each."""

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["name"]:
                rows = []
                for row in work(name):
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=kinds.names)
                        rows = []
                yield pd.DataFrame(rows, columns=kinds.names)

    files = local_frame(spark, [(n,) for n in names], "name string")
    return files.repartition(max(len(names), 1)).mapInPandas(run, schema)


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """Write the ids of all documents to ``folder``; one row ``name, docs, n_tokens`` for each file, in order.

    Documents are ordered by id, nulls first, then by text; repeated rows are
    written as often as they occur; a null or empty text has the end id alone;
    an empty table gives no files. Other columns are not read. Texts are dealt
    to ranges of ids once; ids wait in ``folder`` until the frequencies of all
    documents are known, and each waiting file is removed when its ranked file
    is whole.
    """
    spark = docs.sparkSession
    system, path = _system(folder)
    system.create_dir(path, recursive=True)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded, docs_here, tokens = encoder(vocabulary), 0, 0
        counts = np.zeros(encoded.tokenizer.get_vocab_size(), dtype=np.int64)

        def counted(ids: np.ndarray) -> tuple[bytes, bytes]:
            np.add(counts, np.bincount(ids, minlength=len(counts)), out=counts)
            return _raw_code(ids)

        name = f"waiting-{TaskContext.get().partitionId():06d}"
        writer = _Writer(f"{folder}/{name}", counted)
        for batch in joined(batches):
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded.encode_documents(batch.column(1)), strict=True):
                writer.add(doc_id, ids)
                docs_here, tokens = docs_here + 1, tokens + len(ids)
        writer.close()
        used = np.flatnonzero(counts)
        if docs_here:
            names = [name] * (len(used) + 1)
            token = pa.array([None, *used.tolist()], pa.int64())
            n = pa.array([tokens, *counts[used].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(names), token, n, pa.array([docs_here] * len(names), pa.int64())], names=["name", "id", "n", "docs"])
        else:
            _remove(f"{folder}/{name}")

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    seen = materialise(rows.mapInArrow(tokenise, "name string, id bigint, n bigint, docs bigint"), "token-counts")

    # One row for each id of the vocabulary and one for each file reach the driver.
    ranked = seen.where("id IS NOT NULL").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").select("id").toPandas()["id"]
    files = seen.where("id IS NULL").select("name", "docs", "n").orderBy("name").collect()
    order = ranked.to_numpy(np.uint32)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, dtype=np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    with system.open_output_stream(f"{path}/{VOCABULARY_FILE}", compression=None) as out:
        out.write(order.astype(IDS).tobytes())

    def rerank(name: str) -> Iterator[tuple]:
        target = f"{folder}/{name.replace('waiting', 'tokens')}.bin"
        # A task that runs again after its work was whole finds the file.
        if not _exists(target):
            writer = _Writer(target, lambda ids: encode_ranks(rank[ids]))
            # Blocks stay as they are, only their ids are replaced.
            for *documents, n, control, data in _blocks(f"{folder}/{name}"):
                writer.block(documents, _raw_decode(control, data, n))
            writer.close()
        _remove(f"{folder}/{name}")
        yield (target,)

    _per_file(spark, [f.name for f in files], rerank, "name string").collect()
    manifest = [(f"{folder}/{f.name.replace('waiting', 'tokens')}.bin", f.docs, f.n) for f in files]
    return local_frame(spark, manifest, "name string, docs bigint, n_tokens bigint")


def read(spark: SparkSession, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and with ``with_ids`` its ids as bytes.

    ``start`` is the number of ids of all documents before it.
    """
    files = manifest.collect()  # one row for each file
    starts = dict(zip([f.name for f in files], np.cumsum([0, *(f.n_tokens for f in files)]).tolist()))
    if not files:
        schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
        return local_frame(spark, [], schema)
    system, path = _system(files[0].name.rpartition("/")[0])
    with system.open_input_stream(f"{path}/{VOCABULARY_FILE}", compression=None) as file:
        order = np.frombuffer(file.read(), dtype=IDS)

    def documents(name: str) -> Iterator[tuple]:
        start = starts[name]
        for doc_id, ids in _documents(name, lambda control, data, n: order[decode_ranks(control, data, n)]):
            raw = ids.astype(IDS).tobytes()
            row = (doc_id, start, len(ids), zlib.crc32(raw))
            yield (*row, raw) if with_ids else row
            start += len(ids)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return _per_file(spark, [f.name for f in files], documents, schema)


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = False) -> DataFrame:
    """Write all documents to a new folder of the shared scratch space and read them back."""
    spark = docs.sparkSession
    return read(spark, write(docs, scratch_dir(spark, "tokens"), vocabulary), with_ids)
