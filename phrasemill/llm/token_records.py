"""Token ids as length-delimited binary records with an offset index (operator 10).

A record: length of the payload (u64), its masked checksum (u32), payload, masked checksum of the payload (u32), one
newline; all little-endian. Payload: id of the document (i64), then its token ids as u16 or u32. The checksum is CRC-32
(zlib), masked by a rotation of 15 bits plus 0xA282EAD8, so that checksums of data that hold checksums stay independent.
Files follow the order of the document ids. The index, a Parquet table, has the file, offset, length and tokens of
each record, so that readers can shuffle records without scanning the files.

Documents are range-partitioned by id and text hash, so that one id with very many rows fills no single task, and sorted before encoding.
There are as many partitions as it takes for files of FILE_BYTES of text on average; each task writes its own file through Spark's writer, which commits whole files only and reaches any file system that Spark does, and the files are read back
by Spark as well. The index is built from what was read: a flipped bit in a file raises ValueError. read_records() takes any rows of
the index, in any order, and cuts their records out of the files at their offsets.

Results: null and empty texts give a record of the end id alone; repeated ids give a record each, in the order of their texts' hashes; an empty
table gives no records. A null id is written as the smallest 64-bit integer, comes first and is read back as null. Only the id and text columns
are read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ChunkStore
from .common import map_texts, materialize, new_path

MASK = 0xA282EAD8
NO_ID = -(1 << 63)
END = b"\n"
#: Bytes of text whose records make one file. Readers get a file as one value, which Spark limits to 2 GB.
FILE_BYTES = 1 << 26
INDEX = "file string, doc_id bigint, place bigint, byte_offset bigint, byte_length bigint, n_tokens bigint, ids_crc32 bigint"


def masked(data: bytes | memoryview) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(doc_id: int, ids: np.ndarray) -> bytes:
    """One record."""
    payload = struct.pack("<q", doc_id) + ids.tobytes()
    size = struct.pack("<Q", len(payload))
    return b"".join([size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload)), END])


def frames(content: bytes | memoryview):
    """(offset, length, doc_id, payload's ids as bytes) of each record; ValueError where a checksum or length is wrong."""
    data, at = memoryview(content), 0
    while at < len(data):
        size = data[at : at + 8]
        if len(size) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(size):
            raise ValueError(f"a record's length is damaged at byte {at}")
        n = struct.unpack("<Q", size)[0]
        payload = data[at + 12 : at + 12 + n]
        if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
            raise ValueError(f"a record is damaged at byte {at}")
        yield at, n + 17, struct.unpack_from("<q", payload)[0], payload[8:]
        at += n + 17


class Encoder(ChunkStore):
    """Encodes texts with the tokenizers library, each distinct chunk once.

    That is exact for a byte-level pre-tokenizer without prefix space and normalizer; with any other the library gets the texts
    one by one. With `added` the strings of added tokens in a text become these tokens, as the library does by default: it gets
    each text that holds one by itself. Otherwise they are ordinary text.
    """

    def __init__(self, content: str, added: bool = False) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.encode_special_tokens = True
        self.content, self._whole = content, None
        config = json.loads(content)
        before = config.get("pre_tokenizer") or {}
        self.by_chunk = config.get("normalizer") is None and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        tokens = (config.get("added_tokens") or []) if added else []
        self.added = [t["content"] for t in tokens]
        self.by_chunk = self.by_chunk and all(t["special"] for t in tokens)
        # A byte-level token has a character for each of its bytes.
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.width = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.width[list(vocabulary.values())] = list(map(len, vocabulary))

    @property
    def whole(self):
        """The library as it is, loaded when a text needs it."""
        if not self.added:
            return self.tokenizer
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self.content)
        return self._whole

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        ids = np.concatenate(rows)
        return ids, np.array([len(r) for r in rows]), self.width[ids]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        alone = [i for i, t in enumerate(texts) if not self.by_chunk or t and any(a in t for a in self.added)]
        if not alone:
            return super().encode(texts)
        rows = [np.zeros(0, np.int32)] * len(texts)
        if len(alone) < len(texts):
            hidden = set(alone)
            ids, edges = super().encode([None if i in hidden else t for i, t in enumerate(texts)])
            rows = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, e in zip(alone, self.whole.encode_batch_fast([texts[i] or "" for i in alone], add_special_tokens=False), strict=True):
            rows[i] = np.array(e.ids, np.int32)
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def _encoder(content: str, added: bool) -> Encoder:
    """One encoder a worker process: a later task finds it loaded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if (content, added) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[content, added] = Encoder(content, added)
    return _ENCODERS[content, added]


def write_records(docs: DataFrame, tokenizer_path: str, out: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> bool:
    """Writes the records of docs, in ascending order of id, as files under `out`; returns whether ids take 32 bits. `added`: see Encoder."""
    with open(tokenizer_path, encoding="utf-8") as file:
        content = file.read()
    from tokenizers import Tokenizer

    kind = np.uint16 if max(Tokenizer.from_str(content).get_vocab_size(), end_id + 1) <= 1 << 16 else np.uint32
    shared = docs.sparkSession.sparkContext.broadcast(content)
    given = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    given = given.withColumn("h", F.xxhash64("text"))
    ordered = given.repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h")

    def make():
        coder = _encoder(shared.value, added)

        def work(keys, texts):
            ids, edges = coder.encode(texts)
            ids, edges = ids.astype(kind), edges.tolist()
            rows = [frame(k, np.append(ids[a:b], kind(end_id))) for k, a, b in zip(keys.to_pylist(), edges[:-1], edges[1:], strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

        return work

    # The writer of text puts a newline, the record's last byte, after each value, and copies the bytes as they are.
    records = map_texts(ordered, "doc_id", "text", "record binary", make)
    records.select(F.expr("cast(substring(record, 1, length(record) - 1) as string)").alias("value")).write.option("compression", "none").text(out)
    return kind is np.uint32


def index_records(spark: SparkSession, folder: str, wide: bool = False) -> DataFrame:
    """The offset index, read from the files: each record's checksums are verified."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns, tokens = [[] for _ in range(6)], 0
                for at, size, doc, ids in frames(content.as_buffer()):
                    values = np.frombuffer(ids, np.uint32 if wide else np.uint16).astype("<u4")
                    for c, x in zip(columns, (doc, tokens, at, size, len(values), zlib.crc32(values)), strict=True):
                        c.append(x)
                    tokens += len(values)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(columns[0]), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], [f.split()[0] for f in INDEX.split(", ")])

    return files.select("path", "content").mapInArrow(run, INDEX)


def read_records(wanted: DataFrame, wide: bool = False) -> DataFrame:
    """(file, byte_offset, doc_id, ids) of rows of the index: each record is cut out of its file at its offset, and its checksums are verified.

    Files without a wanted record are not loaded. For a shuffled reading order the index in random order by parts.
    """
    spark = wanted.sparkSession
    files = [r["file"] for r in wanted.select("file").distinct().collect()]
    schema = "file string, byte_offset bigint, doc_id bigint, ids array<int>"
    if not files:
        return spark.createDataFrame([], schema)
    spots = wanted.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("byte_offset", "byte_length"))).alias("spots"))
    # The path of a file is escaped in the index as in the scan, but not where it is loaded.
    loaded = spark.read.format("binaryFile").load([unquote(f) for f in files]).select(F.col("path").alias("file"), "content")

    def run(batches):
        kind = np.uint32 if wide else np.uint16
        for batch in batches:
            for path, content, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data = memoryview(content.as_buffer())
                for first in range(0, len(own), 1024):
                    some = own[first : first + 1024]
                    got = [next(frames(data[s["byte_offset"] : s["byte_offset"] + s["byte_length"]])) for s in some]
                    columns = [pa.array([path] * len(some)), pa.array([s["byte_offset"] for s in some], pa.int64())]
                    columns.append(pa.array([None if doc == NO_ID else doc for _, _, doc, _ in got], pa.int64()))
                    columns.append(pa.array([np.frombuffer(ids, kind).astype(np.int32) for _, _, _, ids in got], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, ["file", "byte_offset", "doc_id", "ids"])

    return loaded.join(spots, "file").select("file", "content", "spots").mapInArrow(run, schema)


def read_positions(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): start counts the ids of all records before. The sums run over files, not records."""
    files = index.groupBy("file").agg(F.min("doc_id").alias("first"), F.sum("n_tokens").alias("tokens"))
    before = files.select("file", F.coalesce(F.sum("tokens").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return index.join(before, "file").select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Writes docs as records, reads the files back and returns the position of each document. `added`: see Encoder."""
    spark = docs.sparkSession
    out = new_path(spark, "records")
    wide = write_records(docs, tokenizer_path, out, end_id, id_col, text_col, added)
    return read_positions(materialize(index_records(spark, out, wide), "record-index"))
