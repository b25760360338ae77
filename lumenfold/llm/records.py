"""Token ids in length-delimited binary records with a separate offset index.

A shard is two files. ``*.rec`` holds one record after another:

    length (8 bytes) | masked checksum of these 8 bytes (4) | payload | masked checksum of the payload (4)
    payload: 1 if the id is null else 0 (1) | document id (8) | bytes to an id, 2 or 4 (1) | ids, the end id last

``*.idx`` holds a 16-byte head (magic, number of records) and, for each record in order, offset in ``*.rec`` (8),
number of ids (8): enough to read any record alone, in any order, or to shuffle without reading the payloads.
All integers are little-endian; a checksum is CRC-32 (zlib), masked by a rotation and a constant as is usual for
checksums stored beside what they check. Shards follow ascending document ids. A task writes under a name of its
own attempt and only the attempt that succeeded is named in the manifest, so lost executors leave no half shard.

Defined cases: a null or empty text is a record of the end id alone; null ids come first; rows that repeat an id are
records each, ordered by a hash of their texts; an empty table gives no shard and an empty result.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm.encoding import encoder
from lumenfold.session import materialize, ship

MAGIC = b"LFTOKIDX"
_MASK = 0xA282EAD8
MANIFEST = "shard int, rec string, idx string, records long, ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(read) -> bytes | None:
    """The next payload from ``read(n)``; None at the end; ValueError if a checksum or a length is wrong."""
    head = read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack("<I", head[8:])[0]:
        raise ValueError("damaged length")
    n = struct.unpack("<Q", head[:8])[0]
    body = read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("damaged record")
    return body[:n]


def encode_payload(key: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<BqB", key is None, key or 0, width) + ids


def decode_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, key, width = struct.unpack_from("<BqB", payload)
    return None if null else key, np.frombuffer(payload, f"<u{width}", offset=10)


def write(docs: DataFrame, out_dir: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Writes the shards to ``out_dir`` (any URI that pyarrow opens) and returns their manifest, one row a shard."""
    spark = docs.sparkSession
    ship(spark)

    def shard(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        context = TaskContext.get()
        files, root = fs.FileSystem.from_uri(out_dir)
        files.create_dir(root, recursive=True)
        name = f"{root}/shard-{context.partitionId():06d}-{context.taskAttemptId()}"
        enc = encoder(tokenizer_path, end_id)
        width, offset, total, index, rec = enc.dtype.itemsize, 0, 0, [], None
        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = enc.encode(text.as_py() or "")
                data = frame(encode_payload(key, ids, width))
                rec = rec or files.open_output_stream(f"{name}.rec", buffer_size=1 << 20)
                rec.write(data)
                index.append((offset, len(ids) // width))
                offset, total = offset + len(data), total + len(ids) // width
        if rec is None:
            return
        rec.close()
        with files.open_output_stream(f"{name}.idx") as f:
            f.write(MAGIC + struct.pack("<Q", len(index)) + np.array(index, "<u8").tobytes())
        row = [[context.partitionId()], [f"{name}.rec"], [f"{name}.idx"], [len(index)], [total]]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=["shard", "rec", "idx", "records", "ids"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(text_col).alias("__tie")
    ordered = docs.select(F.col(id_col).cast("long").alias(id_col), text_col, tie).repartitionByRange(n, id_col, "__tie").sortWithinPartitions(id_col, "__tie")
    return materialize(ordered.select(id_col, text_col).mapInArrow(shard, MANIFEST), "token-manifest")


def _read_index(files, path: str) -> np.ndarray:
    with files.open_input_stream(path) as f:
        data = f.read()
    if data[:8] != MAGIC or len(data) != 16 + 16 * struct.unpack_from("<Q", data, 8)[0]:
        raise ValueError(f"damaged index {path}")
    return np.frombuffer(data, "<u8", offset=16).reshape(-1, 2)


def read(spark: SparkSession, out_dir: str, manifest: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read from the files by way of their indexes.

    The manifest has a row for each shard, as many as the writing job had tasks; the driver adds them up.
    """
    base, rows = 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r["rec"], r["idx"], base))
        base += r["ids"]
    shards = spark.createDataFrame(rows, "rec string, idx string, base long").repartition(max(1, len(rows)))

    def records(batches):
        from pyarrow import fs

        files, _ = fs.FileSystem.from_uri(out_dir)
        for b in batches:
            for rec, idx, base in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                index, start = _read_index(files, idx), base
                with files.open_input_stream(rec, buffer_size=1 << 20) as f:
                    for i in range(0, len(index), 4096):
                        out: tuple[list, ...] = ([], [], [], [])
                        for _, n in index[i : i + 4096]:
                            key, ids = decode_payload(unframe(f.read))
                            if len(ids) != n:
                                raise ValueError(f"{rec} and {idx} differ")
                            for col, v in zip(out, (key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                                col.append(v)
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[id_col, "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(records, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def read_at(out_dir: str, rec: str, idx: str, which: list[int]) -> list[tuple[int | None, np.ndarray]]:
    """Records of one shard in any order, each found through the index alone."""
    from pyarrow import fs

    files, _ = fs.FileSystem.from_uri(out_dir)
    index = _read_index(files, idx)
    with files.open_input_file(rec) as f:
        out = []
        for i in which:
            f.seek(int(index[i, 0]))
            out.append(decode_payload(unframe(f.read)))
    return out
