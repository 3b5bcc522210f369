"""Token ids in files of bit-shuffled, compressed blocks with an index.

File format, little-endian throughout::

    8 bytes   magic "SLTOKS01"
    blocks    each holds BLOCK ids (the last one fewer). The ids are transposed
              into planes: plane p holds bits p of all ids ("bit") or bytes p
              of all ids ("byte"). Each plane is compressed by zstandard; a
              plane of zeros is left out.
    index     zstandard of JSON: ids in the file, plane kind, width, and for
              each block its offset, its number of ids and its planes' sizes
    table     zstandard of the documents in order: int64 id, uint8 "id is
              null", int64 number of ids, column after column
    footer    int64 offset of the index, int64 size of the index, int64 size of
              the table, 8 bytes magic again

Documents are dealt to files by ranges of doc_id whose bounds come from the
ids alone, so that files in order hold the documents in ascending order; a
task tokenizes and writes whole files, block by block, under a temporary name
and then moves it to its final one. Names depend on the range alone, so a
repeated task replaces what it wrote before. Counts by file (one row a file)
give each file the ids before it.

Defined results: null text is empty (the end id alone); null ids come first;
rows with equal ids are ordered by text; an empty table writes no file and
gives an empty result; other columns are ignored. Ids must have an integer type.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, read_table, scratch_path
from .tokens import encoder, sliced

MAGIC = b"SLTOKS01"
BLOCK = 1 << 16
VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
FOOTER = struct.Struct("<qqq8s")


def split_planes(ids, kind: str = "byte") -> list[bytes]:
    """The planes of an array of unsigned 32-bit ids, low plane first."""
    import numpy as np

    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, p].tobytes() for p in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(bits[:, p], bitorder="little").tobytes() for p in range(32)]


def join_planes(planes: list[bytes], n: int, kind: str = "byte"):
    """The ids again; an empty plane holds zeros."""
    import numpy as np

    if kind == "byte":
        octets = np.zeros((n, 4), dtype=np.uint8)
        for p, plane in enumerate(planes):
            if plane:
                octets[:, p] = np.frombuffer(plane, dtype=np.uint8)
        return octets.view("<u4").reshape(-1)
    bits = np.zeros((n, 32), dtype=np.uint8)
    for p, plane in enumerate(planes):
        if plane:
            bits[:, p] = np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class TokenFile:
    """Writes one file; ids are held back only until a block is full."""

    def __init__(self, out, kind: str = "byte", level: int = 3, block: int = BLOCK):
        import zstandard

        self.out, self.kind, self.block = out, kind, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = out.write(MAGIC)
        self.pending: list[bytes] = []
        self.held = self.n_ids = 0
        self.blocks: list = []
        self.docs: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append((doc or 0, doc is None, len(ids) // 4))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        import numpy as np

        data = b"".join(self.pending)
        size = 4 * self.block
        stop = len(data) if last else len(data) - len(data) % size
        for a in range(0, stop, size):
            ids = np.frombuffer(data[a : min(a + size, stop)], dtype="<u4")
            packed = [self.pack(x) if any(x) else b"" for x in split_planes(ids, self.kind)]
            self.blocks.append([self.at, len(ids), [len(x) for x in packed]])
            self.at += self.out.write(b"".join(packed))
            self.n_ids += len(ids)
        self.pending = [data[stop:]]
        self.held = len(data) - stop

    def close(self) -> None:
        import numpy as np

        self._flush(last=True)
        index = self.pack(json.dumps({"ids": self.n_ids, "planes": self.kind, "blocks": self.blocks}).encode())
        table = np.array(self.docs, dtype="<i8").reshape(-1, 3)
        packed = self.pack(table[:, 0].tobytes() + table[:, 1].astype(np.uint8).tobytes() + table[:, 2].tobytes())
        self.out.write(index + packed + FOOTER.pack(self.at, len(index), len(packed), MAGIC))


class TokenReader:
    """Reads ranges of one file through its index."""

    def __init__(self, source):
        import numpy as np
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor().decompress
        source.seek(0, 2)
        size = source.tell()
        source.seek(size - FOOTER.size)
        at, n_index, n_table, magic = FOOTER.unpack(source.read(FOOTER.size))
        source.seek(0)
        if magic != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a token file")
        source.seek(at)
        head = json.loads(self.unpack(source.read(n_index)))
        self.kind, self.blocks, self.n_ids = head["planes"], head["blocks"], head["ids"]
        table = self.unpack(source.read(n_table))
        n = len(table) // 17
        self.doc_ids = np.frombuffer(table, "<i8", n)
        self.nulls = np.frombuffer(table, np.uint8, n, 8 * n)
        self.lengths = np.frombuffer(table, "<i8", n, 9 * n)

    def block(self, k: int):
        at, n, sizes = self.blocks[k]
        self.source.seek(at)
        planes = []
        for size in sizes:
            packed = self.source.read(size) if size else b""
            planes.append(self.unpack(packed) if size else b"")
        return join_planes(planes, n, self.kind)

    def documents(self):
        """(doc_id or None, ids) in order, holding one block and one document."""
        import numpy as np

        k, held = 0, np.zeros(0, dtype="<u4")
        for doc, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist(), strict=True):
            parts, need = [], n
            while need > len(held):
                parts.append(held)
                need -= len(held)
                held = self.block(k)
                k += 1
            parts.append(held[:need])
            held = held[need:]
            yield (None if null else doc), np.concatenate(parts)


def file_system(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def ranges(docs: DataFrame, n_files: int) -> list[int]:
    """Bounds that cut the ids into about ``n_files`` even ranges (the ids alone are read)."""
    shares = [k / n_files for k in range(1, n_files)]
    if not shares:
        return []
    row = docs.select(F.percentile_approx("doc_id", shares, 10_000).alias("q")).first()
    return sorted(set(row["q"] or []))


def write_tokens(docs: DataFrame, folder: str, n_files: int | None = None, vocabulary: str = VOCABULARY, kind: str = "byte") -> DataFrame:
    """Writes the files and returns their manifest: file, path, n_docs, n_ids, ids_before."""
    spark = docs.sparkSession
    n_files = n_files or partitions_for(spark)
    bounds = ranges(docs, n_files)
    part = F.lit(0)
    if bounds:
        # The number of bounds not above the id, by halving; nulls come first.
        part = F.coalesce(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("doc_id"))), F.lit(0))
    dealt = docs.select(part.cast("int").alias("file"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = dealt.repartition(n_files, "file").sortWithinPartitions("file", F.col("doc_id").asc_nulls_first(), "text")

    def write(batches):
        import pyarrow as pa

        store, base = file_system(folder)
        store.create_dir(base, recursive=True)
        encode = encoder(vocabulary, keep_space=True).encode
        end = END_ID.to_bytes(4, "little")
        now, out, writer, name = None, None, None, None
        done = []

        def finish():
            writer.close()
            out.close()
            path = f"{base}/part-{now:06d}.tok"
            store.move(name, path)
            done.append((now, f"{folder.rstrip('/')}/part-{now:06d}.tok", len(writer.docs), writer.n_ids))

        for batch in (x for whole in batches for x in sliced(whole, "text")):
            files = batch.column(0).to_pylist()
            for file, doc, ids in zip(files, batch.column(1).to_pylist(), encode(batch.column(2).to_pylist()), strict=True):
                if file != now:
                    if writer:
                        finish()
                    now, name = file, f"{base}/.{file:06d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                    writer = TokenFile(out, kind)
                writer.add(doc, ids + end)
        if writer:
            finish()
        yield pa.RecordBatch.from_pydict(
            {k: [x[i] for x in done] for i, k in enumerate(("file", "path", "n_docs", "n_ids"))},
            schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    manifest = materialize(dealt.mapInArrow(write, "file int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document in the files."""

    def read(batches):
        import pyarrow as pa

        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names)

        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = file_system(path)
                with store.open_input_file(place) as source:
                    rows = []
                    for doc, ids in TokenReader(source).documents():
                        data = ids.tobytes()
                        rows.append((doc, start, len(ids), zlib.crc32(data), data)[: len(names)])
                        start += len(ids)
                        if len(rows) == 2000:
                            yield made(rows)
                            rows = []
                    if rows:
                        yield made(rows)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    files = manifest.select("path", "ids_before").repartition(max(1, partitions_for(manifest.sparkSession)), "path")
    return files.mapInArrow(read, schema)


def op7_bit_plane_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(read_table(spark, sf_dir, "documents"), scratch_path(spark, "tokens")))
