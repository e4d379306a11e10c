"""Token ids in binary files: each id in as few bits as the vocabulary needs, in blocks that can be read one by one.

A file holds whole documents in ascending id order, the files follow each other in that order. Layout, little-endian:

    magic, version, bits an id, ids a block                     4 unsigned 32-bit integers
    blocks                                                      BLOCK ids each, packed, the last one shorter
    ids of the documents, then their numbers of tokens          signed 64-bit integers
    byte offsets of the blocks                                  unsigned 64-bit integers
    numbers of documents, tokens and blocks; magic              unsigned 64-bit integers

A reader needs the last bytes, then any block alone; a block is unpacked with array operations.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakeprofile.llm.common import per_process, scratch_path, slim

MAGIC, VERSION, BLOCK = 0x46444954, 1, 1 << 16
END_ID = 1
#: Stands for a null id in a file's table of ids; it sorts first.
NO_ID = -(1 << 63)
_MEMO = 400_000
_SIGNS = ".,;:!?)]}#$%&*-_=+/@\""  # ASCII signs that form no token with a letter before them
_ADDED = "<|"  # how added tokens begin


def bits_needed(vocabulary: int) -> int:
    """The bits of the largest of ``vocabulary`` ids."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` one after the other, least significant bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return flat.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class FileWriter:
    def __init__(self, sink, bits: int):
        self.sink, self.bits, self.at, self.waiting, self.parts = sink, bits, 0, 0, []
        self.docs, self.lengths, self.offsets = [], [], []
        self._put(np.array([MAGIC, VERSION, bits, BLOCK], "<u4").tobytes())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc: int, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.parts.append(ids)
        self.waiting += len(ids)
        if self.waiting >= BLOCK:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.concatenate(self.parts) if self.parts else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) - len(ids) % BLOCK
        for start in range(0, end, BLOCK):
            self.offsets.append(self.at)
            self._put(pack(ids[start: min(start + BLOCK, end)], self.bits))
        self.parts, self.waiting = [ids[end:]], len(ids) - end

    def close(self) -> int:
        """Writes the tables; returns the number of tokens."""
        self._blocks(True)
        tokens = int(sum(self.lengths))
        self._put(np.array(self.docs, "<i8").tobytes() + np.array(self.lengths, "<i8").tobytes() + np.array(self.offsets, "<u8").tobytes())
        self._put(np.array([len(self.docs), tokens, len(self.offsets), MAGIC], "<u8").tobytes())
        return tokens


class FileReader:
    """Documents of one file, block by block or by their number."""

    def __init__(self, source):
        self.source, size = source, source.size()
        n_docs, self.tokens, n_blocks, magic = (int(x) for x in np.frombuffer(source.read_at(32, size - 32), "<u8"))
        head = np.frombuffer(source.read_at(16, 0), "<u4")
        if magic != MAGIC or head[0] != MAGIC or head[1] != VERSION:
            raise ValueError("not a token file")
        self.bits, self.block = int(head[2]), int(head[3])
        at = size - 32 - 8 * (2 * n_docs + n_blocks)
        self.offsets = np.frombuffer(source.read_at(8 * n_blocks, at + 16 * n_docs), "<u8")
        self.docs = np.frombuffer(source.read_at(8 * n_docs, at), "<i8")
        self.lengths = np.frombuffer(source.read_at(8 * n_docs, at + 8 * n_docs), "<i8")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self._kept: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint32))

    def _block(self, number: int) -> np.ndarray:
        if self._kept[0] != number:
            count = min(self.block, self.tokens - number * self.block)
            data = self.source.read_at((count * self.bits + 7) // 8, int(self.offsets[number]))
            self._kept = number, unpack(data, self.bits, count)
        return self._kept[1]

    def ids(self, start: int, end: int) -> np.ndarray:
        """Tokens ``start`` to ``end`` of the file."""
        parts = []
        while start < end:
            number, inside = divmod(start, self.block)
            part = self._block(number)[inside: inside + end - start]
            parts.append(part)
            start += len(part)
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)

    def document(self, number: int) -> np.ndarray:
        return self.ids(int(self.starts[number]), int(self.starts[number + 1]))


class ChunkEncoder(dict):
    """The ids of texts, from those of their blank-separated chunks, each encoded once by the tokenizers library.

    For tokenizers that lower-case, drop white space and split letters from signs before their merges, so that no token spans
    a blank and signs behind an ASCII letter are tokens of their own. Other letters may become a letter and a mark before the
    split, and the mark would join the signs; so only an ASCII letter parts a word from its signs. A chunk of ASCII letters is
    a single word to such a tokenizer and goes straight to the library's merges; any other chunk goes through the whole
    library. Added tokens are found in the text as it stands, so chunks that may hold one keep their case and are not split.
    """

    def __init__(self, path: str):
        super().__init__()
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.bits = bits_needed(self.tokenizer.get_vocab_size(with_added_tokens=True))

    def __missing__(self, chunk: str) -> bytes:
        core = chunk.rstrip(_SIGNS)
        if core and core != chunk and core[-1].isascii() and core[-1].isalpha() and _ADDED not in chunk:
            ids = self[core] + self[chunk[len(core):]]
        elif chunk.isascii() and chunk.isalpha():
            ids = np.array([token.id for token in self.model.tokenize(chunk.lower())], np.uint32).tobytes()
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, np.uint32).tobytes()
        self[chunk] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        if len(self) > _MEMO:
            self.clear()
        if _ADDED not in text:
            try:
                text.encode("latin-1")
                text = text.lower()  # one character each, as the tokenizer does itself
            except UnicodeEncodeError:
                pass
        return np.frombuffer(b"".join(map(self.__getitem__, text.replace("\n", " ").split(" "))), np.uint32)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, ends it with ``END_ID`` and writes the files below ``folder``, which all machines share.

    Returns the written table of files: ``part``, ``file``, ``n_docs``, ``n_tokens``. A null text is empty; rows that repeat
    an id follow each other, ordered by text. Rows without an id come first; the file's table of ids marks them with ``NO_ID``,
    which no document may have as its id. A task writes under a name of its own and renames the complete file, so a repeated task does no harm.
    """
    spark = docs.sparkSession
    ordered = slim(docs, id=id_col, text=text_col).select(
        F.coalesce(F.col("id").cast("long"), F.lit(NO_ID)).alias("id"),
        F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")

    def write(batches: Iterator) -> Iterator:
        import uuid

        from pyspark import TaskContext

        batches = (part for batch in batches for part in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)))
        first = next(batches, None)
        if first is None:
            return
        import pyarrow as pa

        part = TaskContext.get().partitionId()
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        name, own = f"part-{part:06d}.ids", f"_writing-{part:06d}-{uuid.uuid4().hex}"
        encoder = per_process(f"chunks {tokenizer_path}", lambda: ChunkEncoder(tokenizer_path))
        end = np.array([END_ID], np.uint32)
        with store.open_output_stream(f"{root}/{own}") as sink:
            writer, n_docs = FileWriter(sink, encoder.bits), 0
            while first is not None:
                for doc, text in zip(first.column(0).to_pylist(), first.column(1).to_pylist()):
                    writer.add(doc, np.concatenate([encoder.encode(text), end]))
                    n_docs += 1
                first = next(batches, None)
            tokens = writer.close()
        store.move(f"{root}/{own}", f"{root}/{name}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/{name}"], "n_docs": [n_docs], "n_tokens": [tokens]})

    table = f"{folder}/_files.parquet"
    ordered.mapInArrow(write, "part long, file string, n_docs long, n_tokens long").write.parquet(table)
    return spark.read.parquet(table)


def read_token_files(files: DataFrame) -> DataFrame:
    """Per document of the written files: ``id`` (null for ``NO_ID``), ``start`` (tokens before it in all files), ``n_tokens`` and ``ids_crc32``.

    The running sum goes over the table of files, one row each, not over documents.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, offset in zip(batch.file, batch.before):
                store, path = _store(file)
                with store.open_input_file(path) as source:
                    reader = FileReader(source)
                    crcs = [zlib.crc32(reader.document(nth).astype("<u4").tobytes()) for nth in range(len(reader.docs))]
                yield pd.DataFrame({"id": reader.docs, "start": reader.starts[:-1] + offset, "n_tokens": reader.lengths, "ids_crc32": np.array(crcs, np.int64)})

    tasks = max(1, 4 * files.sparkSession.sparkContext.defaultParallelism)
    found = placed.repartition(tasks).mapInPandas(read, "id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return read_token_files(write_token_files(docs, tokenizer_path, scratch_path(spark, "token_files"), id_col, text_col))
