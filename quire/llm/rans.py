"""Token-ID files: range asymmetric numeral system with static tables, interleaved lanes, checkpoints and checksums.

A file holds whole documents in ascending id order: their ids and lengths, a head with the frequency table that all its blocks
share, and independent blocks.  A block's ids go round robin over LANES coder states, so that a step of the coder is one vector
operation; every CHECKPOINT_STEPS steps the decoder's states and place in the block are on record, from where decoding can begin
on its own.  Each block has the CRC-32 of its ids, checked when the block is read whole.  Readers take all documents, single blocks
side by side (read_blocks), or some documents from the checkpoints before them (read_documents).

Files are rows of a Parquet table, as executors may have no other way into the store.  Documents are dealt by ranges of id, so files
follow one another in id order; a task closes a file at FILE_TOKENS, and a document never spans two files.  Null texts count as
empty, null ids come first, rows that share an id are all kept (in the order of their texts' hashes; that of alike rows is open).
A very long text is encoded whole, at the memory of its ids, and makes a file of its own size.  An empty table gives no files, and
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quire.llm.arrays import buffers, tidy
from quire.llm.bytebpe import encoder, with_end

MAGIC = b"QRNS0002"
LANES = 1024
CHECKPOINT_STEPS = 64
BLOCK_TOKENS = 1 << 17
FILE_TOKENS = 1 << 22
LOW = np.uint64(1 << 31)  # states stay in [2**31, 2**63)
_U = np.uint64
_32 = _U(32)
_MARK = 4 + 8 * LANES  # bytes of a checkpoint


class Table:
    """Frequencies of the symbols present, scaled to sum to 2**bits, each at least 1."""

    def __init__(self, symbols: np.ndarray, scaled: np.ndarray, bits: int):
        self.symbols, self.scaled, self.bits = symbols, scaled, bits
        self.freq = scaled.astype(_U)
        self.cum = (np.cumsum(scaled) - scaled).astype(_U)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        symbols, counts = np.unique(ids, return_counts=True)
        bits = max(14, int(len(symbols)).bit_length() + 3)
        whole = 1 << bits
        scaled = np.maximum(1, counts * whole // max(1, int(counts.sum())))
        order, k = np.argsort(-scaled, kind="stable"), 0
        rest = whole - int(scaled.sum())
        if rest > 0 and len(scaled):
            scaled[order[0]] += rest
        while rest < 0:  # from the most frequent on; there is room, as symbols fill an eighth of the range at most
            take = min(-rest, int(scaled[order[k]]) // 2)
            scaled[order[k]] -= take
            rest, k = rest + take, k + 1
        return cls(symbols.astype(np.int64), scaled.astype(np.int64), bits)

    def packed(self) -> bytes:
        return zlib.compress(np.concatenate([np.diff(self.symbols, prepend=0), self.scaled]).astype("<u4").tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes, bits: int) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4").astype(np.int64)
        n = len(both) // 2
        return cls(np.cumsum(both[:n]), both[n:], bits)

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.symbols), dtype=np.int32), self.scaled)


def encode_block(rank: np.ndarray, table: Table) -> tuple[bytes, list[tuple[int, np.ndarray]]]:
    """(words, checkpoints) of a block of symbol ranks. A checkpoint: (words read before, decoder states)."""
    n = len(rank)
    steps = -(-n // LANES)
    x = np.full(LANES, LOW, _U)
    bits, out, states = _U(table.bits), [], {}
    shift = _U(63 - table.bits)
    for t in range(steps - 1, -1, -1):
        s = rank[t * LANES : (t + 1) * LANES]
        m = len(s)
        f, y = table.freq[s], x[:m]
        full = y >= f << shift
        out.append((y[full] & _U(0xFFFFFFFF)).astype("<u4"))
        y = np.where(full, y >> _32, y)
        q = y // f
        x[:m] = (q << bits) + (y - q * f) + table.cum[s]
        if t % CHECKPOINT_STEPS == 0:
            states[t] = x.copy()
    out.reverse()
    read = np.concatenate([[0], np.cumsum([len(w) for w in out])])
    return b"".join(w.tobytes() for w in out), [(int(read[t]), states[t]) for t in sorted(states)]


def decode_steps(words: np.ndarray, n: int, table: Table, slots: np.ndarray, first_step: int, state: np.ndarray, at: int, until: int) -> np.ndarray:
    """Symbol ranks of the steps first_step..until of a block of n symbols, from a checkpoint."""
    x, mask, bits = state.copy(), _U((1 << table.bits) - 1), _U(table.bits)
    out = []
    for t in range(first_step, until):
        m = min(LANES, n - t * LANES)
        y = x[:m]
        slot = y & mask
        s = slots[slot]
        y = table.freq[s] * (y >> bits) + slot - table.cum[s]
        need = y < LOW
        k = int(np.count_nonzero(need))
        y[need] = y[need] << _32 | words[at : at + k]
        at += k
        x[:m] = y
        out.append(s)
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def pack_file(ids: np.ndarray) -> tuple[bytes, list[bytes]]:
    """(head, blocks) of a file of these ids."""
    table = Table.of(ids)
    rank_of = np.zeros(int(table.symbols[-1]) + 1 if len(table.symbols) else 1, np.int32)
    rank_of[table.symbols] = np.arange(len(table.symbols), dtype=np.int32)
    blocks = []
    for a in range(0, len(ids), BLOCK_TOKENS):
        part = ids[a : a + BLOCK_TOKENS]
        words, marks = encode_block(rank_of[part], table)
        states = b"".join(struct.pack("<I", at) + s.astype("<u8").tobytes() for at, s in marks)
        blocks.append(struct.pack("<III", len(part), len(marks), zlib.crc32(part.astype("<u4").tobytes())) + states + words)
    freq = table.packed()
    return MAGIC + struct.pack("<III", table.bits, len(freq), LANES) + freq, blocks


class Reader:
    """Decodes blocks of one file, whole or in part, each without the others."""

    def __init__(self, head: bytes):
        if head[:8] != MAGIC:
            raise ValueError("not a token file")
        bits, n, lanes = struct.unpack_from("<III", head, 8)
        if lanes != LANES:
            raise ValueError(f"written with {lanes} lanes")
        self.table = Table.unpacked(head[20 : 20 + n], bits)
        self.slots = self.table.slots()

    def block(self, block: bytes, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids first..end of a block, decoded from the last checkpoint before them. All of it is held against its checksum."""
        n, n_marks, crc = struct.unpack_from("<III", block)
        end = n if end is None else min(end, n)
        if first >= end:
            return np.zeros(0, np.int32)
        words = np.frombuffer(block, "<u4", -1, 12 + _MARK * n_marks).astype(_U)
        k = first // LANES // CHECKPOINT_STEPS
        at = struct.unpack_from("<I", block, 12 + _MARK * k)[0]
        state = np.frombuffer(block, "<u8", LANES, 12 + _MARK * k + 4).astype(_U)
        begin = k * CHECKPOINT_STEPS
        rank = decode_steps(words, n, self.table, self.slots, begin, state, at, -(-end // LANES))
        ids = self.table.symbols[rank[first - begin * LANES : end - begin * LANES]].astype(np.int32)
        if end - first == n and zlib.crc32(ids.astype("<u4").tobytes()) != crc:
            raise ValueError("a block's checksum differs")
        return ids

    def range(self, blocks: list[bytes], first: int, end: int) -> np.ndarray:
        """Ids first..end of the file."""
        parts = [self.block(blocks[k], max(0, first - k * BLOCK_TOKENS), end - k * BLOCK_TOKENS) for k in range(first // BLOCK_TOKENS, -(-end // BLOCK_TOKENS))]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def write_token_files(df: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every text, appends end_id to each, and writes files in ascending id order as rows of a table at path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held, docs, sizes, total = [], [], [], 0

        def close():
            head, blocks = pack_file(np.concatenate(held))
            lengths = pa.array(np.concatenate(sizes).astype(np.int64))
            ids = pa.concat_arrays(docs)
            begins = pa.array(np.cumsum(lengths.to_numpy()) - lengths.to_numpy())
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, begins, lengths, pa.array(blocks, pa.binary()))]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), *lists[:3], pa.array([head], pa.binary()), lists[3]], names=names)

        for batch in batches:
            for i, j, ids, first in encoder(tokenizer).encode_all(*buffers(batch.column(1))):
                ids, first = with_end(ids, first, end_id)
                held.append(ids)
                docs.append(batch.column(0).slice(i, j - i))
                sizes.append(np.diff(first))
                total += len(ids)
                if total >= FILE_TOKENS:
                    yield close()
                    seq += 1
                    held, docs, sizes, total = [], [], [], 0
        if docs:
            yield close()

    names = ["part", "seq", "n_tokens", "docs", "begins", "lengths", "head", "blocks"]
    order = [F.col(id_col), F.xxhash64(text_col)]
    source = df.select(F.col(id_col), F.col(text_col)).repartitionByRange(*order).sortWithinPartitions(*order)
    kind = source.schema[0].dataType.simpleString()
    files = source.mapInArrow(tidy(run), f"part int, seq int, n_tokens long, docs array<{kind}>, begins array<long>, lengths array<long>, head binary, blocks array<binary>")
    files.write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32.

    Parts are in id order; the driver adds up one number for each part, tasks the files of theirs.
    """
    files = spark.read.parquet(path).drop("begins")
    at, base = 0, {}
    for r in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):
        base[r["part"]], at = at, at + r["n"]
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "seq", "n_tokens").select("part", "seq", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))
    if base:
        bases = spark.createDataFrame(list(base.items()), "part int, base long")
        starts = starts.join(bases, "part").select("part", "seq", (F.col("start") + F.col("base")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, seq, n, docs, lengths, head, blocks = (c[k] for c in batch.columns)
                docs, lengths = docs.values, lengths.values.to_numpy()
                raw = memoryview(Reader(head.as_py()).range(blocks.as_py(), 0, n.as_py()).astype("<u4").tobytes())
                ends = np.cumsum(lengths)
                begins = ends - lengths
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                same = [pa.array([x.as_py()] * len(docs), pa.int32()) for x in (part, seq)]
                yield pa.RecordBatch.from_arrays([*same, docs, pa.array(begins), pa.array(lengths), pa.array(crc, pa.int64())], names=["part", "seq", id_col, "inner", "n_tokens", "ids_crc32"])

    kind = files.schema["docs"].dataType.elementType.simpleString()
    read = files.mapInArrow(run, f"part int, seq int, `{id_col}` {kind}, inner long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select(id_col, (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(part, seq, block, ids) of every block; blocks are dealt out one by one, so a file's are decoded in parallel."""
    blocks = spark.read.parquet(path).select("part", "seq", "head", F.posexplode("blocks").alias("block", "data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                ids = Reader(one.column(2)[0].as_py()).block(one.column(4)[0].as_py())
                yield pa.RecordBatch.from_arrays([one.column(0), one.column(1), one.column(3), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=["part", "seq", "block", "ids"])

    return blocks.repartition("part", "seq", "block").mapInArrow(run, "part int, seq int, block int, ids array<int>")


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, ids) of the wanted documents (a table of ids); only the checkpoints before them and what follows are decoded. Of rows that
    share an id all come, ids that no file has do not."""
    files = spark.read.parquet(path)
    rows = files.select("part", "seq", F.inline(F.arrays_zip("docs", "begins", "lengths"))).withColumnRenamed("docs", id_col)
    some = rows.join(wanted.select(id_col).distinct(), id_col, "left_semi").groupBy("part", "seq").agg(F.collect_list(F.struct(id_col, "begins", "lengths")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader, blocks, found = Reader(batch.column(0)[k].as_py()), batch.column(1)[k].as_py(), batch.column(2)[k].values
                begin, size = found.field("begins").to_numpy(), found.field("lengths").to_numpy()
                for d in range(len(found)):
                    ids = reader.range(blocks, int(begin[d]), int(begin[d] + size[d]))
                    yield pa.RecordBatch.from_arrays([found.field(id_col).slice(d, 1), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids))], names=[id_col, "ids"])

    kind = files.schema["docs"].dataType.elementType.simpleString()
    return files.select("part", "seq", "head", "blocks").join(some, ["part", "seq"]).select("head", "blocks", "found").mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
