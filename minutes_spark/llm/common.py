"""What the operators share: tables in the shared folder, text buffers, hash splits."""

import tempfile
import uuid

import numpy as np
from pyspark.sql import functions as F

# The white space that separates words.
WORD_SPACE = "\\x20\\x09-\\x0D"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shared_folder(spark):
    """The cluster's checkpoint folder; where it is unset on a local master, a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="checkpoints-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def durable(df, name):
    """Write ``df`` to the shared folder and go on from the files, which survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_remainder(modulus, column="doc_id"):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def utf8(array):
    """Byte offsets and bytes of an Arrow string array; a null is an empty text."""
    wide = "large" in str(array.type)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[array.offset : array.offset + len(array) + 1].astype(np.int64)
    buffer = array.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer else np.zeros(0, np.uint8)
    return offsets, data


def pieces_of(lengths, size):
    """(index, start, end) pieces of at most ``size`` elements that cover all lengths."""
    for index, length in enumerate(lengths):
        for start in range(0, int(length), size):
            yield index, start, min(start + size, int(length))


def chunks_of(lengths, size):
    """Lists of pieces whose sizes add up to about ``size``."""
    held, total = [], 0
    for piece in pieces_of(lengths, size):
        held.append(piece)
        total += piece[2] - piece[1]
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


class Index:
    """Number of a key, from 1 in the order given; 0 if absent. Open addressing, at most a quarter full."""

    def __init__(self, keys):
        self.bits = max(4, int(np.ceil(np.log2(4 * len(keys) + 1))))
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.nodes = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = self.nodes[slot] == 0
            self.nodes[slot[free]] = left[free] + 1
            placed = self.nodes[slot] == left + 1
            self.keys[slot[placed]] = keys[left[placed]]
            left, slot = left[~placed], (slot[~placed] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys):
        return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        slot = self._slot(keys)
        here = self.nodes[slot]
        hit = self.keys[slot] == keys
        nodes = np.where(hit, here, 0)
        left = np.flatnonzero(~hit & (here != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            here, hit = self.nodes[slot], self.keys[slot] == keys[left]
            nodes[left[hit]] = here[hit]
            on = ~hit & (here != 0)
            left, slot = left[on], slot[on]
        return nodes
