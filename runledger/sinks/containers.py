"""Key/value container files, written by a data source with commit and abort.

Spark has no DataFrame writer for this container. Rows arrive as Arrow batches and
are laid out column by column; no row becomes a Python object. A task writes below
a folder of the job's own, the driver moves whole files to their names when all tasks
have ended, so a failed or repeated attempt never leaves a file that a reader sees.
"""

import hashlib
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

# Fixed values of the container: magic and version, the mark in front of a sync, and the
# value classes by Arrow type. A block holds about this many bytes of values.
MAGIC = b"SEQ\x06"
SYNC_ESCAPE = b"\xff\xff\xff\xff"
CLASSES = {
    pa.int32(): ("org.apache.hadoop.io.IntWritable", ">i4"), pa.int64(): ("org.apache.hadoop.io.LongWritable", ">i8"),
    pa.float32(): ("org.apache.hadoop.io.FloatWritable", ">f4"), pa.float64(): ("org.apache.hadoop.io.DoubleWritable", ">f8"),
    pa.string(): ("org.apache.hadoop.io.Text", "vint"), pa.binary(): ("org.apache.hadoop.io.BytesWritable", ">i4")}
BLOCK_BYTES = 1 << 20
STAGING = "_temporary"


def vints(numbers):
    """(bytes, bytes of each) of numbers of 0 and more as variable-length integers.

    Up to 127 a number is its own byte; beyond, a byte tells how many bytes follow, highest first.
    """
    n = np.asarray(numbers, dtype=np.int64)
    more = (n > 127).astype(np.int64) + (n > 0xFF) + (n > 0xFFFF) + (n > 0xFFFFFF)
    cells = np.empty((len(n), 5), dtype=np.uint8)
    cells[:, 0] = np.where(more == 0, n, 144 - more)
    for place in range(1, 5):
        cells[:, place] = (n >> np.maximum(8 * (more - place), 0)) & 255
    return cells[np.arange(5) <= more[:, None]], more + 1


def _vint(number):
    return vints([number])[0].tobytes()


def _named(name):
    return _vint(len(name)) + name.encode()


def serialized(column):
    """(bytes, bytes of each) of a column's values as the container's classes write them."""
    if column.null_count:
        raise ValueError("a container has no place for nulls")
    kind = CLASSES[column.type][1]
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        values = column.to_numpy(zero_copy_only=False).astype(kind)
        return values.view(np.uint8), np.full(len(values), values.dtype.itemsize, dtype=np.int64)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int32)[column.offset] if len(column) else 0
    content = np.frombuffer(data, dtype=np.uint8)[first:first + sizes.sum()] if data else np.empty(0, dtype=np.uint8)
    if kind == "vint":
        heads, head_sizes = vints(sizes)
    else:
        heads, head_sizes = sizes.astype(kind).view(np.uint8), np.full(len(sizes), 4, dtype=np.int64)
    # Heads and contents take turns: each byte's side follows from the sizes alone.
    turns = np.empty(2 * len(sizes), dtype=np.int64)
    turns[0::2], turns[1::2] = head_sizes, sizes
    is_head = np.repeat(np.arange(len(turns)) % 2 == 0, turns)
    joined = np.empty(len(is_head), dtype=np.uint8)
    joined[is_head], joined[~is_head] = heads, content
    return joined, head_sizes + sizes


def header(key_type, value_type, codec, sync):
    """Magic, classes, both kinds of compression, the codec, no metadata, the sync mark."""
    classes = _named(CLASSES[key_type][0]) + _named(CLASSES[value_type][0])
    return MAGIC + classes + b"\x01\x01" + _named(codec) + bytes(4) + sync


def block(keys, values, sync):
    """A block of records: lengths and contents of the keys, then of the values, each deflated."""
    parts = [SYNC_ESCAPE, sync, _vint(len(keys))]
    for column in (keys, values):
        content, sizes = serialized(column)
        for part in (vints(sizes)[0], content):
            packed = zlib.compress(part.tobytes())
            parts += [_vint(len(packed)), packed]
    return b"".join(parts)


def _pieces(batch):
    """The batch in runs of rows of at most BLOCK_BYTES together; a longer row stands alone."""
    weight = np.zeros(len(batch), dtype=np.int64)
    for column in batch.columns:
        weight += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False) if (
            pa.types.is_string(column.type) or pa.types.is_binary(column.type)) else 8
    ends = np.cumsum(weight)
    start = 0
    while start < len(batch):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


@dataclass
class Written(WriterCommitMessage):
    path: str
    name: str


def _store(path):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class SequenceWriter(DataSourceArrowWriter):
    def __init__(self, schema, path, codec, overwrite):
        self.schema, self.path, self.codec, self.overwrite = schema, path.rstrip("/"), codec, overwrite
        self.job = uuid.uuid4().hex

    def _folder(self):
        store, path = _store(self.path)
        return store, path, f"{path}/{STAGING}/{self.job}"

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        store, _, staging = self._folder()
        store.create_dir(staging, recursive=True)
        # Every attempt has a file of its own; only the one that the driver hears of is moved.
        path, name = f"{staging}/{uuid.uuid4().hex}", f"part-{task:05d}"
        sync = hashlib.md5(f"{self.job}-{task}".encode()).digest()
        with store.open_output_stream(path) as out:
            started = False
            for batch in iterator:
                for piece in _pieces(batch):
                    if not started:
                        out.write(header(*(column.type for column in piece.columns), self.codec, sync))
                        started = True
                    out.write(block(*piece.columns, sync))
        return Written(path if started else "", name)

    def commit(self, messages):
        store, path, staging = self._folder()
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                if old.base_name != STAGING:
                    (store.delete_dir if old.type == fs.FileType.Directory else store.delete_file)(old.path)
        store.create_dir(path, recursive=True)
        for message in messages:
            if message is not None and message.path:
                store.move(message.path, f"{path}/{message.name}")
        self._clear(store, path, staging)
        store.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages):
        store, path, staging = self._folder()
        self._clear(store, path, staging)

    @staticmethod
    def _clear(store, path, staging):
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)
        above = f"{path}/{STAGING}"
        if store.get_file_info(above).type == fs.FileType.Directory and not store.get_file_info(fs.FileSelector(above)):
            store.delete_dir(above)


class SequenceSource(DataSource):
    """`df.write.format("sequence")` for rows of a key and a value; appends or overwrites a folder."""

    @classmethod
    def name(cls):
        return "sequence"

    def schema(self):
        raise ValueError("read containers with read_sequence")

    def writer(self, schema, overwrite):
        if len(schema.fields) != 2:
            raise ValueError("a container takes a key and a value column")
        return SequenceWriter(schema, self.options["path"], self.options["codec"], overwrite)
