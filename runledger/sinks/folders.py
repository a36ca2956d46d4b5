"""Text files in very many folders, written by a data source with commit and abort.

A file of a Hadoop store costs some 10 ms without its native library, as a process is started
to set the rights of each. Here tasks write rows, sorted by folder, through Arrow's stores. A
task writes hidden files beside their place, which no reader sees, and names them when all of
its rows are written; a repeated attempt replaces whole files by the same.
"""

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from runledger.sources.files import store_of

# What Spark escapes in the name of a partition's folder, and the name for none.
ESCAPED = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def folder_name(keys, values):
    """`<key>=<value>/...` as partitioned writers name it."""
    return "/".join(f"{key}=" + (ESCAPED.sub(lambda mark: f"%{ord(mark[0]):02X}", value) if value else NO_VALUE)
                    for key, value in zip(keys, values))


def runs_of_rows(keys):
    """Where in the columns another folder begins, with both ends."""
    changes = np.zeros(max(len(keys[0]) - 1, 0), dtype=bool)
    for column in keys:
        codes = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changes |= codes[1:] != codes[:-1]
    return [0, *(np.flatnonzero(changes) + 1).tolist(), len(keys[0])]


@dataclass
class Written(WriterCommitMessage):
    files: int


class FolderWriter(DataSourceArrowWriter):
    """All columns but the last one name the folder, the last one is a line."""

    def __init__(self, schema, path, suffix):
        self.keys, self.path, self.suffix = [field.name for field in schema.fields[:-1]], path.rstrip("/"), suffix

    def write(self, iterator):
        from pyspark import TaskContext

        store, path = store_of(self.path)
        name = f"part-{TaskContext.get().partitionId():05d}{self.suffix}"
        hidden = f".{name}-{uuid.uuid4().hex}"
        current, seen, out = None, set(), None
        try:
            for batch in iterator:
                if not len(batch):
                    continue
                keys = batch.columns[:-1]
                lines = [line or b"" for line in batch.columns[-1].cast(pa.binary()).to_pylist()]
                ends = runs_of_rows(keys)
                names = zip(*(column.take(pa.array(ends[:-1])).to_pylist() for column in keys))
                for values, start, stop in zip(names, ends, ends[1:]):
                    folder = folder_name(self.keys, values)
                    if folder != current:
                        if out is not None:
                            out.close()
                        if folder in seen:
                            out = store.open_append_stream(f"{path}/{folder}/{hidden}")
                        else:
                            store.create_dir(f"{path}/{folder}")
                            out = store.open_output_stream(f"{path}/{folder}/{hidden}", compression=None)
                            seen.add(folder)
                        current = folder
                    out.write(b"\n".join(lines[start:stop]) + b"\n")
            if out is not None:
                out.close()
            for folder in seen:
                store.move(f"{path}/{folder}/{hidden}", f"{path}/{folder}/{name}")
        except BaseException:
            self._clear(store, [f"{path}/{folder}/{hidden}" for folder in seen])
            raise
        return Written(len(seen))

    @staticmethod
    def _clear(store, files):
        for file in files:
            try:
                store.delete_file(file)
            except OSError:
                pass

    def commit(self, messages):
        store, path = store_of(self.path)
        store.create_dir(path)
        store.open_output_stream(f"{path}/_SUCCESS").close()

    def abort(self, messages):
        """Files of tasks that had ended stay, as with a committer that works in tasks; `_SUCCESS` is missing."""


class FolderSource(DataSource):
    """`df.write.format("folders")` for rows of folder columns and a line, sorted by folder."""

    @classmethod
    def name(cls):
        return "folders"

    def schema(self):
        raise ValueError("read folders of text with read_small_files")

    def writer(self, schema, overwrite):
        if len(schema.fields) < 2 or overwrite:
            raise ValueError("folders take the columns that name them and a line, and are never overwritten")
        return FolderWriter(schema, self.options["path"], self.options.get("suffix", ".txt"))
