"""Trees of very many small files: listed and read by tasks, a few hundred files each.

Spark's readers hold every file of a query in the driver and open a few files a task. Here the
names of the files are rows: tasks list the folders level by level, and others read the files.
Files that Spark would split or one task should not read as a whole, compressed ones and stores
that Arrow does not know are left to Spark's reader.
"""

import os
import re

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from runledger.session import LISTING_TASKS_PER_CORE, conf_bytes, materialise, shared_listing, ship_package, tasks_for

FILES_PER_TASK = 1000
BYTES_PER_TASK = 64 << 20
SMALL_FILE = 4 << 20
BATCH_BYTES = 8 << 20
NAMES_PER_BATCH = 10_000
# The names of compressed files, the marks of a pattern, and what a URI quotes in a path.
COMPRESSED = r"\.(?:gz|gzip|bz2|deflate|lz4|snappy|zst|zstd|xz|lzo)$"
WILD = re.compile(r"[*?\[{]")
MARKS = re.compile(r"[*?\[\]{}\\]")
QUOTED = re.compile(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]')
BYTE_ORDER_MARK = b"\xef\xbb\xbf"

LISTED = "path string, folder boolean, size long"


def qualified(spark, path):
    """The path with its scheme, as Spark would find it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def store_of(path):
    """(store, path in the store) of a path with or without a scheme."""
    if path.startswith("file:"):
        path = re.sub(r"^file:/+", "/", path)
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def opens(path):
    """Whether Arrow knows the store of a path; of a pattern its first folders count."""
    try:
        store_of(path)
    except (ValueError, OSError, NotImplementedError):
        return False
    return True


def split_pattern(path):
    """(folder, patterns of the levels below it) of a path pattern; None for what only Spark understands."""
    levels = path.split("/")
    first = next((i for i, level in enumerate(levels) if WILD.search(level)), len(levels))
    below = [level for level in levels[first:] if level]
    if "\\" in path or any(level.count("{") != level.count("}") or "{" in re.sub(r"\{[^{}]*\}", "", level) for level in below):
        return None
    return "/".join(levels[:first]), below


def level_regex(level):
    """The names that a level of a path pattern stands for, as Hadoop reads it."""
    out, braces = [], 0
    for mark in re.findall(r"\[[\^!]?\]?[^\]]*\]|.", level, re.DOTALL):
        braces += (mark == "{") - (mark == "}")
        out.append({"*": ".*", "?": ".", "{": "(?:", "}": ")"}.get(mark) or ("|" if mark == "," and braces else None)
                   or (mark.replace("[!", "[^") if len(mark) > 1 else re.escape(mark)))
    return "".join(out)


def _hidden(name):
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(store, folder):
    """(name, whether it is a folder, bytes) of what is in a folder, without the names that Spark passes over."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if not _hidden(entry.name):
                    yield entry.name, entry.is_dir(), 0 if entry.is_dir() else entry.stat().st_size
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            if not _hidden(info.base_name):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def _below(store, folder):
    """The files of a folder that a pattern names, and those of its partitions, as Spark takes them."""
    for name, inner, size in _entries(store, folder):
        if inner and "=" in name:
            yield from _below(store, f"{folder}/{name}")
        elif not inner:
            yield f"{folder}/{name}", False, size


def _listing(expand):
    """A task's listing: every row that `expand` makes of the rows of its folders; files pass."""
    def task(batches):
        names = []

        def batch():
            paths, folders, sizes = zip(*names) if names else ((), (), ())
            names.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(folders, pa.bool_()), pa.array(sizes, pa.int64())], ["path", "folder", "size"])

        for rows in batches:
            for path, folder, size in zip(*(column.to_pylist() for column in rows.columns)):
                for entry in expand(path, folder, size):
                    names.append(entry)
                    if len(names) == NAMES_PER_BATCH:
                        yield batch()
        yield batch()
    return task


def _matching(base, level):
    wanted = re.compile(level_regex(level), re.DOTALL)

    def expand(path, folder, _):
        if folder:
            store = store_of(base)[0]
            for name, inner, size in _entries(store, path):
                if wanted.fullmatch(name):
                    yield f"{path}/{name}", inner, size
    return expand


def _leaves(base):
    def expand(path, folder, size):
        return _below(store_of(base)[0], path) if folder else [(path, folder, size)]
    return expand


def list_files(spark, base, levels):
    """(path, size) of the files that a pattern names, or that are in the folders it names; empty ones are left out."""
    ship_package(spark)
    tasks = LISTING_TASKS_PER_CORE * spark.sparkContext.defaultParallelism
    found = spark.createDataFrame([(store_of(base)[1].rstrip("/") or "/", True, 0)], LISTED)
    for level in levels:
        found = found.mapInArrow(_listing(_matching(base, level)), LISTED).repartition(tasks)
    return found.mapInArrow(_listing(_leaves(base)), LISTED).filter(F.col("size") > 0).select("path", "size")


def _lines(content):
    """The lines of a file as Spark's text source cuts them."""
    lines = content.removeprefix(BYTE_ORDER_MARK).replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    return lines if lines[-1] else lines[:-1]


def _prefix(base):
    """What stands before the paths of a store in the paths that Spark knows."""
    return "file:" if base.startswith(("file:", "/")) else base.removesuffix(store_of(base)[1])


def _reading(base, whole):
    """A task's reading: a row per file with its lines, or with the whole file as its one part."""
    prefix = _prefix(base)

    def task(batches):
        store = store_of(base)[0]
        paths, parts, size = [], [], 0

        def batch():
            flat = pa.array([part for file in parts for part in file], pa.binary())
            ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
            names = pa.array([prefix + QUOTED.sub(lambda mark: f"%{ord(mark[0]):02X}", path) for path in paths], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(ends), flat)], ["path", "parts"])

        for rows in batches:
            for path in rows.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as file:
                    content = file.read()
                paths.append(path)
                parts.append([content] if whole else _lines(content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield batch()
                    paths, parts, size = [], [], 0
        if paths:
            yield batch()
    return task


def _by_spark(spark, paths, whole, number):
    with shared_listing(spark):
        texts = spark.read.text(paths, wholetext=whole)
    return texts.select(F.col("_metadata.file_path").alias("path"), number.alias("line_no"), "value")


def read_small_files(spark, path, number, whole=False):
    """(path, line_no, value) of every line, or of every file, that a path pattern names.

    `number` numbers the lines of the files that Spark's reader reads. What the pattern names is
    listed once, when this is called.
    """
    path = qualified(spark, path)
    pattern = split_pattern(path)
    if pattern is None or not opens(pattern[0]):
        return _by_spark(spark, path, whole, number)
    base, levels = pattern
    store, folder = store_of(base)
    if not levels or store.get_file_info(folder).type != fs.FileType.Directory:
        return _by_spark(spark, path, whole, number)
    files = materialise(list_files(spark, base, levels), "files")
    split = conf_bytes(spark, "spark.sql.files.maxPartitionBytes")
    ours = (F.col("size") <= min(SMALL_FILE, split)) & ~F.lower("path").rlike(COMPRESSED)
    n, size = files.agg(F.count_if(ours), F.sum(F.when(ours, F.col("size")))).first()
    large = [row.path for row in files.filter(~ours).select("path").collect()]
    if not n:
        # Spark says what is wrong with a pattern that names nothing.
        return _by_spark(spark, path, whole, number)
    tasks = max(tasks_for(spark, n, FILES_PER_TASK), tasks_for(spark, size, min(BYTES_PER_TASK, split)))
    rows = files.filter(ours).select("path").repartition(tasks).mapInArrow(_reading(base, whole), "path string, parts array<binary>")
    lines = rows.select("path", F.posexplode("parts").alias("line_no", "value")).select(
        "path", F.col("line_no").cast("long").alias("line_no"), F.col("value").cast("string").alias("value"))
    if not large:
        return lines
    named = [_prefix(base) + MARKS.sub(r"\\\g<0>", name) for name in large]
    return lines.unionByName(_by_spark(spark, named, whole, number))
