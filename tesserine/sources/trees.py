"""Source trees as DataFrames: one row per file, text decoded, generated and foreign folders pruned."""

from __future__ import annotations

from collections.abc import Collection, Iterator

import pandas as pd
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.plans.staging import staged

#: Extensions of source files and folders that are left out.
EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rb", "php", "java")
EXCLUDED = (".git", ".hg", ".svn", ".idea", ".vscode", "__pycache__", ".mypy_cache", "node_modules", "dist", "build", "out", "target", ".venv", "venv", ".tox")
#: Larger files are skipped by ``small_enough``.
MAX_BYTES = 1 << 20


#: Folders that one task lists.
FOLDERS = 256
_LISTED = "path string, rel_path string, ext string, length long"


def listed_files(spark: SparkSession, root: str, extensions: Collection[str] | None = EXTENSIONS, excluded: Collection[str] = EXCLUDED, dot_folders: bool = True) -> DataFrame:
    """(path, rel_path, ext, length) of the wanted files below ``root``; all files with ``extensions`` None.

    Folders are listed in tasks, one level of the tree after the other; each level is staged, and
    the driver learns only how many folders the next one has. Excluded folders aren't entered.
    """
    wanted, pruned = None if extensions is None else frozenset(extensions), frozenset(excluded)

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, top = FileSystem.from_uri(root)
        top = top.rstrip("/")
        for frame in frames:
            found = []
            for folder in frame["folder"]:
                for info in files.get_file_info(FileSelector(f"{top}/{folder}" if folder else top or "/")):
                    name = info.base_name
                    below = f"{folder}/{name}" if folder else name
                    if info.type == FileType.Directory:
                        if name not in pruned and not name.startswith(".cache") and (dot_folders or not name.startswith(".")):
                            found.append((info.path, below, None, None))
                    else:
                        ext = name.rsplit(".", 1)[-1].lower() if "." in name else ""
                        if wanted is None or ext and ext in wanted:
                            found.append((info.path, below, ext, info.size))
            yield pd.DataFrame(found, columns=["path", "rel_path", "ext", "length"]).astype({"length": "Int64"})

    level, out = spark.createDataFrame([("",)], "folder string"), None
    while True:
        found = staged(level.mapInPandas(look, _LISTED), "listing")
        files = found.where("ext IS NOT NULL")
        out = files if out is None else out.unionByName(files)
        folders = found.where("ext IS NULL")
        n = folders.count()
        if not n:
            return out
        level = folders.select(F.col("rel_path").alias("folder")).repartition(-(-n // FOLDERS))


def source_files(spark: SparkSession, root: str, extensions: Collection[str] = EXTENSIONS, excluded: Collection[str] = EXCLUDED, dot_folders: bool = True, partition_bytes: int = 64 << 20, batch_bytes: int = 8 << 20) -> DataFrame:
    """(path, rel_path, ext, length, text) of the wanted files below ``root``; invalid UTF-8 bytes are dropped.

    Spark's own file sources leave out names that begin with an underscore or a dot, and with
    them ``__init__.py``, so the tree is listed by ``listed_files``. Contents are read in tasks,
    at most ``batch_bytes`` or one file at a time. ``root``
    is an absolute path or URI that the executors can read. Empty files have the empty text.
    """
    listed = listed_files(spark, root, extensions, excluded, dot_folders)
    size = listed.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, -(-int(size) // partition_bytes))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = FileSystem.from_uri(root)
        for frame in frames:
            batch = (frame["length"].cumsum() // batch_bytes).to_numpy()
            for _, part in frame.groupby(batch):
                texts = []
                for path in part["path"]:
                    with files.open_input_stream(path) as f:
                        texts.append(f.read().decode("utf-8", "ignore"))
                yield part.assign(text=texts)

    return listed.repartition(tasks).mapInPandas(read, f"{_LISTED}, text string")


def small_enough(files: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    return files.where(F.col("length") <= most)


#: What the chunk builder skips and takes.
BINARY = ("png", "jpg", "jpeg", "gif", "ico", "pdf", "zip", "tar", "gz", "exe", "dll", "so")
VENDORED = (*EXCLUDED, ".cache", "coverage", ".coverage", "htmlcov", ".pytest_cache")
SUPPORTED = ("py", "js", "jsx", "ts", "tsx", "go", "php", "rb", "css", "java", "cpp", "c", "yaml", "yml", "json", "toml", "ini", "md", "sql")


def skipped(path: Column, length: Column, vendor: bool = False) -> Column:
    """Whether the chunk builder skips a file: binary or unsupported by its suffix, over MAX_BYTES, or below a vendored folder unless ``vendor``."""
    suffix = F.regexp_extract(path, r"(?s)[^/]\.([^./]*)$", 1)
    below = F.lit(False) if vendor else F.exists(F.split(path, "/"), lambda part: part.isin(*VENDORED))
    return F.lower(suffix).isin(*BINARY) | (length > MAX_BYTES) | below | ~suffix.isin(*SUPPORTED)


def file_type(ext: Column, text: Column) -> Column:
    """The extension, but ``openapi`` for YAML and JSON files that say so in their first 1000 characters."""
    head = F.substring(text, 1, 1000)
    spec = ext.isin("yaml", "yml", "json") & (F.contains(head, F.lit("openapi:")) | F.contains(head, F.lit('"openapi"')))
    return F.when(spec, F.lit("openapi")).otherwise(ext)
