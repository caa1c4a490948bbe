"""A directory tree as a table: ignore files are honoured, large and non-UTF-8 files are counted and left out."""

from __future__ import annotations

import contextlib
import itertools
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

MAX_BYTES = 1_048_576
#: Folders that are never entered.
OWN, GIT = ".quernel", ".git"


def _pattern(line: str) -> tuple[re.Pattern, bool, bool] | None:
    """(regex over the path below the ignore file's folder, negated, folders only) of one ignore line."""
    line = line.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:].removeprefix("\\")
    folders = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("**", i):
            out, i = out + ".*", i + 2
        elif line[i] == "[" and (end := line.find("]", i + 2)) > 0:
            out, i = out + "[" + re.sub("^!", "^", line[i + 1 : end]) + "]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(line[i], re.escape(line[i])), i + 1
    return re.compile(("" if anchored else "(?:.*/)?") + out + r"\Z"), negated, folders


def _rules(path: str) -> list[tuple[re.Pattern, bool, bool]]:
    try:
        with open(path, errors="replace") as f:
            return [r for r in map(_pattern, f) if r]
    except OSError:
        return []


def _global_ignore_file() -> str:
    """core.excludesFile of the user's Git settings, or its default place."""
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    for path in (os.path.expanduser("~/.gitconfig"), os.path.join(home, "git", "config")):
        with contextlib.suppress(OSError), open(path, errors="replace") as f:
            section = ""
            for line in f:
                if m := re.match(r"\s*\[\s*([^\]\s]+)", line):
                    section = m[1].lower()
                elif section == "core" and (m := re.match(r"\s*excludesfile\s*=\s*\"?([^\"\n]+?)\"?\s*$", line, re.IGNORECASE)):
                    return os.path.expanduser(m[1])
    return os.path.join(home, "git", "ignore")


def walk(root: str, strict: bool = False, ignore: str | None = None) -> Iterator[str]:
    """Relative paths of regular files, hidden ones included. Errors are dropped, or raised if strict. ignore: the ignore file for all
    trees, by default that of the user's settings."""
    base = [*_rules(_global_ignore_file() if ignore is None else ignore), *_rules(os.path.join(root, GIT, "info", "exclude"))]

    def below(folder: str, above: list[tuple[str, list]]) -> Iterator[str]:
        own = [*above, (folder, _rules(os.path.join(root, folder, ".gitignore")))]
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            if strict:
                raise
            return
        for e in entries:
            path = f"{folder}/{e.name}" if folder else e.name
            is_dir = e.is_dir(follow_symlinks=False)
            if is_dir and e.name in (OWN, GIT):
                continue
            ignored = False
            for at, rules in own:
                tail = path[len(at) + 1 :] if at else path
                for regex, negated, folders in rules:
                    if (is_dir or not folders) and regex.match(tail):
                        ignored = not negated
            if ignored:
                continue
            if is_dir:
                yield from below(path, own)
            elif e.is_file(follow_symlinks=False):
                yield path

    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    yield from below("", [("", base)])


def _read(root: str, path: str) -> tuple[str, int, str | None, str]:
    """A file's row: path, length, content, status."""
    full = os.path.join(root, path)
    try:
        size = os.path.getsize(full)
        if size > MAX_BYTES:
            return path, size, None, "large"
        with open(full, "rb") as f:
            return path, size, f.read().decode(), "kept"
    except UnicodeDecodeError:
        return path, size, None, "binary"
    except OSError:
        return path, 0, None, "unreadable"


SCHEMA = "path string, length long, content string, status string"


class Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        if not options.get("path"):
            raise ValueError("the directory source needs a path")
        self.root, self.strict, self.per_task = options["path"], str(options.get("strict", "false")).lower() == "true", int(options.get("per_task", 256))
        self.ignore = options.get("ignore")

    def partitions(self) -> list[Paths]:
        walked = walk(self.root, self.strict, self.ignore)
        return [Paths(part) for part in iter(lambda: list(itertools.islice(walked, self.per_task)), [])] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple]:
        for path in partition.paths:
            yield _read(self.root, path)


class DirectorySource(DataSource):
    """A directory tree as a Spark source: spark.read.format("quernel_directory").option("strict", "true").load(root). Its partitions are
    batches of per_task paths; root must be reachable from all executors."""

    @classmethod
    def name(cls) -> str:
        return "quernel_directory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options)


def read_directory(spark: SparkSession, root: str, strict: bool = False, per_task: int = 256) -> DataFrame:
    """(path, length, content, status): status is kept, large, binary or unreadable; only kept files have a content.

    The driver walks the tree, files are read by tasks of per_task paths. If strict, a folder that can't be listed is an error.
    """
    if not os.path.isdir(root):
        raise FileNotFoundError(root)
    spark.dataSource.register(DirectorySource)
    return spark.read.format(DirectorySource.name()).option("strict", str(strict).lower()).option("per_task", str(per_task)).option("ignore", _global_ignore_file()).load(root)


def scan_summary(files: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s)
    return files.agg(count("kept").alias("kept"), count("large").alias("skipped_large"), count("binary").alias("skipped_binary"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, content) of the documents table: path is source/doc_id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))
