"""A directory tree as a Spark source that keeps hidden and underscore paths."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import params as P

SCHEMA = "rel string, size long, sha string, body string"
#: Bytes of files, with 4096 more a file, that one task reads.
PART_BYTES = 32 << 20


def _pattern(text: str) -> re.Pattern[str]:
    """An ignore pattern as a regular expression over paths: * and ? stay inside a name, ** takes whole directories."""
    out, i = [], 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
            continue
        if text[i:] == "**" and i and text[i - 1] == "/":
            out.append(".+")
            break
        if c == "*":
            while text.startswith("*", i + 1):
                i += 1
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := text.find("]", i + 2)) > 0:
            inside = text[i + 1 : end].replace("\\", "\\\\")
            out.append("(?!/)[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end
        elif c == "\\" and i + 1 < len(text):
            i += 1
            out.append(re.escape(text[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return re.compile("".join(out) + r"\Z", re.S)


def ignore_rules(text: str) -> list[tuple[re.Pattern[str], bool, bool, bool]]:
    """(pattern, negated, directories only, anchored) of each line of an ignore file; a slash before the end anchors it to the root."""
    out = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        only_dirs, line = line.endswith("/"), line.rstrip("/")
        if line:
            out.append((_pattern(line.removeprefix("/")), negated, only_dirs, "/" in line))
    return out


def ignored(rel: str, is_dir: bool, rules: list[tuple[re.Pattern[str], bool, bool, bool]]) -> bool:
    """Whether the last rule that fits a path ignores it; what lies below an ignored directory is never looked at."""
    hit = False
    for pattern, negated, only_dirs, anchored in rules:
        if (is_dir or not only_dirs) and pattern.match(rel if anchored else rel.rsplit("/", 1)[-1]):
            hit = not negated
    return hit


class _Part(InputPartition):
    def __init__(self, files: list[str]) -> None:
        self.files = files


class TreeReader(DataSourceReader):
    """The files of a tree in parts of about PART_BYTES; ignored subtrees are never entered, unreadable directories are empty.

    The tree is listed once, in order, up to `files_most` files of `file_bytes` at most; `clipped` tells whether there were more. The
    tree must be mounted under the same path wherever tasks run.
    """

    def __init__(self, root: str, file_bytes: int, files_most: int = P.FILES_MOST) -> None:
        self.root, self.file_bytes, self.files_most, self.clipped = os.path.abspath(root), file_bytes, files_most, False
        rules = ignore_rules("\n".join(P.IGNORED))
        path = os.path.join(self.root, ".gitignore")
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                rules += ignore_rules(f.read())
        self.rules = rules

    def listed(self) -> list[tuple[str, int]]:
        """(rel, bytes) of the files to read, depth first with names sorted in each directory."""
        found: list[tuple[str, int]] = []
        stack = [""]
        while stack:
            rel = stack.pop()
            path = os.path.join(self.root, rel)
            if os.path.islink(path) and rel or rel and ignored(rel, os.path.isdir(path), self.rules):
                continue
            try:
                if os.path.isdir(path):
                    stack += [f"{rel}/{x}" if rel else x for x in sorted(os.listdir(path), reverse=True)]
                elif os.path.isfile(path) and (size := os.path.getsize(path)) <= self.file_bytes:
                    if len(found) >= self.files_most:
                        self.clipped = True
                        break
                    found.append((rel, size))
            except OSError:
                continue
        return found

    def partitions(self) -> list[_Part]:
        parts: list[list[str]] = [[]]
        used = 0
        for rel, size in self.listed():
            if parts[-1] and used + size > PART_BYTES:
                parts.append([])
                used = 0
            parts[-1].append(rel)
            used += size + 4096
        return [_Part(files) for files in parts]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for rel in partition.files:
            try:
                with open(os.path.join(self.root, rel), "rb") as f:
                    data = f.read(self.file_bytes + 1)
            except OSError:
                continue
            if len(data) <= self.file_bytes and b"\0" not in data[: P.NUL_WINDOW]:
                yield rel, len(data), hashlib.sha256(data).hexdigest(), data.decode("utf-8", "replace").removeprefix("\ufeff")


class TreeSource(DataSource):
    """spark.read.format("tree").load(root); options file_bytes and files_most."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:  # noqa: ANN001
        return TreeReader(self.options["path"], int(self.options.get("file_bytes", P.FILE_BYTES)), int(self.options.get("files_most", P.FILES_MOST)))


def open_corpus(spark: SparkSession, root: str) -> DataFrame:
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").load(root)


def in_tree_order(docs: DataFrame) -> DataFrame:
    """Depth first with names sorted in each directory: the order of the path's pieces."""
    return docs.orderBy(F.split("rel", "/"))


def stale(docs: DataFrame, again: DataFrame) -> DataFrame:
    """rel of the documents that have changed or are gone in a later scan."""
    now = again.select("rel", F.col("sha").alias("now"))
    return docs.join(now, "rel", "left").where(F.col("now").isNull() | (F.col("now") != F.col("sha"))).select("rel")
