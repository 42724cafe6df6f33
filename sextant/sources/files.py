"""Discovery of source files below repository roots.

Roots, paths and contents are DataFrames: listing and reading run in tasks that stream their
output, so neither the path list nor the texts pass through the driver. The roots have to be
visible to the executors (a shared file system).
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.functions import paths as P
from sextant.functions.digest import content_hash, line_count
from sextant.sources.ignore import ignored, load_rules

LISTING = "root string, path string, mode string"
FILES = "root string, path string, size bigint, reason string, content string"
BATCH, BATCH_CHARS = 500, 16 << 20


def _git_listing(root: str) -> Iterator[str] | None:
    """Tracked and untracked paths that git does not ignore; None outside a repository."""
    command = ["git", "-C", root, "ls-files", "-co", "--exclude-standard", "-z", "--", "."]
    if not os.path.isdir(root):
        raise FileNotFoundError(f"{root} is no folder that this task can see")
    inside = subprocess.run(
        ["git", "-C", root, "rev-parse", "--is-inside-work-tree"], capture_output=True
    )
    if inside.returncode != 0:
        return None

    def stream() -> Iterator[str]:
        rest = b""
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL) as git:
            while chunk := git.stdout.read(1 << 20):
                *whole, rest = (rest + chunk).split(b"\0")
                yield from (name.decode("utf-8", "replace") for name in whole if name)
        if git.returncode or rest:
            raise RuntimeError(f"git ended with {git.returncode} before it had listed {root}")

    return stream()


def _fail(error: OSError) -> None:
    raise error


def _walk_listing(root: str, ignored_dirs: frozenset[str]) -> Iterator[str]:
    for folder, below, names in os.walk(root, onerror=_fail, followlinks=False):
        below[:] = sorted(n for n in below if n not in ignored_dirs and not n.startswith("."))
        for name in names:
            full = os.path.join(folder, name)
            if not os.path.islink(full):
                yield os.path.relpath(full, root).replace(os.sep, "/")


def list_paths(
    spark: SparkSession, roots: list[str], ignored_dirs: list[str] | None = None
) -> DataFrame:
    """All paths below the roots: git's own listing where there is one, else a walk."""
    skip = frozenset(P.IGNORED_DIRS if ignored_dirs is None else ignored_dirs)

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root in batch["root"]:
                found = _git_listing(root)
                mode = "walk" if found is None else "git"
                rows: list[str] = []
                for path in found if found is not None else _walk_listing(root, skip):
                    rows.append(path)
                    if len(rows) == 10000:
                        yield pd.DataFrame({"root": root, "path": rows, "mode": mode})
                        rows = []
                if rows:
                    yield pd.DataFrame({"root": root, "path": rows, "mode": mode})

    table = spark.createDataFrame([(root,) for root in roots], "root string")
    return table.repartition(len(roots), "root").mapInPandas(listing, LISTING)


def _read_file(full: str, max_bytes: int | None) -> tuple[int, str | None, str | None]:
    """Size, skip reason and text. A listed path that is not there is a row too."""
    if not os.path.isfile(full):
        return 0, "missing", None
    size = os.path.getsize(full)
    if max_bytes is not None and size > max_bytes:
        return size, "too_large", None
    try:
        with open(full, "rb") as file:
            return size, None, file.read().decode("utf-8", "replace")
    except OSError:
        return size, "unreadable", None


def _read_files(max_bytes: int | None):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["root", "path", "size", "reason", "content"]
        for batch in batches:
            rows, held = [], 0
            for root, path in zip(batch["root"], batch["path"]):
                full = os.path.join(root, path)
                rows.append((root, path, *_read_file(full, max_bytes)))
                held += len(rows[-1][-1] or "")
                if len(rows) == BATCH or held >= BATCH_CHARS:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    return read


def discover(
    spark: SparkSession,
    root: str,
    ignored_dirs: list[str] | None = None,
    max_bytes: int | None = None,
) -> DataFrame:
    """Candidate files of a root with size, skip reason and content.

    Files larger than ``max_bytes``, if given, and files that cannot be read are rows with a reason.

    The path filter runs before any file is read, and paths are spread over all tasks before
    the reads.
    """
    path = F.col("path")
    wanted = P.is_candidate(path, ignored_dirs) & ~ignored(path, load_rules(root))
    candidates = list_paths(spark, [root], ignored_dirs).where(wanted).select("root", "path")
    spread = candidates.repartition(spark.sparkContext.defaultParallelism * 4, "path")
    return spread.mapInPandas(_read_files(max_bytes), FILES)


def units_of(files: DataFrame) -> DataFrame:
    """Readable files as units: language, kind, hash, bytes and lines of the decoded text."""
    path, content = F.col("path"), F.col("content")
    return files.where(F.col("reason").isNull()).select(
        "path",
        P.language(path).alias("language"),
        F.when(P.is_test_path(path), "test").otherwise("source").alias("kind"),
        content_hash(content).alias("hash"),
        F.octet_length(content).cast("bigint").alias("bytes"),
        line_count(content).alias("lines"),
        "content",
    )


def skipped_of(files: DataFrame) -> DataFrame:
    return files.where(F.col("reason").isNotNull()).select(
        "path", "reason", F.col("size").alias("bytes")
    )


def discovery_mode(root: str) -> str:
    return "walk" if _git_listing(root) is None else "git"


def head_commit(root: str) -> str | None:
    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True)
    return done.stdout.strip() or None if done.returncode == 0 else None


def go_module(root: str) -> str | None:
    file = Path(root) / "go.mod"
    if not file.is_file():
        return None
    found = re.search(r"^module\s+(\S+)", file.read_text(errors="replace"), re.MULTILINE)
    return found.group(1) if found else None
