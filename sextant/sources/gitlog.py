"""Commit history of a repository as a table of touched files."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.history import WINDOW_DAYS, with_moment

# Record and field separators, and the log format that writes them.
RECORD, FIELD = "\x1e", "\x1f"
FORMAT = "--pretty=format:%x1e%H%x1f%an%x1f%aI%x1f%s"


def _stream_log(root: str, max_commits: int | None) -> Iterator[str]:
    within = subprocess.run(["git", "-C", root, "rev-parse", "--verify", "HEAD"], capture_output=True)
    if within.returncode != 0:
        return  # no repository, or none with a commit
    limit = [] if max_commits is None else ["-n", str(max_commits)]
    command = ["git", "-C", root, "log", "--no-merges", "--name-only", *limit, FORMAT]
    rest = ""
    with subprocess.Popen(
        command, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL,
        encoding="utf-8", errors="replace",
    ) as git:
        while chunk := git.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(RECORD)
            yield from whole
    if git.returncode:
        raise RuntimeError(f"git ended with {git.returncode} before it had told the log of {root}")
    yield rest


def read_log(spark: SparkSession, root: str, max_commits: int | None = None) -> DataFrame:
    """Raw log records, one row each, the newest ``max_commits`` if given; a folder without history
    has none."""

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["root"]:
                rows: list[str] = []
                for record in _stream_log(folder, max_commits):
                    rows.append(record)
                    if len(rows) == 2000:
                        yield pd.DataFrame({"record": rows})
                        rows = []
                if rows:
                    yield pd.DataFrame({"record": rows})

    table = spark.createDataFrame([(root,)], "root string")
    return table.mapInPandas(records, "record string")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parse_records(records: DataFrame) -> DataFrame:
    """Records to commits with their file lists; records with a short header are dropped."""
    lines = F.split(_strip(F.col("record")), "\n")
    parts = F.split(lines[0], FIELD)
    files = F.filter(
        F.transform(F.slice(lines, F.lit(2), F.size(lines)), _strip), lambda name: name != ""
    )
    return records.where(F.size(parts) >= 4).select(
        parts[0].alias("commit_id"), parts[1].alias("author"), parts[2].alias("date"),
        F.array_join(F.slice(parts, F.lit(4), F.size(parts)), FIELD).alias("subject"),
        files.alias("files"),
    )


def touches(commits: DataFrame, as_of: Column, window_days: int = WINDOW_DAYS) -> DataFrame:
    """One row per commit and file with the commit's flags: no join on the commit needed."""
    flagged = with_moment(commits, as_of, window_days)
    return flagged.select(
        "commit_id", F.explode("files").alias("path"), "author", "date_rank",
        "recent", "bot", "bugfix", "revert",
    )
