"""Commit logs as text, read back: each order is a record in the form that git prints, its line items
the files it touched. Some records are cut short, some subjects hold a field mark, and every record
names a file that is no unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.operators import history
from sextant.sources import gitlog
from sextant.sources.bindings import Tables

EXTRA = "docs/notes.md"


def records(t: Tables) -> DataFrame:
    listed = t.file_touches().groupBy("commit_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    mark = F.lit(gitlog.FIELD)
    commits = t.commits().join(listed, "commit_id", "left")
    head = F.concat(F.col("commit_id").cast("string"), mark, "author", mark, "date")
    more = F.when(F.col("commit_id") % 5 == 0, F.concat(mark, F.lit("more"))).otherwise("")
    names = F.concat(F.array(F.lit(EXTRA)), F.coalesce("paths", F.array().cast("array<string>")))
    whole = F.concat(
        F.lit("\n"), head, mark, "subject", more, F.lit("\n\n"),
        F.array_join(F.transform(names, lambda name: F.concat(F.lit("  "), name)), "\n"), F.lit("\n"),
    )
    return commits.select(F.when(F.col("commit_id") % 13 == 0, head).otherwise(whole).alias("record"))


def log_commits(t: Tables) -> DataFrame:
    return gitlog.parse_records(records(t)).withColumn("files", F.array_join("files", ","))


def log_churn(t: Tables) -> DataFrame:
    """Commit counters of the units that the log names; other files are left out."""
    touched = gitlog.touches(gitlog.parse_records(records(t)), t.as_of())
    return history.churn(history.keep_known(touched, t.units()))


COMMITS_SQL = f"""
SELECT parts[1] AS commit_id, parts[2] AS author, parts[3] AS date,
  array_to_string(parts[4:], chr(31)) AS subject,
  array_to_string(list_filter(list_transform(rows[2:], lambda x: trim(x)), lambda x: x <> ''), ',') AS files
FROM (SELECT rows, string_split(rows[1], chr(31)) AS parts FROM (
  SELECT string_split(regexp_replace(record, '^\\s+|\\s+$', '', 'g'), chr(10)) AS rows FROM (
    SELECT CASE WHEN commit_id % 13 = 0 THEN concat_ws(chr(31), commit_id, author, date)
      ELSE chr(10) || concat_ws(chr(31), commit_id, author, date, subject)
        || CASE WHEN commit_id % 5 = 0 THEN chr(31) || 'more' ELSE '' END || chr(10) || chr(10) || '  {EXTRA}'
        || coalesce(names, '') || chr(10) END AS record
    FROM commits LEFT JOIN (
      SELECT commit_id, string_agg(chr(10) || '  ' || path, '' ORDER BY path) AS names FROM touches
      GROUP BY commit_id) USING (commit_id))))
WHERE len(parts) >= 4"""

CHURN_SQL = """
SELECT path, count(*) AS commits, count_if(recent) AS recent_commits, count_if(bugfix) AS bug_fix_commits,
  count_if(revert) AS revert_commits, max(date) AS last_modified, min(date) AS first_seen
FROM touches WHERE commit_id % 13 <> 0 GROUP BY path"""
