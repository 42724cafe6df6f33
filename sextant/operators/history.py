"""Change history: churn, authorship and change coupling.

Input is the *touch* table, one row per commit and file:
``commit_id, path, author, date_rank, recent, bot, bugfix, revert``. Git ingestion produces it by
exploding the file list of a commit, so the commit's attributes travel with the row and no
join on the commit is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.session import cut_lineage

# Commit classification. The lookarounds keep word edges ASCII in Java too.
_EDGE = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
BUGFIX = r"(?i)" + _EDGE[0] + r"(?:fix(?:es|ed)?|bug|hotfix|revert|regression|broken)" + _EDGE[1]
REVERT = r"(?i)" + _EDGE[0] + r"revert" + _EDGE[1]
BOT = r"(?i)(?:\[bot\]|bot$|dependabot|renovate|github-actions)"

# History defaults.
WINDOW_DAYS = 90
MAX_CHANGESET = 25
MIN_CO_CHANGES = 3
TOP_COUPLINGS = 5

COUPLINGS_TYPE = "array<struct<path:string,co_changes:bigint,strength:double>>"


def date_rank(date: Column) -> Column:
    """ISO date text as a number with the text's own order.

    The latest and earliest date of a file compare as text. A number keeps the aggregation
    buffers fixed-width, hence in the hash aggregate, where text would fall back to sorting.
    """
    digits = F.translate(F.substring(date, 1, 19), "-T:", "").cast("bigint")
    sign = F.substring(date, 20, 1)
    hhmm = F.translate(F.substring(date, 21, 5), ":", "")
    offset = F.when(sign.isin("+", "-"), hhmm.cast("int")).otherwise(F.lit(0))
    zone = F.when(sign == "+", F.lit(0)).when(sign == "-", F.lit(10000)).otherwise(F.lit(20000))
    return digits * F.lit(100000) + zone + offset


def date_text(rank: Column) -> Column:
    digits = F.lpad(F.floor(rank / F.lit(100000)).cast("bigint").cast("string"), 14, "0")
    code = F.pmod(rank, F.lit(100000))
    hhmm = F.lpad(F.pmod(code, F.lit(10000)).cast("string"), 4, "0")
    offset = F.concat(F.substring(hhmm, 1, 2), F.lit(":"), F.substring(hhmm, 3, 2))
    zone = (
        F.when(code >= 20000, F.lit("Z"))
        .when(code >= 10000, F.concat(F.lit("-"), offset))
        .otherwise(F.concat(F.lit("+"), offset))
    )
    return F.concat(
        F.substring(digits, 1, 4), F.lit("-"),
        F.substring(digits, 5, 2), F.lit("-"),
        F.substring(digits, 7, 2), F.lit("T"),
        F.substring(digits, 9, 2), F.lit(":"),
        F.substring(digits, 11, 2), F.lit(":"),
        F.substring(digits, 13, 2), zone,
    )


def with_moment(commits: DataFrame, as_of: Column, window_days: int = WINDOW_DAYS) -> DataFrame:
    """Flag each commit (``author, date, subject``) as recent, bot, bug fix, revert."""
    cutoff = as_of - F.expr(f"INTERVAL {int(window_days)} DAYS")
    return commits.withColumns(
        {
            "date_rank": date_rank(F.col("date")),
            "recent": F.coalesce(F.to_timestamp("date") >= cutoff, F.lit(False)),
            "bot": F.col("author").rlike(BOT),
            "bugfix": F.col("subject").rlike(BUGFIX),
            "revert": F.col("subject").rlike(REVERT),
        }
    )


def keep_known(touches: DataFrame, units: DataFrame) -> DataFrame:
    """Touched files that are scanned units (``units.path``)."""
    return touches.join(units.select("path"), "path", "left_semi")


def churn(touches: DataFrame, key: str = "path") -> DataFrame:
    """Commit counters per file, files named by ``key``. Bots count here."""
    return touches.groupBy(key).agg(
        F.count(F.lit(1)).alias("commits"),
        F.count_if("recent").alias("recent_commits"),
        F.count_if("bugfix").alias("bug_fix_commits"),
        F.count_if("revert").alias("revert_commits"),
        date_text(F.max("date_rank")).alias("last_modified"),
        date_text(F.min("date_rank")).alias("first_seen"),
    )


def author_tally(touches: DataFrame, key: str = "path") -> DataFrame:
    return (
        touches.where(~F.col("bot"))
        .groupBy(key, "author")
        .agg(
            F.count(F.lit(1)).alias("all_commits"),
            F.count_if("recent").alias("recent_commits"),
        )
    )


def authorship(tally: DataFrame, key: str = "path") -> DataFrame:
    """Distinct authors and the leading author's share of the recent commits."""
    total = F.sum("recent_commits")
    return tally.groupBy(key).agg(
        F.count(F.lit(1)).alias("authors"),
        F.count_if(F.col("recent_commits") > 0).alias("recent_authors"),
        F.when(total > 0, F.max("recent_commits") / total)
        .otherwise(F.lit(0.0))
        .alias("primary_author_share"),
    )


def changesets(
    touches: DataFrame, max_changeset: int = MAX_CHANGESET, key: str = "path"
) -> DataFrame:
    """Sorted file list of every commit with 2 to ``max_changeset`` files, by ``key``.

    A commit is only told apart from an oversized one, so at most ``max_changeset + 1`` rows of
    it are needed. The row-number filter becomes a group limit ahead of the exchange: a commit
    that holds a third of all rows still sends a handful of rows per map task.
    """
    order = Window.partitionBy("commit_id").orderBy(key)
    return (
        touches.select("commit_id", key)
        .withColumn("at", F.row_number().over(order))
        .where(F.col("at") <= max_changeset + 1)
        .groupBy("commit_id")
        .agg(F.array_sort(F.collect_list(key)).alias("paths"))
        .where(F.size("paths").between(2, max_changeset))
    )


def co_change_pairs(
    touches: DataFrame, max_changeset: int = MAX_CHANGESET, key: str = "path"
) -> DataFrame:
    """Number of commits per file pair ``a < b``, files named by ``key``.

    Pairs come from the bounded per-commit array by two explodes, without a self-join, and are
    counted on the map side before the exchange.
    """
    firsts = changesets(touches, max_changeset, key).select(
        "paths", F.posexplode("paths").alias("at", "a")
    )
    later = F.slice("paths", F.col("at") + 2, F.size("paths"))
    return (
        firsts.select("a", F.explode(later).alias("b"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("co_changes"))
    )


def couplings(
    pairs: DataFrame, churn_: DataFrame, min_co_changes: int = MIN_CO_CHANGES, key: str = "path"
) -> DataFrame:
    """Pairs above the threshold with their strength; the joins see only those.

    ``key`` is what names the files of ``pairs``, a column of ``churn_``; the result has paths.
    """

    def side(end: str) -> DataFrame:
        return churn_.select(
            F.col(key).alias(end), F.col("path").alias(f"path_{end}"),
            F.col("commits").alias(f"commits_{end}"),
        )

    return (
        pairs.where(F.col("co_changes") >= min_co_changes)
        .join(side("a"), "a")
        .join(side("b"), "b")
        .select(
            F.least("path_a", "path_b").alias("a"), F.greatest("path_a", "path_b").alias("b"),
            "co_changes",
            (F.col("co_changes") / F.least("commits_a", "commits_b")).alias("strength"),
        )
    )


def directed(couplings_: DataFrame) -> DataFrame:
    """Both directions of every coupling in one pass over the pairs."""
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("path"), F.col("b").alias("other")),
            F.struct(F.col("b").alias("path"), F.col("a").alias("other")),
        )
    )
    return couplings_.select(ends.alias("end"), "co_changes", "strength").select(
        "end.path", "end.other", "co_changes", "strength"
    )


def top_couplings(couplings_: DataFrame, top: int = TOP_COUPLINGS) -> DataFrame:
    """Strongest partners per file, one row each.

    Equal strengths are ordered by more shared commits, then by path; the order among them is
    otherwise left to the order commits were read in.
    """
    order = Window.partitionBy("path").orderBy(
        F.desc("strength"), F.desc("co_changes"), F.asc("other")
    )
    return (
        directed(couplings_)
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= top)
    )


def coupling_counts(couplings_: DataFrame) -> DataFrame:
    """Partners per file before the cut to the strongest."""
    return directed(couplings_).groupBy("path").agg(F.count(F.lit(1)).alias("sum_coupling"))


def coupling_lists(top: DataFrame) -> DataFrame:
    """Ordered array of the strongest partners; bounded by the cut."""
    listed = F.array_sort(F.collect_list(F.struct("position", "other", "co_changes", "strength")))
    return top.groupBy("path").agg(
        F.transform(
            listed,
            lambda c: F.struct(
                c["other"].alias("path"),
                c["co_changes"].alias("co_changes"),
                c["strength"].alias("strength"),
            ),
        ).alias("couplings")
    )


def file_history(
    touches: DataFrame,
    max_changeset: int = MAX_CHANGESET,
    min_co_changes: int = MIN_CO_CHANGES,
    top: int = TOP_COUPLINGS,
    paths: DataFrame | None = None,
) -> DataFrame:
    """All history columns of every touched file.

    ``touches`` is read three times; callers pass a stored table. The pairs above the threshold
    feed both the counts and the strongest partners, and the counters of the files are looked up
    for both ends of a pair, so these are stored too. With ``paths`` (``path_id, path``, each once)
    files of ``touches`` are named by ``path_id`` alone, and only what is left of them by paths.
    """
    key = "path" if paths is None else "path_id"
    counted = churn(touches, key)
    counters = cut_lineage(counted if paths is None else counted.join(paths, key))
    linked = cut_lineage(
        couplings(co_change_pairs(touches, max_changeset, key), counters, min_co_changes, key)
    )
    return (
        counters.join(authorship(author_tally(touches, key), key), key, "left")
        .join(coupling_counts(linked), "path", "left")
        .join(coupling_lists(top_couplings(linked, top)), "path", "left")
        .select(
            "path", "commits", "recent_commits",
            F.coalesce("authors", F.lit(0)).alias("authors"),
            F.coalesce("recent_authors", F.lit(0)).alias("recent_authors"),
            F.coalesce("primary_author_share", F.lit(0.0)).alias("primary_author_share"),
            "bug_fix_commits", "revert_commits", "last_modified", "first_seen",
            F.coalesce("sum_coupling", F.lit(0)).alias("sum_coupling"),
            F.coalesce("couplings", F.array().cast(COUPLINGS_TYPE)).alias("couplings"),
        )
    )
