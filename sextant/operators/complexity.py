"""Complexity of files from tables of their lines and scopes.

Lines, braces and scopes are rows with a place in their file; depth is a running sum, the end of a
scope the next row of its level, and the function that owns a line the last one that opened at the
line's depth of functions. All windows are over the file, so a table of files is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sextant.functions.lexer import BLOCK_STARTS, FUNCTION_STARTS, code_of, decision_count
from sextant.session import cut_lineage

COUNTERS = ["functions", "total_cyclomatic", "max_cyclomatic", "max_nesting", "max_function_lines"]
PLACE = ["line", "at"]


def _of_file(*order: str):
    return Window.partitionBy("path").orderBy(*order)


def _so_far(*order: str):
    return _of_file(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _before(*order: str):
    return _of_file(*order).rowsBetween(Window.unboundedPreceding, -1)


def lines_of(files: DataFrame, language: str) -> DataFrame:
    """path, line (from 0), text, starts, decisions of ``files`` (path, content)."""
    code = code_of(F.coalesce("content", F.lit("")), language, strings=True)
    lines = files.select("path", F.posexplode(F.split(code, "\n", -1)).alias("line", "text"))
    return lines.select(
        "path", "line", "text", F.col("text").rlike(FUNCTION_STARTS[language]).alias("starts"),
        decision_count(F.col("text"), language).alias("decisions"),
    )


def with_owner(events: DataFrame) -> DataFrame:
    """``events`` (path, line, at, opens, closes; the function that a row opens, how many it closes)
    with ``depth``, the functions open after the row, and ``owner``, the place at which the
    innermost of them opened."""
    depth = F.sum(F.col("opens").cast("int") - F.col("closes")).over(_so_far(*PLACE))
    same = (
        Window.partitionBy("path", "depth").orderBy(*PLACE)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    opened = F.when(F.col("opens"), F.struct("line", "at"))
    last = F.last(opened, ignorenulls=True).over(same)
    return events.withColumn("depth", depth).withColumn(
        "owner", F.when(F.col("depth") > 0, last)
    )


def _counted(files: DataFrame, starts: DataFrame, owned: DataFrame, scopes: DataFrame) -> DataFrame:
    """Counters of each file. ``owned``: path, owner, decisions, nesting of lines; ``scopes``: path,
    owner (where a function opened), nesting, lines of closed functions."""
    per_owner = owned.groupBy("path", "owner").agg(
        F.sum("decisions").alias("decisions"), F.max("nesting").alias("inside")
    )
    scoped = scopes.join(per_owner.where("owner IS NOT NULL"), ["path", "owner"], "left").select(
        "path", (1 + F.coalesce("decisions", F.lit(0))).alias("cyclomatic"),
        F.greatest("nesting", F.coalesce("inside", F.lit(0))).alias("nesting"), "lines",
    )
    whole = per_owner.where("owner IS NULL").select(
        "path", (1 + F.col("decisions")).alias("cyclomatic"), F.lit(0).alias("nesting"), F.lit(0).alias("lines")
    )
    # A file counts once itself, also where no line is its own.
    none = files.select("path", F.lit(1).alias("cyclomatic"), F.lit(0).alias("nesting"), F.lit(0).alias("lines"))
    extra = none.join(whole.select("path"), "path", "left_anti")
    sums = scoped.unionByName(whole).unionByName(extra).groupBy("path").agg(
        F.sum("cyclomatic").alias("total_cyclomatic"), F.max("cyclomatic").alias("max_cyclomatic"),
        F.max("nesting").alias("max_nesting"), F.max("lines").alias("max_function_lines"),
    )
    return sums.join(starts, "path", "left").select(
        "path", F.coalesce("functions", F.lit(0)).cast("int").alias("functions"),
        *(F.col(name).cast("int").alias(name) for name in COUNTERS[1:]),
    )


def brace_complexity(files: DataFrame, language: str) -> DataFrame:
    """path and ``COUNTERS`` of Go or Rust ``files`` (path, content); null content is empty.

    A function is the first block that opens on or after its line, and owns the decisions of the
    lines after the one it opens on, up to the one it closes on, less those of functions inside.
    Nesting is its block's depth. A closing brace with nothing open does not count; a function that
    never closes counts as one, but neither its decisions nor its lines do.
    """
    lines = lines_of(files, language).withColumn(
        "start", F.max(F.when(F.col("starts"), F.col("line"))).over(_so_far("line"))
    )
    braces = F.regexp_extract_all("text", F.lit("[{}]"), 0)
    events = lines.select(
        "path", "line", "start", "starts", "decisions",
        F.posexplode(F.concat(F.array(F.lit("")), braces)).alias("at", "brace"),
    )
    step = F.when(F.col("brace") == "{", 1).when(F.col("brace") == "}", -1).otherwise(0)
    total = F.sum("step").over(_so_far(*PLACE))
    floor = F.least(F.min("total").over(_before(*PLACE)), F.lit(0))
    opened = F.max(F.when(F.col("step") == 1, F.col("line"))).over(_before(*PLACE))
    # Stored: moves, marks and starts are three readers of it.
    leveled = cut_lineage(
        events.withColumn("step", step).withColumn("total", total).withColumns(
            {"floor": F.coalesce(floor, F.lit(0)), "opened": F.coalesce(opened, F.lit(-1))}
        )
        # Below the lowest total so far nothing is open.
        .withColumn("step", F.when(F.col("total") < F.col("floor"), 0).otherwise(F.col("step")))
        .withColumn("blocks", F.col("total") - F.least("floor", "total"))
        .withColumn("level", F.col("blocks") + F.when(F.col("step") == -1, 1).otherwise(0))
        .withColumn("fn", (F.col("step") == 1) & F.coalesce(F.col("start") > F.col("opened"), F.lit(False)))
        .select("path", "line", "at", "starts", "decisions", "step", "level", "fn")
    )
    # Rows of a level: an opening brace, then the brace that closes it, and so on; between them lie
    # only lines.
    moves = leveled.where("step != 0")
    pair = Window.partitionBy("path", "level").orderBy(*PLACE)
    paired = moves.withColumns(
        {
            "closed": F.when(F.col("step") == 1, F.lead("line").over(pair)),
            "closes": F.when(F.col("step") == -1, F.coalesce(F.lag("fn").over(pair), F.lit(False))).otherwise(False),
        }
    )
    marks = leveled.where("at = 0").select(
        "path", "line", "at", F.lit(False).alias("fn"), F.lit(False).alias("closes"), "decisions",
        F.lit(0).alias("level"), F.lit(None).cast("int").alias("closed"), F.lit(True).alias("mark"),
    )
    both = marks.unionByName(
        paired.select("path", "line", "at", "fn", "closes", F.lit(0).alias("decisions"), "level", "closed",
                      F.lit(False).alias("mark"))
    )
    owned = with_owner(
        both.withColumns({"opens": F.col("fn"), "closes": F.col("closes").cast("int")})
    )
    scopes = owned.where("fn AND closed IS NOT NULL").select(
        "path", F.struct("line", "at").alias("owner"), F.col("level").alias("nesting"),
        (F.col("closed") - F.col("line") + 1).alias("lines"),
    )
    starts = leveled.where("at = 0").groupBy("path").agg(F.count_if("starts").alias("functions"))
    of_lines = owned.where("mark").select("path", "owner", "decisions", F.lit(0).alias("nesting"))
    return _counted(files, starts, of_lines, scopes)


def indent_complexity(files: DataFrame) -> DataFrame:
    """path and ``COUNTERS`` of Python ``files`` (path, content); null content is empty.

    A function or block lasts until the next line that is not indented further. Decisions on a
    ``def`` line do not count; nesting is the number of blocks open at a function's own blocks.

    Each line is a row of every level of scopes that it ends: of the file's indents of functions and
    blocks, those not below its own. A file with n such levels has lines with up to n blanks, so
    levels grow with the root of a text's length at most.
    """
    # Stored: scopes, marks and starts are three readers of it.
    raw = cut_lineage(
        lines_of(files, "python").where(F.col("text").rlike(r"\S")).select(
            "path", "line", "starts", "decisions", _indent().alias("indent"),
            (~F.col("starts") & F.col("text").rlike(BLOCK_STARTS)).alias("blocks"),
        )
    )
    filled = raw.withColumns(
        {
            "ended": F.lag("line").over(_of_file("line")),
            "last": F.max("line").over(Window.partitionBy("path")),
        }
    )
    head = F.col("starts") | F.col("blocks")
    levels = F.collect_set(F.when(head, F.col("indent"))).over(Window.partitionBy("path"))
    lines = filled.withColumn("levels", levels)
    ends = lines.withColumn(
        "level", F.explode(F.filter("levels", lambda v: v >= F.col("indent")))
    )
    next_ = Window.partitionBy("path", "level").orderBy("line")
    scopes = (
        ends.withColumns({"end": F.lead("line").over(next_), "until": F.lead("ended").over(next_)})
        .where(head & (F.col("level") == F.col("indent")))
        .select("path", "line", "starts", "blocks", "end", F.coalesce("until", "last").alias("until"))
    )
    # At a line its closed scopes go first, then the line itself, then the scope that it opens.
    marks = lines.select(
        "path", "line", F.lit(1).alias("at"), F.when(F.col("starts"), 0).otherwise(F.col("decisions")).alias("decisions"),
        F.lit(False).alias("opens"), F.lit(0).alias("closes"), F.lit(0).alias("step"), "blocks",
    )
    opened = scopes.select(
        "path", "line", F.lit(2).alias("at"), F.lit(0).alias("decisions"), F.col("starts").alias("opens"),
        F.lit(0).alias("closes"), F.col("blocks").cast("int").alias("step"), F.lit(False).alias("blocks"),
    )
    closed = scopes.where("end IS NOT NULL").groupBy("path", F.col("end").alias("line")).agg(
        F.count_if("starts").cast("int").alias("closes"), (-F.count_if("blocks")).cast("int").alias("step")
    ).select(
        "path", "line", F.lit(0).alias("at"), F.lit(0).alias("decisions"), F.lit(False).alias("opens"),
        "closes", "step", F.lit(False).alias("blocks"),
    )
    events = with_owner(marks.unionByName(opened).unionByName(closed))
    open_blocks = F.sum("step").over(_so_far(*PLACE))
    owned = events.withColumn("open", open_blocks).where("at = 1").select(
        "path", "owner", "decisions",
        F.when(F.col("blocks"), F.col("open") + 1).otherwise(0).alias("nesting"),
    )
    functions = scopes.where("starts").select(
        "path", F.struct("line", F.lit(2).alias("at")).alias("owner"), F.lit(0).alias("nesting"),
        (F.col("until") - F.col("line") + 1).alias("lines"),
    )
    starts = raw.groupBy("path").agg(F.count_if("starts").alias("functions"))
    return _counted(files, starts, owned, functions)


def _indent() -> Column:
    return F.length(F.regexp_extract("text", r"^\s*", 0))


def complexity(files: DataFrame, language: str) -> DataFrame:
    """path and ``COUNTERS`` of files of one language."""
    if language == "python":
        return indent_complexity(files)
    return brace_complexity(files, language)
