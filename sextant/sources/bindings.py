"""The analytics vocabulary over a star schema of Parquet tables.

``part`` plays the file, ``orders`` the commit, ``lineitem`` the touched file and the import
statement, ``documents`` the source text, ``pages`` a tree of addresses and ``events`` the usage
ledger. Every binding is a projection or join of whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators.graph import distinct_edges
from sextant.operators.history import MAX_CHANGESET, file_history, with_moment
from sextant.operators.history import churn as churn_of
from sextant.session import cut_lineage

MODEL = "judge-1"


class Tables:
    """Bindings on one directory of Parquet tables."""

    def __init__(self, spark: SparkSession, directory: str) -> None:
        self.spark, self.directory = spark, directory.rstrip("/")

    def read(self, name: str) -> DataFrame:
        """A table as it lies, with the schema that its files have now."""
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def unit_path(self) -> Column:
        return F.concat_ws(
            "/", "p_brand", "p_type", F.concat(F.lit("part_"), F.col("p_partkey").cast("string"))
        )

    def units(self) -> DataFrame:
        """Files: one per part. The PROMO shelf plays the tests; size 50 cannot be judged."""
        size = F.col("p_size").cast("int")
        facts = F.struct(
            F.lit(1).alias("functions"),
            (size + 1).alias("total_cyclomatic"),
            size.alias("max_cyclomatic"),
            F.floor(size / 10).cast("int").alias("max_nesting"),
            (size * 2).alias("max_function_lines"),
        )
        return self.read("part").select(
            F.col("p_partkey").alias("unit_id"),
            self.unit_path().alias("path"),
            F.when(F.col("p_type") == "PROMO", "test").otherwise("source").alias("kind"),
            F.lit("typescript").alias("language"),
            F.floor("p_retailprice").alias("bytes"),
            F.sha2(F.col("p_name"), 256).alias("hash"),
            F.lit(0).alias("type_imports"),
            F.array(F.translate("p_name", " ", "_")).alias("exports"),
            F.lit(0).alias("type_exports"),
            facts.alias("complexity_facts"),
            F.when(size == 50, "too large to judge").alias("error"),
        )

    def unit_keys(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").alias("unit_id"), self.unit_path().alias("path")
        )

    def path_numbers(self) -> DataFrame:
        """Every path once with ``path_id``, a number; stored."""
        paths = self.unit_keys().select("path").distinct()
        return cut_lineage(paths.withColumn("path_id", F.monotonically_increasing_id()))

    def numbered_keys(self, numbers: DataFrame | None = None) -> DataFrame:
        """``unit_keys`` with ``path_id``, one number for each path."""
        return self.unit_keys().join(self.path_numbers() if numbers is None else numbers, "path")

    def as_of(self) -> Column:
        """The latest commit's instant, as a scalar subquery."""
        return self.read("orders").agg(F.max("o_orderdate").cast("timestamp")).scalar()

    def commits(self) -> DataFrame:
        """Commits: author, ISO date and subject derived from the order."""
        bot = F.when(F.col("c_mktsegment") == "MACHINERY", "[bot]").otherwise("")
        subject = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "Revert the last order")
            .when(F.col("o_orderpriority") == "2-HIGH", "fix: order entry")
            .otherwise("prefix the order")
        )
        raw = (
            self.read("orders")
            .select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
            .join(
                self.read("customer").select("c_custkey", "c_mktsegment"),
                F.col("o_custkey") == F.col("c_custkey"),
            )
            .select(
                F.col("o_orderkey").alias("commit_id"),
                F.concat(F.lit("author_"), F.col("o_custkey").cast("string"), bot).alias("author"),
                F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"),
                subject.alias("subject"),
            )
        )
        return with_moment(raw, self.as_of())

    def touches(self, keys: DataFrame | None = None) -> DataFrame:
        """Commit and file, once each, with the commit's flags.

        The exchanges are left to the joins: only those can be split at run time when one
        commit or one file holds most of the rows.
        """
        lines = (
            self.read("lineitem")
            .select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("unit_id"))
            .distinct()
        )
        flags = self.commits().select(
            "commit_id", "author", "date_rank", "recent", "bot", "bugfix", "revert"
        )
        if keys is None:
            return lines.join(flags, "commit_id").join(self.unit_keys(), "unit_id").drop("unit_id")
        # Numbers of files are narrower than the flags, so they go through the first of the joins.
        return lines.join(keys, "unit_id").drop("unit_id").join(flags, "commit_id")

    def file_touches(self, keys: DataFrame | None = None) -> DataFrame:
        """Commit and file only, for co-change."""
        lines = (
            self.read("lineitem")
            .select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("unit_id"))
            .distinct()
        )
        return lines.join(self.unit_keys() if keys is None else keys, "unit_id").drop("unit_id")

    def import_statements(self) -> DataFrame:
        """A line's part names the part numbered like its supplier."""
        return self.read("lineitem").select(
            F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")
        )

    def edges(self) -> DataFrame:
        """Distinct imports between files; repeats go before the paths are looked up."""
        keys = self.unit_keys()
        pairs = distinct_edges(self.import_statements())
        source = keys.select(F.col("unit_id").alias("src"), F.col("path").alias("src_path"))
        target = keys.select(F.col("unit_id").alias("dst"), F.col("path").alias("dst_path"))
        return (
            pairs.join(source, "src")
            .join(target, "dst")
            .select(F.col("src_path").alias("src"), F.col("dst_path").alias("dst"))
        )

    def churn(self) -> DataFrame:
        return churn_of(self.touches())

    def history(self, max_changeset: int = MAX_CHANGESET, min_co_changes: int = 2) -> DataFrame:
        numbers = self.path_numbers()
        touched = cut_lineage(self.touches(self.numbered_keys(numbers).drop("path")))
        return file_history(touched, max_changeset, min_co_changes, paths=numbers)

    def texts(self) -> DataFrame:
        """Source texts: one per document."""
        return self.read("documents").select(
            F.concat_ws(
                "/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
            ).alias("path"),
            F.col("text").alias("content"),
            "lang",
        )

    def source_paths(self) -> DataFrame:
        """Documents as source files: the language gives the extension, short ones are tests."""
        name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
        short, long = F.col("n_chars") < 500, F.col("n_chars") > 5000

        def if_short(text: str) -> Column:
            return F.when(short, F.lit(text)).otherwise(F.lit(""))

        script = F.when(short, ".test.ts").when(long, ".min.js").otherwise(".ts")
        below = (
            F.when(F.col("lang") == "en", F.concat(F.lit("en/"), name, script))
            .when(F.col("lang") == "de", F.concat(F.lit("de/"), if_short("test_"), name, F.lit(".py")))
            .when(F.col("lang") == "fr", F.concat(F.lit("fr/"), name, if_short("_test"), F.lit(".go")))
            .otherwise(F.concat(F.when(short, "tests/").otherwise("es/"), name, F.lit(".rs")))
        )
        return self.read("documents").select(
            F.concat_ws("/", F.col("source"), below).alias("path"), F.col("text").alias("content")
        )

    def ledger(self) -> DataFrame:
        """Usage runs: one per user and day."""
        return (
            self.read("events")
            .groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(
                F.count(F.lit(1)).alias("calls"),
                F.count_if(F.col("event_type") == "view").alias("cached"),
                F.count_if(F.col("event_type") == "error").alias("failed"),
                F.sum(F.floor(F.col("value") * 100)).alias("input_tokens"),
                F.sum(F.floor(F.col("value") * 10)).alias("output_tokens"),
            )
            .select(
                F.concat_ws("_", F.lit("run"), F.col("user_id").cast("string"),
                            F.date_format("day", "yyyyMMdd")).alias("id"),
                F.date_format("day", "yyyy-MM-dd'T'00:00:00'Z'").alias("started_at"),
                F.lit(MODEL).alias("model"),
                "calls", "cached", "failed", "input_tokens", "output_tokens",
            )
        )
