"""The keyword filter by an index: posting lists of trigrams, and the filter itself on what they leave.

The index has, for each three neighbouring characters of a searched column in lower case, the ids of the rows that hold them, in lists of LIST ids, and how many
there are. A keyword of three characters or more is looked up by the RAREST of its trigrams; a trigram without a list ends the search. The rows that hold all of these
are read by id and tested for the whole keyword, so the index decides nothing by itself, and `%` and `_` are characters like others. Shorter keywords scan.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import includes

COLUMNS = ("title", "catalogNo", "notes")
LIST = 4096
RAREST = 3


def trigrams(text: Column) -> Column:
    """The distinct runs of three characters of a lower-case text; none of a shorter one or of null."""
    starts = F.when(F.length(text) > 2, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(3))))


@dataclass(frozen=True)
class KeywordIndex:
    path: str
    id_col: str = "id"
    columns: tuple[str, ...] = COLUMNS

    def create(self, rows: DataFrame) -> None:
        """Write the index of rows; their ids are not null. A trigram that most rows hold has many lists, made by many tasks."""
        grams = F.array_distinct(F.flatten(F.array(*[trigrams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in self.columns])))
        held = rows.select(F.explode(grams).alias("gram"), F.col(self.id_col).alias("id"))
        counts = held.groupBy("gram").agg(F.count("*").alias("n"))
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.option("parquet.bloom.filter.enabled#gram", "true").parquet(f"{self.path}/counts")
        total = rows.count()
        lists = held.groupBy("gram", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-total // LIST)))).alias("list")).agg(F.collect_list("id").alias("ids"))
        lists = lists.repartitionByRange("gram", "list").sortWithinPartitions("gram", "list")
        lists.write.option("parquet.bloom.filter.enabled#gram", "true").option("parquet.block.size", 1 << 20).parquet(f"{self.path}/lists")

    def candidates(self, spark: SparkSession, q: str) -> DataFrame | None:
        """(id) of the rows that hold the keyword's rarest trigrams; None if it has none."""
        own = q.strip().lower()
        grams = list(dict.fromkeys(own[i : i + 3] for i in range(len(own) - 2)))
        if not grams:
            return None
        n = {r.gram: r.n for r in spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(grams)).collect()}
        rare = sorted(grams, key=lambda g: (n.get(g, 0), g))[:RAREST]
        lists = spark.read.parquet(f"{self.path}/lists").where(F.col("gram").isin(rare) if rare[0] in n else F.lit(False))
        return lists.select("gram", F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rare)).select("id")

    def search(self, rows: DataFrame, q: str) -> DataFrame:
        """The rows that the filter of keyword q lets through."""
        own = q.strip()
        if not own:
            return rows
        hit = F.lit(False)
        for c in self.columns:
            hit = hit | includes(F.col(c), own)
        few = self.candidates(rows.sparkSession, own)
        if few is not None:
            rows = rows.join(few.withColumnRenamed("id", "__id"), F.col(self.id_col) == F.col("__id"), "left_semi")
        return rows.where(hit)
