"""Files in and out: JSON lines of questions, the id cache, XML records, JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.dedup import first_by_key
from paperloom.session import shared_path

QUESTION = "qid string, question string, answer_arxiv_id array<string>, answer array<string>, source_meta struct<split:string,published_time:string>"
# Months as they are abbreviated.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no bigint, value: lines of a text in order from 0. Partitions are counted, so no single task numbers all lines."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("id"))
    lines = lines.select("value", F.shiftright("id", 33).alias("part"), (F.col("id").bitwiseAND(2**33 - 1)).alias("at"))
    counts = {r["part"]: r["n"] for r in lines.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per file split
    start, before = [], 0
    for part in sorted(counts):
        start.append((part, before))
        before += counts[part]
    if not start:
        return lines.select(F.col("at").alias("line_no"), "value")
    offsets = spark.createDataFrame(start, "part bigint, before bigint")
    return lines.join(F.broadcast(offsets), "part").select((F.col("before") + F.col("at")).alias("line_no"), "value")


def read_questions(spark: SparkSession, path: str, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Questions with gold answers out of JSON lines. offset counts lines, limit kept rows; blank lines are passed over; a missing qid becomes row_<line>."""
    rows = numbered_lines(spark, path).where((F.col("line_no") >= offset) & (F.trim("value") != ""))
    parsed = rows.select("line_no", F.from_json("value", QUESTION).alias("q")).select("line_no", "q.*")
    out = parsed.withColumn("qid", F.coalesce(F.nullif("qid", F.lit("")), F.concat(F.lit("row_"), F.col("line_no").cast("string"))))
    return out if limit is None else out.orderBy("line_no").limit(limit)


def write_questions(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct("qid", "question", "answer_arxiv_id", "answer", "source_meta")).alias("value")).write.mode("overwrite").text(path)


class IdCache:
    """A table of records by id, as Parquet in the shared folder: the last record of an id stays.

    Every load is a new version next to the old one, so readers of the old one go on.
    """

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path
        self.loads = 0

    def table(self) -> DataFrame:
        schema = "id string, data string, seq bigint"
        return self.spark.read.schema(schema).parquet(self.path) if self.path else self.spark.createDataFrame([], schema)

    def upsert(self, records: DataFrame) -> None:
        """records: id, data, and seq to tell which of two of one load is later. Rows without id are passed over."""
        self.loads += 1
        fresh = records.where("id is not null and id <> ''").select("id", "data", (F.col("seq") + F.lit(self.loads * 2**40)).alias("seq"))
        path = shared_path(self.spark, "idcache")
        first_by_key(self.table().unionByName(fresh), ["id"], "seq", last=True).write.parquet(path)
        self.path = path

    def load_lines(self, path: str, ident: str = "arxivId") -> None:
        """Upsert JSON lines; lines that can't be read or have no id are passed over."""
        lines = numbered_lines(self.spark, path)
        self.upsert(lines.select(F.get_json_object(F.when(F.try_parse_json("value").isNotNull(), F.col("value")), f"$.{ident}").alias("id"), F.col("value").alias("data"), F.col("line_no").alias("seq")))

    def get(self, *ids: str) -> DataFrame:
        return self.table().where(F.col("id").isin(*ids)).select("id", "data")

    def lookup(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits with data, misses) of a column id: only misses are left to ask a provider for."""
        have = self.table().select("id", "data")
        return wanted.join(have, "id"), wanted.join(have.select("id"), "id", "left_anti")

    def count(self) -> int:
        return self.table().count()


ARTICLE = "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:array<string>>,Journal:struct<JournalIssue:struct<PubDate:struct<Year:int,Month:string>>>>>, PubmedData struct<ReferenceList:struct<Reference:array<string>>>"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """id, title, abstract, year, month, n_references out of XML files of biomedical articles. Month names become numbers, absent ones null."""
    return _articles(spark.read.format("xml").option("rowTag", "PubmedArticle").schema(ARTICLE).load(path))


def parse_articles(rows: DataFrame, record: str) -> DataFrame:
    """read_articles() of records that are already rows."""
    return _articles(rows.select(F.from_xml(F.col(record), ARTICLE).alias("x")).select("x.*"))


def _articles(rows: DataFrame) -> DataFrame:
    date = "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    month = F.col(f"{date}.Month")
    number = month.try_cast("int")
    for i, m in enumerate(MONTHS):
        number = F.when(F.left(F.initcap(month), F.lit(3)) == m, i + 1).otherwise(number)
    return rows.select(
        F.col("MedlineCitation.PMID").alias("id"), F.col("MedlineCitation.Article.ArticleTitle").alias("title"), F.array_join("MedlineCitation.Article.Abstract.AbstractText", " ").alias("abstract"),
        F.col(f"{date}.Year").alias("year"), number.alias("month"), F.greatest(F.coalesce(F.size("PubmedData.ReferenceList.Reference"), F.lit(0)), F.lit(0)).alias("n_references"),
    )


def write_stages(stages: dict[str, DataFrame], path: str) -> None:
    """One folder of JSON lines for each stage of a run."""
    for name, df in stages.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_report(scores: DataFrame, summary: DataFrame, path: str, by: str = "split") -> None:
    """A macro block, and the scores of every question by split."""
    summary.write.mode("overwrite").json(f"{path}/macro")
    scores.write.mode("overwrite").partitionBy(by).json(f"{path}/samples")


def stage_log(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n: a line for each stage of a run."""
    out = None
    for name, df in stages.items():
        line = df.agg(F.lit(name).alias("stage"), F.count("*").alias("n"))
        out = line if out is None else out.unionByName(line)
    return out
