"""Attack corpora: scans, the merge in which the first text wins, statistics, and evaluation of a screen over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from promptlens.functions import text as T

RECORD = "id string, text string, category string, source string, type string, is_jailbreak boolean, original_query string"
DIRECT = "id string, question string, policy string, from string"
JAILBREAK = "id string, jailbreak_query string, redteam_query string, policy string, from string, format string"
VERDICTS = ("blocked", "flagged", "passed")


def load_dataset(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON-lines files; blank lines are none."""
    return spark.read.schema(RECORD).json(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A corpus file with a header, quoted fields over several lines, and ``row``, its order of rows."""
    rows = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', enforceSchema=False)
    return rows.withColumn("row", F.monotonically_increasing_id())


def _filled(c: Column) -> Column:
    return F.coalesce(T.strip(c), F.lit(""))


def direct_records(rows: DataFrame, rank: int) -> DataFrame:
    """One record of each question that is not blank; ``rank`` is the source's place in the merge."""
    text = _filled(F.col("question"))
    own = rows.where(text != "")
    return own.select(F.lit(rank).alias("rank"), "row", F.lit(0).alias("sub"), F.concat(F.lit("redteam_"), "id").alias("id"), text.alias("text"), T.policy(F.coalesce("policy", F.lit("unknown"))).alias("category"), F.coalesce("from", F.lit("RedTeam")).alias("source"), F.lit("direct").alias("type"), F.lit(False).alias("is_jailbreak"), F.lit(None).cast("string").alias("original_query"))


def jailbreak_records(rows: DataFrame, rank: int, prefix: str) -> DataFrame:
    """Up to two records of each row: the attack and, where it differs, the plain query behind it."""
    attack, plain = _filled(F.col("jailbreak_query")), _filled(F.col("redteam_query"))
    own = rows.select("*", attack.alias("_a"), plain.alias("_p")).where("_a <> ''")
    differs = F.col("_p") != F.col("_a")
    made = lambda sub, mark, text, kind, jail, query: F.struct(F.lit(sub).alias("sub"), F.concat(F.lit(prefix + mark), "id").alias("id"), text.alias("text"), kind.alias("type"), F.lit(jail).alias("is_jailbreak"), query.alias("original_query"))
    first = made(0, "_", F.col("_a"), F.lower(F.coalesce("format", F.lit("Template"))), True, F.when(differs, F.col("_p")))
    second = made(1, "_clean_", F.col("_p"), F.lit("direct"), False, F.lit(None).cast("string"))
    both = F.array_compact(F.array(first, F.when(differs & (F.col("_p") != ""), second)))
    each = own.select("row", T.policy(F.coalesce("policy", F.lit("unknown"))).alias("category"), F.coalesce("from", F.lit("JailBreakV")).alias("source"), F.explode(both).alias("r"))
    return each.select(F.lit(rank).alias("rank"), "row", "r.sub", "r.id", "r.text", "category", "source", "r.type", "r.is_jailbreak", "r.original_query")


def merged(*sources: DataFrame) -> DataFrame:
    """All sources' records, of each text the first by source, row and place (a grouped minimum, so that copies fold before the shuffle)."""
    rows = reduce(DataFrame.unionByName, sources)
    order = ["rank", "row", "sub"]
    rest = [c for c in rows.columns if c not in order]
    found = rows.groupBy(T.dedup_key(F.col("text")).alias("key")).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return found.select("key", "r.*")


def corpus_stats(records: DataFrame) -> DataFrame:
    """Counts of all records and by category, type and source, in one pass: (dimension, value, n, jailbreaks)."""
    sets = records.groupingSets([["category"], ["type"], ["source"], []], "category", "type", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("is_jailbreak"), 1).otherwise(0)).alias("jailbreaks"), F.grouping_id().alias("g"))
    name = F.when(F.col("g") == 3, "category").when(F.col("g") == 5, "type").when(F.col("g") == 6, "source").otherwise("all")
    return sets.select(name.alias("dimension"), F.when(F.col("g") == 7, "all").otherwise(F.coalesce("category", "type", "source")).alias("value"), "n", "jailbreaks")


def evaluation(screened: DataFrame, by: str) -> DataFrame:
    """How many records of each value of ``by`` have each verdict, and the share in hundredths that was detected."""
    own = screened.groupBy(by).pivot("verdict", list(VERDICTS)).agg(F.count(F.lit(1))).na.fill(0, list(VERDICTS))
    tested = F.col("blocked") + F.col("flagged") + F.col("passed")
    return own.withColumns({"tested": tested, "detection_rate": F.coalesce(F.try_divide((F.col("blocked") + F.col("flagged")) * 100.0, tested), F.lit(0.0))})


def verdict_samples(screened: DataFrame, order: str, text: str, most: dict[str, int] | None = None) -> DataFrame:
    """The first records of each verdict: up to five blocked and flagged and ten passed ones, each with the first 200 characters."""
    most = most or {"blocked": 5, "flagged": 5, "passed": 10}
    rank = F.row_number().over(Window.partitionBy("verdict").orderBy(order))
    limit = reduce(lambda c, k: F.when(F.col("verdict") == k, most[k]).otherwise(c), most, F.lit(0))
    return screened.withColumn("r", rank).where((F.col("r") <= 10) & (F.col("r") <= limit)).select("verdict", order, F.substring(text, 1, 200).alias("sample"))


def knowledge_base(texts: DataFrame, text: str = "text") -> DataFrame:
    """(id ``doc_<place>``, text, source, topic, index) of a small base of texts with a column ``index``."""
    return texts.select(F.concat(F.lit("doc_"), F.col("index").cast("string")).alias("id"), F.col(text).alias("text"), F.lit("knowledge_base").alias("source"), T.topic(F.col(text)).alias("topic"), "index")


def write_knowledge_base(base: DataFrame, path: str) -> None:
    """The base is dropped and made anew."""
    base.write.mode("overwrite").parquet(path)


def retrieved(base: DataFrame, found: DataFrame) -> DataFrame:
    """(q, texts): the texts of the nearest rows of each query, nearest first; ``found`` has q, id and rank, a bounded number for each query."""
    rows = found.join(base.select("id", "text"), "id")
    return rows.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("texts"))
