"""From raw documents to shards: each stage works on all that its predecessor kept.

``run`` applies the stages to ``documents``; between two stages the rows are written
as Parquet below the session's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ratebook.llm import decontaminate, jaccard, langid, mixing, sharding
from ratebook.llm.common import small
from ratebook.operators.staging import stage

LEAST_SCORE = 0.5
SHARDS = 40


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _row_key() -> Column:
    """Names a row by its id, source and text, each of which may be NULL."""
    told = [F.coalesce(F.md5(F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "source", "text")]
    return F.unhex(F.md5(F.concat_ws("|", *told)))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, or whose language none of the learned ones explains.

    The model learns from the stage's own rows that have a language; a document goes
    if its calibrated probability is below one half. A row without an id is judged like
    the others.
    """
    model = langid.fit(docs)
    name = _fresh(docs, "_told")
    told = F.col(name)
    return (
        docs.withColumn(name, langid.scored(model, F.col("text")))
        .where((told["lang_pred"] != langid.UND) & (told["score"] >= LEAST_SCORE))
        .select(*docs.columns)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: one with the least id of the group.

    Rows are judged by their text, so rows that share an id have fates of their own. A
    group whose ids are all NULL keeps one of its rows.
    """
    rows, texts = jaccard.tied_texts(docs)
    least = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "tk")).alias("least")
    groups = texts.groupBy("root").agg(least, F.sum("weight").alias("rows")).where("rows > 1")
    fate = stage(texts.join(groups, "root").select("tk", "rep", (F.col("tk") == F.col("least.tk")).alias("stays")))
    first = rows.join(small(fate), "tk").where(F.col("stays") & rows["doc_id"].eqNullSafe(fate["rep"]))
    many = stage(first.groupBy("tk").count().where("count > 1").select("tk", F.lit(True).alias("many")))
    names = {c: _fresh(docs, f"_{c}") for c in ("tk", "rep", "stays", "many")}
    tk, rep, stays, several = names.values()
    told = stage(fate.join(many, "tk", "left")).withColumnsRenamed(names)
    kept = (
        docs.withColumn(tk, F.md5("text"))
        .join(small(told), tk, "left")
        .where(F.col(stays).isNull() | (F.col(stays) & F.col("doc_id").eqNullSafe(F.col(rep))))
    )
    if many.isEmpty():
        return kept.select(*docs.columns)
    one = kept.where(F.col(several)).groupBy(tk).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return kept.where(F.col(several).isNull()).select(*docs.columns).union(one.select("row.*"))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold ten consecutive words of a benchmark item, or a whole shorter one.

    Rows are judged by their text, whatever their id.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = docs.select(F.unhex(F.md5("text")).alias("doc_id"), "text")
    tk = _fresh(docs, "_tk")
    gone = decontaminate.contamination(texts, items).where("contaminated").select(F.col("doc_id").alias(tk))
    return (
        docs.withColumn(tk, F.unhex(F.md5("text")))
        .join(small(stage(gone.distinct())), tk, "left_anti")
        .select(*docs.columns)
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that each source comes near its target.

    A document is written as many times as its share of the mix rounds to, the
    fraction decided by a seeded draw of its id, source and text.
    """
    keyed = docs.select(F.hex(_row_key()).alias("doc_id"), "source", "text")
    told = mixing.mix(keyed).select("doc_id", "size", "taken").where("size > 0")
    draw = mixing.seeded(66, F.col("doc_id")) / float(1 << 60)
    times = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    key, count, copy = _fresh(docs, "_key"), _fresh(docs, "_times"), _fresh(docs, "_copy")
    often = (
        told.groupBy(F.unhex("doc_id").alias(key)).agg(F.max(times).alias(count)).where(F.col(count) > 0)
    )
    return (
        docs.withColumn(key, _row_key())
        .join(small(stage(often)), key)
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count))))
        .select(*docs.columns)
    )


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining row's shard and slot."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("language", language),
    ("near duplicates", near_duplicates),
    ("decontamination", clean),
    ("mixing", mix),
    ("sharding", shard),
]

# Two stages, a learned model and a join by random paths, are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs)
    return docs
