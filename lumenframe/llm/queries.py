"""Queries of the problems of text data (pN_...), over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import charset_repair, names, packing, tokens, toxicity
from lumenframe.session import cut, table


# Value representations whose text depends on the declared character set, as far as the elements hold them.
ENCODED_VRS = ["PN", "LO", "LT", "UT"]


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of elements, the strings of their values one per line, and of documents."""
    elements = table(spark, d, "elements").where(F.col("vr").isin(ENCODED_VRS) & F.col("values_json").isNotNull())
    plain = F.array_join(F.from_json("values_json", "array<string>"), "\n")
    names = F.from_json("values_json", "array<struct<Alphabetic:string,Ideographic:string,Phonetic:string>>")
    person = F.array_join(F.transform(names, lambda n: F.concat_ws("\n", n["Alphabetic"], n["Ideographic"], n["Phonetic"])), "\n")
    values = elements.select(F.lit("elements").alias("origin"), F.col("element_id").alias("record_id"), F.when(F.col("vr") == "PN", person).otherwise(plain).alias("text"))
    documents = table(spark, d, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("record_id"), "text")
    return values.unionByName(documents)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return charset_repair.repair(_texts(spark, d)).select("origin", "record_id")


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every garbled text with its kind and, where possible, the original text."""
    return charset_repair.repair(_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.pairs(names.link(table(spark, d, "person_names")))


def p3_persons(spark: SparkSession, d: str) -> DataFrame:
    """One row per typed name with its person and the number of rows of that person."""
    linked = names.link(table(spark, d, "person_names"))
    return linked.join(linked.groupBy("person").agg(F.count("*").alias("n_rows")), "person").select("name_id", "person", "n_rows")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(table(spark, d, "documents"))


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every text encoded and decoded again."""
    return tokens.decode_documents(tokens.encode_documents(table(spark, d, "documents")))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or every part of one that exceeds a capacity, with its container."""
    sizes = tokens.encode_documents(table(spark, d, "documents"), count=True)
    return packing.pack(sizes, table(spark, d, "container_sizes"))


def p9_valid(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the packing, per container: all documents are there, none split that fits, whole up to its end, and nothing overfull."""
    sizes = cut(tokens.encode_documents(table(spark, d, "documents"), count=True))
    rows = cut(packing.pack(sizes, table(spark, d, "container_sizes")))
    known = sizes.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"))
    each = rows.groupBy("container", "capacity", "doc_id").agg(F.count("*").alias("parts"), F.sum("size").alias("size")).join(known, "doc_id", "full")
    documents = each.groupBy("container", "capacity").agg(F.count("*").alias("n_documents"), F.count_if((F.col("parts") > 1) & (F.col("n_tokens") <= F.col("capacity"))).alias("split"), F.count_if(~F.col("size").eqNullSafe(F.col("n_tokens").cast("bigint"))).alias("incomplete"))
    bins = rows.groupBy("container", "capacity", "bin_id").agg(F.sum("size").alias("load")).groupBy("container").agg(F.count_if(F.col("load") > F.col("capacity")).alias("overfull"))
    return documents.join(bins, "container").select("container", "n_documents", "split", "incomplete", "overfull")


def _scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score_documents(documents, toxicity.fit(documents, table(spark, d, "labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).where(F.col("toxic_score") >= toxicity.THRESHOLD).where("doc_id is not null").select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score, probability and evidence of every document."""
    return _scores(spark, d)


def p10_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rate of flagged documents per source."""
    return toxicity.source_rates(table(spark, d, "documents"), cut(_scores(spark, d)))


QUERIES = {f.__name__: f for f in (p2_found, p2_restored, p3_found, p3_persons, p8_ids, p8_decoded, p9_packing, p9_valid, p10_found, p10_scores, p10_source_rates)}
ORACLE: dict[str, str] = {
    "p9_valid": "select container, (select count(distinct doc_id) from documents) as n_documents, 0 as split, 0 as incomplete, 0 as overfull from container_sizes",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
