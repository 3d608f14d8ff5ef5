"""Rule tables, reaction log and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry import schema
from digestry.settings import Settings

def read_rules(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A rule table (Parquet); empty, with the same columns, when it is missing. Files that cannot be read are left out;
    `unread_rules` names them."""
    columns = schema.RULE_TABLES[name]
    try:
        return spark.read.schema(columns).option("ignoreCorruptFiles", True).parquet(f"{folder}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], columns)


def unread_rules(spark: SparkSession, folder: str, names: Sequence[str] = tuple(schema.RULE_TABLES)) -> DataFrame:
    """(name, file, reason) of files of rule tables that cannot be read. Each is tried on its own: rule tables are
    configuration, a few files written by people."""
    found = []
    for name in names:
        try:
            files = [r.path for r in spark.read.format("binaryFile").load(f"{folder}/{name}").select("path").collect()]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        for file in sorted(files):
            try:
                spark.read.schema(schema.RULE_TABLES[name]).parquet(file).write.format("noop").mode("overwrite").save()
            except (AnalysisException, SparkRuntimeException, Py4JJavaError) as e:
                found.append((name, file, str(e).splitlines()[0][:200]))
    return spark.createDataFrame(found, "name string, file string, reason string")


def _rows(table: DataFrame, *order: str) -> list:
    """Rules are configuration: written by people, and sent with every plan."""
    return table.orderBy(*order).collect() if order else table.collect()


def settings_from_tables(spark: SparkSession, folder: str, base: Settings = Settings()) -> Settings:
    """Settings with the rules of a folder. Missing tables mean no rules; domains fall back to the default three."""

    def grouped(rows: list, value: str) -> tuple:
        out: dict[str, list[str]] = {}
        for r in rows:
            out.setdefault(r["domain"], []).append(r[value])
        return tuple((d, tuple(v)) for d, v in out.items())

    def load(name: str, *order: str) -> list:
        return _rows(read_rules(spark, folder, name), *order)

    domains = tuple(r["domain"] for r in load("domains", "ord"))
    return base.with_(
        domains=domains or base.domains,
        domain_keywords=grouped(load("domain_keywords", "domain_ord", "kw_ord"), "keyword"),
        search_keywords=grouped(load("search_keywords", "ord"), "keyword"),
        channels=tuple((r["channel_id"], r["domain"]) for r in load("channels", "ord")),
        feeds=tuple({**r.asDict(), "domains": tuple(r["domains"] or ())} for r in load("feeds", "ord")),
        whitelist=tuple(r["channel"] for r in load("whitelist")),
        spam_keywords=tuple(r["keyword"] for r in load("spam_keywords")))


def feeds_table(spark: SparkSession, s: Settings) -> DataFrame:
    rows = [(f["url"], f["name"], f["lang"], list(f["domains"]), f.get("authority", "medium"), i)
            for i, f in enumerate(s.feeds)]
    return spark.createDataFrame(rows, schema.RULE_TABLES["feeds"])


def read_reactions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejected lines) of an append-only JSON log. Bad lines are set apart, not the whole log; a log that no one
    has written to yet is empty, and one that cannot be read is an error."""
    columns = T.StructType([*schema.FEEDBACK_EVENTS.fields, T.StructField("_bad", T.StringType())])
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value STRING")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.select(F.from_json("value", columns, options).alias("_e")).select("_e.*")
    return rows.where(F.col("_bad").isNull()).drop("_bad"), rows.where(F.col("_bad").isNotNull()).select("_bad")


def append_reactions(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def write_briefings(docs: DataFrame, path: str) -> None:
    """Documents by `brief_date`. Writing a date again replaces that date only."""
    (docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("brief_date").parquet(path))


def write_payloads(messages: DataFrame, path: str) -> None:
    """Message payloads, one JSON text per line."""
    messages.select(F.col("payload").alias("value")).write.mode("overwrite").text(path)
