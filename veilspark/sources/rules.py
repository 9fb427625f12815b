"""Rule tables and files: catalog, keyword list, rule bundle, keyword dictionary."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.rulepack import CATALOG_SCHEMA, RulePack, compiles_sql
from veilspark.functions.text import lit
from veilspark.sources.tables import exists

BUNDLE = "keywords array<string>, regex_rules array<struct<name:string,pattern:string,entity_type:string>>"


def read_catalog(spark: SparkSession, path: str) -> DataFrame | None:
    """Entities of a catalog file; None when the file cannot be read."""
    entity = "array<struct<" + CATALOG_SCHEMA.replace(" string", ":string").replace(
        " boolean", ":boolean") + ">>"
    try:
        raw = spark.read.schema(f"version string, entities {entity}").json(path, multiLine=True)
        found = raw.select(F.explode("entities").alias("e")).select("e.*").filter("key is not null")
        return None if found.isEmpty() else found
    except AnalysisException:
        return None


def load_pack(spark: SparkSession, path: str) -> RulePack:
    return RulePack.from_catalog(read_catalog(spark, path))


def read_keyword_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(token, name, enabled, keyword) of a keyword dictionary file."""
    schema = (
        "version string, entities map<string,struct<name:string,description:string,"
        "enabled:boolean,custom_keywords:array<string>>>"
    )
    return (
        spark.read.schema(schema).json(path, multiLine=True)
        .select(F.explode("entities").alias("token", "e"))
        .select("token", "e.name", "e.enabled", F.explode("e.custom_keywords").alias("keyword"))
    )


def keyword_reject_reason(keyword: str) -> str:
    """Why a (trimmed) keyword is refused, null when it is accepted."""
    return (
        f"case when coalesce({keyword}, '') = '' then 'empty' "
        f"when length({keyword}) > {C.MAX_KEYWORD_CHARS} then 'too long' "
        f"when rlike({keyword}, {lit(r'[\p{C}\p{Zl}\p{Zp}]|[\p{Zs}&&[^ ]]')}) then 'not printable' end"
    )


def rule_reject_reason(pack: RulePack = RulePack()) -> str:
    """Why a rule row is refused; the JVM, which will run it, judges the pattern."""
    known = ", ".join(lit(e.key) for e in pack.entities)
    return (
        "case when coalesce(name, '') = '' or coalesce(pattern, '') = '' then 'name or pattern missing' "
        f"when length(name) > {C.MAX_RULE_NAME_CHARS} then 'name too long' "
        f"when entity_type not in ({known}) then 'unknown entity type' "
        f"when not {compiles_sql('pattern')} then 'pattern does not compile' end"
    )


def add_keywords(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Accepted incoming keywords that are not stored yet, each once."""
    return (
        incoming.select(F.trim("keyword").alias("keyword"))
        .filter(f"{keyword_reject_reason('keyword')} is null")
        .distinct()
        .join(stored.select("keyword"), "keyword", "left_anti")
    )


def delete_keywords(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("keyword").distinct(), "keyword", "left_anti")


def checked_rules(incoming: DataFrame, pack: RulePack = RulePack()) -> DataFrame:
    """Incoming rules trimmed, with ``error`` null where usable.  Keeps column ``pos``."""
    return (
        incoming.selectExpr(
            "pos", "trim(name) as name", "trim(pattern) as pattern",
            "lower(trim(entity_type)) as entity_type",
        )
        .withColumn("error", F.expr(rule_reject_reason(pack)))
    )


def add_rules(stored: DataFrame, checked: DataFrame) -> DataFrame:
    """Usable rules whose name is new; of equal names the first comes in."""
    first = (
        checked.filter("error is null").groupBy("name")
        .agg(F.min_by(F.struct("pattern", "entity_type", "pos"), "pos").alias("r"))
        .select("name", "r.pattern", "r.entity_type", "r.pos")
    )
    return first.join(stored.select("name"), "name", "left_anti")


def delete_rules(stored: DataFrame, names: DataFrame) -> DataFrame:
    return stored.join(names.select("name").distinct(), "name", "left_anti")


def toggle_rules(stored: DataFrame, switches: DataFrame) -> DataFrame:
    """Apply (name, enabled) switches."""
    s = switches.groupBy("name").agg(F.max("enabled").alias("__on"))
    return stored.join(s, "name", "left").withColumn(
        "enabled", F.coalesce("__on", "enabled")
    ).drop("__on")


PART = "keyword string, pos long, rule struct<name:string,pattern:string,entity_type:string>"


def read_bundle(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(keywords, rules) of a rule bundle: one file, or a folder that ``write_bundle`` has made."""
    if not exists(spark, f"{path}/manifest"):
        raw = spark.read.schema(BUNDLE).json(path, multiLine=True)
        words = raw.select(F.explode("keywords").alias("keyword"))
        rules = raw.select(F.posexplode("regex_rules").alias("pos", "r")).select("pos", "r.*")
        return words, rules
    parts = spark.read.schema(PART).json(f"{path}/parts")
    said = spark.read.schema("n_keywords long, n_rules long").json(f"{path}/manifest").first()
    have = parts.agg(F.count("keyword"), F.count("rule")).first()
    if tuple(said) != tuple(have):
        raise ValueError(f"the bundle should have {tuple(said)} keywords and rules, not {tuple(have)}")
    words = parts.filter("keyword is not null").select("keyword")
    return words, parts.filter("rule is not null").select("pos", "rule.*")


def write_bundle(keywords: DataFrame, rules: DataFrame, path: str) -> None:
    """Write all keywords and rules, one per line, and last a manifest with their numbers.

    A rule keeps its place as ``pos``, its id; tables of any size are written in parallel.
    """
    words = keywords.filter("keyword is not null").selectExpr("keyword")
    numbered = rules.selectExpr("cast(id as bigint) as pos", "struct(name, pattern, entity_type) as rule")
    spark = keywords.sparkSession
    words.unionByName(numbered, allowMissingColumns=True).write.json(f"{path}/parts")
    parts = spark.read.schema(PART).json(f"{path}/parts")
    parts.agg(F.count("keyword").alias("n_keywords"), F.count("rule").alias("n_rules")).write.json(f"{path}/manifest")
