"""Immutable description of what to look for."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.functions import catalog as C

CATALOG_SCHEMA = (
    "key string, name_zh string, name_en string, detector string, enabled boolean, "
    "compliance_tag string, placeholder_token string, pattern string"
)


@dataclass(frozen=True)
class Entity:
    key: str
    name_zh: str | None = None
    name_en: str | None = None
    detector: str = "regex"
    enabled: bool = True
    compliance_tag: str = "personal_info"
    placeholder_token: str | None = None
    pattern: str | None = None

    @property
    def token(self) -> str:
        return self.placeholder_token or "PII_" + self.key.upper()


@dataclass(frozen=True)
class CustomRule:
    name: str
    pattern: str
    entity_type: str
    enabled: bool = True


DEFAULT_ENTITIES = tuple(Entity(*row) for row in C.ENTITIES)
FALLBACK_ENTITIES = tuple(
    replace(e, enabled=True, pattern=C.FALLBACK_PLATE if e.key == "plate" else e.pattern)
    for e in DEFAULT_ENTITIES
    if e.key in C.FALLBACK_KEYS
)


def java_pattern(pattern: str) -> str:
    """Spell a pattern for the JVM with the Unicode classes Python has by default."""
    named = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    named = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", named)
    return "(?U)" + named


def compiles(pattern: str) -> bool:
    """Whether the JVM, which runs the rules, takes a pattern; without a session Python is asked."""
    spark = SparkSession.getActiveSession()
    try:
        if spark is None:
            re.compile(pattern)
        else:
            spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except (re.error, Py4JJavaError, PySparkException):
        return False
    return True


def compiles_sql(pattern: str) -> str:
    """The same test as an expression."""
    named = rf"""regexp_replace(regexp_replace({pattern}, r'\(\?P<(\w+)>', r'(?<$1>'), r'\(\?P=(\w+)\)', r'\\k<$1>')"""
    return f"try_reflect('java.util.regex.Pattern', 'compile', concat('(?U)', {named})) is not null"


@dataclass(frozen=True)
class RulePack:
    """Catalog entities, user keywords and user rules, plus two switches.

    ``entity_stage`` turns the early stage (eleven patterns, names, places and
    organisations) off.  ``card_luhn`` is ``"parity"`` (16- and 19-digit cards
    need no check digit) or ``"strict"`` (all cards do).
    """

    entities: tuple[Entity, ...] = DEFAULT_ENTITIES
    keywords: tuple[str, ...] = ()
    rules: tuple[CustomRule, ...] = ()
    entity_stage: bool = True
    card_luhn: str = "parity"
    _by_key: dict = field(init=False, repr=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "_by_key", {e.key: e for e in self.entities})

    # -- lookups ---------------------------------------------------------
    def entity(self, key: str) -> Entity | None:
        return self._by_key.get(key)

    def is_enabled(self, key: str) -> bool:
        e = self._by_key.get(key)
        return bool(e and e.enabled)

    def catalog_rules(self) -> list[Entity]:
        """Enabled regex entities in the order in which they apply."""
        rank = {k: i for i, k in enumerate(C.RULE_ORDER)}
        usable = [e for e in self.entities if e.detector == "regex" and e.pattern and e.enabled]
        return sorted(usable, key=lambda e: (rank.get(e.key, len(rank)), e.key))

    # -- changes (each returns a new pack) --------------------------------
    def with_keywords(self, words: Iterable[str]) -> RulePack:
        seen = dict.fromkeys(self.keywords)
        seen.update(dict.fromkeys(w for w in words if w))
        return replace(self, keywords=tuple(seen))

    def without_keywords(self, words: Iterable[str]) -> RulePack:
        gone = set(words)
        return replace(self, keywords=tuple(k for k in self.keywords if k not in gone))

    def with_rules(self, rules: Iterable[CustomRule]) -> RulePack:
        """Add rules; names already present are kept as they are."""
        have = {r.name: r for r in self.rules}
        for r in rules:
            if r.entity_type not in self._by_key:
                raise ValueError(f"unknown entity type: {r.entity_type}")
            if not compiles(r.pattern):
                raise ValueError(f"pattern does not compile: {r.pattern}")
            have.setdefault(r.name, r)
        return replace(self, rules=tuple(have.values()))

    def without_rules(self, names: Iterable[str]) -> RulePack:
        gone = set(names)
        return replace(self, rules=tuple(r for r in self.rules if r.name not in gone))

    def toggle_rule(self, name: str, enabled: bool) -> RulePack:
        return replace(
            self,
            rules=tuple(replace(r, enabled=enabled) if r.name == name else r for r in self.rules),
        )

    def enable(self, *keys: str) -> RulePack:
        return self._switch(keys, True)

    def disable(self, *keys: str) -> RulePack:
        return self._switch(keys, False)

    def only(self, *keys: str) -> RulePack:
        return replace(
            self, entities=tuple(replace(e, enabled=e.key in keys) for e in self.entities)
        )

    def _switch(self, keys, enabled) -> RulePack:
        return replace(
            self,
            entities=tuple(
                replace(e, enabled=enabled) if e.key in keys else e for e in self.entities
            ),
        )

    # -- tables ------------------------------------------------------------
    @staticmethod
    def from_catalog(df: DataFrame | None) -> RulePack:
        """Pack from a catalog table; an absent or empty table gives the built-in rules."""
        rows = df.filter("key is not null").collect() if df is not None else []
        if not rows:
            return RulePack(entities=FALLBACK_ENTITIES)
        kept = []
        for r in rows:
            e = Entity(
                r["key"], r["name_zh"], r["name_en"], r["detector"] or "regex",
                True if r["enabled"] is None else r["enabled"],
                r["compliance_tag"] or "personal_info", r["placeholder_token"], r["pattern"],
            )
            kept.append(replace(e, pattern=None) if e.pattern and not compiles(e.pattern) else e)
        return RulePack(entities=tuple(kept))

    def with_tables(self, keywords: DataFrame, rules: DataFrame) -> RulePack:
        """Add the stored keyword and rule tables; unusable rules are left out.

        The rules become part of the plan, so they come to the driver.  A
        dictionary that is data in its own right stays a table in
        ``operators.keywords.mask_with_dictionary``.
        """
        words = [r["keyword"] for r in keywords.select("keyword").distinct().orderBy("keyword").collect()]
        rows = rules.orderBy("id").select("name", "pattern", "entity_type", "enabled").collect()
        usable = [
            CustomRule(r["name"], r["pattern"], r["entity_type"], bool(r["enabled"]))
            for r in rows
            if r["entity_type"] in self._by_key and compiles(r["pattern"])
        ]
        return self.with_keywords(words).with_rules(usable)

    def catalog_table(self, spark: SparkSession) -> DataFrame:
        """Listing of the catalog with display names, switch, engine and grade."""
        rows = [
            (e.key, e.name_zh, e.name_en, e.detector, e.enabled, e.compliance_tag,
             e.placeholder_token, e.pattern)
            for e in self.entities
        ]
        return spark.createDataFrame(rows, CATALOG_SCHEMA).select(
            F.coalesce("placeholder_token", F.concat(F.lit("PII_"), F.upper("key"))).alias("type"),
            "key",
            F.coalesce("name_zh", "name_en", "key").alias("name"),
            F.coalesce("name_en", "key").alias("name_en"),
            "enabled",
            F.col("detector").alias("engine"),
            F.coalesce("compliance_tag", F.lit("personal_info")).alias("compliance_tag"),
        )

