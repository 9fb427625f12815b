"""The same expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from veilspark.functions.matchers import GUARD_OF, GUARDS, bank_card_keep, regex
from veilspark.functions.rulepack import RulePack
from veilspark.functions.text import alpha_id, fingerprint, placeholders_in
from veilspark.operators.compliance import compliance_tag, placeholder_token
from veilspark.operators.mask import MAPPINGS, detect_expression, mask_expression
from veilspark.operators.restore import restored


ROUNDS = 1_000


def register(spark: SparkSession, pack: RulePack = RulePack()) -> list[str]:
    """Create temporary SQL functions and return their names.

    Masking is a deep expression, which the analyzer resolves level by level, so its limit of
    rounds (``spark.sql.analyzer.maxIterations``) is raised for the session.

    ``pii_mask(text)`` (the masked text), ``pii_mask_all(text)`` (with mappings and
    counters), ``pii_detect(text)`` (the spans), ``pii_restore(text, map)``, ``pii_placeholders(text)``, ``pii_token(placeholder)``,
    ``pii_compliance(key)``, ``pii_fingerprint(value)``, ``pii_alpha_id(n)`` and, per
    enabled catalog rule, ``pii_find_<key>(text)`` with the values it matches.
    """
    spans = "array<struct<entity_type string,start int,end int,value string>>"
    entries = MAPPINGS.replace(":", " ")
    defs = {
        "pii_mask": ("t string", "string", f"{mask_expression('t', pack)}.masked"),
        "pii_mask_all": (
            "t string", f"struct<masked string,mappings {entries},stats map<string,bigint>>", mask_expression("t", pack)),
        "pii_detect": ("t string", spans, detect_expression("t", pack)),
        "pii_restore": ("t string, m map<string,string>", "string", restored("t", "m")),
        "pii_placeholders": ("t string", "array<string>", placeholders_in("t")),
        "pii_token": ("p string", "string", placeholder_token(pack, "p")),
        "pii_compliance": ("k string", "string", compliance_tag(pack, "k")),
        "pii_fingerprint": ("v string", "string", fingerprint("v")),
        "pii_alpha_id": ("n bigint", "string", alpha_id("n")),
    }
    for entity in pack.catalog_rules():
        found = f"regexp_extract_all(t, {regex(entity.pattern)}, 0)"
        if entity.key == "bankcard":
            found = f"filter({found}, v -> {bank_card_keep('v')})"
        guard = GUARDS[GUARD_OF[entity.key]]("t") if entity.key in GUARD_OF else "true"
        known = RulePack().entity(entity.key)
        if known is None or known.pattern != entity.pattern:
            guard = "true"
        body = f"if({guard}, {found}, cast(array() as array<string>))"
        defs[f"pii_find_{entity.key}"] = ("t string", "array<string>", body)
    rounds = "spark.sql.analyzer.maxIterations"
    spark.conf.set(rounds, str(max(ROUNDS, int(spark.conf.get(rounds)))))
    for name, (params, result, body) in defs.items():
        spark.sql(f"create or replace temporary function {name}({params}) returns {result} return {body}")
    return list(defs)
