"""The second rule pack, with numbered placeholders such as ``[PHONE_0001]``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions.fence import fence
from veilspark.functions.matchers import GUARDS, Matcher, regex
from veilspark.functions.spans import (
    NO_SPANS, by_rank, count_by_key, marked_pieces, original_values, regex_spans, scan_text,
    splice,
)
from veilspark.functions.text import lit

_GUARDS = {"EMAIL": "at", "IDCARD": "digits", "BANKCARD": "digits", "IP": "dotted", "PHONE": "digits"}


def alt_matchers() -> list[Matcher]:
    return [
        Matcher(key, regex(pattern), 0, i, _GUARDS.get(key))
        for i, (key, pattern, _) in enumerate(C.ALT_PACK)
    ]


def mask_numbered(df: DataFrame, text: str = "text", masked: str = "masked") -> DataFrame:
    """Mask with the second pack; every type counts from one in each text."""
    ms = alt_matchers()
    guards = sorted({m.guard for m in ms if m.guard})
    hits = [f"__hit{i}" for i, _ in enumerate(ms)]
    found = {
        h: f"case when {'__guard_' + m.guard if m.guard else 'true'} "
           f"then {marked_pieces('__scan', m.pattern)} end"
        for h, m in zip(hits, ms)
    }
    parts = ", ".join(
        f"if(size({h}) > 1, {regex_spans(h, m.key, 0, m.rank)}, {NO_SPANS})"
        for h, m in zip(hits, ms)
    )
    types = list(dict.fromkeys(m.key for m in ms))
    quoted = ", ".join(lit(k) for k, _, q in C.ALT_PACK if q)
    listed = "array(" + ", ".join(lit(k) for k in types) + ")"
    # one sort by type, rule and place; a type's numbers begin where the types before it end
    ranked = f"""array_sort(transform(__spans, s -> named_struct(
        't', array_position({listed}, s.key), 'rank', s.rank, 'start', s.start, 'neglen', s.neglen,
        'key', s.key, 'value', s.value)))"""
    before = f"transform(sequence(1, {len(types)}), t -> size(filter(__ranked, r -> r.t < t)))"
    quote = f"if(s.key in ({quoted}), '\"', '')"
    labelled = f"""array_sort(transform(__ranked, (s, i) -> named_struct(
        'start', s.start, 'neglen', s.neglen, 'key', s.key, 'value', s.value,
        'placeholder', concat({quote}, format_string('[%s_%04d]', s.key, i - __before[cast(s.t - 1 as int)] + 1), {quote}))))"""
    done = (
        df.withColumn("__scan", F.expr(scan_text(text)))
        .withColumns({f"__guard_{g}": F.expr(GUARDS[g](text)) for g in guards})
        .withColumns({h: F.expr(sql) for h, sql in found.items()})
        .withColumn("__cand", F.expr(f"concat({parts})"))
        .withColumn("__spans", F.expr(
            f"if(size(__cand) > 0, {original_values(by_rank('__cand'), text)}, __cand)"))
        .withColumn("__ranked", F.expr(ranked))
        .withColumn("__before", F.expr(before))
        .withColumn("__labelled", F.expr(labelled))
        .withColumn(masked, F.expr(
            f"if(size(__spans) = 0, {text}, {splice(text, '__labelled', 'x.placeholder')})"))
        .withColumn("mappings", F.expr(
            "transform(__labelled, s -> named_struct('placeholder', s.placeholder, "
            "'value', s.value, 'entity_type', s.key))"))
        .withColumn("stats", F.expr(count_by_key("__spans")))
        .drop("__scan", "__cand", "__spans", "__ranked", "__before", "__labelled", *hits, *[f"__guard_{g}" for g in guards])
    )
    return fence(done, masked, "mappings", "stats")


def detection_summary(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Per text and label that occurs: number of hits and the first two."""
    entries = ", ".join(
        f"named_struct('label', {lit(label)}, 'hits', "
        f"regexp_extract_all({text}, {lit(pattern)}, 0))"
        for label, pattern in C.SUMMARY_RULES
    )
    return (
        df.select(*keys, F.explode(F.expr(f"array({entries})")).alias("d"))
        .filter("size(d.hits) > 0")
        .selectExpr(*keys, "d.label as label", "cast(size(d.hits) as bigint) as n",
                    "slice(d.hits, 1, 2) as examples")
    )
