"""Replace detected spans by placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame

from veilspark.functions.fence import fence
from veilspark.functions.rulepack import RulePack
from veilspark.functions.spans import bind, count_by_key, splice
from veilspark.functions.text import SEQ_STRIDE, placeholder
from veilspark.operators.detect import Steps, applied, closed, detect, detect_steps

MAPPINGS = (
    "array<struct<placeholder:string,value:string,entity_type:string,seq:bigint,"
    "start:int,end:int>>"
)


def mask(
    df: DataFrame,
    text: str = "text",
    pack: RulePack = RulePack(),
    message_no: str | None = None,
    row_keywords: str | None = None,
    masked: str = "masked",
    row_places: str | None = None,
) -> DataFrame:
    """Add ``masked``, ``mappings`` and ``stats`` columns.

    Placeholders are numbered inside a text by stage, rule and position.  Texts
    of one session stay apart through ``message_no``, a SQL expression for a
    number from zero that is unique per text of the session: each text has its
    own range of numbers, so no text has to wait for, or shuffle with, another.
    """
    detected = detect(df, text, pack, "__spans", row_keywords, row_places)
    done = applied(detected, label_steps(text, masked, message_no))
    return fence(done.drop("__spans", "__base", "__numbered", "__labelled"), masked, "mappings", "stats")


def label_steps(text: str, masked: str = "masked", message_no: str | None = None) -> Steps:
    """The columns that ``mask`` makes of ``__spans``, as SQL by name."""
    base = "0L" if message_no is None else f"cast({message_no} as bigint) * {SEQ_STRIDE}L"
    # places as plain numbers, which sort faster than structs: first by rule and place, then back by place
    ranked = f"sort_array(transform(__spans, (s, i) -> s.rank * {SEQ_STRIDE}L + i))"
    numbered = f"sort_array(transform({ranked}, (r, i) -> r % {SEQ_STRIDE}L * {SEQ_STRIDE}L + i))"
    # the numbers are an argument, as an optimizer that puts them inside the lambda would sort for every span
    entries = f"""zip_with(__spans, __numbered, (s, r) -> {bind(f'__base + r % {SEQ_STRIDE}L + 1', 'q', f"""named_struct(
        'placeholder', {placeholder('s.key', 'q')}, 'value', s.value, 'entity_type', s.key, 'seq', q,
        'start', s.start, 'end', s.start - s.neglen)""")})"""
    none = "size(__spans) = 0"
    return [
        {"__base": base},
        {"__numbered": f"case when not ({none}) then {numbered} end"},
        {"__labelled": f"if({none}, cast(array() as {MAPPINGS}), {entries})"},
        {
            masked: f"if({none}, {text}, {splice(text, '__labelled', 'x.placeholder', 'end')})",
            "mappings": "__labelled",
            "stats": f"if({none}, cast(map() as map<string,bigint>), {count_by_key('__spans')})",
        },
    ]


def mask_expression(text: str, pack: RulePack = RulePack()) -> str:
    """``mask`` as one SQL expression: struct<masked, mappings, stats>.

    Every step is bound to a name inside the expression, so it fits a SQL
    function.  ``mask`` itself, with a projection per step, is faster.
    """
    labels = label_steps(text)
    result = "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in labels[-1].items()) + ")"
    steps = detect_steps(text, pack, "__spans", once=False) + labels[:-1]
    kind = f"struct<masked:string,mappings:{MAPPINGS},stats:map<string,bigint>>"
    return f"if({text} is null, cast(null as {kind}), {closed(steps, result, kind)})"


def detect_expression(text: str, pack: RulePack = RulePack()) -> str:
    """``detect`` as one SQL expression: array<struct<entity_type, start, end, value>>."""
    spans = "transform(__spans, s -> named_struct('entity_type', s.key, 'start', s.start, 'end', s.start - s.neglen, 'value', s.value))"
    kind = "array<struct<entity_type:string,start:int,end:int,value:string>>"
    return f"if({text} is null, cast(null as {kind}), {closed(detect_steps(text, pack, '__spans', once=False), spans, kind)})"
