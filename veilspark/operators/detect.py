"""Find sensitive spans in a text column.

Three stages run one after the other: user keywords and rules, the entity
stage, and the catalog rules.  A stage scans the text with everything found
earlier blanked out to the same length, so offsets always refer to the original
text.  The whole plan is a chain of projections: no shuffle, no Python.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.functions import matchers as M
from veilspark.functions.fence import fence
from veilspark.functions.rulepack import RulePack
from veilspark.functions.spans import (
    NO_SPANS, OPEN, bind, blank, by_rank, count_by_key, first_occurrences, keep_values, leftmost_longest,
    marked, marked_pieces, original_values, regex_spans, scan_text, sweep_spans,
)
from veilspark.functions.text import lit

_SCAN = "__scan"


Steps = list[dict[str, str]]


def applied(df: DataFrame, steps: Steps) -> DataFrame:
    """Add the columns of each step; a step sees those of the steps before."""
    for step in steps:
        df = df.withColumns({name: F.expr(sql) for name, sql in step.items()})
    return df


def closed(steps: Steps, result: str, kind: str) -> str:
    """The steps as one expression with ``result`` of type ``kind`` inside.

    The values of a step are bound together, as a struct: the analyzer takes a
    round for every level of binding, so there must not be one for every value.
    """
    now: dict[str, str] = {}

    def renamed(sql: str) -> str:
        return re.sub(r"\b__\w+", lambda m: now.get(m[0], m[0]), sql)

    values = []
    for i, step in enumerate(steps):
        values.append("named_struct(" + ", ".join(f"'{name}', {renamed(sql)}" for name, sql in step.items()) + ")")
        now |= {name: f"__step{i}.{name}" for name in step}
    result = renamed(result)
    for i, value in reversed(list(enumerate(values))):
        result = bind(value, f"__step{i}", result, kind)
    return result


def detect(
    df: DataFrame,
    text: str = "text",
    pack: RulePack = RulePack(),
    out: str = "spans",
    row_keywords: str | None = None,
    row_places: str | None = None,
) -> DataFrame:
    """Add an array of the spans to mask, sorted by position and disjoint.

    ``row_keywords`` names an optional array<string> column with extra keywords
    that hold for that row only.  ``row_places`` names an optional column
    array<struct<start, keyword>> with the places of all keywords instead, those of
    the pack included; the text is not searched then.
    """
    steps = detect_steps(text, pack, out, row_keywords, row_places)
    made = {name for step in steps for name in step} - {out}
    return fence(applied(df, steps).drop(*made), out)


def detect_steps(
    text: str, pack: RulePack = RulePack(), out: str = "spans", row_keywords: str | None = None,
    row_places: str | None = None, once: bool = True,
) -> Steps:
    """The columns of ``detect``, as SQL by name; the last one is the result.

    ``once`` tries both built-in stages in one scan first; a single expression goes without, to be nested less deep.
    """
    steps: Steps = [{_SCAN: scan_text(text)}]
    found: list[str] = []
    if row_keywords is not None:
        steps.append({"__words": _row_words(row_keywords, pack)})
    user = M.user_matchers(pack, "__words" if row_keywords is not None else None, row_places)
    if user:
        steps += [*_stage(user, "__user", by_rank), _blank_found("__user")]
        found.append("__user")
    tested: list[str] = []
    whole = M.whole_sweep(pack) if once and pack.entity_stage and not user else None
    if whole:
        # a text swept as a whole is empty to the stages that follow
        steps += [
            *_swept(whole, "__once"), {"__once": f"if(size(__once_pieces) > 1, {_sweep_choice(whole, '__once')}, {NO_SPANS})"},
            {_SCAN: f"if(__once_swept, '', {_SCAN})"},
        ]
    if pack.entity_stage:
        entity = M.entity_matchers(pack)
        off = sorted({k for m in entity for k in m.keys if not pack.is_enabled(k)})
        sweep = M.entity_sweep(pack)
        steps += [*_stage(entity, "__entity", leftmost_longest, off, sweep=sweep), _blank_found("__entity")]
        steps.append({"__beside": f"size(__entity) > 0 and rlike({_SCAN}, {lit(M.BESIDE_BLANK)})"})
        found.append("__entity")
        tested = M.guards_of(entity)
    rules = M.catalog_matchers(pack)
    if rules:
        sweep = M.catalog_sweep(pack)
        steps += _stage(rules, "__catalog", by_rank, tested=tested, sweep=sweep, first=f"not __beside and not contains({_SCAN}, '://')")
        found.append("__catalog")

    steps.append({"__all": f"concat({', '.join(found)})" if found else NO_SPANS})
    # a later span may enclose an earlier one (a keyword inside a URL): the outer one stays
    chosen = f"if(size(__all) = 0, {NO_SPANS}, {original_values(leftmost_longest('__all'), text)})"
    return [*steps, {out: f"if(__once_swept, __once, {chosen})" if whole else chosen}]


def _swept(sweep: M.Sweep, out: str, first: str = "true") -> Steps:
    """The text marked by a sweep, whether that does for it, and if so its pieces."""
    swept = f"{out}_swept"
    return [
        {f"{out}_marked": f"case when {first} then {marked(_SCAN, sweep.pattern)} end" if first != "true" else marked(_SCAN, sweep.pattern)},
        {swept: f"{out}_marked is not null and not rlike({out}_marked, {sweep.doubt})"},
        {f"{out}_pieces": f"case when {swept} then split({out}_marked, {lit(OPEN)}, -1) end"},
    ]


def _sweep_choice(sweep: M.Sweep, out: str) -> str:
    """The spans of a sweep; of rules with the same key only the last one has a test for its values."""
    spans = sweep_spans(f"{out}_marked", f"{out}_pieces", sweep.kinds)
    if sweep.keep:
        key, test = sweep.keep
        rank = [k.rank for k in sweep.kinds if k.key == key][-1]
        spans = f"filter({spans}, s -> s.rank <> {rank} or s.key <> {lit(key)} or {test('s.value')})"
    return spans


def _row_words(words: str, pack: RulePack) -> str:
    """The keywords of a row and of the pack, each once."""
    known = f"cast(array({', '.join(lit(k) for k in pack.keywords)}) as array<string>)"
    return f"""array_distinct(concat(
        filter(transform(coalesce({words}, cast(array() as array<string>)), w -> trim(w)), w -> length(w) > 0),
        {known}))"""


def _stage(
    matchers: list[M.Matcher], out: str, choose: Callable[[str], str], off: list[str] = (), tested: list[str] = (),
    sweep: M.Sweep | None = None, first: str = "true",
) -> Steps:
    """Candidate spans of one stage, reduced to a disjoint choice.

    ``sweep`` finds the choice in one scan where that is the same (``<out>_swept``), but only in texts
    that pass ``first``; the rules are run one by one on the others.

    ``tested`` lists guards already known for the text before the entity stage
    blanked parts of it.  Blanking cannot make a failed guard pass, so such a
    guard is only tested again where it passed and something was blanked.  A
    pattern that stage has run already is skipped unless a blank has a character
    beside it with which a new match could begin or end.
    """

    guards = M.guards_of(matchers)
    swept = f"{out}_swept" if sweep else "false"
    before = "__entity_swept" if tested else "false"
    hits = [f"__hit{i}" for i, _ in enumerate(matchers)]
    again = {m.guard for m in matchers if not (tested and m.seen_before)}

    def guard(g: str) -> str:
        test = M.GUARDS[g](_SCAN)
        if g not in tested:
            return " and ".join([f"not {swept}", *(f"__base_{b}" for b in M.NEEDS.get(g, [])), test])
        # a text that was swept before has not been tested yet
        if g not in again:
            return f"not {swept} and ({before} or __guard_{g}) and __beside and {test}"
        return f"not {swept} and ({before} or __guard_{g}) and (size(__entity) = 0 and not {before} or {test})"

    def guarded(m: M.Matcher, value: str) -> str:
        if not m.guard:
            return f"case when not {swept} then {value} end" if sweep else value
        beside = " and __beside" if tested and m.seen_before else ""
        return f"case when __guard_{m.guard}{beside} then {value} end"

    found, parts, some = {}, [], []
    for m, hit in zip(matchers, hits):
        if m.pattern is None:
            listed = m.spans(_SCAN) if m.spans else first_occurrences(_SCAN, m.words, m.key, m.ord, m.rank)
            found[hit] = guarded(m, listed)
            spans = hit
        else:
            found[hit] = guarded(m, marked_pieces(_SCAN, m.pattern))
            spans = regex_spans(hit, m.key, m.ord, m.rank, m.kinds)
            if m.keep is not None:
                spans = keep_values(spans, m.keep)
        # pieces of a text without a match are one, spans are none
        some.append(f"size({hit}) > {0 if m.pattern is None else 1}")
        parts.append(f"if({some[-1]}, {spans}, {NO_SPANS})")
    some = " or ".join(some)
    off_keys = ', '.join(map(lit, off))
    chosen = choose("__cand")
    if off:
        chosen = f"filter({chosen}, s -> s.key not in ({off_keys}))"
    bases = sorted({b for g in guards if g not in tested for b in M.NEEDS.get(g, [])})
    at_once = []
    if sweep:
        spans = _sweep_choice(sweep, out)
        if set(off) & {k.key for k in sweep.kinds}:
            spans = f"filter({spans}, s -> s.key not in ({off_keys}))"
        chosen = f"if({swept}, {spans}, {chosen})"
        at_once = _swept(sweep, out, first)
    steps = [
        *at_once,
        {f"__base_{b}": f"not {swept} and {M.BASES[b](_SCAN)}" for b in bases},
        {f"__guard_{g}": guard(g) for g in guards},
        found,
        {"__cand": f"case when {some} then concat({', '.join(parts)}) end"},
        {out: f"if({f'size({out}_pieces) > 1 or ' if sweep else ''}size(__cand) > 0, {chosen}, {NO_SPANS})"},
    ]
    return [step for step in steps if step]


def _blank_found(found: str) -> dict[str, str]:
    return {_SCAN: f"if(size({found}) = 0, {_SCAN}, {blank(_SCAN, found)})"}


def span_rows(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span: keys, entity_type, start, end, value."""
    return df.select(*keys, F.explode(spans).alias("s")).selectExpr(
        *keys,
        "s.key as entity_type",
        "cast(s.start as bigint) as start",
        "cast(s.start - s.neglen as bigint) as end",
        "s.value as value",
    )


def count_spans(df: DataFrame, spans: str = "spans", out: str = "stats") -> DataFrame:
    """Dry run: per-text counters, nothing is replaced or kept."""
    return df.withColumn(out, F.expr(count_by_key(spans)))


def matches(df: DataFrame, keys: list[str], text: str, matcher: M.Matcher) -> DataFrame:
    """All spans of a single matcher, one row each, without any other rule."""
    work = df.select(*keys, F.col(text), F.expr(scan_text(text)).alias(_SCAN))
    if matcher.guard:
        work = work.filter(M.GUARDS[matcher.guard](_SCAN))
    if matcher.pattern is None:
        spans = first_occurrences(_SCAN, matcher.words, matcher.key, 0, 0)
    else:
        work = work.withColumn(
            "__hit", F.expr(marked_pieces(_SCAN, matcher.pattern))
        )
        spans = f"if(size(__hit) > 1, {regex_spans('__hit', matcher.key, 0, 0)}, {NO_SPANS})"
        if matcher.keep is not None:
            spans = keep_values(spans, matcher.keep)
    work = work.withColumn("spans", F.expr(spans))
    work = work.withColumn("spans", F.expr(original_values("spans", text)))
    return span_rows(fence(work, "spans"), keys)


def match_values(df: DataFrame, keys: list[str], text: str, matcher: M.Matcher) -> DataFrame:
    """Texts that match one rule: number of values and the values, in order.

    A projection and a filter; nothing is exploded or shuffled.
    """
    hits = f"regexp_extract_all({text}, {matcher.pattern}, 0)"
    if matcher.keep is not None:
        hits = f"filter({hits}, v -> {matcher.keep('v')})"
    work = df.filter(M.GUARDS[matcher.guard](text)) if matcher.guard else df
    return (
        work.select(*keys, F.expr(hits).alias("vals"))
        .filter("size(vals) > 0")
        .select(*keys, F.size("vals").cast("long").alias("n"), "vals")
    )
