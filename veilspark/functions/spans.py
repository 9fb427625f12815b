"""Span arrays as native SQL expressions.

A span is struct<start, neglen, ord, rank, key, value>.  Offsets count
characters from zero.  ``neglen`` is minus the length, so the natural order of
the struct is leftmost first and longest first.  ``rank`` numbers the rule that
found the span; ``ord`` only breaks ties inside a stage.

Arguments named ``text``, ``spans`` and ``pieces`` should be column names: they
are used inside lambdas, where a longer expression would run once per element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from veilspark.functions.text import lit

SPAN = "struct<start:int,neglen:int,ord:int,rank:int,key:string,value:string>"
SPANS = f"array<{SPAN}>"
NO_SPANS = f"cast(array() as {SPANS})"

# Stands for one masked character while later stages scan the text.  It is
# neither a digit, a letter, nor a space, so it ends words and digit runs.
FILL = "\ue000"
# Mark the ends of a match while a text is cut into pieces.
OPEN = "\ue001"
CLOSE = "\ue002"
# Elements that a fold appends one by one before they are put together.
BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """One of several rules that share a pattern; ``test`` tells its values from those of the others."""

    key: str
    ord: int
    rank: int
    test: Callable[[str], str]


def make_span(start: str, length: str, ord_: int, rank: int, key: str, value: str, kinds: Sequence[Kind] = ()) -> str:
    """A span; of ``kinds`` the first whose test the value passes names the rule, the last one without a test."""

    def told(name: str, alone: str) -> str:
        if not kinds:
            return alone
        *others, last = [(k.test(value), lit(k.key) if name == "key" else getattr(k, name)) for k in kinds]
        return "case " + " ".join(f"when {test} then {sql}" for test, sql in others) + f" else {last[1]} end"

    return (
        f"named_struct('start', cast({start} as int), 'neglen', cast(-({length}) as int), "
        f"'ord', {told('ord', ord_)}, 'rank', {told('rank', rank)}, 'key', {told('key', lit(key))}, 'value', {value})"
    )


def scan_text(text: str) -> str:
    """The text as the patterns see it: the two marks below are filled in, should it hold any."""
    return (
        f"if(contains({text}, {lit(OPEN)}) or contains({text}, {lit(CLOSE)}), "
        f"translate({text}, {lit(OPEN + CLOSE)}, {lit(FILL + FILL)}), {text})"
    )


def marked(text: str, pattern: str) -> str:
    """The text with both ends of each match marked, in one scan."""
    return f"regexp_replace({text}, {pattern}, {lit(OPEN + '$0' + CLOSE)})"


def marked_pieces(text: str, pattern: str) -> str:
    """The text cut before every match; a single piece without one.

    One scan marks both ends of each match; cutting at a mark needs no pattern.
    """
    return f"split({marked(text, pattern)}, {lit(OPEN)}, -1)"


def bind(value: str, name: str, body: str, kind: str | None = None) -> str:
    """Compute a value once and use it by name in an expression.

    Spark asks an array of lambda results for its type whenever it takes one out, and the answer asks the
    expression inside twice, so time doubles with every level of binding.  An aggregate has the type
    of its start: ``kind``, the type of the result, is for bindings of many levels.
    """
    if kind:
        return f"aggregate(array({value}), cast(null as {kind}), (__none, {name}) -> {body})"
    return f"transform(array({value}), {name} -> {body})[0]"


def fold(items: str, out: str, first: str, value: str, after: str, keep: str = "true", emit: str = "true") -> str:
    """Walk over an array with a running position and collect one value per element kept.

    ``value``, ``after``, ``keep`` and ``emit`` see the element as ``x`` and the
    position before it as ``a.pos``, which may be a struct.  An element not kept
    leaves the position; one not emitted moves it but gives no value.  Appending
    copies an array, so values are appended inside blocks of BLOCK elements, and
    blocks to each other: cost is near linear.
    """
    more = f"concat(a.out, array({value}))"
    more = more if emit == "true" else f"if({emit}, {more}, a.out)"
    append = f"(a, x) -> if({keep}, named_struct('pos', {after}, 'out', {more}), a)"
    short = f"""aggregate(it, named_struct('pos', {first}, 'out', cast(array() as array<{out}>)),
        {append}, a -> a.out)"""
    inner = f"aggregate(blk, named_struct('pos', acc.pos, 'out', cast(array() as array<{out}>)), {append})"
    step = bind(inner, "b", "named_struct('pos', b.pos, 'out', concat(acc.out, array(b.out)))")
    blocks = f"transform(sequence(0, greatest(size(it) - 1, 0) div {BLOCK}), k -> slice(it, k * {BLOCK} + 1, {BLOCK}))"
    walk = f"""aggregate({blocks}, named_struct('pos', {first}, 'out', cast(array() as array<array<{out}>>)),
        (acc, blk) -> {step}, acc -> flatten(acc.out))"""
    return bind(items, "it", f"if(size(it) <= {BLOCK}, {short}, {walk})")


def regex_spans(pieces: str, key: str, ord_: int, rank: int, kinds: Sequence[Kind] = ()) -> str:
    """Spans of the matches in marked pieces; the lengths of the pieces give the offsets.

    A single match needs no walk.
    """
    hits = f"""transform(slice({pieces}, 2, size({pieces})), x -> named_struct(
            'hit', substring_index(x, {lit(CLOSE)}, 1), 'n', length(x) - 1))"""
    span = make_span("a.pos", "length(x.hit)", ord_, rank, key, "x.hit", kinds)
    hit = f"substring_index({pieces}[1], {lit(CLOSE)}, 1)"
    alone = make_span(f"length({pieces}[0])", f"length({hit})", ord_, rank, key, hit, kinds)
    return f"if(size({pieces}) = 2, array({alone}), {fold(hits, SPAN, f'length({pieces}[0])', span, 'a.pos + x.n')})"


def sweep_spans(marked_text: str, pieces: str, kinds: Sequence[Kind]) -> str:
    """Spans of the matches of several rules in a marked text and its pieces; the first of ``kinds`` whose test a value passes names the rule.

    Few matches are counted from the start of the text, many are walked over.
    """
    told = "case " + " ".join(f"when {k.test('v')} then {i}" for i, k in enumerate(kinds[:-1])) + f" else {len(kinds) - 1} end"
    hits = f"transform(slice({pieces}, 2, size({pieces})), x -> substring_index(x, {lit(CLOSE)}, 1))"

    def span(start: str, value: str, kind: str) -> str:
        def of_kind(values: Iterable[object]) -> str:
            return f"array({', '.join(map(str, values))})[{kind}]"

        return (
            f"named_struct('start', {start}, 'neglen', -length({value}), 'ord', {of_kind(k.ord for k in kinds)}, "
            f"'rank', {of_kind(k.rank for k in kinds)}, 'key', {of_kind(lit(k.key) for k in kinds)}, 'value', {value})"
        )

    few = f"transform(vs, (v, i) -> {span(f'length(substring_index({marked_text}, {lit(OPEN)}, i + 1)) - 2 * i', 'v', 'ks[i]')})"
    many = fold(
        f"transform(slice({pieces}, 2, size({pieces})), (x, i) -> named_struct('hit', vs[i], 'kind', ks[i], 'n', length(x) - 1))",
        SPAN, f"length({pieces}[0])", span("a.pos", "x.hit", "x.kind"), "a.pos + x.n")
    return bind(hits, "vs", bind(f"transform(vs, v -> {told})", "ks", f"if(size(vs) <= {BLOCK}, {few}, {many})"))


def word_spans(text: str, words: str, key: str, ord_: int, rank: int) -> str:
    """Spans of all occurrences of the words of an array column, by plain search: no pattern is built.

    The text is cut at a word; a word that can overlap itself is looked for at every place.
    """
    cut = f"split(replace({text}, w, {lit(OPEN)}), {lit(OPEN)}, -1)"
    span = make_span("a.pos + length(x)", "length(w)", ord_, rank, key, "w")
    apart = bind(cut, "cuts", fold("slice(cuts, 1, size(cuts) - 1)", SPAN, "0", span, "a.pos + length(x) + length(w)"))
    everywhere = (
        f"transform(filter(sequence(0, length({text}) - length(w)), i -> substr({text}, i + 1, length(w)) = w), "
        f"i -> {make_span('i', 'length(w)', ord_, rank, key, 'w')})"
    )
    overlaps = "length(w) > 1 and exists(sequence(1, length(w) - 1), k -> endswith(w, left(w, k)))"
    return (
        f"flatten(transform(filter({words}, w -> length(w) > 0 and contains({text}, w)), "
        f"w -> if({overlaps}, {everywhere}, {apart})))"
    )


def place_spans(places: str, key: str, ord_: int, rank: int) -> str:
    """Spans of words whose places are known already."""
    span = make_span("p.start", "length(p.keyword)", ord_, rank, key, "p.keyword")
    return f"coalesce(transform({places}, p -> {span}), {NO_SPANS})"


def keep_values(spans: str, test: Callable[[str], str]) -> str:
    return f"filter({spans}, s -> {test('s.value')})"


def first_occurrences(text: str, words: Iterable[str], key: str, ord_: int, rank: int) -> str:
    """One span per listed word that occurs, at its first position."""
    listed = ", ".join(lit(w) for w in words)
    span = make_span(f"position(w, {text}) - 1", "length(w)", ord_, rank, key, "w")
    return f"transform(filter(array({listed}), w -> contains({text}, w)), w -> {span})"


def sorted_or(spans: str, choice: str) -> str:
    """The spans by position, or if some of them overlap ``choice``, which sees them by position as ``ss``."""
    end = "aggregate(ss, 0, (p, x) -> if(x.start >= p, x.start - x.neglen, 2147483647))"
    return bind(f"sort_array({spans})", "ss", f"if({end} < 2147483647, ss, {choice})")


def leftmost_longest(spans: str) -> str:
    """Greedy choice without overlaps; the result is sorted by position."""
    return sorted_or(spans, fold("ss", SPAN, "0", "x", "x.start - x.neglen", "x.start >= a.pos"))


def by_rank(spans: str) -> str:
    """Choice without overlaps in which the lower rank wins.

    Spans are first cut into runs that touch no other run, so the pairwise test
    only ever sees the few spans of one run.
    """
    marked = fold(
        "ss", f"struct<new:boolean,s:{SPAN}>", "0",
        "named_struct('new', x.start >= a.pos, 's', x)", "greatest(a.pos, x.start - x.neglen)")
    runs = bind(marked, "m", bind(
        "filter(sequence(0, size(m) - 1), i -> m[i].new)", "f",
        "transform(f, (i, k) -> slice(m.s, i + 1, coalesce(try_element_at(f, k + 2), size(m)) - i))"))
    pick = f"""aggregate(
        sort_array(transform(run, s -> named_struct('rank', s.rank, 'start', s.start, 's', s))),
        {NO_SPANS},
        (acc, x) -> if(
            exists(acc, k -> k.start < x.s.start - x.s.neglen and x.s.start < k.start - k.neglen),
            acc,
            concat(acc, array(x.s))))"""
    return sorted_or(spans, f"sort_array(flatten(transform({runs}, run -> if(size(run) < 2, run, {pick}))))")


def splice(text: str, spans: str, replacement: str, end: str | None = None) -> str:
    """Text with every span ``x`` (sorted, disjoint) replaced by an expression; ``end`` may name the field with its end.

    A substring is counted from the start of the text, so with many spans the text is
    cut once for each block of them, and then inside that part.
    """
    def after(x: str) -> str:
        return f"{x}.{end}" if end else f"({x}.start - {x}.neglen)"

    before = f"if(i = 0, 0, {after('it[i - 1]')})"
    few = f"""concat(array_join(transform(it, (x, i) -> concat(substr(__whole, {before} + 1, x.start - {before}), {replacement})), ''),
        substr(__whole, {after('element_at(it, -1)')} + 1))"""
    inner = f"""aggregate(blk, named_struct('pos', acc.pos, 'out', cast(array() as array<string>)),
        (a, x) -> named_struct('pos', {after('x')}, 'out', concat(a.out, array(
            concat(substr(part, a.pos - acc.pos + 1, x.start - a.pos), {replacement})))))"""
    last = after('element_at(blk, -1)')
    step = bind(f"substr(__whole, acc.pos + 1, {last} - acc.pos)", "part", bind(
        inner, "b", "named_struct('pos', b.pos, 'out', concat(acc.out, array(array_join(b.out, ''))))"))
    blocks = f"transform(sequence(0, greatest(size(it) - 1, 0) div {BLOCK}), k -> slice(it, k * {BLOCK} + 1, {BLOCK}))"
    return bind(text, "__whole", bind(spans, "it", f"""if(size(it) = 0, __whole, if(size(it) <= {BLOCK}, {few}, aggregate({blocks},
        named_struct('pos', 0, 'out', cast(array() as array<string>)), (acc, blk) -> {step},
        acc -> concat(array_join(acc.out, ''), substr(__whole, acc.pos + 1)))))"""))


def blank(text: str, spans: str) -> str:
    """Text of the same length in which the spans are filled in."""
    return splice(text, spans, f"repeat({lit(FILL)}, -x.neglen)")


def original_values(spans: str, text: str) -> str:
    """Values read from the original text where the scanned text was filled in."""
    filled = f"contains(s.value, {lit(FILL)})"
    read = f"""transform(__found, s -> if(
        {filled},
        named_struct('start', s.start, 'neglen', s.neglen, 'ord', s.ord, 'rank', s.rank,
                     'key', s.key, 'value', substr({text}, s.start + 1, -s.neglen)),
        s))"""
    return bind(spans, "__found", f"if(exists(__found, s -> {filled}), {read}, __found)")


def count_by_key(spans: str) -> str:
    """map<key, number of spans>, without zero entries."""
    counts = "transform(sort_array(array_distinct(ks)), k -> struct(k, cast(size(ks) - size(array_remove(ks, k)) as bigint)))"
    return f"map_from_entries({bind(f'{spans}.key', 'ks', counts)})"
