"""Compile a RulePack into the matchers of each stage."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from veilspark.functions import catalog as C
from veilspark.functions.rulepack import RulePack, java_pattern
from veilspark.functions.spans import CLOSE, FILL, OPEN, Kind, place_spans, word_spans
from veilspark.functions.text import lit

CJK = "[一-鿿]"


def _contains_any(*words: str) -> Callable[[str], str]:
    return lambda t: "(" + " or ".join(f"contains({t}, {lit(w)})" for w in words) + ")"


def _rlike(pattern: str) -> Callable[[str], str]:
    return lambda t: f"rlike({t}, {lit(pattern)})"


# Cheap tests that every text with a match of the entity passes.  A text that
# fails one skips the patterns behind it.
GUARDS: dict[str, Callable[[str], str]] = {
    "digits": _rlike(r"\p{Nd}{6}"),
    "at": _contains_any("@"),
    "scheme": _contains_any("://"),
    "money": _contains_any("$", "¥", "￥"),
    "date": _rlike(r"\p{Nd}{4}[-/年]"),
    "dotted": _rlike(r"[0-9]\.[0-9]{1,3}\.[0-9]"),
    "decimal": _rlike(r"\p{Nd}\.\p{Nd}{4}"),
    "ssn": _rlike(r"\p{Nd}-\p{Nd}{2}-\p{Nd}{4}"),
    "hexpair": _rlike(r"[0-9A-Fa-f][:-][0-9A-Fa-f]{2}[:-]"),
    "plate": _rlike(CJK + "[A-Z]"),
    "plate_behind": _rlike(CJK + CJK + "[A-Z]"),
    "orgcode": _rlike(r"[0-9A-Z]{8}-[0-9A-Z]"),
    "keys": lambda t: "(" + " or ".join([
        f"(contains({t}, '-') and {_contains_any('sk-', 'xox', 'glpat-', 'key-')(t)})",
        f"(contains({t}, '_') and "
        + _contains_any("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "hf_", "_live_", "_test_")(t) + ")",
        _contains_any("AKIA", "AIza", "acct", "SG.", "ya29.")(t),
    ]) + ")",
    "cjk": _rlike(CJK),
}
# Still cheaper tests that come first, and the guards that need them to pass.
BASES: dict[str, Callable[[str], str]] = {
    "digit": _rlike(r"\p{Nd}"),
    "dash": _contains_any("-"),
}
NEEDS = {
    "digits": ["digit"], "date": ["digit"], "dotted": ["digit"], "decimal": ["digit"],
    "ssn": ["digit", "dash"], "orgcode": ["dash"],
}
GUARD_OF = {
    "phone": "digits", "idcard": "digits", "bankcard": "digits", "postcode": "digits",
    "passport": "digits", "credit_code": "digits", "hkmo_pass": "digits",
    "taiwan_pass": "digits", "taiwan_id": "digits", "hkmo_resident": "digits",
    "military_id": "digits", "email": "at", "url": "scheme", "amount": "money", "date": "date",
    "ip": "dotted", "coordinates": "decimal", "ssn": "ssn", "mac": "hexpair", "plate": "plate",
    "org_code": "orgcode", "api_key": "keys",
}


# What a match of the entity starts with.  Tested ahead of the pattern, it turns
# most positions away before any look-behind; it never changes a match.
STARTS_WITH = {
    "phone": "(?=1[3-9])",
    "idcard": r"(?=[1-9])(?<!\d)(?=\d{6})",
    "bankcard": r"(?=\d)(?<!\d)(?=\d{6})",
    "postcode": r"(?=[1-9])(?<!\d)(?=\d{6})",
    "coordinates": r"(?=\d{1,3}\.)",
    "ip": r"(?=[0-9]{1,3}\.)",
    "date": r"(?=\d{4}[-/年])",
    "passport": r"(?=E\d)",
    "ssn": r"(?=\d{3}-)",
    "credit_code": r"(?=[0-9A-Y])(?<![A-Z0-9])(?=[0-9A-Y]{2}\d{6})",
    "mac": "(?=[0-9A-Fa-f]{2}[:-])",
    "hkmo_pass": r"(?=C\d)",
    "taiwan_pass": r"(?=L\d)",
    "taiwan_id": r"(?=[A-Z][12]\d)",
    "org_code": "(?=[0-9A-Y])(?<![A-Z0-9])(?=[0-9A-Y]{8}-)",
    "hkmo_resident": "(?=8[1-3])",
    "military_id": "(?=军)",
    "amount": "(?=[$¥￥])",
    "api_key": "(?=[sghrkxyaAS])(?=sk[-_]|gh[pousr]_|sc_|rk_|key-|xox|glpat-|hf_|AKIA|AIza|SG|ya29|acct)",
    "plate": CJK.join(["(?=", "[A-Z])"]),
    # the longest run before an @ starts after a match or after some other character
    "email": r"(?=[a-zA-Z0-9._%+-])(?:\G|(?<![a-zA-Z0-9._%+-]))(?=[a-zA-Z0-9._%+-]++@)",
}


# Catalog entities whose every match the entity stage sees as well.  Once that
# stage has blanked its choice, such a pattern can only match anew beside a blank.
SEEN_BEFORE = {"phone", "email", "idcard", "ip", "date", "amount", "postcode", "api_key"}
BESIDE_BLANK = (
    f"{FILL}[\\p{{Nd}}A-Za-z._%+$¥￥-]|[\\p{{Nd}}A-Za-z_日-]{FILL}"
)


@dataclass(frozen=True)
class Matcher:
    """One pattern (a SQL expression) or word list that finds spans of a key."""

    key: str
    pattern: str | None
    ord: int
    rank: int
    guard: str | None = None
    keep: Callable[[str], str] | None = None
    words: tuple[str, ...] = ()
    enabled: bool = True
    seen_before: bool = False
    # from the name of the scanned text to its spans, for what no pattern of the plan can say
    spans: Callable[[str], str] | None = None
    # rules that share the pattern; no two of them can match at places that touch
    kinds: tuple[Kind, ...] = ()

    @property
    def keys(self) -> tuple[str, ...]:
        return tuple(k.key for k in self.kinds) or (self.key,)


def guards_of(matchers: Iterable[Matcher]) -> list[str]:
    return sorted({m.guard for m in matchers if m.guard})


def regex(pattern: str, lead: str = "") -> str:
    return lit(java_pattern(lead + fast(pattern)))


def trie_pattern(words: Iterable[str]) -> str:
    """One pattern for many literals: shared prefixes, longest literal first."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def render(node: dict) -> str:
        branches = [literal_pattern(ch) + render(sub) for ch, sub in sorted(node.items()) if ch]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 else "|".join(branches)
        if "" in node:
            return f"(?:{body})?"
        return body if len(branches) == 1 else f"(?:{body})"

    return render(root)


def literal_pattern(text: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", text)


def spelt(pattern: str) -> str:
    """Write out the ranges of ASCII classes: the regex engine looks single characters up in one table.

    For patterns of the catalog only; in others a bracket may mean something else.
    """

    def written(m: re.Match) -> str:
        chars = re.sub("([A-Za-z0-9])-([A-Za-z0-9])", lambda r: "".join(map(chr, range(ord(r[1]), ord(r[2]) + 1))), m[1])
        return "[" + re.sub("-$", r"\\-", chars) + "]"

    return re.sub(r"\[((?:[A-Za-z0-9]-[A-Za-z0-9]|[A-Za-z0-9._%+]|\\-|-(?=\]))+)\]", written, pattern)


def _of_length(*n: int) -> Callable[[str], str]:
    return lambda v: f"length({v}) in ({', '.join(map(str, n))})"


def _starting(text: str) -> Callable[[str], str]:
    return lambda v: f"startswith({v}, {lit(text)})"


# Rules whose matches cannot touch one another, so that one scan finds them all, with what tells
# their values apart: the first four take whole runs of digits (an ID card may end in X), of different
# lengths; the others a capital and 8 digits that no digit follows, or a capital and 9 digits.
DIGIT_RUNS = {
    "phone": _of_length(11), "idcard": _of_length(18), "bankcard": _of_length(16, 19), "postcode": _of_length(6),
}
LETTER_RUNS = {
    "taiwan_id": _of_length(10), "passport": _starting("E"), "hkmo_pass": _starting("C"), "taiwan_pass": _starting("L"),
}
DIGITS_LEAD = r"(?=\d)(?<!\d)(?=\d{6})"
LETTERS_LEAD = r"(?=[A-Z]\d)(?<![A-Z])"


def together(ms: list[Matcher], patterns: dict[str, str], tests: dict[str, Callable[[str], str]], lead: str) -> list[Matcher]:
    """The matchers with those of ``tests`` as one, in the place of the first; all must have the same guard."""
    one = [m for m in ms if m.key in tests]
    if len(one) < 2:
        return ms
    keep = [m for m in one if m.keep]
    merged = replace(
        one[0], pattern=lit(java_pattern(lead + "(?:" + "|".join(spelt(patterns[m.key]) for m in one) + ")")),
        kinds=tuple(Kind(m.key, m.ord, m.rank, tests[m.key]) for m in sorted(one, key=lambda m: list(tests).index(m.key))),
        keep=(lambda v: " and ".join(f"(not {tests[m.key](v)} or {m.keep(v)})" for m in keep)) if keep else None,
    )
    return [merged if m is one[0] else m for m in ms if m is one[0] or m not in one]


@dataclass(frozen=True)
class Sweep:
    """All rules of a stage as one pattern, for texts in which it finds what the rules find one by one.

    The pattern tries the rules at every place, and of those that match there takes the one that the
    stage would choose.  From the end of a match on it and every rule alone go on alike, unless
    another match crosses that end.  ``doubt`` is a pattern that the marked text passes where
    one may, or where something else is to be chosen than what was found; such texts go rule by rule.
    ``kinds`` tell values apart, each after those before it.
    """

    pattern: str
    doubt: str
    kinds: tuple[Kind, ...]
    keep: tuple[str, Callable[[str], str]] | None = None  # a key and what its values must pass
    parts: tuple[tuple[str, str], ...] = ()  # the pattern in pieces, each with what goes ahead of it


def _plain(pattern: str) -> str:
    """A shipped pattern without groups that are kept."""
    return re.sub(r"(?<!\\)\((?!\?)", "(?:", fast(spelt(pattern)))


def _sweep_pattern(parts: Iterable[tuple[str, str]]) -> str:
    """Alternatives with what goes ahead of each."""
    return lit(java_pattern("|".join(_plain(lead) + "(?:" + _plain(pattern) + ")" for lead, pattern in parts)))


def _doubt(after: str, *others: str, marks: Iterable[str] = ()) -> str:
    """A match goes on, or the next one follows without a gap; a full stop that ends a sentence is none of that.

    ``marks`` are patterns that start at a mark: one test turns away all other places.
    """
    ends = [f"{CLOSE}(?:[{OPEN}{after}]|\\.\\S)", *marks]
    return lit(java_pattern("|".join([f"(?=[{FILL}-{CLOSE}])(?:{'|'.join(ends)})", *others])))


def entity_sweep(pack: RulePack) -> Sweep:
    """The entity stage at once.

    None of its patterns takes a blank, so only a match that is followed by a character of another
    match is in doubt.  Where several match at a place the address is the longest, and no others share a first place.
    Names, places and organisations are left to the single rules, see ``entity_matchers``.
    """
    rules = dict(C.ENTITY_STAGE)
    mail = STARTS_WITH["email"].replace(r"\G|", "")
    def one_of(*keys: str) -> str:
        return "|".join(f"{STARTS_WITH.get(k, '(?=http)')}(?:{rules[k]})" for k in keys)

    numbers = f"{DIGITS_LEAD}(?:{'|'.join(rules[k] for k in DIGIT_RUNS)})"
    parts = (
        (mail, rules["email"]), (r"(?=\d)", f"{numbers}|{one_of('ip', 'date')}"),
        ("(?=[hsgrkxyaAS$¥￥])", one_of("url", "api_key", "amount")), (STARTS_WITH["plate"], rules["plate"]),
    )
    marks = f"[{OPEN}{CLOSE}]*"
    names = any(map(pack.is_enabled, ("person", "location", "organization")))
    tests = {
        "url": lambda v: f"contains({v}, '://')", "email": lambda v: f"contains({v}, '@')",
        "amount": lambda v: f"left({v}, 1) in ('$', '¥', '￥')", "plate": lambda v: f"({v} >= '一' and {v} < 'ꀀ')",
        "api_key": lambda v: f"({v} >= 'A' and {v} < '{{')", "ip": lambda v: f"contains({v}, '.')",
        "date": lambda v: f"substr({v}, 5, 1) in ('-', '/', '年')", **DIGIT_RUNS,
    }
    ords = {key: i for i, (key, _) in enumerate(C.ENTITY_STAGE)}
    return Sweep(
        _sweep_pattern(parts), _doubt(r"A-Za-z\p{Nd}_%+@:/年月日\-", CJK if names else CJK + marks + CJK + marks + "[A-Z]"),
        tuple(Kind(key, ords[key], 300, test) for key, test in tests.items()),
        ("bankcard", luhn_keep) if pack.card_luhn == "strict" else None, parts,
    )


# Rules of the late stage that the entity stage has not run, with what tells a value from those of the rules below.
LATE_RUNS = {
    "plate": lambda v: f"({v} >= '一' and {v} < 'ꀀ')",
    "coordinates": lambda v: f"contains({v}, '.')",
    "mac": lambda v: f"(length({v}) = 17 and substr({v}, 3, 1) in (':', '-'))",
    "ssn": lambda v: f"substr({v}, 4, 1) = '-'",
    "org_code": lambda v: f"substr({v}, 9, 1) = '-'",
    "credit_code": _of_length(18),
    **LETTER_RUNS,
    "bankcard": lambda v: "true",
}


def catalog_sweep(pack: RulePack) -> Sweep | None:
    """The late stage at once, for texts in which the rules that the entity stage has run cannot match anew.

    A rule that comes earlier wins wherever it touches another.  Inside the match of a later rule it can
    only be a number in long coordinates, and as long as a credit code only a card behind a capital; both are in doubt.
    None if the pack has other rules than the shipped ones.  URLs are left to the single rules.
    """
    ranked = [(400 + i, e) for i, e in enumerate(pack.catalog_rules())]
    late = {e.key: (rank, e) for rank, e in ranked if e.key not in SEEN_BEFORE and e.key != "url"}
    if not pack.entity_stage or not late or not set(late) <= set(LATE_RUNS) or not all(_shipped(e) for _, e in ranked):
        return None
    spelt_out = {k: e.pattern[4:].replace("A-F", "A-Fa-f") if e.pattern.startswith("(?i)") else e.pattern for k, (_, e) in late.items()}
    # rules that need the same before them; of one place a code comes before a card, and no other two match there
    groups = [
        ("(?=[0-9A-Y])(?<![A-Z0-9])", ("credit_code", "org_code")), (r"(?=\d)(?<!\d)", ("bankcard", "coordinates", "ssn")),
        ("", ("mac",)), ("", ("plate",)), (LETTERS_LEAD, tuple(LETTER_RUNS)),
    ]
    parts = [
        (lead, "|".join(f"{STARTS_WITH[k]}(?:{spelt_out[k]})" for k in keys if k in late))
        for lead, keys in groups if set(keys) & set(late)
    ]
    return Sweep(
        _sweep_pattern(parts),
        _doubt(
            r"A-Za-z\p{Nd}:\-", rf"[A-Z]{OPEN}[1-9]\d{{17}}{CLOSE}", rf"{OPEN}\d+[^\x00-\x7F{CLOSE}]",
            rf"{OPEN}(?=\d{{1,3}}\.)[^{CLOSE}]{{25}}",
        ),
        tuple(Kind(k, 0, late[k][0], test) for k, test in LATE_RUNS.items() if k in late),
        ("bankcard", bank_card_keep) if "bankcard" in late else None, tuple(parts),
    )


def whole_sweep(pack: RulePack) -> Sweep | None:
    """Both built-in stages at once, for texts in which no match of one stage touches what the other needs to see.

    At a place the rules of the entity stage come first, as they do when the stages run one after the
    other.  What that order decides otherwise is in doubt: a match with a letter or digit beside it (it may cross
    another, or a rule may match anew beside its blank), and a number inside a match of the late stage, which is
    one in a long fraction or a run of 6, 11 or 16 digits between capitals.  A later plate starts with an earlier one.
    None unless all rules are the shipped ones, those of the entity stage are on and its names are off.
    """
    late = catalog_sweep(pack)
    names = any(map(pack.is_enabled, ("person", "location", "organization")))
    if late is None or names or pack.card_luhn == "strict" or not all(pack.is_enabled(k) for k, _ in C.ENTITY_STAGE):
        return None
    ords = {key: i for i, (key, _) in enumerate(C.ENTITY_STAGE)}
    ranks = {k.key: k.rank for k in late.kinds}
    tests = {k: test for k, test in LATE_RUNS.items() if k in ranks and k != "plate"}
    early, dotted = entity_sweep(pack).parts, lambda v: f"(contains({v}, '.') and rlike({v}, '^[0-9.]+$'))"
    idcard = lit(java_pattern("^(?:" + dict(C.ENTITY_STAGE)["idcard"] + ")$"))
    told = [
        ("url", lambda v: f"contains({v}, '://')"), ("email", lambda v: f"contains({v}, '@')"),
        ("amount", lambda v: f"left({v}, 1) in ('$', '¥', '￥')"), ("plate", LATE_RUNS["plate"]), ("mac", None),
        ("api_key", lambda v: f"({v} >= 'a' and {v} < '{{' or {v} >= 'A' and {v} < '[' and length({v}) > 18)"),
        ("ip", dotted), ("coordinates", None), ("date", lambda v: f"substr({v}, 5, 1) in ('-', '/', '年')"),
        ("ssn", None), ("org_code", None), ("phone", DIGIT_RUNS["phone"]), ("bankcard", DIGIT_RUNS["bankcard"]),
        ("postcode", DIGIT_RUNS["postcode"]),
        ("idcard", lambda v: f"(length({v}) = 18 and rlike({v}, {idcard}))"),
        *((k, None) for k in ("credit_code", *LETTER_RUNS)),
    ]
    kinds = [Kind(k, ords[k], 300, test) if test else Kind(k, 0, ranks[k], tests[k]) for k, test in told if test or k in ranks]
    if "bankcard" in ranks:
        kinds.append(Kind("bankcard", 0, ranks["bankcard"], tests["bankcard"]))
    ascii_first = [*(part for part in early if part[0] != STARTS_WITH["plate"]), *(part for part in late.parts if not part[1].startswith(STARTS_WITH["plate"]))]
    plate = [part for part in early if part[0] == STARTS_WITH["plate"]]
    marks = f"[{OPEN}{CLOSE}]{{0,2}}"
    return Sweep(
        _sweep_pattern([("(?=[0-9A-Za-z._%+$¥￥\\p{Nd}-])", "|".join(f"{lead}(?:{p})" for lead, p in ascii_first)), *plate]),
        _doubt(
            r"A-Za-z\p{Nd}_%+@:/年月日$¥￥\-", f"{CJK}{marks}{CJK}{marks}[A-Z]", marks=[
                FILL, rf"{OPEN}(?<=[\p{{Nd}}A-Za-z_日-].)", rf"{OPEN}\d+[^\x00-\x7F{CLOSE}年]", rf"{OPEN}\d{{1,3}}\.[^{CLOSE}]*\d{{6}}",
                rf"{OPEN}(?=\d*[A-Z])[0-9A-Z]*(?<!\d)(?:\d{{6}}|\d{{11}}|\d{{16}})(?!\d)",
            ],
        ),
        tuple(kinds), ("bankcard", bank_card_keep) if "bankcard" in ranks else None,
    )


def bank_card_keep(value: str) -> str:
    return f"(not (length({value}) = 11 and startswith({value}, '1')) and luhn_check({value}))"


def luhn_keep(value: str) -> str:
    return f"luhn_check({value})"


def user_matchers(pack: RulePack, row_words: str | None = None, row_places: str | None = None) -> list[Matcher]:
    """Keywords first, then the user's rules in the order they were added.

    ``row_words`` names an array column with the keywords of each row,
    ``row_places`` one with their places.
    """
    out = []
    if row_places is not None:
        out.append(Matcher("custom", None, 0, 100, spans=lambda text: place_spans(row_places, "custom", 0, 100)))
    elif row_words is not None:
        out.append(Matcher("custom", None, 0, 100, spans=lambda text: word_spans(text, row_words, "custom", 0, 100)))
    elif pack.keywords:
        out.append(Matcher("custom", lit(trie_pattern(pack.keywords)), 0, 100))
    for i, r in enumerate(r for r in pack.rules if r.enabled):
        out.append(Matcher(r.entity_type, regex(r.pattern), 0, 200 + i))
    return out


def entity_matchers(pack: RulePack) -> list[Matcher]:
    """Early stage: eleven patterns, names, places, organisations.

    Switched-off types stay in, because they still take part in the choice
    between overlapping spans; the caller drops them afterwards.  Names, places
    and organisations are made of Chinese characters only, and of the patterns
    only a plate starts with one.  So while all three are off, they matter only
    to texts in which a plate may follow a Chinese character: they could only
    end at its first character.
    """
    strict = pack.card_luhn == "strict"
    out = [
        Matcher(
            key, regex(spelt(pattern), spelt(STARTS_WITH.get(key, ""))), i, 300, GUARD_OF[key],
            luhn_keep if strict and key == "bankcard" else None, (), pack.is_enabled(key),
        )
        for i, (key, pattern) in enumerate(C.ENTITY_STAGE)
    ]
    n = len(out)
    out = together(out, dict(C.ENTITY_STAGE), DIGIT_RUNS, DIGITS_LEAD)
    person, place, org = map(pack.is_enabled, ("person", "location", "organization"))
    cjk = "cjk" if person or place or org else "plate_behind"
    return out + [
        Matcher("person", lit(compound_name_pattern()), n, 300, cjk, not_common, (), person),
        Matcher("person", lit(fast(single_name_pattern())), n + 1, 300, cjk, single_name_keep, (), person),
        Matcher("location", None, n + 2, 300, cjk, None, tuple(C.PROVINCES), place),
        Matcher("location", lit(f"[{C.PLACE_SUFFIX_CHARS}]"), n + 3, 300, cjk, None, (), place),
        Matcher("organization", lit(org_pattern()), n + 4, 300, cjk, org_keep, (), org),
    ]


def catalog_matchers(pack: RulePack) -> list[Matcher]:
    """Late stage: the enabled catalog patterns, in rule order."""
    rules = pack.catalog_rules()
    ms = [catalog_matcher(e, 400 + i) for i, e in enumerate(rules)]
    if not all(_shipped(e) for e in rules if e.key in LETTER_RUNS):
        return ms
    return together(ms, {e.key: e.pattern for e in rules}, LETTER_RUNS, LETTERS_LEAD)


def _shipped(entity) -> bool:
    return (entity.key, entity.pattern) in {(row[0], row[7]) for row in C.ENTITIES} | {("plate", C.FALLBACK_PLATE)}


def catalog_matcher(entity, rank: int = 0) -> Matcher:
    known = _shipped(entity)
    # an address that must start at a word boundary may start inside a run
    lead = STARTS_WITH.get(entity.key, "") if known and entity.key != "email" else ""
    if lead and entity.pattern.startswith("(?i)"):
        # only the hexadecimal letters have case here; spelt out they need no folding
        pattern = entity.pattern[4:].replace("A-F", "A-Fa-f")
    else:
        pattern = entity.pattern
    return Matcher(
        entity.key, regex(spelt(pattern) if known else pattern, spelt(lead)), 0, rank,
        GUARD_OF.get(entity.key) if known else None,
        bank_card_keep if entity.key == "bankcard" else None,
        seen_before=known and entity.key in SEEN_BEFORE,
    )


def char_choice(chars: str) -> str:
    """One of many characters.

    The regex engine tries the members of a class one by one, so a long class
    is halved by ranges: a character outside is turned away by one comparison.
    """

    def choose(part: str) -> str:
        if len(part) <= 4:
            return f"[{part}]"
        mid = len(part) // 2
        left, right = part[:mid], part[mid:]
        return f"(?:(?=[{left[0]}-{left[-1]}]){choose(left)}|(?=[{right[0]}-{right[-1]}]){choose(right)})"

    ordered = "".join(sorted(set(chars)))
    return f"(?=[{ordered[0]}-{ordered[-1]}]){choose(ordered)}"


def fast(pattern: str) -> str:
    """Rewrite the long classes of a pattern; its matches stay the same."""
    return re.sub(r"\[([一-鿿]{12,})\]", lambda m: char_choice(m.group(1)), pattern)


def compound_name_pattern() -> str:
    return f"(?={CJK}{{3}})(?:{'|'.join(C.COMPOUND_SURNAMES)}){CJK}{{1,2}}"


def single_name_pattern() -> str:
    return f"(?={CJK}{{2}})[{C.SURNAMES}]{CJK}"


def org_pattern() -> str:
    suffixes = sorted(C.ORG_SUFFIXES, key=len, reverse=True)
    return f"({CJK}{{2,12}}?)(?:{'|'.join(suffixes)})"


def not_common(value: str) -> str:
    return f"{value} not in ({', '.join(lit(w) for w in C.COMMON_WORDS)})"


def single_name_keep(value: str) -> str:
    return f"({not_common(value)} and not rlike({value}, {lit('|'.join(C.PLACE_FRAGMENTS))}))"


def org_keep(value: str) -> str:
    only_directions = f"^[{C.DIRECTION_CHARS}]+(?:{'|'.join(C.ORG_SUFFIXES)})$"
    return f"not rlike({value}, {lit(only_directions)})"
