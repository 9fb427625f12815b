"""Detection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import catalog as C
from veilspark.functions import matchers as M
from veilspark.functions.rulepack import CustomRule, RulePack
from veilspark.functions.text import lit
from veilspark.operators import altpack, keywords, quality, requests
from veilspark.operators.detect import count_spans, detect, match_values, span_rows
from veilspark.operators.restore import restore
from veilspark.plans import derived as D
from veilspark.plans.registry import query
from veilspark.sources.tables import spread, table

PACK = RulePack()
NAMES_ON = PACK.enable("person", "location", "organization")
PATTERN = {row[0]: row[7] for row in C.ENTITIES}
EARLY = dict(C.ENTITY_STAGE)


# -- how the checking engine, whose patterns cannot look around, lists the values ----
def sq(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def all_of(pattern: str) -> str:
    return f"regexp_extract_all(text, {sq(pattern)})"


def where(values: str, test: str) -> str:
    return f"[x for x in {values} if {test}]"


def whole(run: str, pattern: str) -> str:
    return where(all_of(run), f"regexp_full_match(x, {sq(pattern)})")


def luhn(x: str) -> str:
    d = f"try_cast(substr(reverse({x}), i + 1, 1) as int)"
    return (
        f"list_sum([case when i % 2 = 0 then {d} else ({d} * 2) % 10 + ({d} * 2) // 10 end "
        f"for i in range(length({x}))]) % 10 = 0"
    )


IDCARD = r"[1-9][0-9]{5}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"
DIGITS = all_of("[0-9]+")
VALUES = {
    "phone": whole("[0-9]+", "1[3-9][0-9]{9}"),
    "email": all_of(EARLY["email"]),
    "idcard": whole("[0-9]+[Xx]?", IDCARD),
    "bankcard": where(DIGITS, f"length(x) between 16 and 19 and x[1] <> '0' and {luhn('x')}"),
    "plate": all_of(PATTERN["plate"]),
    "coordinates": where(
        all_of(r"[0-9]+\.[0-9]{4,}\s*[,，\s]\s*[0-9]{1,3}\.[0-9]{4,}"),
        r"regexp_matches(x, '^[0-9]{1,3}\.')",
    ),
    "ip": all_of(PATTERN["ip"]),
    "url": all_of(r"https?://[^\s]+"),
    "date": all_of(r"[0-9]{4}[-/年](?:0?[1-9]|1[0-2])[-/月](?:0?[1-9]|[12][0-9]|3[01])日?"),
    "amount": all_of(PATTERN["amount"]),
    "postcode": where(DIGITS, "length(x) = 6 and x[1] <> '0'"),
    "passport": whole("[A-Z]*[0-9]+", "E[0-9]{8}"),
    "ssn": whole("[0-9]+-[0-9]+-[0-9]+", "[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "credit_code": whole("[A-Z0-9]+", "[0-9A-HJ-NPQRTUWXY]{2}[0-9]{6}[0-9A-HJ-NPQRTUWXY]{10}"),
    "mac": all_of("(?i)[0-9A-F]{2}(?:[:-][0-9A-F]{2}){5}"),
    "api_key": all_of(EARLY["api_key"]),
    "hkmo_pass": whole("[A-Z]*[0-9]+", "C[0-9]{8}"),
    "taiwan_pass": whole("[A-Z]*[0-9]+", "L[0-9]{8}"),
    "taiwan_id": whole("[A-Z0-9]+", "[A-Z][12][0-9]{8}"),
    "org_code": whole("[A-Z0-9-]+", "[0-9A-HJ-NPQRTUWXY]{8}-[0-9A-HJ-NPQRTUWXY]"),
    "hkmo_resident": whole("[0-9]+", "8[1-3][0-9]{16}"),
    "military_id": all_of("军字第?[0-9]{6,8}号?"),
}


def values_check(source: str, values: str, key: str = "doc_id", prefix: str = "") -> str:
    return (
        f"{prefix} select {key}, cast(len(v) as bigint) as n, array_to_string(v, '|') as vals "
        f"from (select {key}, {values} as v from {source}) q where len(v) > 0"
    )


def joined(df):
    return df.withColumn("vals", F.array_join("vals", "|"))


def _register_rule(key: str, source: str) -> None:
    matcher = M.catalog_matcher(PACK.entity(key))
    given = source == "documents"
    check = values_check(source, VALUES[key], prefix="" if given else D.with_tables(source))

    @query(f"detect_{key}" if given else f"detect_{key}_rich", check)
    def run(spark, sf_dir):
        df = spread(table(spark, sf_dir, source)) if given else D.derived(spark, sf_dir, source)
        return joined(match_values(df, ["doc_id"], "text", matcher))


for _key in ("email", "bankcard", "ip"):
    _register_rule(_key, "documents")
for _key in VALUES:
    _register_rule(_key, "pii_text")


@query(
    "detect_pages",
    "select page_id, cast(len(e) as bigint) as n_email, cast(len(i) as bigint) as n_ip from "
    f"(select page_id, {VALUES['email'].replace('text', 'html')} as e, "
    f"{VALUES['ip'].replace('text', 'html')} as i from pages) q where len(e) + len(i) > 0",
)
def detect_pages(spark, sf_dir):
    """Count form of two catalog rules over raw pages."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "html"))
    count = {
        f"n_{k}": F.expr(
            f"if({M.GUARDS[M.GUARD_OF[k]]('html')}, cast(regexp_count(html, {M.regex(PATTERN[k])}) as bigint), 0L)"
        )
        for k in ("email", "ip")
    }
    return pages.withColumns(count).drop("html").filter("n_email + n_ip > 0")


# -- names, places, organisations ------------------------------------------------
_common = "(" + ", ".join(f"'{w}'" for w in C.COMMON_WORDS) + ")"
_place = "|".join(C.PLACE_FRAGMENTS)


@query(
    "detect_person",
    D.with_tables("names_text") + f""", v as (
        select doc_id, {where(all_of(M.compound_name_pattern().partition(')')[2]), f'x not in {_common}')} as a,
               {where(all_of(M.single_name_pattern().partition(')')[2]),
                      f"x not in {_common} and not regexp_matches(x, '{_place}')")} as b
        from names_text)
    select doc_id, cast(len(a) as bigint) as n_compound, array_to_string(a, '|') as compound,
           cast(len(b) as bigint) as n_single, array_to_string(b, '|') as single from v""",
)
def detect_person(spark, sf_dir):
    """Two-character and single-character surnames with their filters."""
    early = M.entity_matchers(NAMES_ON)
    compound, single = [m for m in early if m.key == "person"]
    df = D.derived(spark, sf_dir, "names_text")

    def vals(m):
        return F.expr(f"filter(regexp_extract_all(text, {m.pattern}, 0), v -> {m.keep('v')})")

    return df.select("doc_id", vals(compound).alias("a"), vals(single).alias("b")).selectExpr(
        "doc_id", "cast(size(a) as bigint) as n_compound", "array_join(a, '|') as compound",
        "cast(size(b) as bigint) as n_single", "array_join(b, '|') as single",
    )


@query(
    "detect_location",
    D.with_tables("names_text") + ", p as (select unnest(["
    + ", ".join(f"'{p}'" for p in C.PROVINCES)
    + "]) as value), r as (select doc_id, value, strpos(text, value) - 1 as start from names_text, p "
    "where contains(text, value)), s as (select doc_id, unnest(range(length(text))) as i, text "
    "from names_text) select doc_id, value, cast(start as bigint) as start from r union all "
    f"select doc_id, text[i + 1] as value, cast(i as bigint) as start from s "
    f"where contains('{C.PLACE_SUFFIX_CHARS}', text[i + 1])",
)
def detect_location(spark, sf_dir):
    """Provinces at their first place, and single place characters."""
    from veilspark.operators.detect import matches

    df = D.derived(spark, sf_dir, "names_text")
    provinces, chars = [m for m in M.entity_matchers(NAMES_ON) if m.key == "location"]
    found = matches(df, ["doc_id"], "text", provinces).unionByName(
        matches(df, ["doc_id"], "text", chars)
    )
    return found.select("doc_id", "value", "start")


@query(
    "detect_org",
    values_check(
        "names_text",
        where(all_of(M.org_pattern().replace("(" + M.CJK, "(?:" + M.CJK, 1)),
              f"not regexp_full_match(x, '[{C.DIRECTION_CHARS}]+({'|'.join(C.ORG_SUFFIXES)})')"),
        prefix=D.with_tables("names_text"),
    ),
)
def detect_org(spark, sf_dir):
    """Organisation names: the shortest name before a known ending."""
    org = [m for m in M.entity_matchers(NAMES_ON) if m.key == "organization"][0]
    return joined(match_values(D.derived(spark, sf_dir, "names_text"), ["doc_id"], "text", org))


# -- the whole choice of spans --------------------------------------------------------
def gold_sql(parts=None) -> str:
    """Planted spans of the rich text, computed from how the text is put together."""
    parts = parts or [p for p in D.PII_PARTS if p[0] in D.GOLD_KEYS]
    out, before = [], "''"
    for key, value, lead, gap in parts:
        before = f"concat({before}, '{lead}')"
        out.append(
            f"select o_orderkey as doc_id, '{key}' as entity_type, "
            f"cast(length({before}) as bigint) as start, "
            f"cast(length({before}) + length({value}) as bigint) as \"end\", {value} as value "
            "from orders"
        )
        before = f"concat({before}, {value}, '{gap}')"
    return " union all ".join(out)


def gold_spans(spark, sf_dir):
    sql = gold_sql().replace('"end"', "`end`").replace("from orders", "from {orders}")
    return spark.sql(sql, orders=table(spark, sf_dir, "orders"))


@query("spans_resolved", gold_sql())
def spans_resolved(spark, sf_dir):
    """All stages together on text with one entity of each kind."""
    return span_rows(detect(D.derived(spark, sf_dir, "pii_text_on")), ["doc_id"])


@query(
    "detector_f1",
    f"with g as ({gold_sql()}), f as (select entity_type, count(*) as n, "
    f"count(*) filter (where entity_type <> 'bankcard' or {luhn('value')}) as tp from g group by 1) "
    "select entity_type, cast(tp as bigint) as tp, cast(0 as bigint) as fp, "
    "cast(n - tp as bigint) as fn, case when tp > 0 then 1.0 end::double as precision, "
    "round(tp / n, 6) as recall, round(2 * tp / (2 * tp + n - tp), 6) as f1 from f",
)
def detector_f1(spark, sf_dir):
    """Scores per type; with strict cards the planted numbers that fail the check are missed."""
    texts = D.derived(spark, sf_dir, "pii_text_on")
    predicted = span_rows(detect(texts, pack=RulePack(card_luhn="strict")), ["doc_id"])
    return quality.detector_scores(predicted, gold_spans(spark, sf_dir), ["entity_type"])


# the same texts with more or less after them, so that several lengths occur
_PADDED = "concat(text, repeat(' 。', cast(doc_id % 3 * 400 * (doc_id % 3) as int)))"


@query(
    "detector_f1_by_length",
    f"with g as ({gold_sql()}), {D.with_tables('pii_text_on')[5:]}, f as (select "
    + quality.length_bucket(f"length({_PADDED})") + " as bucket, count(*) as n, "
    f"count(*) filter (where entity_type <> 'bankcard' or {luhn('value')}) as tp "
    "from g join pii_text_on t using (doc_id) group by 1) "
    "select bucket, cast(tp as bigint) as tp, cast(0 as bigint) as fp, "
    "cast(n - tp as bigint) as fn, 1.0::double as precision, round(tp / n, 6) as recall, "
    "round(2 * tp / (2 * tp + n - tp), 6) as f1 from f",
)
def detector_f1_by_length(spark, sf_dir):
    texts = D.derived(spark, sf_dir, "pii_text_on").withColumn("text", F.expr(_PADDED)).withColumn(
        "bucket", F.expr(quality.length_bucket("length(text)"))
    )
    predicted = span_rows(
        detect(texts, pack=RulePack(card_luhn="strict")), ["doc_id", "bucket"]
    )
    gold = gold_spans(spark, sf_dir).join(texts.select("doc_id", "bucket"), "doc_id")
    return quality.detector_scores(predicted, gold, ["bucket"])


# -- keywords and user rules ------------------------------------------------------------
WORDS = ["the", "there", "here", "token", "que", "der", "and", "quen", "ent"]


def _per_word(w: str) -> str:
    return (
        f"select doc_id, '{w}' as keyword, "
        f"cast((length(text) - length(replace(text, '{w}', ''))) / {len(w)} as bigint) as n, "
        f"cast(strpos(text, '{w}') - 1 as bigint) as first_start from documents "
        f"where contains(text, '{w}')"
    )


@query("keyword_matches", " union all ".join(_per_word(w) for w in WORDS))
def keyword_matches(spark, sf_dir):
    """Every occurrence of every keyword, overlapping ones too, counted per text."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    found = keywords.keyword_matches(docs, ["doc_id"], words)
    return found.groupBy("doc_id", "keyword").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("first_start")
    )


@query(
    "keyword_matches_longest",
    values_check("documents", all_of("|".join(sorted(WORDS, key=len, reverse=True)))),
)
def keyword_matches_longest(spark, sf_dir):
    """Leftmost, longest keywords."""
    matcher = M.Matcher("custom", lit(M.trie_pattern(WORDS)), 0, 0)
    docs = spread(table(spark, sf_dir, "documents"))
    return joined(match_values(docs, ["doc_id"], "text", matcher))


# more than 10,000 keywords at the scale of the checks: parts of words of the texts themselves
_DICTIONARY = "regexp_extract_all(text, '[a-z]{8,9}', 0)"
_dictionary_hits = (
    "with k as (select distinct unnest(regexp_extract_all(text, '[a-z]{8,9}')) as w from documents), "
    "p as (select doc_id, text, unnest(range(1, length(text) + 1)) as i from documents), "
    "j as (select doc_id, i, substr(text, i, n) as w from p, (values (8), (9)) as l(n) where i + n - 1 <= length(text)) "
)


def _dictionary(docs):
    return docs.select(F.explode(F.expr(_DICTIONARY)).alias("keyword")).distinct()


@query(
    "keyword_dictionary",
    _dictionary_hits + "select doc_id, count(*) as n, cast(sum(i - 1) as bigint) as places from j join k using (w) group by 1",
)
def keyword_dictionary(spark, sf_dir):
    """Every occurrence of every keyword of a large dictionary."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = keywords.keyword_matches(docs, ["doc_id"], _dictionary(docs))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("places"))


@query(
    "mask_dictionary",
    _dictionary_hits + ", h as (select distinct doc_id from j join k using (w)) "
    "select d.doc_id, h.doc_id is not null as hit, true as restored from documents d left join h on d.doc_id = h.doc_id",
)
def mask_dictionary(spark, sf_dir):
    """The same dictionary through masking: texts with a keyword have one masked, and all come back."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    masked = keywords.mask_with_dictionary(docs, ["doc_id"], _dictionary(docs))
    return restore(masked).selectExpr(
        "doc_id", "exists(mappings, m -> m.entity_type = 'custom') as hit", "restored = text as restored")


@query(
    "keyword_matches_ranked",
    f"with m as ({' union all '.join(_per_word(w) for w in WORDS)}), "
    "r as (select *, row_number() over (partition by doc_id order by -length(keyword), first_start, keyword) as k from m) "
    "select doc_id, keyword as longest, cast(first_start as int) as first_start from r where k = 1",
)
def keyword_matches_ranked(spark, sf_dir):
    """Matches of a text in order: the longest keyword first, then by place."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = spark.createDataFrame([(w,) for w in WORDS], "keyword string")
    ranked = keywords.ranked_matches(keywords.keyword_matches(docs, ["doc_id"], words), ["doc_id"])
    return ranked.selectExpr("doc_id", "matches[0].keyword as longest", "cast(matches[0].start as int) as first_start")


US_PHONE = r"\(\d{3}\) \d{3}-\d{4}"
TOKEN = r'token = "[0-9a-f]+"'


def _custom(name: str, pattern: str) -> None:
    @query(name, values_check("documents", all_of(pattern)))
    def run(spark, sf_dir):
        pack = RulePack(entities=(PACK.entity("custom"),), entity_stage=False).with_rules(
            [CustomRule(name, pattern, "custom")]
        )
        spans = detect(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), pack=pack)
        return spans.filter("size(spans) > 0").selectExpr(
            "doc_id", "cast(size(spans) as bigint) as n", "array_join(spans.value, '|') as vals"
        )


_custom("custom_rule_us_phone", US_PHONE)
_custom("custom_rule_token", TOKEN)

def ascii_words(pattern: str) -> str:
    """Word boundaries and plain groups in the checking engine's spelling."""
    return (
        pattern.replace("(?<![A-Za-z0-9_])", r"\b").replace("(?![A-Za-z0-9_])", r"\b")
        .replace("(1", "(?:1").replace("(0", "(?:0").replace("([", "(?:[")
    )


_summary = " union all ".join(
    f"select doc_id, '{label}' as label, cast(len(v) as bigint) as n, "
    f"array_to_string(v[1:2], '|') as examples from "
    f"(select doc_id, regexp_extract_all(text, {sq(ascii_words(p))}) as v from t) q "
    "where len(v) > 0"
    for label, p in C.SUMMARY_RULES
)


@query(
    "detection_summary",
    D.with_tables("pii_text")
    + ", t as (select doc_id, text from documents union all select -1 - doc_id, text from pii_text) "
    + _summary,
)
def detection_summary(spark, sf_dir):
    """Hits and two examples per label, over given and rich texts."""
    rich = D.derived(spark, sf_dir, "pii_text").selectExpr("-1 - doc_id as doc_id", "text")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).unionByName(rich)
    found = altpack.detection_summary(docs, ["doc_id"])
    return found.withColumn("examples", F.array_join("examples", "|"))


_landline = where(DIGITS, "length(x) between 10 and 12 and x[1] = '0'")
_ALT = {
    "PHONE": f"list_concat(list_concat({VALUES['phone']}, {_landline}), "
             f"{whole('[0-9]+-[0-9]+', '0[0-9]{2,3}-[0-9]{7,8}')})",
    "EMAIL": all_of(r"[\w._%+-]+@[\w.-]+\.[a-zA-Z]{2,}"),
    "IDCARD": VALUES["idcard"],
    "BANKCARD": where(
        all_of("[0-9]+[Xx]?"),
        f"regexp_full_match(x, '[0-9]{{16,19}}') and not regexp_full_match(x, {sq(IDCARD)})",
    ),
    "IP": whole(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", r"([0-9]{1,3}\.){3}[0-9]{1,3}"),
}


@query(
    "alt_rule_pack",
    D.with_tables("pii_text")
    + ", t as (select doc_id, text from documents union all select -1 - doc_id, text from pii_text) "
    + " union all ".join(
        f"select doc_id, '{k}' as entity_type, cast(len(v) as bigint) as n, "
        f"'[{k}_' || lpad(cast(len(v) as varchar), 4, '0') || ']' as last_placeholder "
        f"from (select doc_id, {v} as v from t) q where len(v) > 0"
        for k, v in _ALT.items()
    )
    + " union all select -1000000000 - doc_id as doc_id, e.entity_type, cast(e.n as bigint) as n, e.last_placeholder "
    "from documents, (values ('APIKEY', 2, '[APIKEY_0002]'), ('TOKEN', 1, '\"[TOKEN_0001]\"')) "
    "as e(entity_type, n, last_placeholder)",
)
def alt_rule_pack(spark, sf_dir):
    """The second rule pack: per text and type, how many and the highest number given."""
    rich = D.derived(spark, sf_dir, "pii_text").selectExpr("-1 - doc_id as doc_id", "text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    letters = "translate(md5(cast(doc_id as string)), '0123456789', 'ghijklmnop')"
    keys = docs.selectExpr(
        "-1000000000 - doc_id as doc_id",
        f"""concat('use sk-', {letters}, ' or sk-ant-', {letters}, ', send "Bearer ', {letters}, '" too') as text""")
    masked = altpack.mask_numbered(spread(docs.unionByName(rich).unionByName(keys)))
    per_type = F.expr("""transform(map_entries(stats), e -> named_struct(
        'entity_type', e.key, 'n', e.value,
        'last_placeholder', array_max(transform(
            filter(mappings, m -> m.entity_type = e.key), m -> m.placeholder))))""")
    return masked.select("doc_id", F.explode(per_type).alias("x")).select("doc_id", "x.*")


@query(
    "dry_run_counts",
    "with v as (select doc_id, "
    f"len({VALUES['email']}) as email, "
    f"len({where(DIGITS, 'length(x) in (16, 19)')}) as bankcard, len({VALUES['ip']}) as ip, "
    f"len({VALUES['postcode']}) as postcode "
    "from documents), u as (unpivot v on email, bankcard, ip, postcode into name entity_type value n) "
    "select entity_type, cast(sum(n) as bigint) as detected, "
    "cast(sum(case when doc_id % 2 = 1 then n else 0 end) as bigint) as masked "
    "from u where n > 0 group by 1",
)
def dry_run_counts(spark, sf_dir):
    """Detect without masking: dry runs count as detected only."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = count_spans(detect(docs)).withColumn("dry_run", F.expr("doc_id % 2 = 0"))
    return requests.entity_totals(counted)
