"""Entity catalog, detection patterns and word lists.

Everything in this module is data whose exact value decides the result of a
query.  No logic lives here.
"""

# Fixed values -- entity catalog.
# (key, name_zh, name_en, detector, enabled, compliance tag, placeholder token, pattern)
ENTITIES = [
    ("phone", "手机号", "Phone Number", "regex", True, "personal_info", "PII_PHONE",
     r"(?<!\d)(1[3-9]\d{9})(?!\d)"),
    ("email", "邮箱", "Email", "regex", True, "personal_info", "PII_EMAIL",
     r"\b([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b"),
    ("idcard", "身份证号", "China ID Card", "regex", True, "personal_info", "PII_IDCARD",
     r"(?<!\d)([1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?!\d)"),
    ("bankcard", "银行卡号", "Bank Card", "regex", True, "personal_info", "PII_BANK",
     r"(?<!\d)([1-9]\d{15,18})(?!\d)"),
    ("plate", "车牌号", "License Plate", "regex", True, "personal_info", "PII_PLATE",
     "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5,6}"),
    ("coordinates", "经纬度坐标", "Coordinates", "regex", True, "important_data", "PII_COORDINATES",
     r"(?<!\d)(\d{1,3}\.\d{4,}\s*[,，\s]\s*\d{1,3}\.\d{4,})(?!\d)"),
    ("ip", "IP地址", "IP Address", "regex", True, "personal_info", "PII_IP",
     r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"),
    ("url", "URL链接", "URL", "regex", True, "personal_info", "PII_URL",
     r"https?://[^\s]+"),
    ("date", "日期", "Date", "regex", True, "personal_info", "PII_DATE",
     r"\d{4}[-/年](?:0?[1-9]|1[0-2])[-/月](?:0?[1-9]|[12]\d|3[01])日?"),
    ("amount", "金额", "Amount", "regex", True, "personal_info", "PII_AMOUNT",
     r"(?:¥|￥|\$)\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"),
    ("postcode", "邮编", "Postcode", "regex", True, "personal_info", "PII_POSTCODE",
     r"(?<!\d)([1-9]\d{5})(?!\d)"),
    ("passport", "护照号", "Passport", "regex", True, "personal_info", "PII_PASSPORT",
     r"(?<![A-Z])(E\d{8})(?!\d)"),
    ("ssn", "美国社保号", "US SSN", "regex", True, "personal_info", "PII_SSN",
     r"(?<!\d)(\d{3}-\d{2}-\d{4})(?!\d)"),
    ("credit_code", "统一社会信用代码", "Unified Social Credit Code", "regex", True,
     "important_data", "PII_CREDIT_CODE",
     r"(?<![A-Z0-9])([0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10})(?![A-Z0-9])"),
    ("mac", "MAC地址", "MAC Address", "regex", True, "personal_info", "PII_MAC",
     r"(?i)(?<![0-9A-F])([0-9A-F]{2}[:-][0-9A-F]{2}[:-][0-9A-F]{2}[:-][0-9A-F]{2}[:-][0-9A-F]{2}[:-][0-9A-F]{2})(?![0-9A-F])"),
    ("api_key", "API密钥", "API Key", "regex", True, "important_data", "PII_APIKEY",
     r"\b(sk-(?:proj-|ant-)?[A-Za-z0-9]{15,}|gh[pousr]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}"
     r"|xox[abp]-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24,}|hf_[A-Za-z0-9]{25,}"
     r"|glpat-[A-Za-z0-9\-_]{20,}|AIza[0-9A-Za-z\-_]{35}"
     r"|SG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{22,}|s[ck]_(?:live|test)_[0-9A-Za-z]{24,}"
     r"|rk_(?:live|test)_[0-9A-Za-z]{24,}|ya29\.[0-9A-Za-z\-_]{50,}|acct[0-9A-Fa-f]{32}"
     r"|key-[A-Za-z0-9\-_]{20,}|sk-[A-Za-z0-9]{15,})\b"),
    ("hkmo_pass", "港澳通行证", "HK/Macau Exit-Entry Permit", "regex", True, "personal_info",
     "PII_HKMO_PASS", r"(?<![A-Z])(C\d{8})(?!\d)"),
    ("taiwan_pass", "台湾通行证", "Taiwan Travel Permit", "regex", True, "personal_info",
     "PII_TW_PASS", r"(?<![A-Z])(L\d{8})(?!\d)"),
    ("taiwan_id", "台湾身份证", "Taiwan ID", "regex", True, "personal_info", "PII_TW_ID",
     r"(?<![A-Z0-9])([A-Z][12]\d{8})(?![0-9])"),
    ("org_code", "组织机构代码", "Organization Code", "regex", True, "important_data",
     "PII_ORG_CODE", r"(?<![A-Z0-9])([0-9A-HJ-NPQRTUWXY]{8}-[0-9A-HJ-NPQRTUWXY])(?![A-Z0-9])"),
    ("hkmo_resident", "港澳台居民居住证", "HK/Macau/Taiwan Resident Permit", "regex", False,
     "personal_info", "PII_HKMO_RESIDENT", r"(?<!\d)(8[1-3]\d{16})(?!\d)"),
    ("military_id", "军官证", "Military Officer ID", "regex", False, "personal_info",
     "PII_MILITARY_ID", r"(?<![A-Za-z0-9])(军字第?\d{6,8}号?)(?!\d)"),
    ("person", "人名", "Person Name", "ner", False, "personal_info", "PII_PER", None),
    ("location", "地名", "Location", "ner", False, "personal_info", "PII_LOC", None),
    ("organization", "机构名", "Organization", "ner", False, "personal_info", "PII_ORG", None),
    ("custom", "自定义敏感词", "Custom Keyword", "custom", True, "personal_info", "PII_CUST", None),
]

# Fixed values -- order in which catalog rules apply; other keys follow by name.
RULE_ORDER = [
    "phone", "email", "credit_code", "idcard", "bankcard", "plate", "coordinates", "ip", "url",
    "date", "api_key", "amount", "postcode", "passport", "ssn", "mac", "hkmo_pass",
    "taiwan_pass", "taiwan_id", "org_code", "hkmo_resident", "military_id",
]

# Fixed values -- keys known when no catalog file can be read, and the shorter plate rule used then.
FALLBACK_KEYS = [
    "phone", "email", "idcard", "bankcard", "plate", "coordinates", "ip", "url", "date",
    "amount", "postcode", "passport", "ssn", "credit_code", "mac", "api_key", "person",
    "location", "organization", "custom",
]
FALLBACK_PLATE = (
    "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5}"
)

# Fixed values -- patterns of the entity stage, which runs before the catalog rules.
ENTITY_STAGE = [
    ("phone", r"(?<!\d)(1[3-9]\d{9})(?!\d)"),
    ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("idcard",
     r"(?<!\d)([1-9]\d{5}(18|19|20)\d{2}(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])\d{3}[\dXx])(?!\d)"),
    ("bankcard", r"(?<!\d)(\d{16}|\d{19})(?!\d)"),
    ("plate",
     "[京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼使领][A-Z][A-Z0-9]{5}"),
    ("ip", r"(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"),
    ("url", r"https?://[^\s]+"),
    ("date", r"\d{4}[-/年](?:0?[1-9]|1[0-2])[-/月](?:0?[1-9]|[12]\d|3[01])日?"),
    ("amount", r"(?:¥|￥|\$)\d{1,3}(?:,\d{3})*(?:\.\d{1,2})?"),
    ("postcode", r"(?<!\d)([1-9]\d{5})(?!\d)"),
    ("api_key",
     r"\b(?:sk-(?:proj-|ant-)?[A-Za-z0-9]{15,}|gh[pousr]_[A-Za-z0-9]{36,}|AKIA[0-9A-Z]{16}"
     r"|xox[abp]-[0-9]{10,13}-[0-9]{10,13}-[A-Za-z0-9]{24,}|hf_[A-Za-z0-9]{25,}"
     r"|glpat-[A-Za-z0-9\-_]{20,}|AIza[0-9A-Za-z\-_]{35}"
     r"|SG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{22,}|s[ck]_(?:live|test)_[0-9A-Za-z]{24,}"
     r"|rk_(?:live|test)_[0-9A-Za-z]{24,}|ya29\.[0-9A-Za-z\-_]{50,}|acct[0-9A-Fa-f]{32}"
     r"|key-[A-Za-z0-9\-_]{20,})\b"),
]

# Fixed values -- Chinese name, place and organisation word lists.
SURNAMES = (
    "赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦尤许何吕施张孔曹严华金魏陶姜戚谢邹喻柏水窦章"
    "云苏潘葛奚范彭郎鲁韦昌马苗凤花方俞任袁柳酆鲍史唐费廉岑薛雷贺倪汤滕殷罗毕郝邬安常"
    "乐于时傅皮卞齐康伍余元卜顾孟平黄和穆萧尹"
)
COMPOUND_SURNAMES = (
    "欧阳 司马 上官 诸葛 东方 西门 南宫 轩辕 令狐 皇甫 宇文 长孙 慕容 公孙 尉迟 夏侯 "
    "司徒 司空 端木 呼延 钟离 百里 东郭 羊舌 宗政 濮阳 独孤 鲜于 闾丘 太史 万俟 闻人"
).split()
PLACE_FRAGMENTS = "北京 上海 天津 重庆 省 市 区 县 路 街".split()
COMMON_WORDS = (
    "安全 任何 因为 所以 包含 没有 文本 普通 信息 通过 进行 什么 这个 那个 应该 可以 就是 "
    "还是 但是 然后 以及 关于 对于 由于 根据 按照 经过 其他 一些 这样 那样 等等 我们 你们 "
    "他们 自己 已经 正在 如果 虽然"
).split()
PROVINCES = (
    "北京 天津 河北 山西 内蒙古 辽宁 吉林 黑龙江 上海 江苏 浙江 安徽 福建 江西 山东 河南 "
    "湖北 湖南 广东 广西 海南 重庆 四川 贵州 云南 西藏 陕西 甘肃 青海 宁夏 新疆 香港 澳门 台湾"
).split()
PLACE_SUFFIX_CHARS = "市区县镇乡村路巷省"
ORG_SUFFIXES = (
    "股份有限公司 有限责任公司 有限公司 集团公司 公司 集团 银行 大学 学院 医院 研究院 研究所 "
    "事务所 中心 协会 委员会 基金会 合作社 学校 出版社 电视台 证券 保险"
).split()
DIRECTION_CHARS = "东西南北中上下左右前后"

# Fixed values -- second rule pack: (type, pattern, left and right text around the placeholder).
ALT_PACK = [
    ("PHONE", r"(?<!\d)1[3-9]\d{9}(?!\d)", ""),
    ("EMAIL", r"[\w._%+-]+@[\w.-]+\.[a-zA-Z]{2,}", ""),
    ("IDCARD",
     r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)", ""),
    ("BANKCARD", r"(?<!\d)\d{16,19}(?!\d)", ""),
    ("APIKEY", r"sk-[A-Za-z0-9]{20,}(?![A-Za-z0-9])", ""),
    ("APIKEY", r"sk-ant-[A-Za-z0-9]{20,}(?![A-Za-z0-9])", ""),
    ("TOKEN", r'(?i)"bearer\s+[A-Za-z0-9._-]{8,}"', '"'),
    ("IP", r"(?<!\d)\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d)", ""),
    ("PHONE", r"(?<!\d)0\d{2,3}-?\d{7,8}(?!\d)", ""),
]

# Fixed values -- labels and patterns of the detection summary.
SUMMARY_RULES = [
    ("手机号", r"1[3-9][0-9]{9}"),
    ("邮箱", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
    ("身份证",
     r"[1-9][0-9]{5}(18|19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]"),
    ("银行卡", "(?<![A-Za-z0-9_])([1-9][0-9]{15,18})(?![A-Za-z0-9_])"),
]

# Fixed values -- compliance grades, lowest first.
COMPLIANCE_RANK = {"personal_info": 1, "important_data": 2, "core_data": 3}

# Fixed values -- host suffixes and URL paths of hosted model services.
AI_HOSTS = [
    "openai.com", "api.openai.com", "chat.openai.com", "anthropic.com", "api.anthropic.com",
    "deepseek.com", "api.deepseek.com", "chat.deepseek.com", "moonshot.cn", "api.moonshot.cn",
    "kimi.moonshot.cn", "x.ai", "api.x.ai", "grok.x.ai", "doubao.com", "api.doubao.com",
    "yuanbao.com", "api.yuanbao.com", "coze.cn", "api.coze.cn", "coze.com", "api.coze.com",
    "generativelanguage.googleapis.com", "aiplatform.googleapis.com", "openai.azure.com",
    "api.together.xyz", "api.mistral.ai", "api.perplexity.ai", "api.groq.com",
]
AI_PATHS = [
    "/chat/completions", "/v1/completions", "/v1/embeddings", "/v1/messages",
    "/v1/chat/completions",
]

# Fixed values -- counter columns of the statistics table.
STATS_COLUMNS = [
    "phone", "email", "idcard", "bankcard", "custom", "person", "location", "org", "plate", "ip",
    "url", "date", "amount", "postcode", "coordinates", "passport", "ssn", "credit_code", "mac",
    "api_key", "hkmo_pass", "taiwan_pass", "taiwan_id", "org_code", "hkmo_resident",
    "military_id",
]
# Fixed values -- types summed in the history summary and on the team board.
SUMMARY_COLUMNS = [
    "phone", "email", "idcard", "bankcard", "custom", "person", "location", "org", "plate", "ip",
    "url", "date", "amount", "postcode",
]
BOARD_COLUMNS = [c for c in SUMMARY_COLUMNS if c != "custom"]

# Fixed values -- limits.
MAX_TEXT_CHARS = 102400
MAX_KEYWORD_CHARS = 200
MAX_RULE_NAME_CHARS = 100
MAX_TEAM_CHARS = 128
LATENCY_BUCKETS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, float("inf")]
RETENTION_DAYS = {"enterprise": 3650, "team": 90, "free": 7}
FAILURES_TO_UNHEALTHY = 3
FAILURES_TO_LOCK = 5
LOCK_MINUTES = 15
