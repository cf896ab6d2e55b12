"""Column functions on texts and scores. All are expressions inside the JVM but ``question_key``'s Unicode part."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def rstrip(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"(?U)\s+$", "")


def one_line(c: str | Column) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def clamp(c: str | Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(col(c), F.lit(lo)), F.lit(hi))


def ngrams(c: str | Column, n: int) -> Column:
    """All substrings of ``n`` characters; none for a shorter text. The text is evaluated once, not once a substring."""
    runs = lambda x: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(col(c)), runs), F.lit(0))


def strip_reasoning(c: str | Column) -> Column:
    """Closed reasoning blocks go; an unclosed one takes the rest of the text with it."""
    tag = "(?:redacted_thinking|thinking|think)"
    x = F.regexp_replace(F.coalesce(col(c), F.lit("")), f"(?is)<{tag}>.*?</{tag}>", "")
    return strip(F.regexp_replace(x, f"(?is)<{tag}>.*$", ""))


def extract_json(c: str | Column, schema: str) -> Column:
    """The JSON object in a model's reply as a struct; null if there is none."""
    x = F.regexp_replace(F.regexp_replace(strip_reasoning(c), r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    inner = F.regexp_extract(x, r"(?s)(\{.*\})", 1)
    whole = F.when(strip(x).rlike(r"(?s)^\{.*\}$"), strip(x))
    body = F.coalesce(F.when(F.get_json_object(whole, "$").isNotNull(), whole), F.when(F.get_json_object(inner, "$").isNotNull(), inner))
    return F.when(body.isNotNull(), F.from_json(body, schema))


def clean_rewrite(raw: str | Column, original: str | Column) -> Column:
    """The last non-empty line of a reply without prefix and quotes; ``original`` if that is empty or over 40 characters."""
    x = strip_reasoning(raw)
    for prefix in ("改写后的检索查询：", "检索查询：", "查询："):  # fixed values
        x = F.when(F.startswith(x, F.lit(prefix)), strip(F.substring(x, F.lit(len(prefix) + 1), F.length(x)))).otherwise(x)
    lines = F.filter(F.transform(F.split(x, r"\r\n|\n|\r"), strip), lambda s: s != "")
    last = F.regexp_replace(F.try_element_at(lines, F.lit(-1)), "^[\"'`]+|[\"'`]+$", "")
    return F.when((F.length(last) > 0) & (F.length(last) <= 40), last).otherwise(col(original))


def clean_query(c: str | Column, longest: int = 80) -> Column:
    """One line without quotes, cut."""
    x = F.regexp_replace(one_line(strip_reasoning(c)), "^[ \"'`]+|[ \"'`]+$", "")
    return strip(F.substring(x, 1, longest))


def _nfkc_casefold(s: pd.Series) -> pd.Series:
    import unicodedata

    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).strip().casefold())


def question_key(c: str | Column) -> Column:
    """Key of equal questions: NFKC, case folded, one blank between words, no closing punctuation, 1,000 characters at most."""
    x = F.coalesce(col(c), F.lit(""))
    plain = x.rlike(r"^[\x00-\x7F]*$")
    folded = F.when(plain, F.lower(strip(x))).otherwise(F.pandas_udf(_nfkc_casefold, "string")(F.when(~plain, x)))
    x = F.regexp_replace(folded, r"(?U)\s+", " ")
    return F.substring(F.regexp_replace(x, "[?？!！。．.，,；;：: ]+$", ""), 1, 1000)  # fixed values


#: What is masked in previews of questions.
SECRETS = (r"\bsk-[A-Za-z0-9_-]{8,}\b", r"\bBearer\s+[A-Za-z0-9._-]{8,}\b", r"(?i)(?:password|passwd|密码|api[_ -]?key|token|密钥)\s*[:=：]\s*\S+", r"\b[A-Za-z0-9_-]{40,}\b")
MASK = "[已遮蔽]"


def redact(c: str | Column, longest: int = 200) -> Column:
    """One line with secrets masked, cut at ``longest`` (50 to 300) characters."""
    x = one_line(F.coalesce(col(c), F.lit("")))
    for p in SECRETS:
        x = F.regexp_replace(x, p, MASK)
    return F.substring(x, 1, max(50, min(longest, 300)))


def truncate_note(c: str | Column, n: int = 500) -> Column:
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("...[truncated,"), (F.length(x)).cast("string"), F.lit("]"))).otherwise(x)


def normalize_path(c: str | Column) -> Column:
    """Path segments that are numbers or long hexadecimal names become ``{id}``."""
    parts = F.filter(F.split(col(c), "/"), lambda p: p != "")
    named = F.transform(parts, lambda p: F.when(p.rlike(r"^[0-9a-fA-F-]{32,}$|^[0-9]+$"), F.lit("{id}")).otherwise(p))
    return F.concat(F.lit("/"), F.array_join(named, "/"))


def client_ip(forwarded: str | Column, real: str | Column, peer: str | Column) -> Column:
    first = F.nullif(F.trim(F.get(F.split(col(forwarded), ","), F.lit(0))), F.lit(""))
    return F.substring(F.coalesce(first, F.nullif(F.trim(col(real)), F.lit("")), col(peer)), 1, 64)


def title(c: str | Column, n: int = 50) -> Column:
    x = F.trim(F.regexp_replace(col(c), r"\n", " "))
    return F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit("..."))).otherwise(x)


def normalize_score(c: str | Column) -> Column:
    """A score on 0 to 1: as it is, a little over 1 as 1, percentages divided; anything else -1."""
    x = col(c).cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < 0), -1.0).when(x <= 1, x).when(x <= 1.5, 1.0).when(x <= 100, x / 100).otherwise(-1.0)


def confidence_level(c: str | Column) -> Column:
    x = col(c)
    return F.when(x >= 0.75, "high").when(x >= 0.4, "medium").otherwise("low")


def department(c: str | Column) -> Column:
    return F.nullif(F.upper(F.trim(col(c))), F.lit(""))


def visibility(c: str | Column) -> Column:
    return F.when(department(c) == "GUEST", "public").otherwise("restricted")


def squash(c: str | Column) -> Column:
    """A text rank on 0 to 1: ``1 - exp(-4 rank)``."""
    x = col(c)
    return F.when(x > 0, clamp(1 - F.exp(-4 * x))).otherwise(0.0)


def lexical_coverage(query: str | Column, content: str | Column) -> Column:
    """Share of the query's distinct n-grams (2 if it has CJK characters, else 3) that the content holds; very short queries: held or not."""
    return coverage(coverage_query(query), coverage_text(content))


def coverage_text(c: str | Column) -> Column:
    """What coverage compares: digits, ASCII letters in lower case and CJK characters."""
    return F.regexp_replace(F.lower(col(c)), "[^a-z0-9一-鿿]", "")


def coverage_query(c: str | Column) -> Column:
    """``q, g``: a query's comparable text and its n-grams."""
    q = coverage_text(c)
    grams = F.when(col(c).rlike("[一-鿿]"), F.array_distinct(ngrams(q, 2))).otherwise(F.array_distinct(ngrams(q, 3)))
    return F.struct(q.alias("q"), grams.alias("g"))


def coverage_grams(c: str | Column) -> Column:
    """``c, g2, g3``: a content's comparable text with its distinct runs of two and three characters, prepared once for many queries."""
    t = coverage_text(c)
    return F.struct(t.alias("c"), F.array_distinct(ngrams(t, 2)).alias("g2"), F.array_distinct(ngrams(t, 3)).alias("g3"))


def coverage_prepared(query: Column, grams: Column) -> Column:
    """Coverage from ``coverage_query`` and ``coverage_grams``: a run is in the text if it is among the text's runs of its length."""
    q, g = query["q"], query["g"]
    common = F.when(F.length(g[0]) == 2, F.size(F.array_intersect(g, grams["g2"]))).otherwise(F.size(F.array_intersect(g, grams["g3"])))
    short = F.when(F.instr(grams["c"], q) > 0, 1.0).otherwise(0.0)
    return F.when(F.length(q) == 0, 0.0).when(F.length(q) <= 2, short).otherwise(common / F.size(g))


def coverage(query: Column, text: Column) -> Column:
    """Coverage from prepared sides; each is evaluated once."""
    both = F.array(F.struct(query.alias("q"), text.alias("c")))
    share = lambda s: F.size(F.filter(s["q"]["g"], lambda x: F.instr(s["c"], x) > 0)) / F.size(s["q"]["g"])
    short = lambda s: F.when(F.instr(s["c"], s["q"]["q"]) > 0, 1.0).otherwise(0.0)
    value = lambda s: F.when(F.length(s["q"]["q"]) == 0, 0.0).when(F.length(s["q"]["q"]) <= 2, short(s)).otherwise(share(s))
    return F.get(F.transform(both, value), F.lit(0))


#: Rules of the screen, in order; intent, reason, pattern.
BLOCK_RULES = (
    ("prompt_injection", "prompt_injection", r"(?:忽略|无视|绕过|覆盖).{0,24}(?:系统|开发者|之前|以上|上面).{0,24}(?:指令|提示词|规则)|(?:进入|开启).{0,10}(?:越狱|dan|开发者模式)|jailbreak"),
    ("secret_exfiltration", "system_prompt_extraction", r"(?:输出|显示|打印|泄露|返回|读取|导出).{0,24}(?:系统提示词|system prompt|api[_ -]?key|真实密钥|访问令牌|access token|环境变量|\.env|数据库密码)"),
    ("authorization_bypass", "authorization_bypass", r"(?:绕过|规避|跳过|破解).{0,20}(?:权限|鉴权|角色|部门隔离)|(?:越权|未授权).{0,20}(?:访问|读取|下载)|访问.{0,12}(?:其他部门|其他用户).{0,12}知识库"),
    ("destructive_operation", "destructive_operation", r"(?:删除|清空|销毁|drop|truncate).{0,20}(?:全部|所有|数据库|数据表|用户数据|知识库)|(?:drop\s+table|truncate\s+table)"),
    ("command_execution", "dangerous_command_execution", r"(?:执行|运行|调用).{0,20}(?:rm\s+-rf|反弹\s*shell|reverse\s*shell|powershell\s+-enc|下载并执行|植入后门)|(?:rm\s+-rf\s+/|curl.{0,30}\|\s*(?:sh|bash))"),
)
DEFENSIVE = r"(?:如何|怎么|怎样).{0,8}(?:防止|防御|检测|识别|应对)"
ATTACK = r"(?:现在|立即|请|帮我).{0,8}(?:忽略|绕过|执行|删除|泄露)"
GREETING = r"^(?:你好|您好|嗨|hello|hi|早上好|下午好|晚上好)[！!。.]?$"
LOOKUP = r"(?:哪份|查找|搜索|找到|文档|手册|制度|规定|流程|政策|知识库)"
ADMIN = r"(?:上传|配置|管理|创建知识库|模型设置|切分|向量化)"
INTENTS = ("knowledge_query", "document_lookup", "admin_operation", "greeting", "security_education", *(r[0] for r in BLOCK_RULES), "unknown")
MALICIOUS = tuple(r[0] for r in BLOCK_RULES)


def screen(c: str | Column) -> Column:
    """``allowed, intent, confidence, reason_code, detector`` by the first rule that holds; null if none does."""
    x = strip(F.coalesce(col(c), F.lit("")))
    verdict = lambda allowed, intent, sure, reason: F.struct(F.lit(allowed).alias("allowed"), F.lit(intent).alias("intent"), F.lit(sure).alias("confidence"), F.lit(reason).alias("reason_code"), F.lit("rule").alias("detector"))
    out = F.when(x.rlike(DEFENSIVE) & ~x.rlike(ATTACK), verdict(True, "security_education", 0.95, "defensive_security_query"))
    for intent, reason, pattern in BLOCK_RULES:
        out = out.when(x.rlike("(?iu)" + pattern), verdict(False, intent, 1.0, reason))
    out = out.when((F.length(x) <= 20) & F.lower(x).rlike(GREETING), verdict(True, "greeting", 0.98, "greeting"))
    return out.when(x.rlike(LOOKUP), verdict(True, "document_lookup", 0.85, "knowledge_request")).when(x.rlike(ADMIN), verdict(True, "admin_operation", 0.8, "admin_request"))


def fold_verdict(intent: str | Column, malicious: str | Column, confidence: str | Column, threshold: float = 0.65, fail_open: bool = True) -> Column:
    """A classifier's verdict as ``allowed, intent, confidence``; a missing one lets through or blocks by policy."""
    known = F.when(col(intent).isin(*INTENTS), col(intent)).otherwise("unknown")
    sure = clamp(F.coalesce(col(confidence).cast("double"), F.lit(0.0)))
    block = (F.coalesce(col(malicious), F.lit(False)) | known.isin(*MALICIOUS)) & (sure >= threshold)
    missing = col(intent).isNull() & col(malicious).isNull()
    value = lambda a, i, s: F.struct(a.alias("allowed"), i.alias("intent"), s.alias("confidence"))
    return F.when(missing, value(F.lit(fail_open), F.lit("unknown"), F.lit(0.0))).otherwise(value(~block, known, sure))
