"""Pages and conversations: admission of pages, titles, links, messages, and their assembly to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import WS, trim

# Patterns of page admission, titles and links.
CHALLENGE = "(?i)just a moment|attention required|cf-browser-verification|cf_chl|challenge-platform|enable javascript and cookies|checking your browser|verify you are human|安全验证|访问验证|人机验证"
LOGIN_TITLE = rf"(?i)^[{WS}]*(登录|login)[{WS}|·-]"
LOGIN_TEXT = "(?i)请登录|登录后查看|扫码登录|sign in to continue"
EMBEDDED = "(?i)application/json|__NEXT_DATA__|__INITIAL_STATE__|js-initialData"
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
OG_TITLE = r'(?i)<meta[^>]+property="og:title"[^>]+content="([^"]*)"'
TITLE_TAIL = rf"(?i)[{WS}]*[-|·][{WS}]*(ChatGPT|DeepSeek|Kimi|豆包|腾讯元宝|元宝|文心一言|通义千问|分享对话|Share)[^\n]*\z"
SCRIPT, STYLE, TAG = "(?is)<script.*?</script>", "(?is)<style.*?</style>", "<[^>]+>"
LINK = rf"https?://[^{WS}，,；;]+|www[.][^{WS}，,；;]+"
URL_START = r"(?i)^https?://|^www[.][a-z0-9-]+[.][a-z]{2,}|^[a-z0-9-]+([.][a-z0-9-]+)+/"
NOISE = r"[。，；！？、,.;:!?\x22'“”’‘]+\z"
#: Platforms and their hosts.
HOSTS = [
    ("chatgpt", "chatgpt.com"), ("chatgpt", "chat.openai.com"), ("deepseek", "chat.deepseek.com"), ("kimi", "kimi.moonshot.cn"), ("kimi", "kimi.com"), ("doubao", "doubao.com"), ("yuanbao", "yuanbao.tencent.com"),
    ("yiyan", "yiyan.baidu.com"), ("tongyi", "tongyi.aliyun.com"), ("tongyi", "www.tongyi.com"),
]


def visible(html: Column) -> Column:
    """The text without scripts, styles, tags and blanks."""
    for p in (SCRIPT, STYLE, TAG):
        html = F.regexp_replace(html, p, " ")
    return F.regexp_replace(html, f"[{WS}]+", "")


def page_quality(pages: DataFrame) -> DataFrame:
    """Rows (page_id, verdict): challenge, login, shell or ok, in this order."""
    rows = pages.select("page_id", "html", F.left("html", F.lit(6000)).alias("head"), F.length(visible(F.col("html"))).alias("n"))
    rows = rows.withColumn("title", trim(F.regexp_extract("head", TITLE, 1)))
    challenge = F.col("title").rlike(CHALLENGE) | (F.col("head").rlike(CHALLENGE) & (F.length("html") < 200_000) & (F.col("n") < 1500))
    login = F.col("title").rlike(LOGIN_TITLE) | (F.col("head").rlike(LOGIN_TEXT) & (F.col("n") < 1200))
    return rows.select("page_id", F.when(challenge, "challenge").when(login, "login").when((F.col("n") < 200) & ~F.col("html").rlike(EMBEDDED), "shell").otherwise("ok").alias("verdict"))


def titles(pages: DataFrame) -> DataFrame:
    raw = F.coalesce(F.nullif(F.regexp_extract("html", OG_TITLE, 1), F.lit("")), F.regexp_extract("html", TITLE, 1))
    return pages.select("page_id", F.left(F.regexp_replace(trim(raw), TITLE_TAIL, ""), F.lit(120)).alias("title"))


def platforms(urls: DataFrame, hosts: DataFrame) -> DataFrame:
    """Platform of each URL by its host or a parent of it; hosts: platform, host. The host's suffixes meet the list in an equi-join."""
    host = F.lower(F.regexp_extract("url", "(?i)^(?:https?://)?([^/?#:]+)", 1))
    labels = F.split(host, "[.]", -1)
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    wide = urls.select("id", F.explode(suffix).alias("host"))
    return wide.join(F.broadcast(hosts), "host").groupBy("id").agg(F.min("platform").alias("platform"))


def links(texts: DataFrame) -> DataFrame:
    """Links in pasted text: tokens between blanks, commas and semicolons, without the punctuation around them. Rows (id, place, url)."""
    rows = texts.select("id", F.posexplode(F.split("text", f"[{WS}，,；;]+", -1)).alias("place", "token"))
    inner = F.regexp_extract("token", f"({LINK})", 1)
    url = F.regexp_replace(F.when(inner != "", inner).otherwise(F.col("token")), NOISE, "")
    return rows.select("id", "place", url.alias("url")).where(F.col("url").rlike(URL_START))


def role(x: Column) -> Column:
    """user, assistant, unknown, or null for messages to drop."""
    r = F.lower(x)
    return F.when(r.isin("user", "human"), "user").when(r.isin("assistant", "ai", "bot", "model"), "assistant").when(r.isin("system", "tool", "function"), F.lit(None).cast("string")).otherwise("unknown")


def merge_adjacent(messages: DataFrame) -> DataFrame:
    """Neighbouring messages of one role as one, joined by a blank line: conv_id, part, role, turns, content."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumn("new", F.coalesce(F.lag("role").over(w) != F.col("role"), F.lit(True)).cast("int")).withColumn("part", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text), "\n\n")
    return rows.groupBy("conv_id", "part", "role").agg(F.count("*").alias("turns"), text.alias("content"))


def demote(x: Column, levels: int) -> Column:
    """Headings ``levels`` further down, level 6 at most, on every line."""
    for n in range(6, 0, -1):
        x = F.regexp_replace(x, rf"(?m)^#{{{n}}}([{WS}])", "\x01" * min(6, n + levels) + "$1")
    return F.replace(x, F.lit("\x01"), F.lit("#"))


def ordered_text(part: str, order: str, glue: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, part))), lambda s: s[part]), glue)


def dialogue(messages: DataFrame, users: bool = True) -> DataFrame:
    """All messages under role headings, their own headings two levels further down."""
    label = F.when(F.col("role") == "user", "User").when(F.col("role") == "assistant", "AI").otherwise("Message")
    rows = messages if users else messages.where("role <> 'user'")
    rows = rows.select("conv_id", "turn", F.concat(F.lit("### "), label, F.lit("\n\n"), demote(trim(F.col("text")), 2)).alias("part"))
    return rows.groupBy("conv_id").agg(ordered_text("part", "turn", "\n\n").alias("markdown"))


def article(messages: DataFrame) -> DataFrame:
    """The assistant's messages alone; those with a top heading one level further down."""
    body = trim(F.col("text"))
    rows = messages.where("role = 'assistant'").select("conv_id", "turn", F.when(body.rlike(rf"(?m)^#[{WS}]"), demote(body, 1)).otherwise(body).alias("part")).where("part <> ''")
    return rows.groupBy("conv_id").agg(ordered_text("part", "turn", "\n\n").alias("markdown"))


def question_answer(messages: DataFrame) -> DataFrame:
    """The first question and the first answer."""
    first = lambda r: F.min_by(F.when(F.col("role") == r, trim(F.col("text"))), F.when(F.col("role") == r, F.col("turn")))
    rows = messages.groupBy("conv_id").agg(first("user").alias("q"), first("assistant").alias("a"))
    return rows.select("conv_id", F.concat_ws("\n\n", F.concat(F.lit("## Question\n\n"), "q"), F.concat(F.lit("## Answer\n\n"), demote(F.col("a"), 1))).alias("markdown"))


def conversation_markdown(messages: DataFrame, titles: DataFrame) -> DataFrame:
    """Title, source note and numbered messages; titles: conv_id, title (blank: a default)."""
    icon = F.when(F.col("role") == "user", "### User").when(F.col("role") == "assistant", "### AI").otherwise("### Message")
    rows = messages.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    rows = rows.select("conv_id", "turn", F.concat(icon, F.lit(" ("), F.col("n").cast("string"), F.lit(")\n\n"), trim(F.col("text"))).alias("part"))
    body = rows.groupBy("conv_id").agg(ordered_text("part", "turn", "\n\n").alias("body"))
    head = F.coalesce(F.nullif("title", F.lit("")), F.lit("Conversation"))
    return body.join(titles, "conv_id").select("conv_id", F.concat(F.lit("# "), head, F.lit("\n\n> Source: shared link, imported 2024-01-31\n\n"), "body").alias("markdown"))


def last_answer(messages: DataFrame) -> DataFrame:
    """The last answer of each conversation and the question before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("question", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w)).where("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("question", "turn").alias("question"))


def sources(rows: DataFrame, limit: int = 50) -> DataFrame:
    """Distinct http(s) links of each conversation in order of first sight, the first text winning; numbered, ``limit`` at most.
    rows: conv_id, place, url, text."""
    first = rows.where(F.col("url").rlike("(?i)^https?:")).groupBy("conv_id", "url").agg(F.min(F.struct("place", "text")).alias("s"))
    numbered = first.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("s.place", "url"))).where(F.col("n") <= limit)
    return numbered.select("conv_id", "n", F.concat(F.lit("["), F.coalesce(F.nullif("s.text", F.lit("")), "url"), F.lit("]("), "url", F.lit(")")).alias("link"))
