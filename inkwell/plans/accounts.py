"""Queries over the account tables and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import accounts as A
from ..sources import tables as S

#: Roles and the permissions they hold; the super role holds all.
PERMISSIONS = ["users.read", "users.write", "histories.read", "stats.read", "logs.read", "config.write"]
ROLES = {"ops": ["stats.read", "logs.read"], "support": ["users.read", "histories.read"]}
#: Actions and the permission each needs.
ACTIONS = {"users.list": "users.read", "users.disable": "users.write", "stats.view": "stats.read", "config.set": "config.write"}
#: Configuration rows, values as JSON text.
CONFIG = {"anon_limit": "1", "ip_daily_limit": "3", "user_limit": "100", "unlimited": "false", "banner": '"hello"'}


def values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({names})"


def dashboard_stats(spark, sf):
    return A.dashboard(S.profiles(spark, sf), S.usage_logs(spark, sf), S.histories(spark, sf), S.AS_OF)


def usage_daily(spark, sf):
    return A.usage_daily(S.usage_logs(spark, sf), S.AS_OF)


def history_cap10(spark, sf):
    return A.newest_per_class(S.histories(spark, sf)).select("id", "user_id", "is_draft", "rn")


def export_bundle(spark, sf):
    return A.export_bundle(S.profiles(spark, sf), S.histories(spark, sf))


def role_permissions(spark, sf):
    """Role to permissions (the super role by a cross join), and which accounts may do which action."""
    perms = spark.createDataFrame([(p,) for p in PERMISSIONS], "permission string")
    held = spark.createDataFrame([(r, p) for r, ps in ROLES.items() for p in ps], "role string, permission string")
    held = held.unionByName(spark.createDataFrame([("super",)], "role string").crossJoin(perms))
    actions = spark.createDataFrame(list(ACTIONS.items()), "action string, permission string")
    may = held.join(F.broadcast(actions), "permission").select("role", "action")
    return S.profiles(spark, sf).where("status = 'active'").join(F.broadcast(may), "role").select("id", "role", "action")


def config_map(spark, sf):
    rows = spark.createDataFrame(list(CONFIG.items()), "key string, value string")
    config = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("c"))
    number = lambda k, d: F.coalesce(F.expr(f"try_cast(c['{k}'] AS bigint)"), F.lit(d))
    return config.select(number("anon_limit", 1).alias("anon_limit"), number("ip_daily_limit", 3).alias("ip_daily_limit"), number("user_limit", 100).alias("user_limit"), number("banner", -1).alias("banner"), (F.col("c")["unlimited"] == "true").alias("unlimited"))


def rls_own_rows(spark, sf):
    sessions = S.login_logs(spark, sf).where("success AND user_id % 2 = 1")
    return A.visible_rows(S.histories(spark, sf), sessions, 7).select("id", "user_id", "title")


def paged_users(spark, sf, page: int = 2, size: int = 20, query: str | None = "0000001", status: str | None = "active"):
    rows = S.profiles(spark, sf)
    if query:
        rows = rows.where(F.col("email").ilike(f"%{query}%"))
    if status:
        rows = rows.where(F.col("status") == status)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total)).select("id", "email", F.coalesce("verified", F.lit(False)).alias("verified"), "total")


#: How many seconds of the events' time count as one of the sign-ins': events are hours apart.
SLOWER = 360


def login_lockout(spark, sf):
    """The rule of five failures in a quarter of an hour."""
    quicker = F.timestamp_micros(F.floor(F.unix_micros(F.col("created_at").cast("timestamp")) / SLOWER).cast("long"))
    return A.lockouts(S.login_logs(spark, sf).withColumn("created_at", quicker)).select("id", "user_id", "failures")


def ip_daily_quota(spark, sf):
    rows = S.usage_logs(spark, sf).where("kind = 'anon'").withColumn("day", F.to_date("created_at"))
    rows = A.ordinal_limit(rows, ["ip", "day"], ["created_at", "id"], 3, "of_day")
    rows = A.ordinal_limit(rows, ["device_id"], ["created_at", "id"], 1, "of_device")
    return rows.select("id", "ip", "device_id", "of_day", "of_device", (F.col("of_day_allowed") & F.col("of_device_allowed")).alias("allowed"))


def signup_limit(spark, sf):
    """Attempts count whether or not they succeed."""
    rows = S.read(spark, sf, "events").where("event_type = 'signup'").select(F.col("event_id").alias("id"), (F.col("event_id") % 25).alias("ip"), F.col("ts").alias("created_at"), F.to_date("ts").alias("day"))
    return A.ordinal_limit(rows, ["ip", "day"], ["created_at", "id"], 5).select("id", "ip", "n", F.col("n_allowed").alias("allowed"))


#: Days after the last day of the data that a clean-up runs.
CLEANUP = 80


def retention_keep(spark, sf):
    """Rows that a clean-up keeps, by table: saves for 365 days, logs for 90, devices for 180 since they were last seen."""
    now = A.ts(S.AS_OF) + F.expr(f"INTERVAL '{CLEANUP}' DAY")
    kept = lambda rows, at, days, tab: rows.agg(F.count_if(F.col(at) >= now - F.expr(f"INTERVAL '{days}' DAY")).alias("kept"), F.count("*").alias("n")).select(F.lit(tab).alias("tab"), "kept", "n")
    usage = S.usage_logs(spark, sf)
    devices = usage.where("device_id IS NOT NULL").groupBy("device_id").agg(F.max("created_at").alias("last_seen"))
    return kept(S.histories(spark, sf), "created_at", 365, "histories").unionByName(kept(usage, "created_at", 90, "usage_logs")).unionByName(kept(devices, "last_seen", 180, "devices"))


def upsert_devices(spark, sf):
    rows = S.usage_logs(spark, sf).where("device_id IS NOT NULL")
    half = A.ts("2024-01-16 00:00:00")
    side = lambda x: x.groupBy("device_id").agg(F.count("*").alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))
    return A.merge_counts(side(rows.where(F.col("created_at") < half)), side(rows.where((F.col("created_at") >= half) & (F.col("device_id") % 4 != 0))), "device_id")


def salted_hash(spark, sf):
    digest = lambda c: F.sha2(F.concat(F.lit("pepper:"), F.lower(c)), 256)
    return S.profiles(spark, sf).select("id", digest("email").alias("email_hash"), F.left(digest(F.col("id").cast("string")), F.lit(32)).alias("short_hash"))


def check_constraints(spark, sf):
    """Data-quality rules: rows of each table that break one."""
    p = S.profiles(spark, sf).select(F.lit("profile_status").alias("rule"), (~F.col("status").isin("active", "disabled", "deleted")).alias("bad"))
    h = S.histories(spark, sf).select(F.lit("history_total").alias("rule"), (F.col("total") < 1000).alias("bad"))
    u = S.usage_logs(spark, sf).select(F.lit("usage_owner").alias("rule"), (F.col("user_id").isNull() == F.col("device_id").isNull()).alias("bad"))
    return p.unionByName(h).unionByName(u).groupBy("rule").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))


def immutable_guard(spark, sf):
    """Updates of accounts that would change the status: rejected."""
    old = S.profiles(spark, sf)
    new = old.select(F.col("id").alias("nid"), F.when(F.col("id") % 7 == 0, "deleted").otherwise(F.col("status")).alias("new_status"))
    return old.join(new, F.col("id") == F.col("nid")).where("status <> new_status").select("id", "status", "new_status")


def dedupe_saves(spark, sf):
    return A.changed_saves(S.histories(spark, sf)).select("id", "user_id", "title")


def newest_save(spark, sf):
    """The newest save of each account."""
    return S.histories(spark, sf).groupBy("user_id").agg(F.max_by("id", F.struct("created_at", "id")).alias("id"), F.max("created_at").alias("created_at"))


def stats_csv(spark, sf):
    d = A.usage_daily(S.usage_logs(spark, sf), S.AS_OF)
    return d.select(F.concat_ws(",", F.date_format("day", "yyyy-MM-dd"), *(F.col(c).cast("string") for c in ("anon", "user", "docx", "pdf"))).alias("line"))


def outcome_merge(spark, sf):
    """Requested URLs with their result, or a failure; a partial retry replaces the results it has."""
    pages = S.read(spark, sf, "pages").select("page_id", "url")
    first = pages.where("page_id % 5 <> 0").select("page_id", F.lit("ok").alias("first"))
    retry = pages.where("page_id % 10 = 0").select("page_id", F.lit("ok on retry").alias("retry"))
    joined = pages.join(first, "page_id", "left").join(retry, "page_id", "left")
    return joined.select("page_id", F.coalesce("retry", "first", F.lit("failed")).alias("outcome"))


def outcome_counts(spark, sf):
    return outcome_merge(spark, sf).agg(F.count_if(F.col("outcome") != "failed").alias("ok"), F.count_if(F.col("outcome") == "failed").alias("failed"))


def fk_cleanup(spark, sf):
    """After accounts with id % 9 = 0 are gone: their documents go too, their log rows lose the account."""
    alive = S.profiles(spark, sf).where("id % 9 <> 0").select(F.col("id").alias("user_id"))
    h = S.histories(spark, sf).join(alive, "user_id", "left_semi").agg(F.count("*").alias("n")).select(F.lit("histories").alias("tab"), "n")
    known = alive.withColumn("here", F.lit(True))
    u = S.usage_logs(spark, sf).join(known, "user_id", "left").agg(F.count_if(F.col("here").isNull()).alias("n")).select(F.lit("usage_without_user").alias("tab"), "n")
    return h.unionByName(u)


def login_sessions(spark, sf):
    return A.sessions(S.login_logs(spark, sf))


def password_rules(spark, sf):
    """Password and address checks over derived candidates."""
    p = S.profiles(spark, sf).select("id", "email", F.concat(F.when(F.col("id") % 3 == 0, "pass").otherwise("1234567"), F.col("id").cast("string")).alias("password"))
    n = F.length("password")
    both = F.col("password").rlike("[A-Za-z]") & F.col("password").rlike("[0-9]")
    return p.select("id", ((n >= 8) & (n <= 72) & both).alias("user_ok"), ((n >= 12) & (n <= 72) & both).alias("admin_ok"), (F.col("email").rlike(r"^[^@ ]+@[^@ ]+\.[^@ ]+\z") & (F.length("email") <= 254)).alias("email_ok"))


def event_ring(spark, sf, keep: int = 50):
    """The last 50 events, newest first, numbered (a top-k report)."""
    rows = S.usage_logs(spark, sf).orderBy(F.desc("created_at"), F.desc("id")).limit(keep)
    return rows.select("id", "format", F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("id"))).alias("place"))


def time_label(spark, sf):
    return S.usage_logs(spark, sf).select("id", F.date_format("created_at", "M-dd HH:mm").alias("label"))


def quota_cache(spark, sf):
    """Remaining quota: the smaller of what server and client know; unknown to both: none."""
    used = S.usage_logs(spark, sf).where("kind = 'user'").groupBy("user_id").agg(F.count("*").alias("used"))
    local = S.profiles(spark, sf).select(F.col("id").alias("user_id"), F.when(F.col("id") % 6 != 0, F.col("id") % 90).alias("local"))
    return local.join(used, "user_id", "left").select("user_id", F.greatest(F.coalesce(F.least(100 - F.col("used"), "local"), F.lit(0)), F.lit(0)).alias("remaining"))


#: User agents.
AGENTS = [
    (0, "Mozilla/5.0 (Windows NT 10.0; Win64; x64) Chrome/120.0 Safari/537.36 Edg/120.0"), (1, "Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Firefox/121.0"),
    (2, "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15) Version/17.0 Safari/605.1"), (3, "Mozilla/5.0 (Linux; Android 14) Chrome/120.0 Mobile Safari/537.36"),
    (4, "Mozilla/5.0 (Windows NT 6.1) Chrome/90.0 OPR/76.0"), (5, "curl/8.0"),
]


def ua_classify(spark, sf):
    rows = spark.createDataFrame(AGENTS, "n long, ua string")
    browser, system = F, F
    for name, part in (("Edge", "Edg/"), ("Opera", "OPR/"), ("Firefox", "Firefox/"), ("Chrome", "Chrome/"), ("Safari", "Safari/")):
        browser = browser.when(F.col("ua").contains(part), name)
    for name, part in (("Windows 10/11", "Windows NT 10"), ("Windows", "Windows"), ("macOS", "Mac OS X"), ("Android", "Android"), ("iOS", "iPhone"), ("iOS", "iPad"), ("Linux", "Linux")):
        system = system.when(F.col("ua").contains(part), name)
    e = S.read(spark, sf, "events").select((F.col("event_id") % 6).alias("n"))
    return e.join(F.broadcast(rows), "n").select(browser.otherwise("unknown").alias("browser"), system.otherwise("unknown").alias("os")).groupBy("browser", "os").agg(F.count("*").alias("n"))


def fetch_rules(spark, sf):
    """Admission of page fetches: scheme, host, size and a redirect count as rule columns."""
    p = S.read(spark, sf, "pages").select("page_id", "url", F.octet_length("html").alias("size"), (F.col("page_id") % 8).alias("hops"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return p.select("page_id", F.when(~F.col("url").startswith("https://"), "not https").when(~(host.endswith(".example.org") | host.endswith(".example.com")), "host").when(F.col("hops") > 5, "redirects").when(F.col("size") > 20000, "too large").otherwise("ok").alias("verdict"))


QUERIES = {f.__name__: f for f in (
    dashboard_stats, usage_daily, history_cap10, export_bundle, role_permissions, config_map, rls_own_rows, paged_users, login_lockout, ip_daily_quota, signup_limit, retention_keep, upsert_devices, salted_hash,
    check_constraints, immutable_guard, dedupe_saves, newest_save, stats_csv, outcome_merge, outcome_counts, fk_cleanup, login_sessions, password_rules, event_ring, time_label, quota_cache, ua_classify, fetch_rules,
)}

NOW = f"TIMESTAMP '{S.AS_OF}'"
DAILY = f"""SELECT CAST(date_trunc('day', created_at) AS DATE) AS day, count(*) FILTER (WHERE kind = 'anon') AS anon, count(*) FILTER (WHERE kind = 'user') AS "user",
  count(*) FILTER (WHERE format = 'docx') AS docx, count(*) FILTER (WHERE format = 'pdf') AS pdf FROM usage_logs WHERE created_at >= {NOW} - INTERVAL 30 DAY GROUP BY 1"""
HELD = f"""held AS (SELECT * FROM {values([(r, p) for r, ps in ROLES.items() for p in ps] + [("super", p) for p in PERMISSIONS], "role, permission")}),
  actions AS (SELECT * FROM {values(list(ACTIONS.items()), "action, permission")})"""
PAGES_OUT = "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'ok on retry' WHEN page_id % 5 <> 0 THEN 'ok' ELSE 'failed' END AS outcome FROM pages"

ORACLES = {
    "dashboard_stats": f"""WITH {S.PROFILES_SQL}, {S.USAGE_SQL}, {S.HISTORIES_SQL},
      p AS (SELECT count(*) FILTER (WHERE status = 'active') AS users_total, count(*) FILTER (WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS users_new_7d, count(*) FILTER (WHERE NOT verified) AS users_unverified, count(*) FILTER (WHERE status = 'disabled') AS users_disabled FROM profiles),
      u AS (SELECT count(*) FILTER (WHERE kind = 'anon') AS exports_anon, count(*) FILTER (WHERE kind = 'user') AS exports_user FROM usage_logs)
      SELECT p.*, u.*, (SELECT count(*) FROM histories) AS histories_total, round(1000.0 * exports_user / nullif(exports_anon + exports_user, 0)) / 10 AS conversion FROM p, u""",
    "usage_daily": f"WITH {S.USAGE_SQL} {DAILY}",
    "history_cap10": f"WITH {S.HISTORIES_SQL} SELECT * FROM (SELECT id, user_id, is_draft, row_number() OVER (PARTITION BY user_id, is_draft ORDER BY created_at DESC, id DESC) AS rn FROM histories) WHERE rn <= 10",
    "export_bundle": f"""WITH {S.PROFILES_SQL}, {S.HISTORIES_SQL}, g AS (SELECT user_id, string_agg(to_json(struct_pack(id := id, title := title))::VARCHAR, ',' ORDER BY created_at DESC, id) AS l FROM histories GROUP BY 1)
      SELECT p.id, coalesce('[' || g.l || ']', '[]') AS histories FROM profiles p LEFT JOIN g ON g.user_id = p.id""",
    "role_permissions": f"WITH {S.PROFILES_SQL}, {HELD} SELECT p.id, p.role, a.action FROM profiles p JOIN held h ON h.role = p.role JOIN actions a ON a.permission = h.permission WHERE p.status = 'active'",
    "config_map": f"""WITH c AS (SELECT * FROM {values(list(CONFIG.items()), "key, value")}), v AS (SELECT key, try_cast(value AS BIGINT) AS n, value FROM c)
      SELECT coalesce(max(n) FILTER (WHERE key = 'anon_limit'), 1) AS anon_limit, coalesce(max(n) FILTER (WHERE key = 'ip_daily_limit'), 3) AS ip_daily_limit, coalesce(max(n) FILTER (WHERE key = 'user_limit'), 100) AS user_limit, coalesce(max(n) FILTER (WHERE key = 'banner'), -1) AS banner, bool_or(value = 'true') FILTER (WHERE key = 'unlimited') AS unlimited FROM v""",
    "rls_own_rows": f"WITH {S.HISTORIES_SQL}, {S.LOGINS_SQL} SELECT id, user_id, title FROM histories h WHERE user_id = 7 AND EXISTS (SELECT 1 FROM login_logs l WHERE l.user_id = h.user_id AND success AND l.user_id % 2 = 1)",
    "paged_users": f"""WITH {S.PROFILES_SQL}, f AS (SELECT * FROM profiles WHERE email ILIKE '%0000001%' AND status = 'active')
      SELECT id, email, coalesce(verified, false) AS verified, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20""",
    "login_lockout": f"""WITH RECURSIVE {S.LOGINS_SQL}, a AS (SELECT id, user_id, success, epoch_us(created_at) // {SLOWER} AS us, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) // {SLOWER}, id) AS k FROM login_logs),
      r(user_id, k, id, failures, seen) AS (SELECT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM a WHERE k = 1
        UNION ALL SELECT user_id, k, id, n, CASE WHEN NOT success OR n >= 5 THEN list_append(near, us) ELSE near END FROM (SELECT *, len(list_filter(near, lambda t: t < us))::BIGINT AS n FROM (
          SELECT a.*, list_filter(r.seen, lambda t: t >= a.us - 900000000) AS near FROM r JOIN a ON a.user_id = r.user_id AND a.k = r.k + 1)))
      SELECT id, user_id, failures FROM r WHERE failures >= 5""",
    "ip_daily_quota": f"""WITH {S.USAGE_SQL}, n AS (SELECT id, ip, device_id, row_number() OVER (PARTITION BY ip, CAST(created_at AS DATE) ORDER BY created_at, id) AS of_day, row_number() OVER (PARTITION BY device_id ORDER BY created_at, id) AS of_device FROM usage_logs WHERE kind = 'anon')
      SELECT *, of_day <= 3 AND of_device <= 1 AS allowed FROM n""",
    "signup_limit": "WITH n AS (SELECT event_id AS id, event_id % 25 AS ip, row_number() OVER (PARTITION BY event_id % 25, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'signup') SELECT *, n <= 5 AS allowed FROM n",
    "retention_keep": f"""WITH {S.HISTORIES_SQL}, {S.USAGE_SQL}, n AS (SELECT {NOW} + INTERVAL {CLEANUP} DAY AS t)
      SELECT 'histories' AS tab, count(*) FILTER (WHERE created_at >= t - INTERVAL 365 DAY) AS kept, count(*) AS n FROM histories, n
      UNION ALL SELECT 'usage_logs', count(*) FILTER (WHERE created_at >= t - INTERVAL 90 DAY), count(*) FROM usage_logs, n
      UNION ALL SELECT 'devices', count(*) FILTER (WHERE last >= t - INTERVAL 180 DAY), count(*) FROM (SELECT device_id, max(created_at) AS last FROM usage_logs WHERE device_id IS NOT NULL GROUP BY 1), n""",
    "upsert_devices": f"""WITH {S.USAGE_SQL} SELECT device_id, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen FROM usage_logs
      WHERE device_id IS NOT NULL AND (created_at < TIMESTAMP '2024-01-16' OR device_id % 4 <> 0) GROUP BY 1""",
    "salted_hash": f"WITH {S.PROFILES_SQL} SELECT id, sha256('pepper:' || lower(email)) AS email_hash, left(sha256('pepper:' || id), 32) AS short_hash FROM profiles",
    "check_constraints": f"""WITH {S.PROFILES_SQL}, {S.HISTORIES_SQL}, {S.USAGE_SQL} SELECT 'profile_status' AS rule, count(*) FILTER (WHERE status NOT IN ('active', 'disabled', 'deleted')) AS bad, count(*) AS n FROM profiles
      UNION ALL SELECT 'history_total', count(*) FILTER (WHERE total < 1000), count(*) FROM histories
      UNION ALL SELECT 'usage_owner', count(*) FILTER (WHERE (user_id IS NULL) = (device_id IS NULL)), count(*) FROM usage_logs""",
    "immutable_guard": f"WITH {S.PROFILES_SQL} SELECT id, status, 'deleted' AS new_status FROM profiles WHERE id % 7 = 0",
    "dedupe_saves": f"WITH {S.HISTORIES_SQL}, l AS (SELECT *, lag(title) OVER (PARTITION BY user_id ORDER BY created_at, id) AS b FROM histories) SELECT id, user_id, title FROM l WHERE title IS DISTINCT FROM b",
    "newest_save": f"WITH {S.HISTORIES_SQL}, r AS (SELECT user_id, id, created_at, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS rn FROM histories) SELECT user_id, id, created_at FROM r WHERE rn = 1",
    "stats_csv": f"WITH {S.USAGE_SQL}, d AS ({DAILY}) SELECT strftime(day, '%Y-%m-%d') || ',' || anon || ',' || \"user\" || ',' || docx || ',' || pdf AS line FROM d",
    "outcome_merge": PAGES_OUT,
    "outcome_counts": f"SELECT count(*) FILTER (WHERE outcome <> 'failed') AS ok, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM ({PAGES_OUT})",
    "fk_cleanup": f"""WITH {S.PROFILES_SQL}, {S.HISTORIES_SQL}, {S.USAGE_SQL}, alive AS (SELECT id FROM profiles WHERE id % 9 <> 0)
      SELECT 'histories' AS tab, count(*) AS n FROM histories WHERE user_id IN (SELECT id FROM alive) UNION ALL SELECT 'usage_without_user', count(*) FROM usage_logs u WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.id = u.user_id)""",
    "login_sessions": f"""WITH {S.LOGINS_SQL}, g AS (SELECT *, CASE WHEN created_at <= lag(created_at) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS s FROM login_logs WINDOW w AS (PARTITION BY user_id ORDER BY created_at, id)),
      n AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, min(created_at) AS first_at, max(created_at) AS last_at, count(*) AS n FROM n GROUP BY 1, 2""",
    "password_rules": rf"""WITH {S.PROFILES_SQL}, p AS (SELECT id, email, (CASE WHEN id % 3 = 0 THEN 'pass' ELSE '1234567' END) || id AS password FROM profiles),
      q AS (SELECT *, length(password) AS n, regexp_matches(password, '[A-Za-z]') AND regexp_matches(password, '[0-9]') AS b FROM p)
      SELECT id, n BETWEEN 8 AND 72 AND b AS user_ok, n BETWEEN 12 AND 72 AND b AS admin_ok, regexp_full_match(email, '[^@ ]+@[^@ ]+\.[^@ ]+') AND length(email) <= 254 AS email_ok FROM q""",
    "event_ring": f"WITH {S.USAGE_SQL}, r AS (SELECT id, format, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place FROM usage_logs) SELECT * FROM r WHERE place <= 50",
    "time_label": f"WITH {S.USAGE_SQL} SELECT id, month(created_at) || '-' || strftime(created_at, '%d %H:%M') AS label FROM usage_logs",
    "quota_cache": f"""WITH {S.PROFILES_SQL}, {S.USAGE_SQL}, u AS (SELECT user_id, count(*) AS used FROM usage_logs WHERE kind = 'user' GROUP BY 1)
      SELECT p.id AS user_id, greatest(coalesce(least(100 - u.used, CASE WHEN p.id % 6 <> 0 THEN p.id % 90 END), 0), 0) AS remaining FROM profiles p LEFT JOIN u ON u.user_id = p.id""",
    "ua_classify": f"""WITH a AS (SELECT * FROM {values(AGENTS, "n, ua")}) SELECT
      CASE WHEN contains(ua, 'Edg/') THEN 'Edge' WHEN contains(ua, 'OPR/') THEN 'Opera' WHEN contains(ua, 'Firefox/') THEN 'Firefox' WHEN contains(ua, 'Chrome/') THEN 'Chrome' WHEN contains(ua, 'Safari/') THEN 'Safari' ELSE 'unknown' END AS browser,
      CASE WHEN contains(ua, 'Windows NT 10') THEN 'Windows 10/11' WHEN contains(ua, 'Windows') THEN 'Windows' WHEN contains(ua, 'Mac OS X') THEN 'macOS' WHEN contains(ua, 'Android') THEN 'Android' WHEN contains(ua, 'iPhone') OR contains(ua, 'iPad') THEN 'iOS' WHEN contains(ua, 'Linux') THEN 'Linux' ELSE 'unknown' END AS os,
      count(*) AS n FROM events e JOIN a ON a.n = e.event_id % 6 GROUP BY 1, 2""",
    "fetch_rules": """WITH p AS (SELECT page_id, url, strlen(html) AS size, page_id % 8 AS hops, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)
      SELECT page_id, CASE WHEN NOT starts_with(url, 'https://') THEN 'not https' WHEN NOT (ends_with(host, '.example.org') OR ends_with(host, '.example.com')) THEN 'host' WHEN hops > 5 THEN 'redirects' WHEN size > 20000 THEN 'too large' ELSE 'ok' END AS verdict FROM p""",
}
