"""Column rules over whole tables: URLs, HTML, dates, salary, language, cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions import dates as dt
from gleaner.functions import html as hm
from gleaner.functions import location as loc
from gleaner.functions import text as tx
from gleaner.functions import urls as ur
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.views import EVENTS_NOW, NOW, Tables, shown, stamp
from gleaner.sources.records import coerce_numbers, flag, number_issues

# ---- urls ----------------------------------------------------------------------------


@query("str_03_url_key", f"SELECT page_id, {s.url_key('url')} AS url_key FROM pages")
def url_keys(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", ur.url_key("url").alias("url_key"))


@query("str_04_link_key", f"SELECT page_id, {s.link_key('url')} AS link FROM pages")
def link_keys(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", ur.link_key("url").alias("link"))


@query("str_16_safe_url", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '#' ELSE url END AS safe, page_id % 3 <> 0 AS http FROM pages""")
def safe_urls(t: Tables) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    return t.table("pages").withColumn("u", u).select("page_id", ur.safe_url("u").alias("safe"), ur.is_http_url("u").alias("http"))


def variants(t: Tables) -> DataFrame:
    """Page urls, and per page one rewritten form that the policy has to judge."""
    host = ur.url_host(F.col("url"))
    forms = [F.col("url"), F.concat(F.lit("https://user:pw@"), host, F.lit("/x")), F.concat(F.lit("https://"), host, F.lit(":8443/x")),
             F.lit("https://127.0.0.1/x"), F.lit("https://db.internal/x"), F.lit("https://localhost./x")]
    return t.table("pages").select("page_id", F.element_at(F.array(*forms), (F.col("page_id") % 6 + 1).cast("int")).alias("url"))


@query("str_17_public_https", """
SELECT page_id, page_id % 6 = 0 AND starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://[^/]*:[0-9]') AS public FROM pages""")
def public(t: Tables) -> DataFrame:
    return variants(t).select("page_id", ur.is_public_https("url").alias("public"))


_V4_PRIVATE = """(a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
  OR (a = 192 AND b = 0 AND c = 0) OR (a = 192 AND b = 168) OR (a = 198 AND b BETWEEN 18 AND 19))"""
_ADDRESSED = f"""SELECT page_id, 'h' || (page_id // 2) || '.' || {s.host('url')} AS host, CASE WHEN page_id % 3 <> 0 THEN 'v4' ELSE CASE page_id % 11 WHEN 0 THEN 'public' WHEN 5 THEN 'public' WHEN 6 THEN 'public' WHEN 9 THEN 'public'
    WHEN 3 THEN 'v4' WHEN 4 THEN 'v4' ELSE 'private' END END AS kind, ((page_id * 7919 + 13) % 256) AS a, ((page_id * 104729) % 256) AS b, page_id % 256 AS c FROM pages WHERE page_id % 7 <> 6"""
_JUDGED = f"SELECT page_id, host, kind = 'private' OR (kind = 'v4' AND {_V4_PRIVATE}) AS private FROM addressed"


def page_addresses(t: Tables) -> DataFrame:
    """(page_id, host, address) for most pages, two pages a host: IPv4, or IPv6 in one of eleven spellings and networks."""
    k = F.col("page_id")
    a, b, c = (k * 7919 + 13) % 256, (k * 104729) % 256, k % 256
    dotted = F.concat_ws(".", *[o.cast("string") for o in (a, b, c, F.lit(1))])
    high, low, own = F.lower(F.hex(a * 256 + b)), F.lower(F.hex(c * 256 + 1)), F.hex(k % 65536)
    forms = [
        F.concat(F.lit("2001:4860:4860::"), own), F.lit("::1"), F.concat(F.lit("fe80::"), own, F.lit("%eth0")),
        F.concat(F.lit("64:ff9b::"), high, F.lit(":"), low), F.concat(F.lit("::FFFF:"), dotted),
        F.concat(F.lit("2606:4700::6810:"), own), F.concat(F.lit("2A00:1450:4001:0830:0000:0:0:"), own), F.concat(F.lit("FD00:"), own, F.lit("::1")),
        F.lit("1:2:3"), F.concat(F.lit("::2:"), own), F.concat(F.lit("2002:"), high, F.lit(":"), low, F.lit("::")),
    ]
    six = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    host = F.concat(F.lit("h"), F.floor(k / 2).cast("string"), F.lit("."), ur.url_host("url"))
    return t.table("pages").filter("page_id % 7 <> 6").select("page_id", host.alias("host"), F.when(k % 3 == 0, six).otherwise(dotted).alias("address"))


@query("str_17_private_address", s.sql("SELECT page_id, private FROM judged", addressed=_ADDRESSED, judged=_JUDGED))
def private_addresses(t: Tables) -> DataFrame:
    return page_addresses(t).select("page_id", ur.is_private_address("address").alias("private"))


@query("str_17_resolves_public", s.sql(f"""
SELECT page_id, coalesce(NOT private, false) AS resolves_public FROM pages LEFT JOIN (SELECT host, bool_or(private) AS private FROM judged GROUP BY host) h
  ON h.host = 'h' || (page_id // 2) || '.' || {s.host('url')}""", addressed=_ADDRESSED, judged=_JUDGED))
def resolves(t: Tables) -> DataFrame:
    """Hosts of two pages with the resolved addresses of both, of both families; hosts without any are not public."""
    own = F.concat(F.lit("https://h"), F.floor(F.col("page_id") / 2).cast("string"), F.lit("."), ur.url_host("url"), F.lit("/x"))
    urls = t.table("pages").select("page_id", own.alias("url"))
    return ur.resolves_public(urls, page_addresses(t).select("host", "address")).select("page_id", "resolves_public")


@query("str_18_on_board_host", s.sql("""
SELECT seq, CASE WHEN seq % 4 = 0 THEN source IN ('dou', 'djinni', 'linkedin') ELSE false END AS own, CASE seq % 4 WHEN 0 THEN probe_board END AS board FROM listings""", "listings"))
def board_host(t: Tables) -> DataFrame:
    """Listing urls as they are, with a port, under a look-alike host, and over another scheme."""
    u = F.col("url")
    host = F.regexp_extract(u, r"^https://([^/]+)", 1)
    forged = (
        F.when(F.col("seq") % 4 == 1, F.concat(F.lit("https://"), host, F.lit(":8443/x")))
        .when(F.col("seq") % 4 == 2, F.concat(F.lit("https://"), host, F.lit(".evil.example/x")))
        .when(F.col("seq") % 4 == 3, F.concat(F.lit("ftp://"), host, F.lit("/x"))).otherwise(u)
    )
    return t.listings.withColumn("u", forged).select("seq", ur.on_board_host("source", "u").alias("own"), ur.board_of("source", F.col("u")).alias("board"))


@query("str_19_same_site", f"""
SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN starts_with(url, 'http://') WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS allowed FROM pages""")
def hops(t: Tables) -> DataFrame:
    """Redirect hops of every page: itself, a downgrade, a subdomain, another port, another host, its parent domain."""
    k, host = F.col("page_id") % 6, ur.url_host("url")
    scheme = F.regexp_extract("url", "^(https?)://", 1)
    to = (
        F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("http://"), host, F.lit("/y"))).when(k == 2, F.concat(scheme, F.lit("://jobs."), host, F.lit("/y")))
        .when(k == 3, F.concat(scheme, F.lit("://"), host, F.lit(":8443/y"))).when(k == 4, F.concat(scheme, F.lit("://not"), host, F.lit("/y")))
        .otherwise(F.concat(scheme, F.lit("://"), F.regexp_extract(host, r"^[^.]*\.(.*)$", 1), F.lit("/y")))
    )
    return t.table("pages").withColumn("to", to).select("page_id", ur.same_site(F.col("to"), F.col("url")).alias("allowed"))


@query("str_29_parse_alt_links", s.sql("""
SELECT seq, source, url FROM (SELECT seq, 'dou' AS source, 'https://boards.example.org/jobs/' || (seq + 2) || '/?utm_source=y' AS url FROM packages)""", "packages"))
def alt_links(t: Tables) -> DataFrame:
    return t.packages.select("seq", F.inline(ur.parse_alt_links("alt_links")))


# ---- html ------------------------------------------------------------------------------

_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]


def sql_text(e: str, blocks: bool) -> str:
    if blocks:
        e = f"regexp_replace({e}, '(?is)<!--(?:>|->|.*?-->)|<script\\b.*?</script[^>]*>|<style\\b.*?</style[^>]*>', '', 'g')"
    e = rf"""regexp_replace({e}, '(?s)<!--.*?-->|<[a-zA-Z](?:[^<>="'']|=\s*"[^"]*"|=\s*''[^'']*''|=|["''])*>|<[/!][^<>]*>', ' ', 'g')"""
    for name, value in _ENTITIES:
        e = f"regexp_replace({e}, '(?i){name}', {s.lit(value)}, 'g')"
    return rf"trim(regexp_replace({e}, '[\s\p{{Z}}]+', ' ', 'g'))"


_BLANKS = r"[\s\p{Z}\x{FEFF}\x{0085}\x{000B}]+"


@query("src_09_html_to_text", f"SELECT page_id, {sql_text('html', True)} AS page_text FROM pages")
def page_text(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", hm.html_page_text("html").alias("page_text"))


@query("src_09_numeric_entities", rf"""
SELECT doc_id, md5(trim(trim(regexp_replace(text, '{_BLANKS}', ' ', 'g')) || ' < 5000 &lt; € A <b> ' || 'é')) AS decoded_md5, length(text) AS n FROM documents""")
def numeric_entities(t: Tables) -> DataFrame:
    """Every document escaped as HTML text, in a tag with a quoted bracket, between entities of each kind."""
    text = F.col("text")
    for plain, escaped in (("&", "&amp;"), ("<", "&#60;"), (">", "&#x3E;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    html = F.concat(F.lit("<p title='a > b'>"), text, F.lit("</p>< 5000 &amp;lt; &#8364;&#x20;&#65; &#60;b&#62; &#xe9;"))
    return t.table("documents").select("doc_id", F.md5(hm.html_to_text(html)).alias("decoded_md5"), F.length("text").cast("bigint").alias("n"))


@query("src_06_best_link", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://apply.example/' || page_id || '?a=1&b=2' ELSE url END AS href, page_id % 2 = 0 AS explicit FROM pages""")
def best_links(t: Tables) -> DataFrame:
    """Posts that link their page first and, every other one, an explicit application page after it."""
    k = F.col("page_id")
    first = F.concat(F.lit('<a class="x" href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">Company</a> text '))
    second = F.concat(F.lit('<a href="https://apply.example/'), k.cast("string"), F.lit('?a=1&amp;b=2">( <b>Job</b> &amp; Apply )</a>'))
    post = F.concat(first, F.when(k % 2 == 0, second).otherwise('<a href="?q=%23qa">#apply</a>'), F.col("html"))
    return t.table("pages").withColumn("link", hm.best_link(post)).select("page_id", "link.href", "link.explicit")


@query("src_11_compose_text", s.sql("""
SELECT seq, md5(trim(title || CASE WHEN company <> '' THEN ' at ' || company ELSE '' END || '. ' || location || '. ' || text)) AS text_md5 FROM postings""", "postings"))
def composed(t: Tables) -> DataFrame:
    return t.postings.select("seq", F.md5(tx.compose_text("title", "company", "location", "text")).alias("text_md5"))


# ---- cleaning -----------------------------------------------------------------------------


@query("str_13_one_line", r"""
SELECT doc_id, md5(one) AS one_md5, left(fm, 80) AS clipped, length(fm) AS n FROM (
  SELECT doc_id, trim(regexp_replace('a b' || text, '\s+', ' ', 'g')) AS one, trim(regexp_replace(text, '\s+', ' ', 'g')) AS fm FROM documents)""")
def one_lines(t: Tables) -> DataFrame:
    forged = F.concat(F.lit("a‮ \u0007b"), "text")
    return t.table("documents").select(
        "doc_id", F.md5(tx.one_line(forged)).alias("one_md5"), tx.clip("text", 80).alias("clipped"), F.length(tx.squeeze("text")).cast("bigint").alias("n")
    )


@query("str_11_detect_lang", r"""
SELECT doc_id, CASE WHEN cyr * 2 < lat THEN 'en' WHEN doc_id % 2 = 0 THEN 'uk' ELSE 'ru' END AS detected FROM (
  SELECT doc_id, length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS lat, 1000 * CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 7 END AS cyr FROM documents)""")
def languages(t: Tables) -> DataFrame:
    """Each document behind a Cyrillic passage: short documents read as uk or ru, long ones stay en."""
    passage = F.when(F.col("doc_id") % 2 == 0, F.repeat(F.lit("Київ, їжак "), 1000)).otherwise(F.repeat(F.lit("ищем тыл "), 1000))
    return t.table("documents").select("doc_id", tx.detect_lang(F.concat(passage, "text")).alias("detected"))


@query("str_10_looks_like_job", "SELECT conv_id, turn, " + " OR ".join(f"contains(lower(text), {s.lit(x)})" for x in fixed.JOB_SIGNALS) + " AS job FROM conversations")
def job_like(t: Tables) -> DataFrame:
    return t.table("conversations").select("conv_id", "turn", tx.looks_like_job("text").alias("job"))


def inserted(text, piece, turn) -> Column:
    """``piece`` at the start, in the middle or at the end of ``text``, by ``turn`` % 3."""
    at = F.floor(F.length(text) * (F.abs(turn) % 3) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), at), piece, F.substring(text, at + 1, F.length(text)))


_PAY = ["salary $3,000-$5,000/mo now", "from $3,000 to $5,000 gross", "up to $4,000", "pays $25/hr", "3000-5000 USD net", "team of 5 to 7 years", "щодо $5000/month"]
_PAID = ["$3,000-$5,000/mo", "from $3,000 to $5,000", "up to $4,000", "$25/hr", "3000-5000 USD", None, "$5000/month"]


@query("str_12_extract_salary", "SELECT doc_id, [" + ", ".join("NULL" if p is None else s.lit(p) for p in _PAID) + "][1 + doc_id % 7] AS salary FROM documents")
def salaries(t: Tables) -> DataFrame:
    """A pay phrase at the start, in the middle or at the end of every document, however long."""
    phrase = F.element_at(F.array(*map(F.lit, _PAY)), (F.col("doc_id") % 7 + 1).cast("int"))
    text = inserted("text", F.concat(F.lit(" | "), phrase, F.lit(" | ")), F.col("doc_id"))
    return t.table("documents").select("doc_id", tx.extract_salary(text).alias("salary"))


@query("str_25_score_band", s.sql("SELECT CASE WHEN score >= 40 THEN 'hi' WHEN score >= 30 THEN 'mid' ELSE 'lo' END AS band, count(*) AS n FROM packages GROUP BY 1", "packages"))
def bands(t: Tables) -> DataFrame:
    return t.packages.groupBy(tx.score_band("score").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("str_26_strict_coercion", f"""
SELECT o_orderkey AS seq, CASE o_orderkey % 5 WHEN 0 THEN {s.shown("o_orderdate - CASE WHEN o_orderdate > up AND o_orderdate <= down THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END")} WHEN 1 THEN {s.shown("o_orderdate + INTERVAL 10 HOUR")} END AS stamp,
  CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN 0 ELSE 0 END AS whole
FROM (SELECT o_orderkey, o_orderdate, last_day(make_date(year(o_orderdate), 3, 1)) - ((isodow(last_day(make_date(year(o_orderdate), 3, 1)))) % 7)::INT AS up,
  last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END, 1)) - ((isodow(last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END, 1)))) % 7)::INT AS down FROM orders)""")
def strict(t: Tables) -> DataFrame:
    """Orders as stored dates: a bare local day, a full stamp, an impossible day, a bare number, words."""
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    value = (
        F.when(k % 5 == 0, day).when(k % 5 == 1, F.concat(day, F.lit("T10:00:00Z"))).when(k % 5 == 2, F.concat(F.left(day, F.lit(4)), F.lit("-02-30")))
        .when(k % 5 == 3, "5").otherwise("last week")
    )
    number = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(k.cast("string"), F.lit(".5"))).otherwise("-1")
    return t.table("orders").select(k.alias("seq"), shown(tx.iso_stamp(value, fixed.BOARD_TIME_ZONE)).alias("stamp"), tx.whole_number(number, 0).alias("whole"))


# ---- dates -----------------------------------------------------------------------------------


@query("src_12_normalize_stamp", f"""
SELECT event_id, CASE event_id % 7 WHEN 0 THEN {s.shown('sec')} WHEN 1 THEN {s.shown('sec')} WHEN 2 THEN {s.shown('sec')} WHEN 3 THEN {s.shown('sec')}
  WHEN 4 THEN {s.shown("date_trunc('minute', sec) - INTERVAL 2 HOUR")} END AS stamp
FROM (SELECT event_id, date_trunc('second', ts) AS sec FROM events)""")
def stamps(t: Tables) -> DataFrame:
    """Event times in every spelling; the last two name no day and a day far ahead."""
    k, ts = F.col("event_id") % 7, F.date_trunc("second", F.col("ts"))
    days = F.element_at(F.array(*map(F.lit, ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"])), F.weekday(ts) + 1)
    value = (
        F.when(k == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.unix_seconds(ts).cast("string"))
        .when(k == 2, F.unix_millis(ts).cast("string")).when(k == 3, F.concat(days, F.lit(", "), F.date_format(ts, "dd MMM yyyy HH:mm:ss"), F.lit(" +0000")))
        .when(k == 4, F.date_format(ts, "HH:mm dd.MM.yyyy")).when(k == 5, "31 Feb 2024 10:00:00 GMT").otherwise("2099-01-01")
    )
    return t.events.select("event_id", shown(dt.normalize_stamp(value, stamp(NOW))).alias("stamp"))


@query("src_13_local_wall_to_utc", f"""
SELECT o_orderkey AS seq, {s.shown("o_orderdate + INTERVAL 12 HOUR - CASE WHEN o_orderdate >= up AND o_orderdate < down THEN INTERVAL 3 HOUR ELSE INTERVAL 2 HOUR END")} AS utc FROM (
  SELECT o_orderkey, o_orderdate, last_day(make_date(year(o_orderdate), 3, 1)) - ((isodow(last_day(make_date(year(o_orderdate), 3, 1)))) % 7)::INT AS up,
    last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END, 1)) - ((isodow(last_day(make_date(year(o_orderdate), CASE WHEN year(o_orderdate) < 1996 THEN 9 ELSE 10 END, 1)))) % 7)::INT AS down
  FROM orders)""")
def wall(t: Tables) -> DataFrame:
    """Noon on the board's wall clock; summer time runs from the last Sunday of March to that of October."""
    o = t.table("orders")
    return o.select(F.col("o_orderkey").alias("seq"), shown(dt.local_wall_to_utc(F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 12 HOURS"))).alias("utc"))


_UK = ["січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня"]


@query("src_14_month_name_date", f"""
SELECT o_orderkey AS seq, strftime(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN full_day BETWEEN DATE '2000-01-02' AND DATE '2001-06-02' THEN full_day END
  WHEN m = 2 AND d = 29 THEN DATE '2000-02-29' WHEN make_date(2001, m, d) <= DATE '2001-06-02' THEN make_date(2001, m, d) ELSE make_date(2000, m, d) END, '%Y-%m-%d') AS local_day
FROM (SELECT o_orderkey, o_orderdate::DATE AS full_day, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders)""")
def month_names(t: Tables) -> DataFrame:
    """"Published 9 March 2001" or, on odd orders, "Опубліковано 9 березня" without a year."""
    o = t.table("orders")
    d, uk = F.dayofmonth("o_orderdate").cast("string"), F.element_at(F.array(*map(F.lit, _UK)), F.month("o_orderdate"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("Published "), d, F.lit(" "), F.date_format("o_orderdate", "MMMM yyyy"), F.lit(" · Updated 1 May"))).otherwise(
        F.concat(F.lit("Опубліковано "), d, F.lit(" "), uk, F.lit(" · Оновлено 1 травня")))
    at = dt.month_name_date(text, stamp("2001-06-01 12:00:00"))
    return o.select(F.col("o_orderkey").alias("seq"), F.date_format(F.from_utc_timestamp(at, fixed.BOARD_TIME_ZONE), "yyyy-MM-dd").alias("local_day"))


@query("src_15_relative_age", f"""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'relisted' ELSE 'posted' END AS kind, {s.shown("CASE event_id % 4 WHEN 0 THEN TIMESTAMP '2024-01-31 00:00:00' - to_hours(n) WHEN 1 THEN date_trunc('day', TIMESTAMP '2024-01-31 00:00:00' - to_days(n::INT)) WHEN 2 THEN TIMESTAMP '2024-01-31 00:00:00' - to_days((7 * n)::INT) ELSE TIMESTAMP '2024-01-31 00:00:00' - to_minutes(n) END")} AS at_text
FROM (SELECT event_id, 1 + user_id % 50 AS n FROM events)""")
def relative(t: Tables) -> DataFrame:
    k = F.col("event_id")
    unit = F.element_at(F.array(*map(F.lit, ["hour", "day", "week", "minute"])), (k % 4 + 1).cast("int"))
    n = F.col("user_id") % 50 + 1
    card = F.concat(F.lit("Kyiv · "), F.when(k % 3 == 0, "Reposted ").otherwise(""), n.cast("string"), F.lit(" "), unit, F.when(n > 1, "s").otherwise(""), F.lit(" ago · 25 people"))
    return t.events.withColumn("a", dt.relative_age(card, stamp(EVENTS_NOW))).select("event_id", "a.kind", shown("a.at").alias("at_text"))


# ---- titles, places, cards ---------------------------------------------------------------------


@query("src_02_split_posting_title", s.sql("""
SELECT seq, title || ' в команду' AS title, CASE WHEN bare <> '' THEN bare || legal WHEN legal <> '' THEN 'ТОВ' WHEN seq % 2 = 0 THEN '$3000–4000' ELSE '20000' END AS company, CASE WHEN seq % 2 = 0 THEN 'Київ, Львів' ELSE 'Київ' END AS location FROM (
  SELECT seq, regexp_replace(title, ',', '', 'g') AS title, regexp_replace(split_part(company, ',', 1), ' LLC$', '') AS bare, CASE WHEN seq % 3 = 0 THEN ', ТОВ' ELSE '' END AS legal
  FROM postings)""", "postings"))
def split_titles(t: Tables) -> DataFrame:
    """Titles written the feed's way: role, connector, company, legal form, salary, cities."""
    name = F.regexp_replace(F.split_part("company", F.lit(","), F.lit(1)), " LLC$", "")
    raw = F.concat(
        F.regexp_replace("title", ",", ""), F.lit(" в команду в "), name, F.when(F.col("seq") % 3 == 0, ", ТОВ").otherwise(""),
        F.when(F.col("seq") % 2 == 0, ", $3000–4000, Київ, Львів").otherwise(", 20000, Київ"),
    )
    return t.postings.withColumn("s", tx.split_posting_title(raw)).select("seq", "s.title", "s.company", "s.location")


_PLACES = ["100% Remote or Ukraine (Remote)", "Ukraine — remote", "Remote-first, Kyiv and Lviv", "Poland · Office", "hybrid, Warsaw (office)", "Worldwide"]
_PLACED = ["Ukraine", "Ukraine", "Kyiv and Lviv", "Poland", "Warsaw", "Worldwide"]


_HEADED = f"trim(word || ' ' || {s.items(_PLACED)}[1 + k % 6])"


@query("src_20_place_of", s.sql(f"""
SELECT place, location, count(*) AS n FROM (SELECT {_HEADED} AS place, CASE WHEN k % 2 = 0 THEN 'Office' ELSE 'Remote' END || ' · ' ||
  CASE WHEN k % 3 = 0 THEN CASE WHEN k % 6 = 5 THEN 'Worldwide' ELSE 'Worldwide, ' || {_HEADED} END ELSE {_HEADED} END AS location FROM each_word) GROUP BY ALL""", "words",
    each_word="SELECT doc_id AS k, unnest(list_transform(w, lambda x: regexp_extract(x, '^[a-zA-Z]+'))) AS word FROM words"))
def places(t: Tables) -> DataFrame:
    """Location fields with each word of every document in front of a place that carries format words.

    Words repeat, so they are counted first and each field is taken apart once."""
    k = F.col("doc_id")
    words = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    each = t.table("documents").select((k % 6).alias("k"), F.explode(words).alias("word")).select("k", F.regexp_extract("word", "^[a-zA-Z]+", 0).alias("word"))
    d = each.groupBy("k", "word").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "raw", F.concat("word", F.lit(" "), F.element_at(F.array(*map(F.lit, _PLACES)), (F.col("k") + 1).cast("int")))
    )
    k = F.col("k")
    placed = d.select(loc.place_of("raw").alias("place"), "n",
                      loc.compose_location("raw", F.when(k % 2 == 0, "No").otherwise("Yes"), F.when(k % 3 == 0, "Yes").otherwise("")).alias("location"))
    return placed.groupBy("place", "location").agg(F.sum("n").alias("n"))


@query("fil_02_forbids_country", "SELECT doc_id, doc_id % 4 IN (0, 3) OR (doc_id % 4 = 2 AND regexp_matches(lower(text), 'ukrain|україн|украин')) AS forbids FROM documents")
def forbids(t: Tables) -> DataFrame:
    """One ban field per document, its text behind: plain lists, "outside" lists, lists without the country."""
    lists = ["Russia, Ukraine", "Outside Europe and Ukraine", "Belarus", "Україна"]
    field = F.concat(F.element_at(F.array(*map(F.lit, lists)), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(", "), "text")
    return t.table("documents").select("doc_id", loc.forbids_country(field).alias("forbids"))


# ---- untyped values ---------------------------------------------------------------------------

_RULES = {"a": (5.0, 1.0, 100.0), "b": (0.0, -10.0, 10.0)}
_RAW = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN ' ' || n_chars || ' ' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE (doc_id % 90)::VARCHAR END AS a,
  CASE doc_id % 3 WHEN 0 THEN (doc_id % 40 - 20)::VARCHAR WHEN 1 THEN lang ELSE '7.5' END AS b, CASE doc_id % 4 WHEN 0 THEN 'TRUE ' WHEN 1 THEN 'false' WHEN 2 THEN 'yes' END AS c FROM documents"""


def untyped(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    return t.table("documents").select(
        "doc_id",
        F.when(k % 5 == 0, "abc").when(k % 5 == 1, F.concat(F.lit(" "), F.col("n_chars").cast("string"), F.lit(" "))).when(k % 5 == 2, "").when(k % 5 == 4, (k % 90).cast("string")).alias("a"),
        F.when(k % 3 == 0, (k % 40 - 20).cast("string")).when(k % 3 == 1, F.col("lang")).otherwise("7.5").alias("b"),
        F.when(k % 4 == 0, "TRUE ").when(k % 4 == 1, "false").when(k % 4 == 2, "yes").alias("c"),
    )


def _num(c: str, rule) -> str:
    n = f"TRY_CAST(trim({c}) AS DOUBLE)"
    return f"CASE WHEN {n} IS NULL THEN {rule[0]}::DOUBLE ELSE least({rule[2]}::DOUBLE, greatest({rule[1]}::DOUBLE, {n})) END"


@query("str_32_coerced_values", f"WITH raw AS ({_RAW}) SELECT doc_id, {_num('a', _RULES['a'])} AS a, {_num('b', _RULES['b'])} AS b, CASE WHEN lower(trim(c)) = 'true' THEN true ELSE false END AS c FROM raw")
def coerced(t: Tables) -> DataFrame:
    return coerce_numbers(untyped(t), _RULES).withColumn("c", flag(F.col("c"), False))


@query("str_32_value_issues", f"""WITH raw AS ({_RAW}), long AS (
  SELECT doc_id, 'a' AS column_name, a AS value, {_num('a', _RULES['a'])} AS used FROM raw UNION ALL SELECT doc_id, 'b', b, {_num('b', _RULES['b'])} FROM raw)
SELECT * FROM (SELECT doc_id, column_name, value, used, CASE WHEN value IS NULL THEN NULL WHEN TRY_CAST(trim(value) AS DOUBLE) IS NULL THEN 'not a number' WHEN TRY_CAST(trim(value) AS DOUBLE) <> used THEN 'out of range' END AS issue FROM long) WHERE issue IS NOT NULL""")
def value_issues(t: Tables) -> DataFrame:
    return number_issues(untyped(t), "doc_id", _RULES)
