"""Crawl bodies built from the given tables, read back into postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.html import html_page_text
from gleaner.functions.text import once
from gleaner.operators.health import outages, search_yield
from gleaner.operators.inbox import unread_threads
from gleaner.plans import sqlviews as s
from gleaner.plans.registry import query
from gleaner.plans.text import sql_text
from gleaner.plans.views import NOW, Tables, shown, stamp
from gleaner.sources import feeds, pages, records

PER_BODY = 20  # items per crawled body, as boards page their lists


def bodies(rows: DataFrame, item: Column, by: Column, head: str, tail: str, sep: str = "", column: str = "body") -> DataFrame:
    """Bodies of at most PER_BODY items each, in item order."""
    each = rows.select(F.floor(by / PER_BODY).alias("body_no"), by.alias("_k"), item.alias("_i"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_i"))), lambda x: x["_i"]), sep)
    return each.groupBy("body_no").agg(F.concat(F.lit(head), joined, F.lit(tail)).alias(column))


def escaped(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


_FLAT = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"


def flat(e: str) -> str:
    return _FLAT.format(e)


# ---- feeds ------------------------------------------------------------------------------

def rss_bodies(t: Tables) -> DataFrame:
    """RSS feeds of twenty documents; every ninth item has no link."""
    p = t.postings
    title = F.concat(escaped("title"), F.lit(" в Acme, Київ"))
    link = F.when(p["seq"] % 9 == 0, "").otherwise(F.concat(F.lit("<link>https://jobs.example/"), p["seq"].cast("string"), F.lit("/?from=rss</link>")))
    # The description is HTML, escaped once more for transport.
    desc = escaped(F.concat(F.lit("<p class='a'>"), escaped("text"), F.lit("</p>")))
    date = F.when(p["posted"].isNotNull(), F.concat(F.lit("<pubDate>"), F.date_format("posted", "dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate>"))).otherwise("")
    item = F.concat(F.lit("<item><title><![CDATA["), title, F.lit("]]></title>"), link, F.lit("<description>"), desc, F.lit("</description>"), date, F.lit("</item>"))
    return bodies(p, item, F.col("seq"), "<rss><channel>", "<item><title>cut off</channel></rss>")


@query("src_01_rss_items", s.sql(f"""
SELECT 'https://jobs.example/' || seq || '/' AS url, {flat('title')} AS title, 'Acme' AS company, 'Київ' AS location, {s.shown('posted')} AS posted,
  md5({flat("title || ' в Acme, Київ'")} || '. ' || {flat('text')}) AS text_md5 FROM postings WHERE seq % 9 <> 0""", "postings"))
def rss(t: Tables) -> DataFrame:
    items = feeds.rss_items(rss_bodies(t), stamp(NOW))
    return items.select("url", "title", "company", "location", shown("posted").alias("posted"), F.md5("text").alias("text_md5"))


@query("src_03_listing_cards", s.sql(f"""
SELECT 'https://djinni.co/jobs/' || seq || '-x/' AS url, {flat('title')} AS title, {flat('company')} AS company, location,
  md5(trim({flat('title')} || CASE WHEN {flat('company')} <> '' THEN ' at ' || {flat('company')} ELSE '' END || '. ' || location || '. ' || {flat('text')})) AS text_md5
FROM postings WHERE title <> '' AND seq % 8 <> 0""", "postings"))
def cards(t: Tables) -> DataFrame:
    """Listing pages of twenty cards, each with a nested meta block; every eighth card has no link."""
    p, n = t.postings, F.col("seq").cast("string")
    place = F.concat(F.lit("<div><b>"), F.replace("location", F.lit(" · "), F.lit("</b></div> · <div><b>")), F.lit("</b></div>"))
    href = F.when(p["seq"] % 8 == 0, "").otherwise(F.concat(F.lit('<a href="/jobs/'), n, F.lit('-x/?from=list">open</a>')))
    card = F.concat(
        F.lit('<div id="job-item-'), n, F.lit('" class="card">'), href, F.lit('<h2 class="mb-0 job-item__position">'), escaped("title"), F.lit("</h2>"),
        F.lit('<span class="small text-gray-800 me-1">'), escaped("company"), F.lit("</span>"),
        F.lit('<div class="fw-medium d-flex flex-wrap">'), place, F.lit("</div><div>other</div>"),
        F.lit('<span class="js-truncated-text"><i>'), escaped("text"), F.lit("</i></span></div>"),
    )
    html = bodies(p, card, F.col("seq"), "<html><script>var x='</div>'</script><main>", "</main></html>", column="html")
    return feeds.listing_cards(html).select("url", "title", "company", "location", F.md5("text").alias("text_md5"))


@query("src_04_json_api_jobs", s.sql(f"""
SELECT 'https://api.example/' || seq AS url, {flat('title')} AS title, {flat('company')} AS company, CASE WHEN seq % 4 = 0 THEN 'Remote · Worldwide' ELSE 'Remote · Ukraine, Poland' END AS location,
  {s.shown('updated')} AS updated, md5(trim({flat('title')} || CASE WHEN {flat('company')} <> '' THEN ' at ' || {flat('company')} ELSE '' END || '. ' || CASE WHEN seq % 4 = 0 THEN 'Remote · Worldwide' ELSE 'Remote · Ukraine, Poland' END || '. ' || {flat('text')})) AS text_md5
FROM postings WHERE title <> '' AND seq % 9 <> 0""", "postings"))
def api(t: Tables) -> DataFrame:
    """API pages of twenty jobs; a third carry only the apply link, every ninth no https link at all."""
    seq, n = F.col("seq"), F.col("seq").cast("string")
    link = F.concat(F.lit("https://api.example/"), n)
    job = F.to_json(F.struct(
        "title", F.col("company").alias("companyName"), F.when(seq % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("Ukraine"), F.lit(" Poland "))).alias("locationRestrictions"),
        F.concat(F.lit("<div>"), escaped("text"), F.lit("</div>")).alias("description"), F.unix_seconds("updated").alias("pubDate"),
        F.when(seq % 9 == 0, F.concat(F.lit("http://api.example/"), n)).when(seq % 3 != 1, link).otherwise("urn:1").alias("guid"),
        F.when(seq % 3 == 1, link).alias("applicationLink"),
    ))
    body = bodies(t.postings, job, seq, '{"offset":0,"jobs":[', "]}", ",")
    out = feeds.json_api_jobs(body, stamp(NOW))
    return out.select("url", "title", "company", "location", shown("updated").alias("updated"), F.md5("text").alias("text_md5"))


@query("src_04_json_api_rejects", "SELECT DISTINCT doc_id // 20 AS body_no FROM documents WHERE (doc_id // 20) % 3 = 0")
def api_rejects(t: Tables) -> DataFrame:
    """Every third body is an error page."""
    good = bodies(t.postings, F.to_json(F.struct("title")), F.col("seq"), '{"jobs":[', "]}", ",")
    mixed = good.withColumn("body", F.when(F.col("body_no") % 3 == 0, F.concat(F.lit("<html>"), "body")).otherwise(F.col("body")))
    return feeds.json_api_rejects(mixed).select("body_no")


def channel_pages(t: Tables) -> DataFrame:
    """Channel preview pages of twenty posts; every fifth post is no job, every second has an apply link."""
    seq, n = F.col("seq"), F.col("seq").cast("string")
    fields = F.concat(
        F.when(seq % 5 == 0, "<b>News</b>").otherwise(F.concat(F.lit("<b>Title:</b> "), escaped("title"))), F.lit("<br>Company name: "), escaped("company"),
        F.lit("<br/>Location: Ukraine (Remote)<br>"), F.when(seq % 5 == 0, "").otherwise("Title: second<br>"), F.lit("Job description: "), escaped("text"), F.lit("<br>Tags: #qa #test_automation "),
        F.when(seq % 2 == 0, F.concat(F.lit('<a href="https://apply.example/'), n, F.lit('">( Job Description &amp; Apply )</a>'))).otherwise('<a href="https://company.example/">site</a>'),
    )
    post = F.concat(
        F.lit('<div class="tgme_widget_message_wrap x"><div data-post="chan/'), n, F.lit('"><div class="tgme_widget_message_text js"><div>'), fields,
        F.lit('</div></div><time datetime="2024-01-15T10:00:00+00:00">10:00</time></div></div>'),
    )
    head = '<section class="tgme_channel_history js"><a class="tme_messages_more x" data-before="7">'
    return bodies(t.postings, post, seq, head, "</section>", column="html")


@query("src_05_channel_posts", s.sql(f"""
SELECT 'https://' || CASE WHEN seq % 2 = 0 THEN 'apply.example/' || seq ELSE 't.me/chan/' || seq END AS url, {flat('title')} AS title, {flat('company')} AS company, 'Remote · Ukraine' AS location,
  md5({flat('title')} || CASE WHEN {flat('company')} <> '' THEN ' at ' || {flat('company')} ELSE '' END || '. Remote · Ukraine. ' || {flat('text')} || ' Tags: qa, test automation.') AS text_md5,
  row_number() OVER (PARTITION BY seq // 20 ORDER BY seq DESC) - 1 + 0 * count(*) OVER () AS newest_no, '7' AS before
FROM (SELECT *, row_number() OVER (PARTITION BY seq // 20 ORDER BY seq DESC) AS r FROM postings) WHERE title <> '' AND seq % 5 <> 0""".replace(
    "row_number() OVER (PARTITION BY seq // 20 ORDER BY seq DESC) - 1 + 0 * count(*) OVER () AS newest_no", "(r - 1)::INT AS newest_no"), "postings"))
def channel(t: Tables) -> DataFrame:
    posts = feeds.split_channel_page(channel_pages(t)).withColumn("channel", F.lit("chan"))
    jobs = feeds.channel_posts(posts)
    return jobs.select("url", "title", "company", "location", F.md5("text").alias("text_md5"), "newest_no", "before")


# ---- pages --------------------------------------------------------------------------------


@query("src_07_jsonld_description", rf"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE md5({flat('text')}) END AS text_md5 FROM documents""")
def jsonld(t: Tables) -> DataFrame:
    """Documents as structured data of a page: one node, an array, a graph; every fourth page has none."""
    node = lambda kind: F.to_json(F.struct(F.lit(kind).alias("@type"), F.concat(F.lit("<p>"), escaped("text"), F.lit("</p>")).alias("description")))
    k = F.col("doc_id") % 4
    data = (
        F.when(k == 0, node("JobPosting")).when(k == 1, F.concat(F.lit('[{"@type":"Organization"},'), node("JobPosting"), F.lit("]")))
        .when(k == 2, F.concat(F.lit('{"@context":"x","@graph":['), node("JobPosting"), F.lit("]}"))).otherwise(node("Article"))
    )
    html = F.concat(F.lit('<script>var a=1</script><script type="application/ld+json">'), data, F.lit("</script><p>end</p>"))
    text = pages.jsonld_description(html)
    return t.table("documents").select("doc_id", once(text, lambda x: F.when(x == "", "").otherwise(F.md5(x))).alias("text_md5"))


_STRIPPED = "regexp_replace(html, '(?is)<!--(?:>|->|.*?-->)|<script\\b.*?</script[^>]*>|<style\\b.*?</style[^>]*>', '', 'g')"
_PARTS = {"part": f"SELECT page_id, url, {_STRIPPED} AS html FROM pages"}


@query("src_08_div_block", s.sql("SELECT page_id, md5('<div>' || html || '</div>') AS inner_md5, length(html) + 11 AS n, regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS ad FROM part", **_PARTS))
def div_block(t: Tables) -> DataFrame:
    """Every page inside a description block, behind a script that holds stray tags; and the advert block of the page itself."""
    wrapped = F.concat(
        F.lit('<script>"</div><div class=job-post__description>"</script><div class="a"><div class="b job-post__description c"><div>'),
        F.col("html"), F.lit("</div><!-- </div> --></div></div><div>tail</div>"),
    )
    inner = t.table("pages").select(
        "page_id", pages.div_block_of(wrapped, "job-post__description").alias("inner"), pages.div_block_of(F.col("html"), "ad").alias("ad")
    )
    return inner.select("page_id", F.md5("inner").alias("inner_md5"), F.length("inner").cast("bigint").alias("n"), "ad")


@query("src_08_page_blocks", s.sql("""
SELECT page_id, tag, classes, depth, md5(inner_html) AS inner_md5, count(*) AS n FROM (
  SELECT page_id, 'div' AS tag, 'outer' AS classes, 1 AS depth, '<ul><li>one' || '<li class="b">' || html || '</ul>' AS inner_html FROM part
  UNION ALL SELECT page_id, 'li', '', 2, 'one' FROM part UNION ALL SELECT page_id, 'li', 'b', 2, html FROM part
  UNION ALL SELECT page_id, 'div', 'ad', 3, unnest(regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1)) FROM part
  UNION ALL SELECT page_id, 'li', '', 3, unnest(regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1)) FROM part) GROUP BY ALL""", **_PARTS))
def page_blocks(t: Tables) -> DataFrame:
    """All blocks of every page by class and depth; the page stands in an unclosed list item of a list in a block."""
    wrapped = F.concat(F.lit('<div class="outer"><ul><li>one<li class="b">'), F.col("html"), F.lit("</ul></div></li>"))
    p = t.table("pages").select("page_id", wrapped.alias("w"))
    blocks = p.select("page_id", "w", F.explode(pages.page_blocks(F.col("w"))).alias("b"))
    inner = pages.block_html(F.col("w"), F.col("b"))
    return blocks.groupBy("page_id", "b.tag", "b.classes", "b.depth", F.md5(inner).alias("inner_md5")).agg(F.count(F.lit(1)).alias("n"))


@query("src_10_decode_body", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'windows-1251' WHEN doc_id % 3 = 1 THEN 'windows-1252' ELSE 'utf-8' END AS charset,
  md5(CASE WHEN doc_id % 3 = 2 THEN 'Привіт ' || regexp_replace(text, '[^\x00-\x7F]', '', 'g') WHEN doc_id % 3 = 1 THEN '“' || text ELSE text END) AS body_md5 FROM documents""")
def decoded(t: Tables) -> DataFrame:
    """Documents as bytes in three charsets: a Cyrillic word before the ASCII of the text, Latin-1 by its web meaning, UTF-8."""
    k = F.col("doc_id") % 3
    cyrillic = F.concat(F.unhex(F.lit("CFF0E8E2B3F220")), F.encode(F.regexp_replace("text", r"[^\x00-\x7F]", ""), "US-ASCII"))
    body = F.when(k == 2, cyrillic).when(k == 1, F.concat(F.unhex(F.lit("93")), F.encode("text", "ISO-8859-1"))).otherwise(F.encode("text", "UTF-8"))
    header = F.when(k == 2, "text/html; charset=windows-1251").when(k == 1, 'text/html; charset="ISO-8859-1"')
    raw = t.table("documents").select("doc_id", body.alias("body"), header.alias("content_type"))
    return pages.decode_body(raw).select("doc_id", "charset", F.md5("html").alias("body_md5"))


_CARDS = {**_PARTS, "items": """SELECT page_id, url, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS ord FROM (SELECT *, regexp_extract_all(html, '(?s)<li>(.*?)</li>', 1) AS items FROM part)""",
    "cards": f"""SELECT page_id, ord, url, {sql_text('item', False)} AS title, regexp_extract(item, 'href="([^"]*)"', 1) AS href FROM items"""}


@query("src_22_card_fields", s.sql("""
SELECT page_id, ord, CASE WHEN length(title) % 2 = 0 AND left(title, length(title) // 2) = right(title, length(title) // 2) THEN left(title, length(title) // 2) ELSE title END AS title,
  'https://www.linkedin.com' || split_part(href, '?', 1) AS url
FROM cards WHERE page_id % 4 <> 3 AND title <> '' AND starts_with(href, '/')""", **_CARDS))
def card_fields(t: Tables) -> DataFrame:
    """List items of every page as cards: odd ones with a doubled title and a badge line, those of a quarter of the pages with a link off the site."""
    found = pages.block_cards(t.table("pages").select("page_id", "url", "html")).withColumnRenamed("url", "page_url")
    odd = F.col("ord") % 2 == 1
    raw = found.select(
        "page_id", "ord", F.when(odd & (F.col("title") != ""), F.concat("title", "title", F.lit("\nVerified"))).otherwise(F.col("title")).alias("title"),
        F.when(F.col("page_id") % 4 == 3, F.col("page_url")).when(odd, F.concat("href", F.lit("?trk=x"))).otherwise(F.col("href")).alias("href"),
        F.lit("Acme\nx").alias("company"), F.lit("Kyiv").alias("location"),
    )
    return pages.card_rows(raw, "linkedin.com").select("page_id", "ord", "title", "url")


@query("src_23_crawl_frontier", """
SELECT p_partkey AS part, n AS page_no, 'https://api.example/search?q=' || replace(p_name, ' ', '+') || CASE WHEN p_size % 2 = 0 THEN '&country=C%C3%B4te+d%27Ivoire' ELSE '' END || '&sort=recent' || CASE WHEN n > 1 THEN '&page=' || n ELSE '' END AS url
FROM part, (SELECT unnest([1, 2, 3]) AS n)""")
def frontier(t: Tables) -> DataFrame:
    """Part names as search phrases, three pages each."""
    searches = t.table("part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("query"), F.when(F.col("p_size") % 2 == 0, "Côte d'Ivoire").alias("country"))
    return pages.crawl_frontier(searches, 3, "https://api.example/search").select("part", "page_no", "url")


def classified(t: Tables) -> DataFrame:
    """Every page as one search result: real ones, empty bodies, block pages, cards without fields."""
    k = F.col("page_id")
    p = t.table("pages").select(
        F.when(k % 11 == 0, "").when(k % 13 == 0, F.lit(None)).otherwise(F.col("html")).alias("body"), (k % 3 + 1).cast("int").alias("page_no"),
        (k % 5).cast("int").alias("cards"), F.when(k % 7 == 0, 0).otherwise((k % 5).cast("int")).alias("parsed"), k.alias("page_id"),
    )
    return p.withColumn("c", pages.classify_page("body", "page_no", "cards", "parsed", "<article>")).select(
        "page_id", "page_no", "parsed", "c.status", "c.reason", (k % 4).alias("source"), F.floor(k / 12).alias("search")
    )


_CLASSES = """SELECT page_id, (page_id % 3 + 1)::INT AS page_no, CASE WHEN page_id % 7 = 0 THEN 0 ELSE (page_id % 5)::INT END AS parsed, page_id % 4 AS source, page_id // 12 AS search, CASE
  WHEN page_id % 11 = 0 THEN 'fetch failed' WHEN page_id % 13 = 0 THEN '' WHEN page_id % 5 > 0 AND page_id % 7 = 0 THEN 'no parsable cards'
  WHEN page_id % 3 = 0 AND page_id % 5 = 0 AND NOT contains(html, '<article>') THEN 'not a search page' WHEN page_id % 7 = 0 OR page_id % 5 = 0 THEN '' ELSE 'ok' END AS r, page_id % 13 = 0 AND page_id % 11 <> 0 AS missing FROM pages"""
_STATUS = f"SELECT page_id, page_no, parsed, source, search, CASE WHEN r = 'ok' THEN 'ok' WHEN r = '' THEN 'end' ELSE 'cut' END AS status, CASE WHEN r = 'ok' THEN '' ELSE r END AS reason FROM ({_CLASSES})"


@query("src_32_classify_page", f"SELECT page_id, status, reason FROM ({_STATUS})")
def classes(t: Tables) -> DataFrame:
    return classified(t).select("page_id", "status", "reason")


@query("src_32_classify_bodies", """
SELECT doc_id, kind, CASE WHEN form = 0 THEN 'cut' WHEN form = 1 THEN 'cut' WHEN form = 2 AND kind = 'api' THEN 'end' WHEN form = 2 AND kind = 'channel' THEN 'last' ELSE 'ok' END AS status,
  CASE WHEN form = 0 THEN 'fetch failed' WHEN form = 1 THEN CASE kind WHEN 'feed' THEN 'not a feed' WHEN 'api' THEN 'not a jobs response' ELSE 'not a public channel preview' END ELSE '' END AS reason
FROM (SELECT doc_id, ['feed', 'api', 'channel'][1 + doc_id % 3] AS kind, (doc_id // 3) % 4 AS form FROM documents)""")
def body_classes(t: Tables) -> DataFrame:
    """Documents as bodies of three boards: nothing fetched, a block page, the end of the results, a page with more."""
    form, text = F.floor(F.col("doc_id") / 3) % 4, escaped("text")
    kind = F.element_at(F.array(*map(F.lit, ["feed", "api", "channel"])), (F.col("doc_id") % 3 + 1).cast("int"))
    api = F.when(form == 2, '{"jobs": []}').otherwise(F.to_json(F.struct(F.array(F.struct(F.col("text").alias("description"))).alias("jobs"))))
    cursor = F.when(form == 3, '<a class="tme_messages_more js" href="x" data-before="12">older</a>').otherwise("")
    channel = F.concat(F.lit('<section class="tgme_channel_history js">'), cursor, text, F.lit("</section>"))
    feed = F.concat(F.lit('<?xml version="1.0"?><rss version="2.0"><channel>'), text, F.lit("</channel></rss>"))
    page = F.when(kind == "api", api).when(kind == "channel", channel).otherwise(feed)
    body = F.when(form == 0, F.lit(None).cast("string")).when(form == 1, F.concat(F.lit("<html><p>blocked</p>"), text)).otherwise(page)
    found = t.table("documents").select("doc_id", kind.alias("kind"), pages.classify_body(kind, body).alias("c"))
    return found.select("doc_id", "kind", "c.status", "c.reason")


@query("src_18_search_yield", f"""
SELECT source, search, pages, items, CASE WHEN cuts > 0 AND pages = 0 THEN 'failed' WHEN cuts > 0 THEN 'partial' ELSE 'ok' END AS outcome FROM (
  SELECT source, search, count(*) FILTER (status = 'ok') AS pages, coalesce(sum(parsed) FILTER (status = 'ok'), 0)::BIGINT AS items, count(*) FILTER (status = 'cut') AS cuts
  FROM ({_STATUS}) GROUP BY ALL)""")
def yields(t: Tables) -> DataFrame:
    runs = classified(t).withColumn("run", F.lit(1)).withColumnRenamed("parsed", "items")
    return search_yield(runs).select("source", "search", "pages", "items", "outcome")


@query("src_18_outages", """
SELECT source, run, bool_and(n_ok = 0) AS outage FROM (
  SELECT event_type AS source, date_trunc('day', ts) AS d, strftime(ts, '%Y-%m-%d') AS run, user_id % 3 AS search, count(*) FILTER (value > 50) AS n_ok FROM events GROUP BY ALL) GROUP BY ALL""")
def outage(t: Tables) -> DataFrame:
    """Events as page reads: a low value is a cut page, three searches per source and day."""
    e = t.events.select(
        F.col("event_type").alias("source"), F.date_format("ts", "yyyy-MM-dd").alias("run"), (F.col("user_id") % 3).alias("search"),
        F.when(F.col("value") > 50, "ok").otherwise("cut").alias("status"), F.lit(1).alias("items"),
    )
    return outages(search_yield(e))


@query("src_19_enrich", s.sql("""
SELECT p.seq, md5(CASE WHEN p.seq % 4 <> 0 AND l.seq IS NOT NULL THEN trim(title || CASE WHEN company <> '' THEN ' at ' || company ELSE '' END || '. ' || location || '. full ' || p.text) ELSE 'snippet' END) AS text_md5,
  p.seq % 4 <> 0 AND l.seq IS NOT NULL AS enriched FROM postings p LEFT JOIN verdicts l USING (seq)""", "postings", "verdicts"))
def enriched(t: Tables) -> DataFrame:
    """Labelled documents have a detail page; every fourth posting is known already."""
    return detailed(t)


def detailed(t: Tables, skip: Column | None = None) -> DataFrame:
    own = F.concat(F.lit("https://detail.example/"), F.col("seq").cast("string"))
    p = t.postings.withColumn("url", own)
    details = p.join(t.verdicts.select("seq"), "seq", "left_semi").select("url", F.concat(F.lit("full "), "text").alias("full_text"), F.lit(None).cast("timestamp").alias("posted"))
    out = pages.enrich(p.withColumn("text", F.lit("snippet")), details, p.filter("seq % 4 = 0").select("seq"), skip)
    return out.select("seq", F.md5("text").alias("text_md5"), "enriched")


@query("udf_03_injected_predicate", s.sql("""
SELECT p.seq, md5(CASE WHEN p.seq % 4 <> 0 AND location <> 'Kyiv' AND l.seq IS NOT NULL THEN trim(title || CASE WHEN company <> '' THEN ' at ' || company ELSE '' END || '. ' || location || '. full ' || p.text) ELSE 'snippet' END) AS text_md5,
  p.seq % 4 <> 0 AND location <> 'Kyiv' AND l.seq IS NOT NULL AS enriched FROM postings p LEFT JOIN verdicts l USING (seq)""", "postings", "verdicts"))
def injected_predicate(t: Tables) -> DataFrame:
    """The caller's own rule for what is not worth reading, as a column."""
    return detailed(t, F.col("location") == "Kyiv")


@query("udf_04_pages_to_rows", "SELECT page_id, '/' || word AS href, word AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"/([^\"]*)\">', 1)) AS word FROM pages)")
def nav_rows(t: Tables) -> DataFrame:
    """One page, many rows: the navigation links of every page."""
    items = F.regexp_extract_all("html", F.lit(r'<li><a href="/[^"]*">.*?</a>'), F.lit(0))
    rows = t.table("pages").select("page_id", F.explode(items).alias("a"))
    return rows.select("page_id", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), html_page_text("a").alias("label"))


# ---- records --------------------------------------------------------------------------------


@query("src_24_frontmatter", s.sql(r"""
SELECT seq, CASE WHEN seq % 6 = 0 THEN NULL ELSE trim(title || ': ' || source) END AS title, CASE WHEN seq % 6 = 0 THEN NULL ELSE (seq + 1)::VARCHAR END AS score, md5(CASE WHEN seq % 6 = 0 THEN '' ELSE trim(text, E' \n\t\r') END) AS section_md5 FROM postings""", "postings"))
def frontmatter(t: Tables) -> DataFrame:
    """Documents as package files, with Windows line ends, a repeated key and a value that holds a colon; some without a block."""
    p = t.postings
    nl = F.lit("\r\n")
    block = F.concat(
        F.lit("---"), nl, F.lit("title: "), p["title"], F.lit(": "), p["source"], nl, F.lit("score: 1"), nl, F.lit("no separator"), nl,
        F.lit("score: "), (p["seq"] + 1).cast("string"), nl, F.lit("---"), nl, F.lit("# x\n<!--cover:start-->\n"), p["text"], F.lit("\n<!--cover:end-->\n"),
    )
    files = p.select("seq", F.when(p["seq"] % 6 == 0, "plain").otherwise(block).alias("value"))
    return records.frontmatter_rows(files).select(
        "seq", F.try_element_at("meta", F.lit("title")).alias("title"), F.try_element_at("meta", F.lit("score")).alias("score"), F.md5("section").alias("section_md5")
    )


@query("src_26_run_stats_scan", f"""
SELECT {s.shown("date_trunc('second', ts)")} AS stamp, (event_id % 50)::BIGINT AS considered, (user_id)::BIGINT AS written FROM events WHERE event_id % 5 NOT IN (3, 4) AND ts >= TIMESTAMP '2024-01-10'""")
def stats_scan(t: Tables) -> DataFrame:
    """Events as counter lines; one in five is cut short, one in five has no readable stamp."""
    k = F.col("event_id")
    at = F.when(k % 5 == 4, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    line = F.to_json(F.struct(at.alias("at"), (k % 50).alias("considered"), F.col("user_id").alias("written")))
    lines = t.events.select(F.when(k % 5 == 3, F.left(line, F.lit(20))).otherwise(line).alias("value"))
    return records.run_stats(lines, stamp("2024-01-10 00:00:00")).select(shown("at").alias("stamp"), "considered", "written")


def log_lines(t: Tables) -> DataFrame:
    """Events as log lines: run ends, drops, failures, forged lines and titles that only look like counters."""
    k = F.col("event_id") % 6
    at = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000Z"))
    line = (
        F.when(k == 0, F.concat(at, F.lit(" Done. Considered "), (F.col("user_id")).cast("string"), F.lit(" new, wrote 2 application package(s)")))
        .when(k == 1, F.concat(at, F.lit("   · skip [12 / llm 40] dou: QA"))).when(k == 2, F.concat(at, F.lit("   · llm failed again for: QA")))
        .when(k == 3, F.concat(at, F.lit(" title Done. Considered 500 new, wrote 500"))).when(k == 4, F.concat(F.lit("x\r"), at, F.lit(" Done. Considered 9 new, wrote 9")))
        .otherwise("2024-99-99T00:00:00Z Done. Considered 1 new, wrote 1")
    )
    return t.events.select(line.alias("value"))


@query("src_27_log_counters", """
SELECT (count(*) FILTER (k = 0 AND late OR k = 5))::BIGINT AS runs, coalesce(sum(CASE WHEN k = 0 AND late THEN user_id WHEN k = 5 THEN 1 END), 0)::BIGINT AS considered,
  coalesce(sum(CASE WHEN k = 0 AND late THEN 2 WHEN k = 5 THEN 1 END), 0)::BIGINT AS written, count(*) FILTER (k = 1 AND late) AS dropped, count(*) FILTER (k = 2 AND late) AS failed
FROM (SELECT event_id % 6 AS k, user_id, date_trunc('second', ts) >= TIMESTAMP '2024-01-15' AS late FROM events)""")
def log_counters(t: Tables) -> DataFrame:
    return records.log_totals(records.log_counts(log_lines(t)), stamp("2024-01-15 00:00:00"))


@query("src_29_unread_threads", "SELECT conv_id::VARCHAR AS thread, coalesce(arg_min(label, struct_pack(a := label = '', b := turn)), '') AS label FROM (SELECT conv_id, turn, CASE WHEN turn = 0 THEN '' ELSE role END AS label FROM conversations) GROUP BY conv_id")
def unread(t: Tables) -> DataFrame:
    c = t.table("conversations")
    links = c.select(
        F.col("turn").alias("seq"), F.concat(F.lit("/my/inbox/thread/"), F.col("conv_id").cast("string"), F.lit("?page=1")).alias("href"),
        F.when(F.col("turn") == 0, "").otherwise(F.col("role")).alias("label"),
    )
    return unread_threads(links)


@query("src_30_verdict_json", "SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE (doc_id % 101)::VARCHAR END AS score, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE length(text)::BIGINT END AS n FROM documents")
def verdict_json(t: Tables) -> DataFrame:
    """Answers around every document: clean JSON, JSON after prose with braces, raw line breaks inside, no JSON."""
    k, n = F.col("doc_id"), (F.col("doc_id") % 101).cast("string")
    raw = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    clean = F.to_json(F.struct((k % 101).alias("score"), F.col("text").alias("why")))
    answer = (
        F.when(k % 4 == 0, clean).when(k % 4 == 1, F.concat(F.lit('For {company}: {"note": 1} then '), clean, F.lit(" } done")))
        .when(k % 4 == 2, F.concat(F.lit('Here: {"score": '), n, F.lit(', "why": "'), raw, F.lit('"}'))).otherwise(F.lit("no json {at all"))
    )
    out = pages.verdict_json(t.table("documents").select("doc_id", answer.alias("answer")))
    return out.select("doc_id", F.get_json_object("verdict", "$.score").alias("score"), F.length(F.get_json_object("verdict", "$.why")).cast("bigint").alias("n"))
