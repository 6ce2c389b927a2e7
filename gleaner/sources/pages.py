"""Crawled HTML pages: blocks, structured data, charset, page classes, cards, frontier."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gleaner import fixed
from gleaner.functions.html import decode_entities, html_to_text, strip_blocks
from gleaner.functions.text import compose_text, of_each, once, one_line, text_or_blank
from gleaner.functions.urls import canonical_job_url, undouble

_DIV = r"(?iu)</?div(?![\p{L}\p{N}_])[^>]*+>"
_CLASS = re.compile(r"""class=["']([^"']*)["']""", re.IGNORECASE)


def _inner_div(html: Column, wanted: str) -> Column:
    """The div tags and what stands between them: find the opener, then the tag that brings the depth back to zero."""
    opens = lambda tag: F.lower(F.regexp_extract(tag, f"(?iu){_CLASS.pattern}", 1)).contains(wanted)

    def step(a: Column, tag: Column) -> Column:
        """Of the tags so far: their number, the opener's place, the depth behind them, the place of the end; 0 is none."""
        closing, at = tag.startswith("</"), a["at"] + 1
        first = F.when(a["first"] > 0, a["first"]).when(~closing & opens(tag), at).otherwise(0)
        depth = F.when(a["first"] > 0, a["depth"] + F.when(closing, -1).otherwise(1)).otherwise(1)
        last = F.when(a["last"] > 0, a["last"]).when((a["first"] > 0) & (depth == 0), at).otherwise(0)
        return F.struct(at.alias("at"), first.alias("first"), depth.alias("depth"), last.alias("last"))

    def cut(found: Column) -> Column:
        tags, between, first, last = (found[c] for c in ("tags", "between", "first", "last"))
        inside = F.when(last > 0, last - 1).otherwise(F.size(tags)) - first
        nested = F.zip_with(F.slice(tags, first + 1, inside), F.slice(between, first + 2, inside), lambda tag, text: F.concat(tag, text))
        return F.when(first > 0, F.concat(F.element_at(between, first + 1), F.array_join(nested, ""))).otherwise("")

    def placed(tags: Column) -> Column:
        none = F.struct(*[F.lit(0).alias(c) for c in ("at", "first", "depth", "last")])
        return once(F.aggregate(tags, none, step), lambda a: F.struct(tags.alias("tags"), F.split(html, _DIV).alias("between"), a["first"].alias("first"), a["last"].alias("last")))

    return once(once(F.regexp_extract_all(html, F.lit(_DIV), F.lit(0)), placed), cut)


def div_block_of(html: Column, class_name: str) -> Column:
    """Inner HTML of the first div whose class contains the name, nested divs included; blank where there is none."""
    wanted = class_name.lower()
    return once(strip_blocks(html), lambda page: F.when(F.lower(page).contains(wanted), _inner_div(page, wanted)).otherwise(""))


BLOCK = pa.struct([("tag", pa.string()), ("classes", pa.string()), ("depth", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])


def _blocks(html: str, tag_pattern: re.Pattern, tags: tuple[str, ...]) -> list[dict]:
    """One pass over the tags of interest: each is pushed once and taken off once, whatever closes it.

    Lists are looked at beside the tags asked for: an item ends the one before it only in the same list.
    """
    found: list[dict] = []
    open_: list[tuple[str, dict | None]] = []
    times: Counter = Counter()
    depth = 0

    def end_one(at: int) -> str:
        nonlocal depth
        tag, block = open_.pop()
        if block:
            block["length"] = at - block["start"]
            depth -= 1
        times[tag] -= 1
        return tag

    at = 0
    while m := tag_pattern.search(html, at):
        end = html.find(">", m.end())
        if end < 0:
            break  # no whole tag is left
        tag, at = m.group(2).lower(), end + 1
        if m.group(1):
            if times[tag]:  # an end tag that ends nothing is passed over, any other ends all that is open inside
                while end_one(m.start()) != tag:
                    pass
            continue
        if tag == "li" and open_ and open_[-1][0] == "li":
            end_one(m.start())
        block = None
        if tag in tags:
            names = _CLASS.search(html[m.end() : end])
            depth += 1
            block = {"tag": tag, "classes": names.group(1) if names else "", "depth": depth, "start": at, "length": 0}
            found.append(block)
        open_.append((tag, block))
        times[tag] += 1
    while open_:
        end_one(len(html))
    return found


def page_blocks(html: Column, tags: tuple[str, ...] = ("div", "li")) -> Column:
    """array<struct<tag, classes, depth, start, length>>: every element of the given tags, in page order.

    Places are code points of ``strip_blocks(html)``, depth counts open elements of these tags. Inner texts are cut out by
    ``block_html``: a deep page would hold each of its characters once a level. A new list item ends the open one beside it.
    """
    pattern = rf"<(/?)({'|'.join(sorted({*tags, 'ul', 'ol'}))})(?![a-zA-Z0-9-])"

    @F.arrow_udf("array<struct<tag:string,classes:string,depth:int,start:bigint,length:bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tag_pattern = re.compile(pattern, re.IGNORECASE)
        for batch in batches:
            yield pa.array([_blocks(v.as_py() or "", tag_pattern, tags) for v in batch], pa.list_(BLOCK))

    return run(strip_blocks(html))


def block_html(html: Column, block: Column) -> Column:
    """Inner HTML of one of the ``page_blocks`` of a page."""
    return F.substring(strip_blocks(html), (block["start"] + 1).cast("int"), block["length"].cast("int"))


def block_cards(pages: DataFrame, tag: str = "li") -> DataFrame:
    """The list items of crawled pages as cards: (..., ord, title, href): the text of the item and its first link."""
    blocks = pages.select("*", F.posexplode(page_blocks(F.col("html"), (tag,))).alias("ord", "_b"))
    inner = blocks.withColumn("_inner", block_html(F.col("html"), F.col("_b"))).drop("_b", "html")
    href = F.regexp_extract("_inner", r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1)
    return inner.withColumns({"title": html_to_text(F.col("_inner")), "href": href}).drop("_inner")


# ---- structured data -----------------------------------------------------------

def jsonld_description(html: Column) -> Column:
    """Text of the first JobPosting description in a page's ld+json scripts: one node, an array or a graph."""
    scripts = F.regexp_extract_all(
        text_or_blank(html), F.lit(r"(?is)<script(?![a-z0-9_])([^>]*+)>(.*?)</script"), F.lit(0)
    )
    linked = F.filter(scripts, lambda s: s.rlike(r"(?is)^<script[^>]*application/ld\+json"))
    bodies = F.transform(linked, lambda s: F.regexp_replace(s, r"(?is)^<script[^>]*+>|</script$", ""))
    node = "struct<`@type`:string,description:string>"

    def nodes(body: Column) -> Column:
        kind = F.left(F.ltrim(body), F.lit(1))
        many = F.from_json(body, f"array<{node}>")
        one = F.from_json(body, f"struct<`@type`:string,description:string,`@graph`:array<{node}>>")

        def listed(one: Column) -> Column:
            single = F.array(F.struct(one["@type"].alias("@type"), one["description"].alias("description")))
            return F.concat(single, F.coalesce(one["@graph"], F.array().cast(f"array<{node}>")))

        return F.when(kind == "[", many).otherwise(once(one, listed))

    # "@type" may be a string or a list; read as text, a list keeps its brackets.
    posting = lambda n: n["@type"].rlike(r'^JobPosting$|^\[.*"JobPosting".*\]$') & (n["description"] != "")
    found = F.filter(F.flatten(F.transform(bodies, lambda body: once(body, nodes))), posting)
    description = F.coalesce(F.try_element_at(found, F.lit(1))["description"], F.lit(""))
    unescaped = lambda d: F.when(d.rlike(r"(?i)&lt;/?[a-z]"), decode_entities(d)).otherwise(d)
    return html_to_text(once(description, unescaped))


# ---- charset ------------------------------------------------------------------

def charset_of(content_type: Column, head: Column) -> Column:
    """The header's label, else that of the document's own head, else utf-8.

    The head is scanned once for tags that may name a charset; a ``meta`` goes before an XML declaration, and of several
    the first counts.
    """
    named = lambda text: F.regexp_extract(text, r"""(?i)(?:charset|encoding)\s*=\s*["']?([\w-]+)""", 1)
    tags = F.regexp_extract_all(text_or_blank(head), F.lit(r"(?i)<(?:meta\s|\?xml\s)[^>]*+>"), F.lit(0))
    told = F.transform(tags, lambda tag, i: F.struct(tag.startswith("<?").alias("xml"), i.alias("place"), named(tag).alias("label")))
    own = F.array_min(F.filter(told, lambda t: t["label"] != ""))["label"]
    label = F.lower(F.coalesce(F.nullif(named(text_or_blank(content_type)), F.lit("")), own, F.lit("utf-8")))
    meant = F.create_map(*[F.lit(v) for pair in fixed.WEB_LABELS.items() for v in pair])
    return F.coalesce(F.try_element_at(meant, label), label)


def _upper_halves(labels: list[str]) -> dict[str, str]:
    """What the bytes from 0x80 on mean, by label, in charsets of one byte a character whose lower half is ASCII."""
    return {label: bytes(range(0x80, 0x100)).decode(label, errors="replace") for label in labels}


_LATIN = "".join(map(chr, range(0x80, 0x100)))
BYTE_CHARSETS = _upper_halves([
    *(f"windows-125{i}" for i in range(9)), *(f"iso-8859-{i}" for i in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)), "koi8-r", "koi8-u", "ibm866",
])


def _decode_one(raw: bytes, label: str) -> str:
    try:
        return raw.decode(label, errors="replace")
    except LookupError:
        return raw.decode("utf-8", errors="replace")


@F.arrow_udf(StringType())
def _decode_legacy(body: pa.Array, charset: pa.Array) -> pa.Array:
    return of_each(_decode_one, body, charset)


def decode_body(bodies: DataFrame, body: str = "body", content_type: str = "content_type", head_bytes: int = 2048) -> DataFrame:
    """Adds charset and html. UTF-8 and charsets of one byte a character are decoded in the JVM; the others take the Arrow path.

    A body without a header's label names its charset in its first ``head_bytes`` bytes, as browsers expect, or not at all.
    """
    head = F.decode(F.substring(F.col(body), 1, head_bytes), "ISO-8859-1")
    labelled = bodies.withColumn("charset", charset_of(F.col(content_type), head))
    charset = F.col("charset")
    plain, bytewise = charset.isin("utf-8", "utf8"), charset.isin(*BYTE_CHARSETS)

    def meant(latin: Column) -> Column:
        found = F.when(latin.rlike(r"^[\x00-\x7F]*+$"), latin)
        for label, upper in BYTE_CHARSETS.items():
            moved = [(a, b) for a, b in zip(_LATIN, upper) if a != b]
            found = found.when(charset == label, F.translate(latin, "".join(a for a, _ in moved), "".join(b for _, b in moved)))
        return found

    legacy = _decode_legacy(F.when(~plain & ~bytewise, F.col(body)), charset)
    told = F.when(plain, F.col(body).cast("string")).when(bytewise, once(F.decode(F.col(body), "ISO-8859-1"), meant))
    return labelled.withColumn("html", told.otherwise(legacy))


# ---- page classes, cards, frontier ----------------------------------------------

def classify_page(body, page_no, cards, parsed, marker: str = "jobs-filter") -> Column:
    """struct(status, reason): ok, end of results, or cut with a reason."""
    body, page_no = F.col(body), F.col(page_no)
    cards, parsed = F.col(cards), F.col(parsed)
    cut = lambda reason: F.struct(F.lit("cut").alias("status"), F.lit(reason).alias("reason"))
    quiet = lambda status: F.struct(F.lit(status).alias("status"), F.lit("").alias("reason"))
    return (
        F.when(body.isNull(), quiet("end"))
        .when(body == "", cut("fetch failed"))
        .when((cards > 0) & (parsed == 0), cut("no parsable cards"))
        .when((page_no == 1) & (cards == 0) & ~body.contains(marker), cut("not a search page"))
        .when(parsed == 0, quiet("end"))
        .otherwise(quiet("ok"))
    )


#: What a body of each kind must look like, and the reason when it does not.
BODY_KINDS = {
    "feed": (r"(?i)<(rss|channel|feed)[\s>]", "not a feed"),
    "channel": (r'class="tgme_channel_history(?![a-zA-Z0-9_])', "not a public channel preview"),
}


def classify_body(kind: Column, body: Column) -> Column:
    """struct(status, reason) of a fetched feed, API or channel body, by its board's own rule.

    A blank body is a failed fetch. An API answer must hold a list of jobs, and an empty list ends the search (a short
    page does not); a channel preview without an older-page cursor is the channel's last page.
    """
    text = text_or_blank(body)
    state = lambda status, reason="": F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
    cut = lambda reason: state("cut", reason)
    jobs = F.from_json(text, "struct<jobs:array<string>>")["jobs"]
    api = F.when(jobs.isNull(), cut("not a jobs response")).when(F.size(jobs) == 0, state("end")).otherwise(state("ok"))
    (feed, no_feed), (channel, no_channel) = BODY_KINDS["feed"], BODY_KINDS["channel"]
    older = text.rlike(r'class="tme_messages_more[^"]*"[^<>]*?data-before="[0-9]+"')
    preview = F.when(~text.rlike(channel), cut(no_channel)).when(older, state("ok")).otherwise(state("last"))
    return (
        F.when(text == "", cut("fetch failed")).when(kind == "api", api).when(kind == "channel", preview)
        .otherwise(F.when(text.rlike(feed), state("ok")).otherwise(cut(no_feed)))
    )


def card_rows(cards: DataFrame, host: str) -> DataFrame:
    """Browser cards (title, href, company, location) cleaned: first line of each field, doubled titles halved,
    cards without title, without href or off the host dropped."""
    first_line = lambda c: F.trim(F.split_part(F.trim(text_or_blank(c)), F.lit("\n"), F.lit(1)))
    return cards.withColumns({
        "title": one_line(undouble(first_line("title"))), "company": one_line(first_line("company")),
        "location": one_line(first_line("location")), "url": canonical_job_url(F.col("href"), host),
    }).filter("title <> '' AND url <> ''").drop("href")


def crawl_frontier(searches: DataFrame, pages: int, base: str) -> DataFrame:
    """Search x page urls with encoded parameters; page 1 carries no page number. searches: query, country."""
    each = searches.withColumn("page_no", F.explode(F.sequence(F.lit(1), F.lit(pages))))
    enc = lambda c: F.url_encode(text_or_blank(c))
    country = F.when(text_or_blank("country") != "", F.concat(F.lit("&country="), enc("country"))).otherwise("")
    page = F.when(F.col("page_no") > 1, F.concat(F.lit("&page="), F.col("page_no").cast("string"))).otherwise("")
    return each.withColumn("url", F.concat(F.lit(f"{base}?q="), enc("query"), country, F.lit("&sort=recent"), page))


def enrich(postings: DataFrame, details: DataFrame, known: DataFrame, skip: Column | None = None) -> DataFrame:
    """Full text replaces the snippet of unknown postings only; details: (url, full_text, posted); known: (seq).

    ``skip`` is the caller's own predicate for postings to leave alone. The known postings are left out
    before the join, so their detail rows are never shuffled for nothing.
    """
    flagged = postings.join(known.select("seq", F.lit(True).alias("_known")), "seq", "left")
    if skip is not None:
        flagged = flagged.withColumn("_known", F.when(F.col("_known") | F.coalesce(skip, F.lit(False)), True))
    usable = details.filter(text_or_blank("full_text") != "").select("url", "full_text", F.col("posted").alias("_posted"))
    todo = flagged.filter("_known IS NULL").join(usable, "url", "left")
    done = todo.withColumns({
        "text": F.when(F.col("full_text").isNotNull(), compose(F.col("full_text"))).otherwise(F.col("text")),
        "posted": F.coalesce("_posted", "posted"),
        "enriched": F.col("full_text").isNotNull(),
    }).drop("full_text", "_posted", "_known")
    rest = flagged.filter("_known").drop("_known").withColumn("enriched", F.lit(False))
    return done.unionByName(rest)


def compose(full: Column) -> Column:
    return compose_text("title", "company", "location", full)


# ---- answers of an external scorer -------------------------------------------------

_JSON_MARKS = re.compile(r'"(?:[^"\\]|\\.)*+"|[{}]', re.DOTALL)


def _json_objects(text: str) -> Iterator[dict]:
    """Objects of the outermost brace blocks, left to right, in one pass; a block that does not parse is passed over whole.

    A brace that nothing closes counts for nothing: the blocks inside it are then outermost. Inside a block, braces in
    strings do not count; line breaks in strings are allowed.
    """
    opened: list[int] = []
    blocks: list[tuple[int, int]] = []
    at = text.find("{")
    while at != -1:
        m = _JSON_MARKS.search(text, at)
        if m is None:
            break
        at = m.end()
        if m.group() == "{":
            opened.append(m.start())
        elif m.group() == "}":
            start = opened.pop()
            while blocks and blocks[-1][0] > start:
                blocks.pop()
            blocks.append((start, at))
            if not opened:
                at = text.find("{", at)
    decoder = json.JSONDecoder(strict=False)
    for start, end in blocks:
        try:
            yield decoder.decode(text[start:end])
        except ValueError:
            continue


def verdict_json(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Adds verdict (JSON text): the first object with a score, else the first object, of a noisy answer.

    Clean bodies are recognised in the JVM; only noisy ones go through Arrow batches.
    """
    @F.pandas_udf(StringType())
    def pick(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            found = list(_json_objects(t))
            best = next((o for o in found if "score" in o), found[0] if found else None)
            return None if best is None else json.dumps(best, ensure_ascii=False)

        return texts.map(one)

    c = F.col(column)
    # one flat object and nothing else; whatever has more braces is read block by block
    clean = c.rlike(r'^\s*\{[^{}]*\}\s*$') & F.get_json_object(c, "$.score").isNotNull() & F.try_parse_json(c).isNotNull()
    return answers.withColumn("verdict", F.when(clean, F.trim(c)).otherwise(pick(F.when(~clean, c))))
