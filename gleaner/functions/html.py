"""HTML to text as column expressions: possessive patterns keep every scan linear."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import once, squeeze, text_or_blank

# A comment, an element tag (a quote opens a value only after "="), or a closing / declaration tag. The "<" stands before
# all alternatives, so any other character is passed over by one comparison.
_COMMENT = r"!(?=--)(?:(?s:.*?)-->|(?s:.*+)$)"
_ELEMENT = r"""[a-zA-Z](?:[^<>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+>"""
_OTHER_TAG = r"[/!][^<>]*+>"
TAG = f"<(?:{_COMMENT}|{_ELEMENT}|{_OTHER_TAG})"
BLOCKS = (
    r"(?is)<(?:!--(?:>|->|.*?-->|.*+$)"
    r"|script(?![a-z0-9_])(?:.*?</script[^>]*+>|.*+$)"
    r"|style(?![a-z0-9_])(?:.*?</style[^>]*+>|.*+$))"
)
_NAMED = f"(?i)&(?:{'|'.join(fixed.NAMED_ENTITIES)});"
_AMP = "\uE000"  # private character


def strip_blocks(c) -> Column:
    """Without comments, scripts and styles."""
    return F.regexp_replace(text_or_blank(c), BLOCKS, "")


def decode_entities(c) -> Column:
    """Each entity once: a decoded "&" is parked under a private character until the end, so it never starts another."""
    def character(entity: Column) -> Column:
        body = F.regexp_extract(entity, r"&#([^;]*);", 1)
        hexed = F.lower(F.left(body, F.lit(1))) == "x"
        digits = F.when(hexed, F.substring(body, F.lit(2), F.length(body))).otherwise(body)
        point = F.when(F.length(digits) > 10, F.lit(None).cast("bigint")).otherwise(
            F.when(hexed, F.conv(digits, 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))
        )
        garbage = (point == 0) | point.between(0xD800, 0xDFFF)
        return (
            F.when(garbage, "")
            .when(point == 38, _AMP)
            .when(point <= 0x10FFFF, F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32"))
            .otherwise(F.concat(F.lit(_AMP), F.substring(entity, F.lit(2), F.length(entity))))
        )

    def numbered(t: Column) -> Column:
        entities = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?i)&#(?:[0-9]+|x[0-9a-f]+);"), F.lit(0)))
        replaced = F.aggregate(entities, t, lambda acc, e: F.replace(acc, e, character(e)))
        return F.when(t.contains("&#"), replaced).otherwise(t)

    def decoded(t: Column) -> Column:
        named = t
        for name, value in fixed.NAMED_ENTITIES.items():
            named = F.regexp_replace(named, f"(?i)&{name};", value)
        named = F.regexp_replace(F.when(t.rlike(_NAMED), named).otherwise(t), r"(?i)&amp;", _AMP)
        return F.replace(once(named, numbered), F.lit(_AMP), F.lit("&"))

    return once(text_or_blank(c), lambda t: F.when(t.contains("&"), decoded(t)).otherwise(t))


def strip_tags(c) -> Column:
    return F.regexp_replace(text_or_blank(c), TAG, " ")


def html_to_text(c) -> Column:
    """Tags out first, entities decoded second, white space squeezed; "salary < 5000" keeps its text."""
    return squeeze(decode_entities(strip_tags(c)))


def html_page_text(c) -> Column:
    """A whole page: scripts, styles and comments go before the tags do."""
    return html_to_text(strip_blocks(c))


def best_link(c) -> Column:
    """struct(href, explicit): the link whose text says "apply", else the first link, of a post's HTML."""
    # anchors do not nest: a search ends at the next one
    pattern = r'(?is)<a\s[^<>]*?href="(https?://[^"]+)"[^>]*+>((?:(?!<a\s).)*?)</a>'
    anchors = F.regexp_extract_all(text_or_blank(c), F.lit(pattern), F.lit(0))
    explicit = F.filter(
        anchors, lambda a: html_to_text(a).rlike(r"(?i)(^|[^a-z0-9_])apply($|[^a-z0-9_])")
    )
    chosen = F.coalesce(F.try_element_at(explicit, F.lit(1)), F.try_element_at(anchors, F.lit(1)), F.lit(""))
    return F.struct(
        decode_entities(F.regexp_extract(chosen, r'(?i)href="([^"]*)"', 1)).alias("href"),
        (F.size(explicit) > 0).alias("explicit"),
    )
