"""Where a posting may be worked from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import one_line, text_or_blank


def countries_segment(location) -> Column:
    """The countries part of "format · countries · ...": the first part that is no format word, unless it is experience."""
    parts = F.filter(F.transform(F.split(text_or_blank(location), " · "), lambda p: F.trim(p)), lambda p: p != "")
    rest = F.filter(parts, lambda p: ~F.lower(p).rlike(fixed.FORMAT_WORDS))
    first = F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(""))
    return F.when(F.lower(first).rlike(fixed.NOT_A_COUNTRY_WORDS), "").otherwise(first)


def _names_any(text: Column, names: list[str]) -> Column:
    found = F.lit(False)
    for name in names:
        found = found | text.contains(name.lower())
    return found


def names_country(location, countries: list[str]) -> Column:
    segment = F.lower(countries_segment(location))
    return (segment != "") & _names_any(segment, countries)


def eligible(location, countries: list[str]) -> Column:
    segment = F.lower(countries_segment(location))
    return (segment == "") | segment.rlike(fixed.WORLDWIDE_WORDS) | _names_any(segment, countries)


def keeps_location(
    source, location, excluded: list[str], countries: list[str] | None = None, country_only: tuple[str, ...] = (),
) -> Column:
    """The location rule: country-segment boards by their countries, the others by excluded substrings; the
    office-list board keeps a posting when one comma part is remote or a bare office no excluded term names."""
    countries = countries or fixed.CANDIDATE_COUNTRY
    source = F.col(source) if isinstance(source, str) else source
    segment_boards = [b[0] for b in fixed.BOARDS if b[1]]
    by_country = F.when(
        source.isin(list(country_only)) if country_only else F.lit(False), names_country(location, countries)
    ).otherwise(eligible(location, countries))
    loc = F.lower(text_or_blank(location))
    terms = [t.strip().lower() for t in excluded if t.strip()]
    bare = lambda part: ~part.contains("(") & ~_names_any(part, terms)
    office = F.exists(F.split(loc, ","), lambda part: part.rlike(fixed.REMOTE_WORDS) | bare(part))
    by_terms = ~_names_any(loc, terms) | ((source == fixed.OFFICE_LIST_BOARD) & office)
    return F.when(source.isin(segment_boards), by_country).otherwise(by_terms)


def forbids_country(forbidden, countries: list[str] | None = None) -> Column:
    """A plain list of banned places that names the country; "outside" and "except" lists are no ban."""
    f = F.lower(text_or_blank(forbidden))
    return (f != "") & ~f.rlike(fixed.BAN_EXCEPTIONS) & _names_any(f, countries or fixed.CANDIDATE_COUNTRY)


def place_of(location) -> Column:
    """A place without its format words and the connectors they leave behind.

    The field is cut into words and connectors (comma, semicolon, slash, brackets). Words lose their format words; those
    of which nothing is left go. A fold then writes a connector only once a word follows it: the last one of a run, an
    opening bracket over any other, and a closing bracket only for one that was written.
    """
    field = F.regexp_replace(F.regexp_replace(one_line(location), r"\s·\s", ", "), fixed.PLACE_FORMAT, "")
    tokens = F.regexp_extract_all(field, F.lit(r"[(),;/]\s*|[^(),;/]+"), F.lit(0))

    def word(token: Column) -> Column:
        bare = F.regexp_replace(token, r"(?i)^[\s+\-–—]+|(?:[\s+\-–—]+|(?:^|\s+)(?:or|and))+$", "")
        return F.regexp_replace(bare, r"\s{2,}", " ")

    def state(text: Column, link: Column, depth: Column) -> Column:
        return F.struct(text.alias("text"), link.alias("link"), depth.alias("depth"))

    def step(so_far: Column, token: Column) -> Column:
        text, link, depth = so_far["text"], so_far["link"], so_far["depth"]
        first, own = F.left(token, F.lit(1)), word(token)
        opening = link.endswith("(")
        written = F.concat(text, F.when((text == "") & ~opening, "").when(text == "", "(").otherwise(link), own)
        return (
            F.when(first == "(", state(text, F.when(text == "", "(").otherwise(" ("), depth))
            .when((first == ")") & opening, state(text, F.lit(" "), depth))
            .when((first == ")") & (depth > 0), state(F.concat(text, F.lit(")")), F.lit(" "), depth - 1))
            .when(first == ")", so_far)
            .when(first.isin(",", ";", "/"), state(text, F.when(opening, link).otherwise(token), depth))
            .when(own == "", so_far)
            .otherwise(state(written, F.lit(" "), depth + F.when(opening, 1).otherwise(0)))
        )

    start = state(F.lit(""), F.lit(""), F.lit(0))
    return F.aggregate(tokens, start, step, lambda end: F.concat(end["text"], F.repeat(F.lit(")"), end["depth"])))


def compose_location(location, remote, anywhere) -> Column:
    """"Remote · <place>" or "Office · <place>" from a post's fields; nothing to say about the place leaves the format."""
    says = lambda c, word: F.lower(F.regexp_extract(text_or_blank(c), "^[a-zA-Z0-9_]*", 0)) == word
    where = F.nullif(place_of(location), F.lit(""))
    world = F.when(says(anywhere, "yes"), "Worldwide")
    named = F.when(world.isNull() | ~where.rlike("(?i)worldwide|anywhere"), where)
    place = F.nullif(F.concat_ws(", ", world, named), F.lit(""))
    return F.concat_ws(" · ", F.when(says(remote, "no"), "Office").otherwise("Remote"), place)


def countries_location(countries) -> Column:
    """"Remote · A, B" from an array of country names; no restriction is worldwide."""
    named = F.filter(F.transform(countries, lambda c: one_line(c)), lambda c: c != "")
    listed = F.coalesce(F.nullif(F.array_join(named, ", "), F.lit("")), F.lit("Worldwide"))
    return F.concat(F.lit("Remote · "), listed)
