"""URL columns. One anchored pattern per part, so a malformed URL yields "" instead of failing."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import fixed
from gleaner.functions.text import once, text_or_blank

_AUTHORITY = r"(?i)^([a-z][a-z0-9+.-]*)://(?:([^/?#@]*)@)?(\[[^\]]*\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?"
_DEFAULT_PORT = {"http": "80", "https": "443"}


_SEPARATOR = "\x01"
_WHOLE = r"(?is)^([a-z][a-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@\s]+)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_parts(url) -> Column:
    """struct(scheme, host, port, path, query); host is "" for a value that is not a URL. One pattern, one pass."""
    cut = F.split(F.regexp_replace(text_or_blank(url), _WHOLE, _SEPARATOR.join(["$1", "$2", "$3", "$4", "$5"])), _SEPARATOR)

    def tidy(p: Column) -> Column:
        part = lambda i: F.when(F.size(p) == 5, F.element_at(p, i)).otherwise("")
        scheme, host, port, path = F.lower(part(1)), F.lower(part(2)), part(3), part(4)
        default = F.lit(False)
        for name, number in _DEFAULT_PORT.items():
            default = default | ((scheme == name) & (port == number))
        return F.struct(
            scheme.alias("scheme"), host.alias("host"), F.when(default, "").otherwise(port).alias("port"),
            F.when((path == "") & (host != ""), "/").otherwise(path).alias("path"), part(5).alias("query"),
        )

    return once(cut, tidy)


def url_host(url) -> Column:
    return F.lower(F.regexp_extract(text_or_blank(url), _AUTHORITY, 3))


def url_key(url) -> Column:
    """host[:port] + path; the value itself when it is not a URL."""
    def key(p: Column) -> Column:
        port = F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise("")
        return F.when(p["host"] == "", text_or_blank(url)).otherwise(F.concat(p["host"], port, p["path"]))

    return once(url_parts(url), key)


def link_key(url) -> Column:
    """One spelling per posting page: no www, no trailing slash, no tracking parameters; "" if not a URL."""
    def trimmed(p: Column) -> Column:
        kept = F.filter(F.split(p["query"], "&"), lambda q: (q != "") & ~q.rlike(fixed.TRACKING_PARAM))
        pairs = F.transform(kept, lambda q: F.when(q.contains("="), q).otherwise(F.concat(q, F.lit("="))))
        return F.struct(
            F.regexp_replace(p["host"], r"^www\.", "").alias("host"), F.regexp_replace(p["path"], r"/+$", "").alias("path"),
            F.array_join(F.array_sort(pairs), "&").alias("query"),
        )

    def key(p: Column) -> Column:
        board = []
        for *_, link_host, link_path in fixed.BOARDS:
            if link_host:
                found = F.regexp_extract(p["path"], link_path, 0)
                board.append(F.when((p["host"] == link_host) & (found != ""), F.concat(p["host"], found)))
        query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
        return F.when(p["host"] == "", "").otherwise(F.coalesce(*board, F.concat(p["host"], p["path"], query)))

    return once(once(url_parts(url), trimmed), key)


def is_http_url(url) -> Column:
    return text_or_blank(url).rlike(r"(?i)^https?://")


def safe_url(url) -> Column:
    return F.when(is_http_url(url), text_or_blank(url)).otherwise("#")


def is_public_https(url) -> Column:
    """https, no port, no credentials, a dotted name that is neither an address nor a local name."""
    def public(p: Column) -> Column:
        host = F.regexp_replace(p["host"], r"\.$", "")
        return (
            (p["scheme"] == "https") & (p["port"] == "") & host.contains(".") & ~host.rlike(r"^[0-9.]+$")
            & ~host.startswith("[") & ~host.rlike(fixed.LOCAL_HOST_SUFFIX)
        )

    return once(url_parts(url), public) & ~text_or_blank(url).rlike(r"(?i)^https://[^/?#]*@")


def ipv4_number(address) -> Column:
    parts = F.split(text_or_blank(address), r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(1, 5):
        octet = F.try_element_at(parts, F.lit(i)).try_cast("bigint")
        number = number * 256 + F.when(octet.between(0, 255), octet)
    return number


def _in_ipv4(number: Column) -> Column:
    """The blocked networks as ranges of one number: literals, so no lookup table travels."""
    inside = F.lit(False)
    for net, bits in fixed.PRIVATE_IPV4:
        block = ipaddress.ip_network(f"{net}/{bits}")
        inside = inside | number.between(int(block.network_address), int(block.broadcast_address))
    return inside


def is_private_ipv4(address) -> Column:
    return F.coalesce(_in_ipv4(ipv4_number(address)), F.lit(True))


def ipv6_halves(address) -> Column:
    """struct(hi, lo): the two 64-bit halves of an IPv6 address, both NULL if it is none.

    Any spelling: one run of zeros left out, a dotted IPv4 tail, a zone behind a percent sign.
    """
    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":"))

    def spelled_out(text: Column) -> Column:
        sides = F.split(text, "::")
        left, right = groups(sides[0]), groups(F.coalesce(F.try_element_at(sides, F.lit(2)), F.lit("")))
        zeros = 8 - F.size(left) - F.size(right)
        return F.when(F.size(sides) == 1, left).when((F.size(sides) == 2) & (zeros > 0), F.concat(left, F.array_repeat(F.lit("0"), zeros), right))

    def halves(parts: Column) -> Column:
        valid = (F.size(parts) == 8) & F.forall(parts, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        number = lambda start: F.aggregate(
            F.slice(parts, start, 4), F.lit(0).cast("bigint"),
            lambda acc, g: F.shiftleft(acc, 16).bitwiseOR(F.conv(g, 16, 10).cast("bigint")),
        )
        return F.struct(F.when(valid, number(1)).alias("hi"), F.when(valid, number(5)).alias("lo"))

    text = F.lower(F.regexp_replace(text_or_blank(address), "%.*$", ""))
    tail = F.regexp_extract(text, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    inner = ipv4_number(tail)
    hexed = F.concat(F.regexp_replace(text, r"[0-9.]+$", ""), F.lower(F.hex(F.floor(inner / 65536))), F.lit(":"), F.lower(F.hex(inner % 65536)))
    return once(once(F.when(tail == "", text).otherwise(hexed), spelled_out), halves)


def _in_ipv6(halves: Column, net: str, bits: int) -> Column:
    """Do the first ``bits`` of the address equal those of the network."""
    number = int(ipaddress.IPv6Address(net))
    signed = lambda n: n - (1 << 64) if n >> 63 else n
    if bits <= 64:
        return F.shiftrightunsigned(halves["hi"], 64 - bits) == number >> (128 - bits)
    return (halves["hi"] == signed(number >> 64)) & (F.shiftrightunsigned(halves["lo"], 128 - bits) == (number & ((1 << 64) - 1)) >> (128 - bits))


def is_private_ipv6(address) -> Column:
    """An address of a blocked network, or one that carries a blocked IPv4 address (mapped or NAT64); unreadable ones are too."""
    def judged(halves: Column) -> Column:
        carried = _in_ipv6(halves, "::ffff:0:0", 96) | _in_ipv6(halves, *fixed.NAT64)
        blocked = F.lit(False)
        for net, bits in fixed.PRIVATE_IPV6:
            blocked = blocked | _in_ipv6(halves, net, bits)
        return F.coalesce(F.when(carried, _in_ipv4(halves["lo"].bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(blocked), F.lit(True))

    return once(ipv6_halves(address), judged)


def is_private_address(address) -> Column:
    """Is an address of either family no public one. What can not be read as an address counts as private."""
    return F.when(text_or_blank(address).contains(":"), is_private_ipv6(address)).otherwise(is_private_ipv4(address))


def resolves_public(urls: DataFrame, addresses: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` whose host has at least one address, of either family, and no private one (``addresses``: host, address)."""
    verdict = addresses.groupBy("host").agg(F.max(is_private_address("address").cast("int")).alias("_private"))
    return (
        urls.withColumn("host", url_host(F.col(url)))
        .join(verdict, "host", "left")
        .withColumn("resolves_public", F.coalesce(F.col("_private") == 0, F.lit(False)))
        .drop("_private")
    )


def _host_or_subdomain(host: Column, base: Column) -> Column:
    return (host == base) | host.endswith(F.concat(F.lit("."), base))


def _on_board(p: Column, board: tuple) -> Column:
    """The parsed url is on the board's host, over http(s), without an explicit port."""
    host = board[3]
    return p["scheme"].isin("http", "https") & (p["port"] == "") & _host_or_subdomain(p["host"], F.lit(host))


_PROBED = [b for b in fixed.BOARDS if b[3]]


def on_board_host(source, url) -> Column:
    """Is the url on its source's own host; false for boards that cannot be probed."""
    source = F.col(source) if isinstance(source, str) else source

    def check(p: Column) -> Column:
        on = F.lit(False)
        for board in _PROBED:
            on = on | ((source == board[0]) & _on_board(p, board))
        return F.coalesce(on, F.lit(False))

    return once(url_parts(url), check)


def board_of(source, url) -> Column:
    """The board a URL can be probed on: its own source first, else the first board whose host it is on."""
    source = F.col(source) if isinstance(source, str) else source

    def find(p: Column) -> Column:
        own = [F.when((source == b[0]) & _on_board(p, b), source) for b in _PROBED]
        return F.coalesce(*own, *[F.when(_on_board(p, b), F.lit(b[0])) for b in _PROBED])

    return once(url_parts(url), find)


def same_site(url, base) -> Column:
    """Redirect rule: no downgrade, same port, the same host, a subdomain, or exactly one dotted parent."""
    def check(both: Column) -> Column:
        to, start = both["to"], both["start"]
        parent = F.regexp_extract(start["host"], r"^[^.]*\.(.*)$", 1)
        host_ok = _host_or_subdomain(to["host"], start["host"]) | (parent.contains(".") & (to["host"] == parent))
        return (
            (to["host"] != "") & (start["host"] != "") & to["scheme"].isin("http", "https")
            & ~((start["scheme"] == "https") & (to["scheme"] != "https")) & (to["port"] == start["port"]) & host_ok
        )

    return once(F.struct(url_parts(url).alias("to"), url_parts(base).alias("start")), check)


def canonical_job_url(href, host: str) -> Column:
    """Absolute URL on ``host`` without its query; "" for anything that leaves the site."""
    path = F.split_part(text_or_blank(href), F.lit("?"), F.lit(1))
    absolute = F.when(_host_or_subdomain(url_host(path), F.lit(host)), path).otherwise("")
    relative = F.when(path.startswith("/"), F.concat(F.lit(f"https://www.{host}"), path)).otherwise("")
    return F.when(path.startswith("http"), absolute).otherwise(relative)


def undouble(c) -> Column:
    """"XX" -> "X": a title rendered twice on one line."""
    t = text_or_blank(c)
    half = F.substring(t, F.lit(1), F.floor(F.length(t) / 2).cast("int"))
    return F.when((F.concat(half, half) == t) & (t != ""), half).otherwise(t)


def parse_alt_links(c) -> Column:
    """array<struct<source,url>> of "source|url, source|url"; pairs without a usable link are dropped."""
    pairs = F.transform(F.split(text_or_blank(c), r",\s*(?=[a-z]+\|)"), lambda p: F.trim(p))
    links = F.transform(
        F.filter(pairs, lambda p: p.contains("|")),
        lambda p: F.struct(
            F.regexp_extract(p, r"(?s)^([^|]*)\|", 1).alias("source"),
            F.regexp_extract(p, r"(?s)^[^|]*\|(.*)$", 1).alias("url"),
        ),
    )
    return F.filter(links, lambda l: l["url"].rlike(r"(?i)^https?://"))
