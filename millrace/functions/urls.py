"""URLs as Column expressions: classes, normal forms, crawl filters and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scheme, host, port and path of a URL with an authority.
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?//(?:[^/?#@]*@)?([^/?#:@]+)(:[0-9]+)?([^?#]*)"

# Extensions of attached files and of images, with their types.
DOCUMENT_TYPES = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xls": "application/vnd.ms-excel",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".ppt": "application/vnd.ms-powerpoint",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    ".zip": "application/zip",
    ".rar": "application/vnd.rar",
}
IMAGE_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".gif": "image/gif",
    ".svg": "image/svg+xml",
    ".webp": "image/webp",
    ".ico": "image/x-icon",
}

# Extensions that a crawl never follows.
BLOCKED = """jpg jpeg png gif svg webp ico mp4 mp3 avi mov webm zip tar gz rar exe dmg apk css js map woff woff2 ttf eot""".split()
# Query keys of crawler traps.
TRAP_KEYS = ("sort", "order", "dir", "asc", "desc", "view", "filter")
# Paths without content.
NO_CONTENT = (
    r"(?i)(/(login|signin|sign-in|signup|sign-up|register)(/?$|[/?#])"
    r"|/(logout|signout)(/?$|[/?#])"
    r"|/(cart|checkout|basket|order)(/?$|[/?#])"
    r"|/print(/|$)|/pdf(/|$)|/feed(\.xml|/|$)|/rss(\.xml|/|$)|/sitemap(\.xml|/|$)|/robots\.txt)"
)
# Path words that raise or lower a link's score.
VALUABLE = "docs doc guide tutorial api reference ref blog article articles post posts news learn learning wiki faq help".split()
NOISY = "tag tags category categories author authors page feed rss search archive archives comment comments reply replies".split()
# Anchors that say nothing.
EMPTY_ANCHORS = [
    "read more", "click here", "learn more", "here", "link", "this", "next", "previous", "prev", "home", "back", "top",
    "→", "»", "«", "←", "#", "edit", "share", "print", "subscribe", "more", "details", "view", "see",
]


def part(url: Column, group: int) -> Column:
    """A piece of the URL by PARTS' group; empty where it has none."""
    return F.regexp_extract(url, PARTS, group)


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def query_items(url: Column) -> Column:
    """The raw key=value items of the query."""
    return F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda x: x != "")


def query_keys(url: Column) -> Column:
    return F.array_distinct(F.transform(query_items(url), lambda x: F.substring_index(x, "=", 1)))


def classify_link(href: Column, base_host: Column) -> Column:
    """Internal for the page's host, its subdomains, and links without a host."""
    h, b = host(href), F.lower(base_host)
    return F.when((h == "") | (h == b) | h.endswith(F.concat(F.lit("."), b)), "internal").otherwise("external")


def normalize_for_parser(url: Column) -> Column:
    """No fragment, no utm_ items, the other items sorted by key."""
    keep = F.filter(query_items(url), lambda x: ~F.lower(x).startswith("utm_"))
    order = F.array_sort(F.transform(keep, lambda x, i: F.struct(F.substring_index(x, "=", 1).alias("k"), i.alias("i"), x.alias("x"))))
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    return F.when(F.size(keep) > 0, F.concat(base, F.lit("?"), F.array_join(F.transform(order, lambda s: s["x"]), "&"))).otherwise(base)


def normalize_for_store(url: Column) -> Column:
    """Https by default; scheme, host and path lower-cased; port kept; user, query and fragment dropped; dot
    segments resolved. Null for a URL without a host (D05)."""
    steps = F.split(F.lower(part(url, 4)), "/")
    up = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.concat(s, F.array(x))),
    )
    scheme = F.when(part(url, 1) == "", "https").otherwise(F.lower(part(url, 1)))
    return F.when(host(url) != "", F.concat(scheme, F.lit("://"), host(url), part(url, 3), F.array_join(up, "/")))


def extension(url: Column) -> Column:
    """The ending of the whole URL, so that a query hides it."""
    return F.lower(F.regexp_extract(url, r"(\.[^./]*)$", 1))


def _lookup(types: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in types.items() for x in kv])[key]


def mime_type(url: Column) -> Column:
    return F.coalesce(_lookup({**DOCUMENT_TYPES, **IMAGE_TYPES}, extension(url)), F.lit("application/octet-stream"))


def is_document(url: Column) -> Column:
    return extension(url).isin(*DOCUMENT_TYPES)


def is_image(url: Column) -> Column:
    return extension(url).isin(*IMAGE_TYPES)


def document_description(url: Column, anchor: Column) -> Column:
    """The anchor as PARAGRAPH, else the file's name without its ending as FILENAME."""
    text = F.trim(F.coalesce(anchor, F.lit("")))
    base = F.regexp_extract(url, r"([^/]*)/*$", 1)
    ext = F.regexp_extract(url, r"(\.[^./]*)$", 1)
    name = F.when((ext != "") & (ext == F.lower(ext)), F.substring(base, F.lit(1), F.length(base) - F.length(ext))).otherwise(base)
    return F.when(text != "", F.struct(text.alias("description"), F.lit("PARAGRAPH").alias("source"))).when(
        (name != "") & (name != "."), F.struct(name.alias("description"), F.lit("FILENAME").alias("source"))
    )


def allowed_extension(url: Column) -> Column:
    """K01."""
    return ~F.regexp_replace(F.lower(url), r"[?#].*$", "").rlike(r"\.(" + "|".join(BLOCKED) + ")$")


def no_trap(url: Column) -> Column:
    """The first page number decides, whatever comes later."""
    number = F.regexp_extract(url, r"(?i)[?&/](?:page|p)[=/]([0-9]+)", 1)
    deep = number.rlike("^0*([1-9][0-9]{2,}|5[1-9]|[6-9][0-9])$")
    keys = F.exists(query_keys(url), lambda k: F.lower(k).isin(*TRAP_KEYS))
    return ~(url.rlike("(?i)/cdn-cgi/") | url.rlike(r"(?i)/(?:calendar|events?)/[0-9]{4}") | deep | keys)


def few_parameters(url: Column, most: int = 4) -> Column:
    """K03."""
    return F.size(query_keys(url)) <= most


def has_content(url: Column) -> Column:
    """K04, on the path with its escapes decoded; a path with a broken escape is taken as it is."""
    path = F.regexp_extract(url, r"^(?:[^/?#]*//[^/?#]*)?([^?#]*)", 1)
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return ~F.coalesce(plain, path).rlike(NO_CONTENT)


def crawlable(url: Column, most: int = 4) -> Column:
    """All filters."""
    return allowed_extension(url) & no_trap(url) & few_parameters(url, most) & has_content(url)


def _clamp(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def url_score(url: Column) -> Column:
    """Shallow is better; the last segment with a known word gives the bonus, a noisy word before a valuable one."""
    path = F.regexp_replace(F.regexp_replace(F.lower(url), "^[^:]*://[^/]*", ""), r"[?#].*$", "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    bonus = F.aggregate(
        segments,
        F.lit(0.0),
        lambda s, x: F.when(x.rlike("|".join(NOISY)), F.lit(-0.15)).when(x.rlike("|".join(VALUABLE)), F.lit(0.2)).otherwise(s),
    )
    return _clamp(F.greatest(F.lit(0.1), 1 - F.size(segments) * F.lit(0.12)) + bonus)


def anchor_score(anchor: Column) -> Column:
    """K07; the length is in bytes, so a lone arrow is an empty anchor and a lone # is none."""
    text = F.trim(F.lower(F.coalesce(anchor, F.lit(""))))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda x: x != ""))
    return (
        F.when(F.octet_length(text) < 2, F.lit(0.3))
        .when(text.isin(*EMPTY_ANCHORS), F.lit(0.1))
        .when(words.between(2, 8), F.lit(1.0))
        .when(words == 1, F.lit(0.6))
        .otherwise(F.lit(0.7))
    )


def link_score(url: Column, anchor: Column, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """The weighted mean; without weights 0.5."""
    if sum(weights) == 0:
        return F.lit(0.5)
    return _clamp((url_score(url) * weights[0] + anchor_score(anchor) * weights[1]) / sum(weights))


def anchor_position(text: Column, anchor: Column) -> Column:
    """The anchor's offset in its block in code points; 0 where it doesn't stand there."""
    return F.greatest(F.instr(text, anchor) - 1, F.lit(0))


def anchor_snippet(text: Column, anchor: Column, window: int = 50) -> Column:
    """The anchor's surroundings, ``window`` code points to either side; null where it doesn't stand there."""
    at = F.instr(text, anchor)
    begin = F.greatest(at - window, F.lit(1))
    return F.when(at > 0, F.substring(text, begin, at + F.length(anchor) + window - begin))


def followed_once(href: Column) -> Column:
    """The key of a web link, its URL without the fragment; null for other schemes, so that they are left out."""
    return F.when(F.lower(href).rlike("^https?://"), F.regexp_replace(href, "#.*$", ""))
