"""Pages and addresses: HTML to text, links, titles, scopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import ZERO_WIDTH, strip

# File endings that are not pages, and the named entities used.
ASSETS = (
    "7z avi bmp css csv doc docx gif gz ico jpeg jpg js json mp3 mp4 pdf png ppt pptx rss svg tar tgz ttf webp woff "
    "woff2 xls xlsx xml zip"
).split()
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "#39": "'", "apos": "'", "nbsp": " ", "amp": "&"}
SLIM_CHARS = 1_200_000


def unescape(text: Column) -> Column:
    for name, char in ENTITIES.items():
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def slim_html(html: Column) -> Column:
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)\b.*?</\1\s*>", "")
    return F.substring(t, 1, SLIM_CHARS)


def page_title(html: Column, url: Column) -> Column:
    """``<title>``, else the first ``<h1>``, else the last part of the path,
    else the host; at most 255 characters."""

    def tag(name: str) -> Column:
        inner = F.regexp_extract(html, rf"(?is)<{name}\b[^>]*>(.*?)</{name}\s*>", 1)
        return strip(F.regexp_replace(unescape(F.regexp_replace(inner, r"<[^>]+>", "")), r"(?U)\s+", " "))

    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/?$", 1)
    host = F.regexp_extract(url, r"^[a-z]+://([^/?#]*)", 1)
    found = [F.nullif(x, F.lit("")) for x in (tag("title"), tag("h1"), last, host)]
    return F.substring(F.coalesce(*found, F.lit("")), 1, 255)


def html_text(html: Column) -> Column:
    """Headings as ``#`` lines, links as ``[label](address)``, paragraphs."""
    t = F.regexp_replace(slim_html(html), r"(?is)<(button|svg)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*href=[\"'](?:javascript:|mailto:|tel:|data:|#)[^\"']*[\"'][^>]*>(.*?)</a>", "$1")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*href=[\"']([^\"']+)[\"'][^>]*>(.*?)</a>", "[$2]($1)")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</p\s*>", "\n\n")
    t = F.regexp_replace(unescape(F.regexp_replace(t, r"<[^>]+>", " ")), ZERO_WIDTH, "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def _undotted(path: Column) -> Column:
    """A path without the segments ``.`` and ``..``."""
    none = F.array().cast("array<string>")

    def step(got: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", got)
            .when(seg == "..", F.slice(got, 1, F.greatest(F.size(got) - 1, F.lit(0))))
            .otherwise(F.concat(got, F.array(seg)))
        )

    segs = F.split(F.regexp_replace(path, "^/", ""), "/")
    return F.concat(F.lit("/"), F.array_join(F.aggregate(segs, none, step), "/"))


def resolved(link: Column, base: Column) -> Column:
    """An address as seen from a page: absolute, from the host, or from the
    page's folder."""
    scheme = F.regexp_extract(base, r"^([a-z]+:)//", 1)
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, r"[?#].*$", ""), r"^[a-z]+://[^/]*(/.*/)?", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(origin, F.regexp_extract(base, r"^[a-z]+://[^/?#]*([^?#]*)", 1), link))
        .otherwise(F.concat(origin, _undotted(F.concat(folder, F.regexp_extract(link, r"^([^?#]*)", 1))), F.regexp_extract(link, r"^[^?#]*(.*)$", 1)))
    )


def normal_url(link: Column, base: Column) -> Column:
    """Absolute http address with a lower-case host, without fragment; no final
    slash but for the root, which has one; null for anything that is not a page."""
    t = F.trim(F.coalesce(link, F.lit("")))
    u = F.regexp_replace(resolved(t, base), r"#.*$", "")
    host = F.lower(F.regexp_extract(u, r"^(?i)https?://([^/?#]+)", 1))
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, r"^(?i)https?://[^/?#]+([^?#]*)", 1), ";.*$", ""), "/+$", "")
    query = F.regexp_extract(u, r"(\?[^#]+)", 1)
    asset = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)).isin(ASSETS)
    refused = (t == "") | t.rlike(r"(?i)^(#|mailto:|javascript:|tel:|data:)") | (host == "") | asset
    scheme = F.lower(F.regexp_extract(u, r"^(?i)(https?)://", 1))
    return F.when(~refused, F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), query))


def links(html: Column, base: Column) -> Column:
    """Addresses of the anchors, normal and distinct, in order."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?href=["']([^"']*)["']"""), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: normal_url(x, base)), lambda x: x.isNotNull()))


def scope_prefix(root: Column) -> Column:
    """The directory that a site's entry page stands for: its parent folder,
    or itself where it has but one segment or ends with a slash."""
    whole = F.regexp_extract(root, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(whole, "/+$", "")
    depth = F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))
    parent = F.regexp_replace(path, r"/[^/]*$", "")
    return F.when((depth <= 1) | whole.endswith("/"), path).otherwise(parent)


def in_scope(root: Column, url: Column) -> Column:
    """Same host, and inside the entry page's directory."""

    def host(x: Column) -> Column:
        return F.lower(F.regexp_extract(x, r"^[a-z]+://([^/?#]*)", 1))

    path = F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)
    prefix = scope_prefix(root)
    inside = (prefix == "") | (path == prefix) | path.startswith(F.concat(prefix, F.lit("/")))
    return (host(root) == host(url)) & inside
