"""URL expressions: parts, kinds, domain rules and one form for equal addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import parse_qsl, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# File extensions by kind, paths and queries that are no content, parameters that only track.
DOCUMENTS = {"pdf": "pdf", "docx": "docx", "txt": "txt", "jpg": "image", "jpeg": "image", "png": "image"}
SKIPPED = """
    gif svg webp ico bmp tif tiff mp4 mp3 wav avi mov webm m4a zip rar 7z gz tar exe msi apk css js json xml rss woff woff2 ttf eot
    doc xls xlsx ppt pptx csv
""".split()
SKIPPED_PATHS = (
    r"(?i)(/wp-admin|/wp-login|/wp-json|/xmlrpc\.php|/feed/?$|/comments/feed|/trackback|/tag/|/cart|/checkout|/my-account|/login|/signin|/sign-in|"
    r"/logout|/register|/erp|/cdn-cgi/|/wp-content/plugins/|/wp-content/themes/|/wp-includes/)"
)
SKIPPED_QUERIES = r"(?i)(^|&)(a7p1|returnurl|redirect|action)="
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|replytocom|share|amp|print|_ga|ref|elementor-preview)$"
UPLOADED = r"/wp-content/uploads/(\d{4})/(\d{2})/"
DRIVE_ID = r"(?:/file/d/|[?&]id=)([A-Za-z0-9_-]{20,})"

_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://(?:[^/?#@]*@)?([^/:?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _PARTS, i)


def host(url: Column) -> Column:
    """The host in lower case; "" where there is none, null for null."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 4)


def query(url: Column) -> Column:
    return _part(url, 5)


def extension(url: Column) -> Column:
    """The extension at the end of the path, 2 to 5 letters or digits, in lower case; "" where there is none."""
    return F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]{2,5})$", 1)


def is_drive(url: Column) -> Column:
    return host(url).isin("drive.google.com", "docs.google.com") & url.rlike(DRIVE_ID)


def drive_download(url: Column) -> Column:
    """The download address of a shared file; null where the url names none."""
    i = F.regexp_extract(url, DRIVE_ID, 1)
    return F.when(i != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), i))


def kind(url: Column) -> Column:
    """drive, pdf, docx, txt, image or html; null for what is not fetched."""
    e = extension(url)
    out = F.when(is_drive(url), "drive")
    for ext, name in DOCUMENTS.items():
        out = out.when(e == ext, name)
    return out.when(e.isin(SKIPPED), F.lit(None)).when(path(url).rlike(SKIPPED_PATHS) | query(url).rlike(SKIPPED_QUERIES), F.lit(None)).when(url.isNotNull(), "html")


def upload_year(url: Column) -> Column:
    y = F.regexp_extract(url, UPLOADED, 1)
    return F.when(y != "", y.cast("int"))


def domain_blocked(url: Column, blocked: Sequence[str]) -> Column:
    """Blocked names bar their subdomains too; null for null."""
    h = host(url)
    bad = F.lit(False)
    for b in blocked:
        bad = bad | (h == b) | h.endswith("." + b)
    return bad


def domain_allowed(url: Column, allowed: Sequence[str], blocked: Sequence[str]) -> Column:
    """Blocked names bar their subdomains too and win; allowed names cover themselves and their www. only."""
    good = host(url).isin([x for a in allowed for x in (a, "www." + a)]) if allowed else F.lit(False)
    return F.coalesce(~domain_blocked(url, blocked) & good, F.lit(False))


def normal_absolute(url: Column) -> Column:
    """One form of an absolute http(s) url, within the JVM: host in lower case, no fragment, default port or tracking
    parameter, single slashes. Null for other schemes; queries keep their order and blanks, and their escapes as written."""
    u = F.trim(url)
    scheme, port = F.lower(_part(u, 1)), _part(u, 3)
    kept = F.array_join(F.filter(F.split(query(u), "&"), lambda p: (p != "") & ~F.regexp_extract(p, "^([^=]*)", 1).rlike(TRACKING)), "&")
    p = F.regexp_replace(path(u), "/{2,}", "/")
    out = F.concat(
        scheme, F.lit("://"), host(u), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
        F.when(p == "", "/").otherwise(p), F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)),
    )
    return F.when(scheme.isin("http", "https") & (host(u) != ""), out)


def _normal(url: str | None, base: str | None) -> str | None:
    if not url or re.match(r"(?i)\s*(mailto:|tel:|javascript:|data:|whatsapp:|#)", url):
        return None
    try:
        parts = urlsplit(urldefrag(urljoin(base, url.strip()) if base else url.strip())[0])
        port, name = parts.port, (parts.hostname or "").lower()
    except ValueError:
        return None
    if parts.scheme not in ("http", "https") or not parts.netloc:
        return None
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not re.match(TRACKING, k)]
    where = re.sub("/{2,}", "/", parts.path or "/").split(";")[0] if ";" in parts.path.rsplit("/", 1)[-1] else re.sub("/{2,}", "/", parts.path or "/")
    return urlunsplit((parts.scheme, f"{name}:{port}" if port and port not in (80, 443) else name, where, urlencode(kept), ""))


@F.pandas_udf(StringType())
def normal(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The full form, for relative links too: joined to a base, with queries escaped anew. Null for null, empty and unusable urls."""
    for urls, bases in parts:
        yield pd.Series([_normal(u, b) for u, b in zip(urls, bases)], dtype=object)


def title_from_url(url: Column) -> Column:
    """A readable name from the last part of the path."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), r"([^/]*)$", 1)
    bare = F.regexp_replace(F.try_url_decode(last), r"\.[A-Za-z0-9]{2,5}$", "")
    return F.initcap(F.trim(F.regexp_replace(bare, r"[-_\s]+", " ")))
