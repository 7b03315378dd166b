"""URLs: canonical forms, redirects, posting identities, links out of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import named

_URL = r"https?://[^\s)\]<>]+"
_UUID = r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"
_ERROR_PATH = r"(?i)/(404|410|error|not.?found|page.?not.?found|gone)(/|$|\.)"


def host(url: Column) -> Column:
    at = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return F.regexp_replace(at, r"^www\.", "")


def path(url: Column) -> Column:
    """The path without a slash at its end; at least ``/``."""
    at = F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(at == "", "/").otherwise(at)


def canonical(url: Column) -> Column:
    """Host and path only, for comparing what a page covers."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^(?i)https?://", ""), r"^www\.", "")
    return F.lower(F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"/+$", ""))


def redirect_verdict(requested: Column, final: Column) -> Column:
    """"" if the page is the one asked for, "fail" for an error page, "warn" for another path."""
    a, b = F.trim(requested), F.trim(final)
    same_path = path(a) == path(b)
    verdict = F.when(same_path & (host(a) == host(b)), "").when(path(b).rlike(_ERROR_PATH), "fail").when(~same_path, "warn").otherwise("")
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), "").otherwise(verdict)


def _board(at: Column) -> Column:
    """One name for hosts that serve the same board."""
    return named(at, lambda x: F.when(F.endswith(x, F.lit("greenhouse.io")), "greenhouse.io").otherwise(x))


def url_identity(url: Column, digits: int = 5) -> Column:
    """The posting that a link names, or null: the first of job parameter, UUID, requisition and trailing number.

    Each is named as it is found: written out, a chain of conditions would look for each again where it is used.
    """
    at = _board(host(url))

    def of(rest: Column) -> Column:
        number = named(F.regexp_extract(rest, r"([^/]+)/*$", 1), lambda x: F.when(x.rlike(rf"^\d{{{digits},}}$"), F.concat_ws(":", at, x)))
        requisition = named(F.regexp_extract(rest, r"(?i)_(R-?\d{3,})\b", 1), lambda x: F.when(x != "", F.concat_ws(":", at, F.upper(x))).otherwise(number))
        uuid = named(F.regexp_extract(rest, f"({_UUID})", 1), lambda x: F.when(x != "", F.concat_ws(":", at, F.lower(x))).otherwise(requisition))
        return named(F.regexp_extract(rest, rf"[?&]gh_jid=(\d{{{digits},}})", 1), lambda x: F.when(x != "", F.concat(F.lit("greenhouse.io:"), x)).otherwise(uuid))

    return named(F.regexp_extract(url, r"^https?://[^/]+(/.*)$", 1), of)


def posting_identities(*texts: Column, digits: int = 5) -> Column:
    """Every posting identity in the texts' links, as a sorted set; empty when no link names one."""
    urls = F.regexp_extract_all(F.concat_ws(" ", *texts), F.lit(_URL), F.lit(0))
    bare = F.transform(urls, lambda u: F.regexp_replace(u, r"""[.,;:)\]}"']+$""", ""))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(bare, lambda u: url_identity(u, digits)))))


def first_url(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(_URL), F.lit(0)), F.lit(1))


def posting_link(text: Column, digits: int = 5) -> Column:
    """The first link that names one posting; never a company's page."""
    urls = F.regexp_extract_all(text, F.lit(_URL), F.lit(0))
    return F.try_element_at(F.filter(urls, lambda u: url_identity(u, digits).isNotNull()), F.lit(1))


def prefixes(canonical_url: Column) -> Column:
    """A canonical URL and all its parent paths, longest first."""
    parts = F.split(canonical_url, "/")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def links_out(html: Column, base: Column, pattern: str, most: int = 3) -> Column:
    """Absolute links on the page's own host whose address matches; distinct, in order, without the page itself."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_extract(base, r"^([^?#]*)", 1), r"(?<=[^/:])/[^/]*$", "")

    def resolved(link: Column) -> Column:
        link = F.replace(link, F.lit("&amp;"), F.lit("&"))
        out = F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        out = out.when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(folder, F.lit("/"), link))
        return F.regexp_replace(out, r"#.*$", "")

    found = F.regexp_extract_all(html, F.lit(pattern), F.lit(1))
    kept = F.filter(F.transform(found, resolved), lambda u: u.rlike("^https?://") & (host(u) == host(base)) & (F.regexp_replace(u, "/+$", "") != F.regexp_replace(F.regexp_replace(base, r"#.*$", ""), "/+$", "")))
    return F.slice(F.array_distinct(kept), 1, most)


def repository_path(target: Column) -> tuple[Column, Column]:
    """``owner/name[/path]`` as repository and file, the README by default."""
    parts = F.split(target, "/")
    rest = F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "/")
    return F.array_join(F.slice(parts, 1, 2), "/"), F.when(rest == "", "README.md").otherwise(rest)
