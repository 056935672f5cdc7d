"""Expressions for file names and URLs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# File kinds a ledger names, URL shape, date prefix of archive file names.
FILE_KINDS = "pdf|html?|txt|xlsx?|jpe?g|png|mp3|md|docx?|csv|json|tsv"
FILE_TOKEN = r"(?i)[A-Za-z0-9][A-Za-z0-9_%.\-]*\.(?:" + FILE_KINDS + r")\b"
URL = r"(?i)https?://[^\s<>|`\)]+"
DATE_PREFIX = r"^(\d{4}(?:-\d{2}(?:-\d{2})?)?|undated)[-_]"

# Words of file names with a set spelling.
SPELLINGS = {
    "mwrd": "MWRD", "tarp": "TARP", "ipcb": "IPCB", "usace": "USACE", "gao": "GAO", "ijc": "IJC", "epa": "EPA",
    "uaa": "UAA", "wrp": "WRP", "caws": "CAWS", "cso": "CSO", "csos": "CSOs", "isws": "ISWS", "idnr": "IDNR",
    "usgs": "USGS", "naid": "NAID", "acfr": "ACFR", "cafr": "CAFR", "eis": "EIS", "npdes": "NPDES", "cwa": "CWA",
    "msdgc": "MSDGC", "waws": "WAWS", "sma": "SMA", "hpwrp": "HPWRP", "erdc": "ERDC", "wes": "WES", "dwm": "DWM",
    "cdot": "CDOT", "ceqa": "CEQA", "gdm": "GDM", "safl": "SAFL", "nara": "NARA", "loc": "LOC", "wttw": "WTTW",
    "iepa": "IEPA", "iit": "IIT", "uiuc": "UIUC", "uic": "UIC", "cmap": "CMAP", "faq": "FAQ", "ms4": "MS4",
    "swmp": "SWMP", "cip": "CIP", "vs": "vs.",
}

# Hosting domains per source tier; every other host is tier 4.
TIER_DOMAINS = {
    1: ("mwrd.org", "chicago.gov", "chipublib.org"),
    2: ("loc.gov", "archive.org", "hathitrust.org", "army.mil", "epa.gov", "illinois.gov", "usgs.gov", "gao.gov"),
    3: ("wikipedia.org", "chicagohistory.org", "illinois.edu", "jstor.org", "asce.org"),
}


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """File name without its last extension; a leading dot is not an extension."""
    return F.regexp_replace(basename(path), r"(?<=[^.])\.[^.]*$", "")


def file_tokens(cell: Column) -> Column:
    return F.regexp_extract_all(cell, F.lit(FILE_TOKEN), F.lit(0))


def first_url(cell: Column) -> Column:
    """First URL of a cell, '' when there is none."""
    return F.regexp_extract(cell, URL, 0)


def clean_title(cell: Column) -> Column:
    """Title without surrounding emphasis or code marks."""
    bare = F.btrim(F.btrim(cell), F.lit("*"))
    return F.btrim(F.regexp_replace(bare, "^`|`$", ""))


def humanize(name: Column, spellings: dict[str, str] | None = None) -> Column:
    """Readable description of a file name: no extension or date prefix, words capitalised, set spellings kept."""
    table = F.create_map(*[F.lit(x) for pair in (spellings or SPELLINGS).items() for x in pair])
    bare = F.regexp_replace(stem(name), DATE_PREFIX, "")
    words = F.filter(F.split(bare, "[-_]+"), lambda w: w != "")
    shaped = F.transform(words, lambda w: F.coalesce(
        F.try_element_at(table, F.lower(w)), F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))))
    text = F.btrim(F.regexp_replace(F.array_join(shaped, " "), r"\s+", " "))
    return F.when(text == "", bare).otherwise(text)


def canonical_url(url: Column) -> Column:
    """Key under which one work is listed: no scheme, 'www.', fragment, tracking part or closing slash; host lower-case."""
    bare = F.regexp_replace(F.btrim(url), r"(?i)^https?://(www\.)?", "")
    bare = F.regexp_replace(bare, r"#.*$", "")
    bare = F.regexp_replace(bare, r"[?&]utm_[a-z]+=[^&]*", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    return F.regexp_replace(F.concat(host, F.regexp_replace(bare, r"^[^/?]*", "")), r"/+$", "")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^https?://([^/?#:]+)", 1))


def url_tier(url: Column, domains: dict[int, tuple[str, ...]] | None = None) -> Column:
    """Tier of the hosting domain (the host itself or a domain above it)."""
    host = url_host(url)
    out = None
    for tier, names in sorted((domains or TIER_DOMAINS).items()):
        hit = F.lit(False)
        for name in names:
            hit = hit | (host == name) | host.endswith("." + name)
        out = F.when(hit, tier) if out is None else out.when(hit, tier)
    return out.otherwise(4)
