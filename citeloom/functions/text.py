"""Text column expressions. All stay in the JVM; regexes carry explicit character classes."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# What counts as white space when text is trimmed or collapsed (Unicode, not only ASCII).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITESPACE) + "]"
# A run of white space that is not one blank already, which needs no replacing; printable ASCII is ruled out by one comparison.
_WS_RUN = f"(?![!-~])(?: (?![!-~]){_WS_CLASS}++|" + _WS_CLASS.replace("\\x{20}", "") + f"{_WS_CLASS}*+)"

# Citation marker, bibliography heading, index word, sentence boundary, figure words.
CITATION = r"\\?\[\\?\[(\d+)\\?\]\\?\]\(#src-(\d+)\)"
BIBLIOGRAPHY_HEADING = r"(?m)^## Sources\s*$"
WORD = r"[a-z0-9\p{L}\p{N}]+"  # ASCII first: most characters are decided without a category look-up
SENTENCE_BOUNDARY = r'(?<=[.;:])\s+(?=[A-Z0-9"\(])'
FIGURE_WORDS = (
    r"(?i)\b(figure|fig\.|plate|exhibit|map|diagram|profile|schematic|cross[- ]section|aerial|photograph)\b"
)


def _accent_pairs() -> tuple[str, str]:
    """Accented Latin letters and their base letters, derived from Unicode decompositions."""
    accented, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and not unicodedata.combining(base[0]):
            accented.append(chr(code))
            plain.append(base[0])
    return "".join(accented), "".join(plain)


_ACCENTED, _PLAIN = _accent_pairs()


def strip_space(text: Column) -> Column:
    """Trim Unicode white space at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def squeeze_space(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, _WS_RUN, " ")


def squeeze_blanks(text: Column) -> Column:
    """Runs of blanks and tabs become one blank; ends are trimmed; line breaks stay."""
    return strip_space(F.regexp_replace(text, "[ \\t]+", " "))


def fold_letters(text: Column) -> Column:
    """Lower case without Latin accents, as the keyword index stores words."""
    plain = F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, _ACCENTED, _PLAIN)).otherwise(text)
    return F.lower(plain)


def index_tokens(text: Column) -> Column:
    """Words of a text as the keyword index sees them: runs of letters and digits, folded."""
    return F.regexp_extract_all(fold_letters(text), F.lit(WORD), F.lit(0))


def index_length(text: Column) -> Column:
    """Number of index words, without building them."""
    return F.regexp_count(fold_letters(text), F.lit(WORD))


def query_terms(text: Column, min_chars: int = 3, limit: int | None = None) -> Column:
    """Words of a question: ASCII letter/digit runs of a least length, duplicates kept; all, or the first ``limit``."""
    found = F.regexp_extract_all(text, F.lit(f"[a-zA-Z0-9]{{{min_chars},}}"), F.lit(0))
    return F.slice(found, 1, limit) if limit else found


def strip_bibliography(text: Column) -> Column:
    """Text before the first bibliography heading."""
    return F.split(text, BIBLIOGRAPHY_HEADING, 2)[0]


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def has_citation(text: Column) -> Column:
    """Whether a citation marker occurs; most texts without one lack its fixed part."""
    return F.contains(text, F.lit("](#src-")) & text.rlike(CITATION)


def citation_numbers(text: Column) -> Column:
    """Anchor numbers of all citation markers in order, duplicates kept."""
    found = F.regexp_extract_all(text, F.lit(CITATION), F.lit(2))
    return F.transform(found, lambda n: n.cast("int"))


def markdown_clean(text: Column) -> Column:
    """Prose of a markdown fragment: no citations, anchors, link targets or markup characters."""
    out = strip_citations(text)
    out = F.regexp_replace(out, r'<a id="[^"]*"></a>', "")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"[#*`>|]", " ")
    return strip_space(squeeze_space(out))


def heading_anchor(heading: Column) -> Column:
    """Page anchor of a heading: lower case, punctuation dropped, each blank one hyphen."""
    kept = F.regexp_replace(F.lower(strip_space(heading)), "[^a-z0-9 _-]", "")
    return F.translate(F.trim(kept), " ", "-")


def document_title(text: Column, fallback: Column) -> Column:
    """Front-matter title near the top, else the first level-1 heading, else ``fallback``."""
    front = F.regexp_extract(F.substring(text, 1, 300), r'(?m)^title:\s*"?(.+?)"?\s*$', 1)
    heading = strip_space(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1))
    return F.coalesce(F.nullif(front, F.lit("")), F.nullif(heading, F.lit("")), fallback)


# The named entities that are resolved in the JVM; anything else goes to the full-table UDF.
NAMED_ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&nbsp;": "\u00a0",
    "&copy;": "\u00a9", "&middot;": "\u00b7", "&mdash;": "\u2014", "&ndash;": "\u2013", "&hellip;": "\u2026",
    "&amp;": "&",
}


def unescape_named(text: Column) -> Column:
    """Resolve the common entities; the ampersand goes last so that nothing is resolved twice."""
    for name, char in NAMED_ENTITIES.items():
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def strip_markup(html: Column) -> Column:
    """Scripts, styles and tags become blanks."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    return F.regexp_replace(out, r"(?s)<[^>]+>", " ")


def tidy_plain(text: Column) -> Column:
    """Squeeze blanks and tabs, keep at most one empty line, trim."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    return strip_space(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def snippet(text: Column, chars: int = 400) -> Column:
    return F.substring(squeeze_space(text), 1, chars)


def page_label(first: Column, last: Column) -> Column:
    single = F.concat(F.lit("p."), first.cast("string"))
    span = F.concat(F.lit("pp."), first.cast("string"), F.lit("-"), last.cast("string"))
    return F.when(first == last, single).otherwise(span)


def figure_text(file: Column, page: Column, description: Column) -> Column:
    """Chunk text of a described figure."""
    return F.concat(
        F.lit("[FIGURE \u2014 "), file, F.lit(" p."), page.cast("string"), F.lit("] "), description
    )


def search_terms(query: Column) -> Column:
    """Words of a search box entry: split at white space, word characters only, longer than one."""
    words = F.split(strip_space(query), _WS_CLASS + "+")
    return F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^a-zA-Z0-9_]", "")), lambda w: F.length(w) > 1)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once per row, however often it is named."""
    return F.transform(F.array(value), use)[0]


def match_snippet(text: Column, terms: Column, before: int = 90, after: int = 200, plain: int = 260) -> Column:
    """Window round the first term (in term order) that occurs, terms marked, ellipses at the cut ends."""

    def spot(words: Column) -> Column:
        """1-based place of the first term that occurs, 0 without one; terms after it are not looked for."""
        return _once(F.lower(text), lambda low: F.aggregate(
            words, F.lit(0), lambda at, t: F.when(at > 0, at).otherwise(F.instr(low, F.lower(t)))))

    def show(words: Column, at: Column) -> Column:
        first = F.greatest(at - before, F.lit(1))
        window = F.when(at == 0, F.substring(text, 1, plain)).otherwise(F.substring(text, first, at + after - first))
        escaped = F.replace(F.replace(F.replace(window, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                            F.lit(">"), F.lit("&gt;"))
        marked = F.aggregate(
            words, escaped, lambda acc, t: F.regexp_replace(acc, F.concat(F.lit("(?i)("), t, F.lit(")")), F.lit("<mark>$1</mark>")))
        return F.concat(F.when(at > before + 1, F.lit("\u2026 ")).otherwise(F.lit("")), marked, F.lit(" \u2026"))

    return _once(terms, lambda words: _once(F.coalesce(spot(words), F.lit(0)), lambda at: show(words, at)))
