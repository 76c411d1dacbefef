"""Text functions as Column expressions: which text represents a record, transport debris, canonical form, shingles, windows.

Regular expressions run with Unicode classes, (?U), and full case folding, (?iu), so that white space, word characters and case
mean what they mean for any script. Nulls: every function here gives an empty string (or False, or an empty array) for null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\x1c-\x1f]"

# Patterns and limits that results depend on.
NOUN = r"(?:file|document|doc|pdf|letter|comment|attachment|enclosure|submission|response|below|above|here)(?:\(s\)|s)?"
ATTACHED = r"attach(?:ed|ment)s?|enclos(?:ed|ure)s?|upload(?:ed)?"
PLACEHOLDER = (
    r"^(?:(?:please\s+)?(?:kindly\s+)?(?:see|refer\s+to|view|read|post|find)\s+(?:the\s+|my\s+|our\s+|attached\s+)*"
    r"(?:attach(?:ed|ment)s?|upload(?:ed)?|enclos(?:ed|ure)s?)?(?:\s+" + NOUN + r")*|(?:" + ATTACHED + r")(?:\s+" + NOUN + r")*|n/?a|none|no\s+comment|test)[\s.,;:!\-]*$"
)
POINTER = r"^\s*(?:please\s+)?(?:kindly\s+)?(?:see|refer\s+to|view|read|find)\s+(?:the\s+|my\s+|our\s+|a\s+|attached\s+)*(?:" + ATTACHED + r"|copy)\b"
POINTER_MID = (
    r"\b(?:submits?|submitting|encloses?|enclosing|attaches?|files?|forwards?|provides?|offers?|transmits?)\b[^.]{0,80}"
    r"\b(?:attach(?:ed|ment)s?|enclos(?:ed|ure)s?)\b"
)
POINTER_CHARS, POINTER_MID_CHARS, POINTER_MID_WINDOW = 400, 600, 300
QUOTES = "[\"“”'‘’]+"
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"
URL = r"https?://\S+"
DOCKET_LINE = r"\b(?:re:\s*)?Docket\s*(?:ID\s*)?N[oO]\.?\s*:?\s*[A-Z]{2,5}[-–][\w\-]+"
HEADER_FIELD = r"\b(From|To|Sent|Subject|Date|Cc|Bcc|Attachments?):"
SALUTATION = r"\b(Dear\s+(?:Administrator|Mr\.?|Ms\.?|Mrs\.?|Dr\.?|Sir|Madam|EPA|Environmental\s+Protection|Secretary|Director|Sirs?|Madams?|[A-Z][a-z]+)[^,\n]{0,60},)"
RECEIPT = r"<\?xml.*?</fdms_submission>"
RECEIPT_PAGE = r"\s*(?:Page\s+\d+\s+of\s+\d+\s*[-–]\s*)?"
FLAT_RECEIPT = "^" + RECEIPT_PAGE + r"[0-9a-f]{16}\b.{0,400}?(?:<!\[CDATA\[|\]\]>)"
BARE_RECEIPT = "^" + RECEIPT_PAGE + r"[0-9a-f]{16}\b"
RENDER_TRAILER = r"(?:\]\]>\s*)?Web\s+file://\S*(?:Adlib|DocumentumConnector)\S*.*$"
MAILBOX = r"\bA-AND-R-DOCKET\b(?:@\S+)?"
LABEL_RUN = r"(?:\b(?:From|Sent|To|Cc|Bcc|Subject|Attachments?|Importance|Date):\s*){2,}"
LONG_DATE = (
    r"\b(?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day,\s+(?:January|February|March|April|May|June|July|August|September|October|November|December)"
    r"\s+\d{1,2},\s+\d{4}(?:\s+\d{1,2}:\d{2}(?::\d{2})?\s*(?:AM|PM)?)?"
)
WORD = "[a-z0-9']+"
RECORD_ID = r"([A-Z][A-Za-z0-9_-]*-\d{4}-[A-Za-z0-9-]+-\d+)"


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def _sub(c: Column, pattern: str, to: str = " ", flags: str = "U") -> Column:
    return F.regexp_replace(c, f"(?{flags}){pattern}", to)


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


#: Outside these, composition changes nothing: all beyond Latin-1, and Latin-1's own compatibility characters.
COMPOSED = r"[^\x00-\xff]|[\xa0\xa8\xaa\xaf\xb2-\xb5\xb8-\xba\xbc-\xbe]"


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has no built-in for it, so this is the one Arrow function of the text rules.

    Only texts that composition can change are sent to Python.
    """
    return F.coalesce(_nfkc(F.when(c.rlike(COMPOSED), c)), c)


def stripped(c: Column) -> Column:
    return _sub(c, f"^{SPACE}+|{SPACE}+$", "")


def normalize_space(c: Column | str, unicode: bool = True) -> Column:
    """White space runs as one space, none at the ends; unicode: NFKC first (the no-break space is white space either way)."""
    t = _text(c)
    return F.trim(_sub(nfkc(t) if unicode else t, SPACE + "+"))


def strip_html(c: Column | str) -> Column:
    t = _sub(_sub(_text(c), r"<br\s*/?>", "\n", "iuU"), "<[^>]+>")
    for entity, to in ENTITIES:  # in this order: a doubly escaped entity is undone once more
        t = F.replace(t, F.lit(entity), F.lit(to))
    return t


def body_text(c: Column | str, unicode: bool = True) -> Column:
    return normalize_space(strip_html(c), unicode)


def is_placeholder(c: Column | str, unicode: bool = True) -> Column:
    """The whole body only stands in for an attachment; so does an empty one."""
    b = stripped(_sub(body_text(c, unicode), f"^{QUOTES}|{QUOTES}$", ""))
    return (b == "") | b.rlike("(?iuU)" + PLACEHOLDER)


def is_pointer(c: Column | str, unicode: bool = True) -> Column:
    """A short body that says no more than where the text is."""
    b = body_text(c, unicode)
    opening = (F.length(b) <= POINTER_CHARS) & b.rlike("(?iuU)" + POINTER)
    sentences = F.size(F.filter(F.split(b, r"(?U)(?<=[.!?])\s+"), lambda x: F.trim(x) != ""))
    middle = (F.length(b) <= POINTER_MID_CHARS) & F.substring(b, 1, POINTER_MID_WINDOW).rlike("(?iuU)" + POINTER_MID) & (sentences <= 2)
    return (b != "") & (opening | middle)


def assembled(body: Column | str, attachments: Column | str, unicode: bool = True) -> Column:
    """struct(text, source) from a body and an ordered array of attachment texts."""
    b = body_text(body, unicode)
    a = F.col(attachments) if isinstance(attachments, str) else attachments
    joined = normalize_space(F.array_join(F.coalesce(a, F.array().cast("array<string>")), " "), unicode)
    pick = lambda t, s: F.struct(t.alias("text"), F.lit(s).alias("source"))
    return (
        F.when((b != "") & is_pointer(body, unicode) & (joined != ""), pick(joined, "attachment"))
        .when((b != "") & ~is_placeholder(body, unicode), pick(b, "body"))
        .when(joined != "", pick(joined, "attachment"))
        .otherwise(pick(F.lit(""), "none"))
    )


def has_envelope(c: Column | str, window: int = 600, fields: int = 3) -> Column:
    labels = F.regexp_extract_all(F.substring(_text(c), 1, window), F.lit("(?iuU)" + HEADER_FIELD), F.lit(1))
    return F.size(F.array_distinct(F.transform(labels, F.lower))) >= fields


def strip_envelope(c: Column | str, window: int = 1500) -> Column:
    """From the salutation on, where an envelope and a salutation both stand at the beginning."""
    t = _text(c)
    at = F.regexp_instr(F.substring(t, 1, window), F.lit("(?U)" + SALUTATION))
    return F.when(has_envelope(t) & (at > 0), stripped(F.substring(t, at, F.length(t)))).otherwise(t)


def strip_header_debris(c: Column | str, window: int = 900) -> Column:
    t = _text(c)
    head = F.substring(t, 1, window)
    for pattern in (LABEL_RUN, MAILBOX, LONG_DATE):
        head = _sub(head, pattern, flags="iuU")
    return F.concat(head, F.substring(t, F.lit(window + 1), F.length(t)))


def clean(c: Column | str) -> Column:
    """The text without receipts, render trailers, mail envelopes, addresses and docket references."""
    t = _text(c)
    comment = "<comment>(.*?)</comment>"
    inner = F.when(t.rlike("(?isuU)" + comment), F.regexp_extract(t, "(?isuU)" + comment, 1)).otherwise(_sub(t, "<[^>]{1,80}>"))
    t = F.when(t.rlike("(?isuU)" + RECEIPT), inner).otherwise(t)
    flat = F.regexp_extract(F.substring(t, 1, 600), "(?isuU)" + FLAT_RECEIPT, 0)
    t = F.substring(t, F.length(flat) + 1, F.length(t))
    t = _sub(_sub(t, RENDER_TRAILER, flags="isuU"), r"\]\]>\s*$")
    t = F.when(t.rlike("(?U)" + BARE_RECEIPT) & (F.length(t) < 400), F.lit("")).otherwise(t)
    t = strip_header_debris(strip_envelope(t))
    return F.trim(_sub(_sub(_sub(_sub(t, EMAIL), URL), DOCKET_LINE, flags="iuU"), SPACE + "+"))


def canonical(c: Column | str, unicode: bool = True) -> Column:
    """Case and white space apart, nothing is changed."""
    t = _text(c)
    return F.trim(_sub(F.lower(nfkc(t) if unicode else t), SPACE + "+"))


def exact_key(c: Column | str, unicode: bool = True) -> Column:
    return F.sha2(canonical(c, unicode).cast("binary"), 256)


def words(c: Column | str, unicode: bool = True) -> Column:
    return F.regexp_extract_all(canonical(c, unicode), F.lit(WORD), F.lit(0))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: inside a lambda, a repeated expression would be computed for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def shingles_of(w: Column, k: int = 5) -> Column:
    """Distinct runs of k words; all words where there are fewer; none for no words."""

    def runs(v: Column) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(v) - k + 1)), lambda i: F.array_join(F.slice(v, i, k), " "))
        return F.when(F.size(v) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))

    return let(w, runs)


def chunks(c: Column | str, size: int = 180, most: int = 24) -> Column:
    """Runs of `size` words that don't overlap, `most` of them; one empty run for no words."""

    def runs(w: Column) -> Column:
        n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.size(w) / size).cast("int")))
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * size + 1, size), " "))

    return let(F.split(normalize_space(c), " "), runs)


def word_windows(c: Column | str, size: int = 320, overlap: int = 60) -> Column:
    """Runs of `size` words that overlap, up to the one that reaches the end; none for no words."""
    step = size - overlap

    def runs(w: Column) -> Column:
        n = F.greatest(F.lit(1), F.ceil((F.size(w) - size) / step).cast("int") + 1)
        each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))
        return F.when((F.size(w) > 1) | (F.get(w, 0) != ""), each).otherwise(F.array().cast("array<string>"))

    return let(F.split(normalize_space(c), " "), runs)


# Keys of listed objects.


def _base(key: Column | str) -> Column:
    return F.element_at(F.split(_text(key), "/"), -1)


def comment_id(key: Column | str) -> Column:
    """The record's id: the last part of a key, without .json and a trailing copy number."""
    return F.regexp_replace(F.regexp_replace(_base(key), r"\.json$", ""), r"^(.+?)\(\d+\)$", "$1")


def copy_rank(key: Column | str) -> Column:
    """n of a trailing (n), else 0."""
    n = F.regexp_extract(F.regexp_replace(_base(key), r"\.json$", ""), r"^.+?\((\d+)\)$", 1)
    return F.when(n != "", n.cast("long")).otherwise(F.lit(0).cast("long"))


def sequence_number(identifier: Column | str) -> Column:
    n = F.regexp_extract(_text(identifier), r"-(\d+)$", 1)
    return F.when(n != "", n.cast("long"))


def any_comment_id(key: Column | str, pattern: str = RECORD_ID) -> Column:
    """An id by its shape, sought in the last part of a key and then in all of it; null if there is none."""
    first = lambda c: F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))
    return F.coalesce(first(_base(key)), first(_text(key)))


def attachment_owner(key: Column | str) -> Column:
    """The id of the record that an attachment's name begins with."""
    return comment_id(F.regexp_replace(_base(key), r"^(.*)_attachment.*$", "$1"))


def extension(key: Column | str) -> Column:
    parts = F.split(_base(key), r"\.")
    return F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -1))).otherwise("(none)")


def listing_prefix(kind: str, docket: Column | str, agency: Column | str) -> Column:
    """Where a docket's objects of a kind are listed."""
    d, a = (F.col(x) if isinstance(x, str) else x for x in (docket, agency))
    if kind == "comments":
        return F.format_string("raw-data/%s/%s/text-%s/comments/", a, d, d)
    if kind == "attachments":
        return F.format_string("raw-data/%s/%s/binary-%s/comments_attachments/", a, d, d)
    if kind == "extracted":
        return F.format_string("derived-data/%s/%s/mirrulations/extracted_txt/comments_extracted_text/pdfminer/", a, d)
    raise ValueError(kind)


def bundled(c: Column | str, opening: int = 200) -> Column:
    """How often a text's own opening stands in it, side by side: over 1, a bundle of copies of one letter. 0 for no text."""

    def count(t: Column) -> Column:
        head = F.substring(t, 1, opening)
        return F.when(t == "", 0).otherwise((F.length(t) - F.length(F.replace(t, head, F.lit("")))) / F.length(head)).cast("long")

    return let(normalize_space(c), count)
