"""Text expressions on Columns: cleaning, identity, tokens, query processing, answer segmentation. All run inside the JVM.

Patterns with (?U) match as Unicode-aware engines do; blank space is stripped by class, since trim() knows only spaces.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The token patterns and word lists that results depend on.
FINANCIAL_TOKEN = "[$£€]?[A-Za-z0-9]++(?:[&./-][A-Za-z0-9]++)*+%?"  # possessive: nothing shorter could match
MATCH_TOKEN = "[a-z0-9]+(?:[.,][0-9]+)*%?"
ARTICLES = ("a", "an", "the")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
ABSTENTIONS = (
    "insufficient evidence in the retrieved context",
    "insufficient evidence",
    "i don't know",
    "i do not know",
    "cannot determine from the provided information",
)
EXPANSIONS = (
    (r"(?iU)\b(?:PPNE|PPE|PP\s*&\s*E|P\s*P\s*&\s*E)\b", "net PP&E property plant and equipment net"),
    (r"(?iU)\bbalance\s+sheets?\b|\bstatement\s+of\s+financial\s+position\b", "consolidated balance sheet"),
    (r"(?iU)\b(?:CAPEX|capital expenditures?|capital spending)\b", "capital expenditure capital spending purchases of property plant and equipment"),
    (r"(?iU)\bcapital(?:\s+|-)+intens(?:ive|ity)\b", "capital expenditures revenue property plant and equipment net total assets net income return on assets"),
)
# Names of filings, years, boilerplate around questions and the ends of answer units.
FILING_NAME = r"(?i)^(.+?)_(20\d{2})(?:Q[1-4])?_(10[-_]?K|10[-_]?Q)$"
YEAR = r"\b(20\d{2})\b"
FISCAL_YEAR = r"(?i)\b(?:FY\s*|fiscal\s+year\s+)(20\d{2})\b"
BETWEEN_WORDS = r"[\W_]*"
ROLE_PLAY = r"(?iU)^\s*assume\s+that\s+you\s+are\b[^.!?]*[.!?]\s*"
PRIMARY_SOURCE = r"\banswer\s+the\s+following\s+question\s+by\s+primarily\s+using\s+information\s+that\s+is\s+shown\s+in\s+the\s+([^:]+?)\s*:\s*"
RELIED_SOURCE = r"(?iU)\bgive\s+a\s+response\s+to\s+the\s+question\s+by\s+relying\s+on\s+the\s+details\s+shown\s+in\s+the\s+([^.!?]+?)\s*[.!?]?\s*$"
ANSWER_UNIT = r"(?iU)\banswer\s+in\s+([^.!?]+?)\s*[.!?]?\s*$"
LIST_MARK = r"(?U)^(?:[-*]\s+|\d+\.\s+)"
CLAUSE_END = r"(?U);\s+"
SENTENCE_END = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9*])"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_text(c: Column) -> Column:
    """Null characters go, line ends become line feeds, blanks before them and around the whole go."""
    c = F.regexp_replace(F.regexp_replace(c, r"\x00", ""), r"\r\n?", "\n")
    return strip(F.regexp_replace(c, r"[ \t]+(?=\n|\z)", ""))


def document_metadata(doc_name: Column, company: Column, doc_type: Column, doc_period: Column) -> Column:
    """struct(company, fiscal_year, document_type) from names such as ACME_2021Q2_10Q; else from the given columns."""
    name = FILING_NAME
    hit = doc_name.rlike(name)
    kind = F.upper(F.regexp_replace(F.regexp_extract(doc_name, name, 3), "_", "-"))
    kind = F.when(F.contains(kind, F.lit("-")), kind).otherwise(F.concat(F.substring(kind, 1, 2), F.lit("-"), F.substring(kind, 3, 9)))
    given = lambda c: F.when(strip(c) != "", strip(c))
    period = F.regexp_extract(doc_period.cast("string"), YEAR, 1)
    return F.struct(
        F.when(hit, F.regexp_replace(F.regexp_extract(doc_name, name, 1), "_", " ")).otherwise(given(company)).alias("company"),
        F.when(hit, F.regexp_extract(doc_name, name, 2).cast("int")).when(period != "", period.cast("int")).alias("fiscal_year"),
        F.when(hit, kind).otherwise(given(doc_type)).alias("document_type"),
    )


def retrieval_header(meta: Column, doc_name: Column, page: Column) -> Column:
    part = lambda label, c: F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(label), c.cast("string")))
    lines = F.concat_ws("\n", part("Company: ", meta["company"]), part("Fiscal year: ", meta["fiscal_year"]), part("Document type: ", meta["document_type"]), F.concat(F.lit("Document: "), doc_name), F.concat(F.lit("Page: "), page.cast("string")))
    return F.concat(lines, F.lit("\n\n"))


def safe_identifier(c: Column) -> Column:
    """Characters other than letters, digits, '.', '_', '-' become one underscore; an identifier that becomes empty raises."""
    out = F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9._-]+", "_"), "_+", "_")
    out = F.regexp_replace(out, r"^_+|_+\z", "")
    return F.when(out == "", F.raise_error(F.lit("identifier is empty after normalisation"))).otherwise(out)


def raw_financial_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(FINANCIAL_TOKEN), F.lit(0))


def financial_tokens(c: Column) -> Column:
    return F.transform(raw_financial_tokens(c), F.lower)


def company_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def mentions_company(question: Column, company: Column) -> Column:
    """By its words with any separators between, bounded by non-alphanumerics; or its collapsed key (3 characters at least) inside the question's."""
    words = F.transform(F.regexp_extract_all(company, F.lit("[A-Za-z0-9]+"), F.lit(0)), lambda w: w)
    pattern = F.concat(F.lit(r"(?iU)(?<![A-Za-z0-9])"), F.array_join(words, BETWEEN_WORDS), F.lit(r"(?![A-Za-z0-9])"))
    key = company_key(company)
    return ((F.size(words) > 0) & F.regexp_like(question, pattern)) | ((F.length(key) >= 3) & F.contains(company_key(question), key))


def unambiguous_year(question: Column) -> Column:
    """The one fiscal year named; without any, the one year named; null if there are several."""
    fiscal = F.array_distinct(F.regexp_extract_all(question, F.lit(FISCAL_YEAR), F.lit(1)))
    years = F.array_distinct(F.regexp_extract_all(question, F.lit(YEAR), F.lit(1)))
    return F.when(F.size(fiscal) == 1, fiscal[0].cast("int")).when((F.size(fiscal) == 0) & (F.size(years) == 1), years[0].cast("int"))


def coerce_year(c: Column) -> Column:
    year = F.regexp_extract(c.cast("string"), YEAR, 1)
    return F.when(year != "", year.cast("int"))


def focus_question(question: Column) -> Column:
    """Drops instructions about the form of the answer and keeps what they name."""
    q = F.regexp_replace(question, ROLE_PLAY, "")
    # only the first occurrence: everything else is captured around it
    q = F.regexp_replace(q, f"(?isU)^(.*?){PRIMARY_SOURCE}(.*)$", "$1$2: $3")
    for instruction in (RELIED_SOURCE, ANSWER_UNIT):
        q = F.regexp_replace(q, instruction, "$1")
    return F.trim(F.regexp_replace(q, r"(?U)\s+", " "))


def expanded_query(question: Column, year: Column) -> Column:
    """The focused question, then the expansions that apply in their order, then the year."""
    more = [F.when(question.rlike(p), F.lit(t)) for p, t in EXPANSIONS]
    return F.concat_ws(" ", focus_question(question), *more, year.cast("string"))


def match_normal_form(c: Column) -> Column:
    """Lower case without commas, tokens joined by blanks; compatibility forms are to be folded before (nfkc)."""
    return F.array_join(F.regexp_extract_all(F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit(","), F.lit("")), F.lit(MATCH_TOKEN), F.lit(0)), " ")


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition, by an Arrow function as Spark has none."""

    def fold(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if x is None or x is pd.NA else x if x.isascii() else unicodedata.normalize("NFKC", x))

    return F.pandas_udf(fold, "string")(c)


def answer_tokens(c: Column) -> Column:
    """Lower case without ASCII punctuation, split at blank space, without articles."""
    t = F.translate(F.lower(c), PUNCTUATION, "")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: (w != "") & ~w.isin(*ARTICLES))


def is_abstention(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"\.+\z", "").isin(*ABSTENTIONS)


def compact_text(c: Column, width: int) -> Column:
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) <= width, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, max(0, width - 3)), r"\s+\z", ""), F.lit("...")))


def answer_units(c: Column) -> Column:
    """array<struct<unit_id, text>>: lines without list marks, split at semicolons and at sentence ends before a capital, digit or star."""
    lines = F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]")
    lines = F.transform(lines, lambda x: F.regexp_replace(strip(x), LIST_MARK, ""))
    clauses = F.flatten(F.transform(lines, lambda x: F.split(x, CLAUSE_END)))
    parts = F.flatten(F.transform(clauses, lambda x: F.split(x, SENTENCE_END)))
    parts = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.transform(parts, lambda x, i: F.struct(F.concat(F.lit("U"), i + 1).alias("unit_id"), x.alias("text")))


def numbered_passages(chunks: Column, tag, body) -> Column:
    """array<struct<evidence_id, text>> of chunks: E1.., each text headed by its source in brackets."""
    return F.transform(chunks, lambda x, i: F.struct(F.concat(F.lit("E"), i + 1).alias("evidence_id"), F.concat(F.lit("["), tag(x), F.lit("]\n"), body(x)).alias("text")))


def seed64(c: Column) -> Column:
    """The first eight bytes of the SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 16), 16, 10).cast("decimal(20,0)")


# Elements whose content is not text, elements that begin and end lines, blank space, and the named references that are decoded.
HIDDEN = ("head", "script", "style", "template", "noscript")
BLOCKS = ("address", "article", "aside", "blockquote", "body", "br", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "table", "td", "th", "tr", "ul")
SPACES = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
REFERENCES = {
    "amp": "&", "apos": "'", "bull": "\u2022", "cent": "\u00a2", "copy": "\u00a9", "dagger": "\u2020", "deg": "\u00b0", "emsp": "\u2003", "ensp": "\u2002", "euro": "\u20ac", "gt": ">", "hellip": "\u2026", "laquo": "\u00ab", "ldquo": "\u201c",
    "lsquo": "\u2018", "lt": "<", "mdash": "\u2014", "middot": "\u00b7", "minus": "\u2212", "nbsp": "\u00a0", "ndash": "\u2013", "para": "\u00b6", "plusmn": "\u00b1", "pound": "\u00a3", "quot": '"', "raquo": "\u00bb", "rdquo": "\u201d", "reg": "\u00ae",
    "rsquo": "\u2019", "sect": "\u00a7", "thinsp": "\u2009", "times": "\u00d7", "trade": "\u2122", "yen": "\u00a5",
}
COMMENT, REFERENCE = r"(?s)<!--.*?(?:-->|\z)", r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]+);"
HIDDEN_ELEMENT = r"(?is)<{0}(?:[\x09-\x0D\x20/][^>]*)?>.*?(?:</{0}[\x09-\x0D\x20]*>|\z)"
BLOCK_TAG = r"(?i)</?(?:" + "|".join(BLOCKS) + r")(?:[\x09-\x0D\x20/][^>]*)?(?:>|\z)"
ANY_TAG = r"<[!/?A-Za-z][^>]*(?:>|\z)"


def _decoded(piece: Column) -> Column:
    """What follows an ampersand, with the reference it may begin with decoded; unknown ones stay as they are."""
    name = F.regexp_extract(piece, REFERENCE, 1)
    hexadecimal = F.lower(F.substring(name, 2, 1)) == "x"
    code = F.when(hexadecimal, F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(F.substring(name, 2, 7)).cast("int")
    valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
    number = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("\ufffd")
    known = F.create_map(*[F.lit(x) for pair in REFERENCES.items() for x in pair])
    value = F.when(name.startswith("#"), number).otherwise(F.try_element_at(known, name))
    return F.when((name != "") & value.isNotNull(), F.concat(value, F.substr(piece, F.length(name) + 2))).otherwise(F.concat(F.lit("&"), piece))


def html_text(html: Column) -> Column:
    """The visible text of HTML, one line a block: comments and elements that hold no text go (to the end, if they are not closed), tags of blocks end lines, other tags go,
    references are decoded, blank space within a line is one blank, lines without text go. Null stays null."""
    t = F.regexp_replace(html, COMMENT, "")
    for name in HIDDEN:
        t = F.regexp_replace(t, HIDDEN_ELEMENT.format(name), "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, SPACES, " "), BLOCK_TAG, "\n"), ANY_TAG, "")
    pieces = F.split(t, "&", -1)
    t = F.array_join(F.transform(pieces, lambda x, i: F.when(i == 0, x).otherwise(_decoded(x))), "")
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.trim(F.regexp_replace(x, SPACES, " ")))
    return F.when(html.isNotNull(), F.array_join(F.filter(lines, lambda x: x != ""), "\n"))
