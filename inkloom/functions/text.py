"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and what they are searched as.
SPECIAL = {
    "\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"',
    "\u00b7": "\u2022", "\u25e6": "\u2022", "\u25aa": "\u2022", "\u25ab": "\u2022",
    "\u2023": "\u2022", "\u2043": "\u2022", "\u25cf": "\u2022", "\u25cb": "\u2022",
    "\u2013": "-", "\u2014": "-", "\u2010": "-", "\u2011": "-", "\u2212": "-",
}
QUOTES = {k: v for k, v in SPECIAL.items() if v in "'\""}
# Starts of numbered headings, in order; those of LOWER are second-level.
NUMBERED = [
    r"^\d+\.\s", r"^\d+\.\d+\s", r"^Article\s+[IVXLCDM]+", r"^Article\s+\d+", r"^Section\s+\d+", r"^SECTION\s+\d+",
    r"^Part\s+[IVXLCDM]+", r"^Part\s+\d+", r"^Chapter\s+\d+", r"^\([a-z]\)", r"^\([0-9]+\)",
]
LOWER = (1, 9, 10)
# Fixed value: white space, a word with inner hyphens or apostrophes, or one other character.
TOKEN = r"(?U)\s+|\w+(?:['\u2019\u2018\-]\w+)*|[^\w\s]"
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_MON = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
DATE_FORMS = [(r"^\d+/", "M/d/yyyy"), (r"^\d+-", "yyyy-MM-dd"), (rf"^{_MONTH} ", "MMMM d, yyyy"), (rf"^{_MON} ", "MMM d, yyyy"), (r"^\d+ ", "d MMMM yyyy")]
DATE = rf"\b(?:\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{4}}-\d{{2}}-\d{{2}}|{_MONTH} \d{{1,2}}, \d{{4}}|{_MON} \d{{1,2}}, \d{{4}}|\d{{1,2}} {_MONTH} \d{{4}})\b"
CURRENCY = r"\$(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"


def normalize_special(text: Column) -> Column:
    """Quotes, bullets and dashes as their keyboard characters, one for one, so offsets stay."""
    return F.translate(text, "".join(SPECIAL), "".join(SPECIAL.values()))


def normalize_quotes(text: Column) -> Column:
    return F.translate(text, "".join(QUOTES), "".join(QUOTES.values()))


def denormalize_quotes(text: Column) -> Column:
    """Typographic quotes as straight ones, as texts are typed that were written with straight ones."""
    return normalize_quotes(text)


def restored(original: Column, start: Column, size: Column) -> Column:
    """What stands in the text itself where its normalised form has a match: normalisation goes one for one, so places are the same in both."""
    return F.substr(original, start + 1, size)


def has_smart_quotes(text: Column) -> Column:
    return text.rlike("[\u2018\u2019\u201c\u201d]")


def has_straight_quotes(text: Column) -> Column:
    return text.rlike("['\"]")


def has_special_chars(text: Column) -> Column:
    return text.rlike("[" + "".join(f"\\x{{{ord(c):x}}}" for c in SPECIAL) + "\u2022]")


def tokens(text: Column) -> Column:
    """Tokens whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def is_space(token: Column) -> Column:
    return token.rlike(r"(?U)^\s+$")


def is_punctuation(token: Column) -> Column:
    return token.rlike(r"(?U)^[^\w\s]+$")


def span_class(found: Column) -> Column:
    """Of an array of tokens: whether all are white space, and whether all are punctuation or white space."""
    return F.struct(
        F.forall(found, is_space).alias("space_only"),
        (F.forall(found, lambda t: is_space(t) | is_punctuation(t)) & F.exists(found, is_punctuation)).alias("punctuation_only"),
    )


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def common_issues(text: Column) -> Column:
    """What in a search text often keeps it from being found."""
    rules = [
        (text.rlike("[\u201c\u201d]"), "has typographic double quotes"),
        (text.rlike("[\u2018\u2019]"), "has typographic single quotes"),
        (text.contains("\u00a0"), "has a space that keeps words together"),
        (text.contains("\u200b"), "has an invisible space"),
        (text.contains("\t"), "has a tab"),
        (text.rlike("[\r\n]"), "spans several lines"),
    ]
    return F.array_compact(F.array(*(F.when(test, F.lit(what)) for test, what in rules)))


def normalize_currency(text: Column) -> Column:
    """Every dollar amount as $X,XXX.XX. An amount without separators counts whole, so $1000 is $1,000.00."""
    amounts = F.regexp_extract_all(text, F.lit(CURRENCY), F.lit(0))
    pieces = F.split(text, CURRENCY, -1)
    shown = F.concat(
        F.transform(amounts, lambda a: F.concat(F.lit("$"), F.format_number(F.regexp_replace(a, "[$,]", "").cast("double"), 2))),
        F.array(F.lit("")),
    )
    return F.array_join(F.zip_with(pieces, shown, lambda p, a: F.concat(p, a)), "")


def normalize_dates(text: Column, to: str = "MMMM dd, yyyy") -> Column:
    """Every date of a known form in the form wanted; impossible dates stay as they are."""
    dates = F.regexp_extract_all(text, F.lit(DATE), F.lit(0))
    read = lambda d: F.coalesce(*(F.try_to_timestamp(F.when(d.rlike(test), d), F.lit(form)) for test, form in DATE_FORMS))
    shown = F.concat(F.transform(dates, lambda d: F.coalesce(F.date_format(read(d), to), d)), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, DATE, -1), shown, lambda p, d: F.concat(p, d)), "")


def section_references(text: Column, old: str, new: str) -> Column:
    quoted = "\\Q" + old + "\\E"
    return F.regexp_replace(text, rf"\bSection\s+{quoted}\b", f"Section {new}")


def numbered_pattern(text: Column, ignore_case: bool = True) -> Column:
    """Number of the first heading pattern that the text begins with, from 1; null if none."""
    flag = "(?i)" if ignore_case else ""
    return F.coalesce(*(F.when(text.rlike(flag + p), F.lit(i + 1)) for i, p in enumerate(NUMBERED)))


def numbered_level(text: Column) -> Column:
    which = numbered_pattern(text)
    return F.when(which.isNotNull(), F.when(which.isin([i + 1 for i in LOWER]), 2).otherwise(1))


def all_caps(text: Column) -> Column:
    """At least two letters, none in lower case."""
    return (F.upper(text) == text) & (F.length(F.regexp_replace(text, r"(?U)\P{L}", "")) >= 2)


def style_level(style: Column) -> Column:
    """Outline level of a heading style; a title is 1, a subtitle 2."""
    low = F.lower(style)
    return (
        F.when(low.startswith("heading"), F.nullif(F.regexp_extract(low, r"(\d+)", 1), F.lit("")).cast("int"))
        .when(low == "title", 1)
        .when(low == "subtitle", 2)
    )


def is_heading_style(style: Column) -> Column:
    return F.coalesce(style.startswith("Heading"), F.lit(False))


def heading_level(style: Column) -> Column:
    level = F.nullif(F.regexp_extract(style, r"(\d+)", 1), F.lit("")).cast("int")
    return F.when(is_heading_style(style) & level.between(1, 9), level)


def valid_bookmark(name: Column) -> Column:
    return (F.length(name) <= 40) & name.rlike(r"^[A-Za-z][A-Za-z0-9_]*$")


def initials(name: Column) -> Column:
    return F.upper(F.array_join(F.transform(F.split(squeeze(name), " "), lambda w: F.substring(w, 1, 1)), ""))


def field(code: Column) -> Column:
    """Type, target and switches of a field instruction."""
    words = F.split(squeeze(code), " ")
    has = lambda s: code.rlike(rf"\\{s}(\s|$)")
    return F.struct(
        F.upper(words[0]).alias("field_type"),
        F.when(F.size(words) > 1, F.when(~F.try_element_at(words, F.lit(2)).startswith("\\"), F.try_element_at(words, F.lit(2)))).alias("target"),
        F.regexp_extract_all(code, F.lit(r"(\\\S+)"), F.lit(1)).alias("switches"),
        has("h").alias("linked"), has("p").alias("position"), has("w").alias("full_number"), has("r").alias("number"), has("n").alias("no_context"),
    )


def field_switch(code: Column, name: str) -> Column:
    """Value of a switch, empty if bare, null if absent."""
    there = code.rlike(rf"\\{name}(\s|$)")
    return F.when(there, F.regexp_extract(code, rf"\\{name}\s+\"([^\"]*)\"", 1))


def toc_levels(code: Column) -> Column:
    """Levels of a table of contents, 1 to 3 where it names none."""
    at = lambda k: F.coalesce(F.nullif(F.regexp_extract(code, r'\\o\s+"(\d)-(\d)"', k), F.lit("")).cast("int"), F.lit(3 if k == 2 else 1))
    return F.struct(at(1).alias("low"), at(2).alias("high"))


def toc_entry(style: Column, text: Column) -> Column:
    """Level by style TOCn, title, and the page that a trailing number gives."""
    return F.struct(
        F.nullif(F.regexp_extract(style, r"^TOC\s?(\d)$", 1), F.lit("")).cast("int").alias("level"),
        F.trim(F.regexp_replace(text, r"[\t .]*\d+\s*$", "")).alias("title"),
        F.nullif(F.regexp_extract(text, r"(\d+)\s*$", 1), F.lit("")).cast("int").alias("page"),
    )


def context(text: Column, found: Column, chars: int = 40) -> Column:
    """The text around the first occurrence of found, with dots where it is cut."""
    at = F.instr(text, found)
    start = F.greatest(at - chars, F.lit(1))
    end = F.least(at + F.length(found) + chars, F.length(text) + 1)
    return F.when(at > 0, F.concat(F.when(start > 1, "...").otherwise(""), F.substr(text, start, end - start), F.when(end <= F.length(text), "...").otherwise("")))


def fingerprint(text: Column, style: Column, parent: Column) -> Column:
    """8 URL-safe characters that name a paragraph by its content."""
    digest = F.sha2(F.concat_ws("|", F.substring(text, 1, 200), F.coalesce(style, F.lit("")), F.coalesce(parent, F.lit(""))), 256)
    return F.rtrim(F.translate(F.base64(F.unhex(F.substring(digest, 1, 12))), "+/", "-_"), F.lit("="))


def ref_parts(ref: Column) -> Column:
    """Segments of a reference: prefix, ordinal, or fingerprint after ~."""
    return F.transform(
        F.split(ref, "/"),
        lambda s: F.struct(
            F.regexp_extract(s, r"^([a-z]+):", 1).alias("prefix"),
            F.nullif(F.regexp_extract(s, r":(\d+)$", 1), F.lit("")).cast("int").alias("ordinal"),
            F.nullif(F.regexp_extract(s, r":~(.+)$", 1), F.lit("")).alias("fingerprint"),
        ),
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def image_size(width: Column, height: Column) -> Column:
    """English Metric Units as inches."""
    return F.format_string("%.1fin x %.1fin", width / 914400, height / 914400)


def twips(points: Column) -> Column:
    return (points * 20).cast("int")


def inch_twips(inches: Column) -> Column:
    return (inches * 1440).cast("int")


def half_points(points: Column) -> Column:
    return (points * 2).cast("int")


def properties_diff(old: Column, new: Column) -> Column:
    """Map of the properties that differ, to (old, new)."""
    both = F.map_zip_with(old, new, lambda k, a, b: F.struct(a.alias("old"), b.alias("new")))
    return F.map_filter(both, lambda k, v: ~v["old"].eqNullSafe(v["new"]))


def merge_properties(base: Column, update: Column) -> Column:
    """update over base; a null keeps what was there, the text 'false' takes the property away."""
    both = F.map_zip_with(base, update, lambda k, a, b: F.coalesce(b, a))
    return F.map_filter(both, lambda k, v: F.coalesce(v != "false", F.lit(False)))


def continuity(after: Column) -> Column:
    """Hints that what follows an edit continues the sentence."""
    # Connecting phrases.
    phrases = ["in question", "of which", "that is", "to which", "which is", "who is", "whose", "wherein", "whereby"]
    rest = F.ltrim(after)
    first = F.substring(rest, 1, 1)
    return F.array_compact(
        F.array(
            F.when((F.lower(first) == first) & (F.upper(first) != first) & (first != "i"), F.lit("starts in lower case")),
            F.when(F.lower(rest).rlike("^(" + "|".join(phrases) + ")"), F.lit("starts with a connecting phrase")),
            F.when(rest.rlike("^[,;:\u2014\u2013]"), F.lit("starts with punctuation")),
        )
    )
