"""Normalisers, cleaners and shape functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "\":;\\-.,!?"


def strict_norm(x: Column) -> Column:
    """White space off both ends (Unicode); null becomes the word None."""
    return F.regexp_replace(F.coalesce(x, F.lit("None")), r"(?U)^\s+|\s+$", "")


def ws_collapse(x: Column) -> Column:
    """``strict_norm`` with inner white space made single blanks."""
    return F.regexp_replace(strict_norm(x), r"(?U)\s+", " ")


def ws_regex_norm(x: Column) -> Column:
    """As ``ws_collapse``, but null and empty become the empty string."""
    return F.when(F.coalesce(x, F.lit("")) == "", "").otherwise(ws_collapse(x))


def generic_clean(x: Column) -> Column:
    """Outer punctuation, one pair of quotes, one pair of parentheses and repeated white space go."""
    out = F.regexp_replace(F.trim(x), f"^[{PUNCTUATION}\\s]+|[{PUNCTUATION}\\s]+$", "")
    out = F.regexp_replace(out, "^[\"'](.*)[\"']$", "$1")
    out = F.regexp_replace(out, r"^\((.*)\)$", "$1")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def collapse_blanks(x: Column) -> Column:
    """Runs of blanks become one; other white space stays."""
    return F.regexp_replace(x, " +", " ")


def structural_clean(x: Column, flags: dict[str, Column]) -> Column:
    """Strip what earlier corrections stripped; each flag says whether its rule was learned.

    Rules in order: parentheses_both, parentheses_start, parentheses_end, quotes, brackets, trailing_comma,
    trailing_period.
    """
    rules = [
        ("parentheses_both", r"^\((.*)\)$", "$1"),
        ("parentheses_start", r"^\((?!.*\)$)", ""),
        ("parentheses_end", r"^(?!\()(.*)\)$", "$1"),
        ("quotes", "^[\"']+|[\"']+$", ""),
        ("brackets", r"^\[(.*)\]$", "$1"),
        ("trailing_comma", r",+$", ""),
        ("trailing_period", r"\.+$", ""),
    ]
    step = lambda acc, rule: F.when(flags[rule[0]], F.trim(F.regexp_replace(acc, rule[1], rule[2]))).otherwise(acc) if rule[0] in flags else acc
    return reduce(step, rules, x)


def affix_clean(x: Column, prefixes: Column, suffixes: Column) -> Column:
    """Take off the first learned prefix and the first learned suffix that match, case ignored, then quotes and parentheses."""
    first = lambda affixes, test: F.get(F.filter(affixes, test), 0)
    head = first(prefixes, lambda p: F.startswith(F.lower(x), F.lower(p)) & (F.length(p) < F.length(x)))
    cut = F.when(head.isNotNull(), F.substr(x, F.length(head) + 1)).otherwise(x)
    tail = first(suffixes, lambda s: F.endswith(F.lower(cut), F.lower(s)) & (F.length(s) < F.length(cut)))
    cut = F.when(tail.isNotNull(), F.substr(cut, F.lit(1), F.length(cut) - F.length(tail))).otherwise(cut)
    return F.trim(F.regexp_replace(F.trim(cut), "^[\"'(]+|[\"')]+$", ""))


def token_shape(x: Column) -> Column:
    """Letters become A or a, digits 9, runs of one of them get a plus; blanks and other characters stay."""
    marked = F.translate(x, "+", "\u0001")
    for pattern, sign in (("[A-Z]", "\u0002"), ("[a-z]", "\u0003"), ("[0-9]", "\u0004")):
        marked = F.regexp_replace(marked, pattern, sign)
    for sign, letter in (("\u0002", "A"), ("\u0003", "a"), ("\u0004", "9")):
        marked = F.regexp_replace(F.regexp_replace(marked, f"{sign}{{2,}}", f"{letter}+"), sign, letter)
    return F.translate(marked, "\u0001", "+")


def ocr_fixes(x: Column) -> Column:
    """Single characters that scanners confuse, as whole words."""
    fixes = [(r"\b0\b", "O"), (r"\bl\b", "I"), (r"\brn\b", "m"), (r"\bvv\b", "w")]
    return reduce(lambda acc, f: F.regexp_replace(acc, *f), fixes, x)


def should_normalise(x: Column) -> Column:
    """Ten characters or more, and a word of over twenty or blanks under a twentieth."""
    words = F.split(x, r"\s+")
    blanks = F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return (F.length(x) >= 10) & (F.exists(words, lambda w: F.length(w) > 20) | (blanks / F.length(x) < 0.05))


def field_keywords(name: Column) -> Column:
    """Alphabetic parts of a field name, two characters or more."""
    return F.filter(F.split(F.lower(name), "_"), lambda p: p.rlike("^[a-z]+$") & (F.length(p) >= 2))


def row_number_of(name: Column) -> Column:
    """The last numeric part of a field name, or null."""
    parts = F.filter(F.split(name, "_"), lambda p: p.rlike("^[0-9]+$"))
    return F.element_at(F.when(F.size(parts) > 0, parts), -1).cast("int")


def is_tabular(name: Column) -> Column:
    """Names that end in a number or a single letter."""
    return name.rlike("(?i)_([0-9]+|[a-z])$")


def simple_tokens(x: Column) -> Column:
    """White-space tokens without outer punctuation; empty ones go."""
    bare = F.transform(F.split(F.trim(x), r"\s+"), lambda t: F.regexp_replace(t, r"^[^\w]+|[^\w]+$", ""))
    return F.filter(bare, lambda t: t != "")


def missing_suffix(original: Column, corrected: Column) -> Column:
    """What a correction appends to the original, or null."""
    return F.when((original != "") & F.startswith(corrected, original) & (F.length(corrected) > F.length(original)), F.trim(F.substr(corrected, F.length(original) + 1)))


def without_fallback(strategy: Column) -> Column:
    """The strategy behind a fallback label."""
    return F.regexp_replace(strategy, "_fallback$", "")


def generalise_affix(x: Column) -> Column:
    """Dates, names in parentheses and a leading place become placeholders."""
    out = F.regexp_replace(x, r"\d{1,2}[-/. ]\w+[-/. ]\d{2,4}", "[DATE]")
    out = F.regexp_replace(out, r"\)\s*\([^)]*", ") ([NAME]")
    return F.regexp_replace(out, r"^[A-Z]\w+,", "[LOCATION],")


# The default pattern of a field by the first rule that its name matches. The phone rule is mended: as it stands where
# it comes from it is no valid expression, so that such fields never had a default.
DEFAULT_PATTERNS = [
    (r"email|e_mail|surel", r"([a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"),
    (r"(no_hp|no_telp|telepon|phone|hp|handphone|whatsapp|wa)", r"(\+?[0-9]{1,4}?[-.\s]?\(?[0-9]{1,3}?\)?[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,4}[-.\s]?[0-9]{1,9})"),
    (r"nik|nomor_induk", r"(\d{16})"),
    (r"(tanggal|tgl|date).*", r"(\d{2}-\d{2}-\d{4})"),
    (r"(usia|umur|age)", r"(\d+)"),
    (r"(nomor|no_|number|jumlah|total)", r"(\d+)"),
    (r"(nama|name|tempat|desa|kecamatan|kabupaten|kota|provinsi|jenis_kelamin|status)", r"([a-zA-Z\s]+)"),
    (r"alamat|address", r"(.+)"),
]


def default_pattern(name: Column) -> Column:
    """A regular expression by field name: the first rule of ``DEFAULT_PATTERNS`` that holds, else any text."""
    out = F
    for key, pattern in DEFAULT_PATTERNS:
        out = out.when(F.lower(name).rlike(key), pattern)
    return out.otherwise(".+")


def default_choice(name: Column, of: Callable[[str], Column]) -> Column:
    """``of`` the default pattern of a field name, given as a plain string so that it is compiled once."""
    out = F
    for key, pattern in DEFAULT_PATTERNS:
        out = out.when(F.lower(name).rlike(key), of(pattern))
    return out.otherwise(of(".+"))


def sanitise_pattern(pattern: Column) -> Column:
    """A pattern out of its quotes: slashes with flags, or a Python literal with or without an r."""
    bare = F.trim(pattern)
    bare = F.regexp_replace(bare, r"^/(.*)/[a-z]*$", "$1")
    return F.regexp_replace(bare, r"""^r?(["'])(.*)\1$""", "$2")


def has_group(pattern: Column) -> Column:
    """Whether a valid pattern has a group that captures: a parenthesis that is neither escaped, nor in a class, nor special."""
    bare = F.regexp_replace(F.regexp_replace(pattern, r"\\.", ""), r"\[\^?\]?[^\]]*\]", "")
    return bare.rlike(r"\((?!\?)|\(\?P?<(?![=!])")


def pattern_value(text: Column, pattern: Column) -> Column:
    """What a valid ``pattern`` finds in ``text``: its first group if it has one, else the whole match; null without a match."""
    first = F.call_function("regexp_extract", text, F.concat(F.lit("(?:"), pattern, F.lit(")()")), F.lit(1))
    found = F.when(has_group(pattern), first).otherwise(F.call_function("regexp_extract", text, pattern, F.lit(0)))
    return F.when(F.rlike(text, pattern), F.trim(found))


def rule_confidence(value: Column, pattern: Column, words: Column, raw: Column) -> Column:
    """How far a rule's value is trusted: half, less for what cleaning took, by how the pattern fits, by length, by words around, by the pattern's kind; 0 to 1."""
    size, taken = F.length(value), 1 - F.length(value) / F.length(raw)
    cleaned = F.when(raw.isNull() | (raw == value), 0.0).when(taken > 0.3, -0.2).when(taken > 0.15, -0.1).otherwise(0.0)
    fit = F.when(F.rlike(value, F.concat(F.lit("\\A(?:"), pattern, F.lit(")\\z"))), 0.3).when(F.rlike(value, pattern), 0.15).otherwise(-0.2)
    length = F.when(size == 1, -0.25).when(size <= 3, -0.1).when(size <= 100, 0.1).otherwise(0.05)
    many = F.when(words >= 3, 0.15).when(words == 2, 0.1).otherwise(0.0) + F.when(words > 10, -0.15).when(words > 7, -0.1).otherwise(0.0)
    simple = F.when(pattern.rlike(r"\\[dDwWsS]|[+*{]") & (size < 3), -0.15).otherwise(0.0)
    full = F.lit(0.5) + cleaned + fit + length + many + simple
    return F.when(F.coalesce(value, F.lit("")) == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), full)))


def keywords_by_length(name: Column) -> Column:
    """``field_keywords``, the longest first, then by the alphabet."""
    by = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.array_sort(field_keywords(name), by)


def token_overlap(a: Column, b: Column) -> Column:
    """Share of b's distinct words that a has; 0 if b has none."""
    wa, wb = (F.array_distinct(F.array_remove(F.split(F.lower(x), r"\s+"), "")) for x in (a, b))
    return F.when(F.size(wb) > 0, F.size(F.array_intersect(wa, wb)) / F.size(wb)).otherwise(0.0)


def upper_median(values: Column, default: float = 10.0) -> Column:
    """The element at half the length of the sorted array."""
    return F.coalesce(F.get(F.array_sort(values), (F.size(values) / 2).cast("int")), F.lit(default))


def safe_div(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return safe_div(2 * precision * recall, precision + recall)


# Which fields lose their parentheses, and which the date after a comma.
WITHOUT_PARENTHESES = ("supervisor_name", "chairman_name", "recipient_name")
WITHOUT_DATES = ("issue_place",)


def field_clean(name: Column, value: Column) -> Column:
    """A value by the rules of its field: parentheses go, a date after a comma goes, and named fields have single blanks only; others stay."""
    listed = (*WITHOUT_PARENTHESES, *WITHOUT_DATES, "event_name", "event_location", "event_date", "issue_date")
    out = F.when(name.isin(*WITHOUT_PARENTHESES), F.regexp_replace(value, r"[()]", "")).when(name.isin(*WITHOUT_DATES), F.regexp_replace(value, r",\s*\d{1,2}\s+\w+\s+\d{4}", "")).otherwise(value)
    return F.when(name.isin(*listed), ws_collapse(out)).otherwise(out)
