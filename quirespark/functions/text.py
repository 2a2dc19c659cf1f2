"""Column builders for text: folding, tokens, shingles, tags, folios, roman numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic characters and their plain forms.
TYPOGRAPHIC = {"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl"}
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: A word of running text: Latin letters, then letters, apostrophes and hyphens.
WORD = r"[A-Za-zÀ-ÖØ-öø-ÿŒœ][A-Za-zÀ-ÖØ-öø-ÿŒœ'’\-]*"
# Abbreviations of a scholar's apparatus, which count as words; suffixes of inflected forms and what takes
# their place in the lemma; particles that belong to the surname after them; a numeral in roman letters.
APPARATUS = (
    "f", "ff", "op", "cit", "ibid", "cf", "pp", "seq", "vol", "vols", "ed", "eds", "ch", "chs", "et", "al", "fig", "figs", "fol", "fols",
    "no", "nos", "viz", "cp", "passim", "supra", "infra", "sic", "esp", "repr", "rev", "trans",
)
INFLECTIONS = (("s", ""), ("es", ""), ("ed", ""), ("ed", "e"), ("ing", ""), ("ing", "e"), ("ly", ""), ("ies", "y"), ("est", ""), ("er", ""))
PARTICLES = ("van", "von", "de", "der", "den", "di", "du", "la", "le", "mac", "mc", "o", "ten", "ter")
ROMAN = "^M{0,4}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def plain_punctuation(text: Column) -> Column:
    for ligature, letters in LIGATURES.items():
        text = F.replace(text, F.lit(ligature), F.lit(letters))
    return F.translate(text, "".join(TYPOGRAPHIC), "".join(TYPOGRAPHIC.values()))


def fold_text(text: Column) -> Column:
    """Typographic characters made plain and words joined over a hyphen at a line's end; null is empty."""
    return F.regexp_replace(plain_punctuation(F.coalesce(text, F.lit(""))), r"(?U)(\w)-\s*\n\s*(\w)", "$1$2")


def fold_word(word: Column) -> Column:
    """The form in which words are compared: lower case, no hyphens or apostrophes, Latin accents off."""
    return F.translate(F.translate(F.lower(plain_punctuation(word)), "-'", ""), ACCENTED, PLAIN)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold_text(text), F.lit(WORD), F.lit(0))


def simple_words(text: Column) -> Column:
    """Lower-case words of a-z and 0-9; everything else parts them."""
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9 ]+", " "), " "), "")


def windows(ws: Column, k: int, glue: str = " ") -> Column:
    """Joined runs of k words, with repeats; none if there are fewer words.

    Words are fetched one by one: slice() inside a lambda would copy the whole array for every window.
    """
    run = lambda i: F.concat_ws(glue, *[F.get(ws, i + j) for j in range(k)])
    return F.when(F.size(ws) >= k, F.transform(F.sequence(F.lit(0), F.size(ws) - k), run)).otherwise(F.array().cast("array<string>"))


def page_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k words; a shorter text is one shingle, an empty one has none."""
    return let(simple_words(text), lambda ws: F.when((F.size(ws) > 0) & (F.size(ws) < k), F.array(F.array_join(ws, " "))).otherwise(F.array_distinct(windows(ws, k))))


def strict_shingles(text: Column, k: int = 6) -> Column:
    """Distinct runs of k lower-case ASCII words; a text of fewer words has none."""
    ws = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return let(ws, lambda w: F.array_distinct(windows(w, k)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Shared share of the smaller set."""
    return F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))


def containment(a: Column, b: Column) -> Column:
    """Share of a that b has; null for an empty a."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.size(a), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union; two empty sets agree."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


# The entities that strip_tags decodes.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&copy;": "©", "&mdash;": "—", "&ndash;": "–", "&hellip;": "…", "&eacute;": "é", "&uuml;": "ü", "&amp;": "&"}


def strip_tags(html: Column) -> Column:
    """Text of a fragment: ends of blocks and breaks become spaces, other tags vanish, entities are decoded, ends trimmed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)</(?:p|div|h[1-6]|li|tr|td|th|table|ul|ol|blockquote|figcaption)>|<(?:br|hr)\b[^>]*>", " ")
    t = F.regexp_replace(t, "<[^>]+>", "")
    for entity, char in ENTITIES.items():
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.trim(t)


def norm_title(text: Column) -> Column:
    """Lower case, with single spaces; what is no letter a-z, digit or space is left out, so that `It's` is `its`."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "), "[^a-z0-9 ]", ""))


def surname_forms(name: Column) -> Column:
    """The last name, and it with a particle before it (in either case, with or without a stop); forms of two letters or
    fewer do not count. Commas at the end are no part of a name."""
    parts = F.array_remove(F.split(F.rtrim(F.trim(name), F.lit(",")), r"\s+"), "")

    def forms(p: Column) -> Column:
        last, before = F.try_element_at(p, F.lit(-1)), F.try_element_at(p, F.lit(-2))
        whole = F.when(F.rtrim(F.lower(before), F.lit(".")).isin(*PARTICLES), F.concat_ws(" ", before, last))
        return F.filter(F.array(last, whole), lambda x: F.length(x) > 2)

    return let(parts, forms)


def roman_to_int(text: Column) -> Column:
    """1 to 99 for a roman numeral written in the one right way, in capitals; else null."""
    tens, units = ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"], ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]
    numerals = [t + u for t in tens for u in units][1:]
    return F.nullif(F.array_position(F.lit(numerals), text), F.lit(0)).cast("int")


def is_roman(word: Column) -> Column:
    """A numeral of two letters or more in one case, stops and commas aside."""
    bare = F.regexp_replace(word, "^[.,;:]+|[.,;:]+$", "")
    one_case = (bare == F.upper(bare)) | (bare == F.lower(bare))
    return (F.length(bare) >= 2) & one_case & F.upper(bare).rlike(ROMAN)


def lemma_candidates(word: Column) -> Column:
    """The word and the forms that taking off an inflection leaves (a stem needs three letters)."""
    forms = [F.when(F.endswith(word, F.lit(s)) & (F.length(word) > len(s) + 2), F.concat(F.left(word, F.length(word) - len(s)), F.lit(add))) for s, add in INFLECTIONS]
    return F.filter(F.array(word, *forms), lambda x: x.isNotNull())


def is_apparatus(word: Column) -> Column:
    return word.isin(*APPARATUS) | word.isin("a", "i", "o")


def parse_folio(text: Column) -> Column:
    """Page number that a running head shows, or null.

    Rules in order: the line has at most 60 characters; `Page N of M`; a tight chapter-page number at either end
    (chapter * 1000 + page) beside letters or alone, unless its page starts with 0; an appendix page `A-2`
    ((100 + letter) * 1000 + page); else, beside at least three letters, one to three digits at either end.
    """
    line = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))

    def rules(s: Column) -> Column:
        number = lambda p, g=1: F.nullif(F.regexp_extract(s, p, g), F.lit("")).cast("int")
        head, tail = r"^([0-9]{1,2})-([0-9]{1,3})(?:\s|$)", r"\s([0-9]{1,2})-([0-9]{1,3})$"
        first = s.rlike(head)
        chapter = F.when(first, number(head)).otherwise(number(tail))
        digits = F.when(first, F.regexp_extract(s, head, 2)).otherwise(F.regexp_extract(s, tail, 2))
        page = F.nullif(digits, F.lit("")).cast("int")
        alone = s.rlike(r"^[0-9]{1,2}-[0-9]{1,3}$")
        compound = F.when((s.rlike("[A-Za-z]{2}") | alone) & ~F.startswith(digits, F.lit("0")) & chapter.between(1, 99) & page.between(1, 999), chapter * 1000 + page)
        letter = F.regexp_extract(s, r"^([A-Z])-[1-9][0-9]{0,2}$", 1)
        appendix = F.when(letter != "", (F.ascii(letter) - 65 + 100) * 1000 + number(r"^[A-Z]-([1-9][0-9]{0,2})$"))
        lead, end = r"^([0-9]{1,3})(?:\s*[•·|:\-]|\s)\s*\S", r"(?:[•·|:\-]\s*|\s)([0-9]{1,3})$"
        plain = F.when(s.rlike("[A-Za-z]{3}"), F.coalesce(number(lead), number(end)))
        found = F.coalesce(number(r"\bPage ([0-9]{1,3}) of [0-9]{1,4}\b"), compound, appendix, F.when(plain.between(1, 999), plain))
        return F.when((F.length(s) > 0) & (F.length(s) <= 60), found)

    return let(line, rules)


def names_page(title: Column, text: Column) -> Column:
    """Whether enough of a title's words (three letters or more) stand in the text: 60 % of them, at least one."""
    ws = F.filter(F.split(norm_title(title), " "), lambda w: F.length(w) > 2)
    return let(ws, lambda w: F.size(F.filter(w, lambda x: norm_title(text).contains(x))) >= F.greatest(F.lit(1), F.ceil(F.size(w) * 3 / 5)))


def edit_within(a: Column, b: Column, most: int = 2) -> Column:
    """Whether the Levenshtein distance is at most `most`; the search stops beyond it."""
    return F.levenshtein(a, b, most) >= 0
