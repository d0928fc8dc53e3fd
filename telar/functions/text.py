"""Text functions of columns: normalisation, tokens, template slots, surface clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A corpus token: ASCII letters, digits and three kinds of apostrophe, in lower-cased text.
CORPUS_TOKEN = "[a-z0-9'’ʼ]+"
SLOT = r"\{[A-Z0-9_]+\}"
_SPACE = r"[ \t\r\n\f\x0b ]"


def blank(c: Column) -> Column:
    """NULL and NaN text as an empty string."""
    return F.when(c.isNull() | (c == "NaN") | (c == "nan"), F.lit("")).otherwise(c.cast("string"))


def strip(c: Column) -> Column:
    """White space at both ends away, no-break spaces too."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def to_bool(c: Column) -> Column:
    """True for 1/true/yes/y, False for 0/false/no/n, else NULL."""
    low = F.lower(strip(c.cast("string")))
    return F.when(low.isin("1", "true", "yes", "y"), True).when(low.isin("0", "false", "no", "n"), False)


def split_set(c: Column, pattern: str = r"[;,/| ]+") -> Column:
    """Members of a delimited set: lower case, trimmed, distinct, without empties."""
    return F.array_distinct(F.filter(F.transform(F.split(blank(c), pattern), lambda x: F.lower(strip(x))), lambda x: x != ""))


def split_list(c: Column) -> Column:
    """Members of a list divided by semicolons, in order."""
    return F.filter(F.transform(F.split(blank(c), ";"), strip), lambda x: x != "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, f"{_SPACE}+", " "))


def tidy_marks(c: Column) -> Column:
    """One space between words and none before a closing mark."""
    return F.regexp_replace(collapse(c), r" +([.?!,;:])", "$1")


def is_vowel_initial(c: Column) -> Column:
    """Whether the first character that is spoken is a vowel; glottal marks, hyphens and spaces are passed over."""
    return F.coalesce(c, F.lit("")).rlike("^[ '’7\\-\\u200b]*[aeiouäëïöüAEIOUÄËÏÖÜ]")


def sentence_case(c: Column) -> Column:
    """The first letter in upper case, past leading marks; a text that begins with a digit stays."""
    s = strip(c)
    lead = F.regexp_extract(s, r"^([^\p{L}\p{N}]*)(\p{L}?)", 1)
    letter = F.regexp_extract(s, r"^([^\p{L}\p{N}]*)(\p{L}?)", 2)
    return F.when(letter == "", s).otherwise(F.concat(lead, F.upper(letter), F.substring(s, F.length(lead) + F.length(letter) + 1, F.length(s))))


def capitalize_sentences(c: Column) -> Column:
    """The first character, and each Spanish lower-case letter after a full stop, question or exclamation mark and space, in upper case."""
    first = F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
    # every part begins where the one before ended with a mark and white space
    parts = F.split(first, r"(?<=[.!?]\s{1,9})(?=[a-záéíóúüñ])")
    return F.when(c == "", c).otherwise(F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30)))), ""))


def clean_kek(c: Column, trailing_hyphens: bool = False) -> Column:
    """Q'eqchi' clean-up: hyphens, a lexical reflexive before a reflexive pronoun, repeated spaces.

    A hyphen before a word character goes, as the corpus was made; with trailing_hyphens, one at a word's end instead.
    """
    dash = F.regexp_replace(c, r"-(?![\p{L}\p{N}_-])", "") if trailing_hyphens else F.regexp_replace(c, r"-(?=[\p{L}\p{N}_])", "")
    dash = F.regexp_replace(dash, "--+", "-")
    reflexive = F.regexp_replace(dash, r"(?i)(?<![\p{L}\p{N}_])(?:ib[’']|[’']ib)\s+((?:w|aaw|r|q|eer)ib[’']|rib[’']eb)", "$1")
    return F.trim(F.regexp_replace(reflexive, r"\s{2,}", " "))


def clean_english(c: Column) -> Column:
    """English clean-up: unfilled slots, doubled determiners and auxiliaries, spaces."""
    t = F.regexp_replace(collapse(c), r"\{[^}]+\}", "")
    for words in ("these|those|this|that|the|an|a", "were|was|are|is|does|did|do|will|have|has|had"):
        t = F.regexp_replace(t, rf"(?i)\b({words}) \1\b", "$1")
    return collapse(t)


def clean_spanish(c: Column) -> Column:
    """Spanish clean-up: contractions, doubled determiners and clitics, spaces."""
    t = collapse(c)
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)(?U)\ba el\b", "al"), r"(?i)(?U)\bde el\b", "del")
    t = F.regexp_replace(t, r"(?i)(?U)\b(unas|unos|una|un|las|los|la|el|se) \1\b", "$1")
    return collapse(t)


def dedupe_plural(c: Column) -> Column:
    """A doubled plural particle eb' once."""
    return F.regexp_replace(c, r"\b(eb['’])(?:\s+eb['’])+", "$1")


def corpus_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(CORPUS_TOKEN), F.lit(0))


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs of a token list, joined by a space."""
    n = F.size(tokens)
    return F.when(n > 1, F.zip_with(F.slice(tokens, 1, n - 1), F.slice(tokens, 2, n - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def annotation_tokens(c: Column) -> Column:
    """Words and marks: marks at a word's ends are tokens of their own, apostrophes stay."""
    return F.regexp_extract_all(c, F.lit(r"[.,!?;:](?=[.,!?;:]*(?:\s|$))|(?<![^\s.,!?;:])[.,!?;:]|(?:[^\s.,!?;:]|[.,!?;:](?=\S*[^\s.,!?;:]))+"), F.lit(0))


def slots(template: Column) -> Column:
    """Distinct slot tokens of a template, in order."""
    return F.array_distinct(F.regexp_extract_all(template, F.lit(SLOT), F.lit(0)))


def fill(template: Column, values: Column) -> Column:
    """A template with its slots replaced from a map; a slot without a value becomes empty."""
    pieces = F.regexp_extract_all(template, F.lit(r"\{[A-Z0-9_]+\}|[^{]+|\{"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^{SLOT}$"), F.coalesce(F.try_element_at(values, F.substring(p, 2, F.length(p) - 2)), F.lit(""))).otherwise(p)), "")


def pair_key(a: Column, b: Column) -> tuple[Column, Column]:
    """The two sides of a pair, trimmed, in order: the same for both directions."""
    return F.least(strip(a), strip(b)), F.greatest(strip(a), strip(b))
