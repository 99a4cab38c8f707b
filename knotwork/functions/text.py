"""String functions over columns; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PAGE_TYPES, PLACEHOLDER

#: Blanks that part tokens; the rest of a line is tokens.
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^ \t\n\r\f]"
#: A token or a run of blanks: the pieces of a line, put together, are the line.
PIECE = r"[\p{L}\p{M}]+|\p{N}+|[ \t\n\r\f]+|[^ \t\n\r\f]"
#: Innermost parentheses with a placeholder, and the clean-up's patterns with what they become, in order.
MARKED = rf"\([^()]*{PLACEHOLDER}[^()]*\)"
CLEANUP = (("[ \t]+", " "), ("(?m)^ +| +$", ""), ("\n{3,}", "\n\n"), (r"(?m)(\n\s*){3,}", "\n\n"), (r"^\s+|\s+$", ""))


def clean_anchor(anchor: Column, prefix: str = ":en:") -> Column:
    """The title that a link's text names: no section, no underscores, no prefix of the own language."""
    plain = F.trim(F.translate(F.split_part(anchor, F.lit("#"), F.lit(1)), "_", " "))
    return F.trim(F.when(F.startswith(plain, F.lit(prefix)), F.substr(plain, F.lit(len(prefix) + 1))).otherwise(plain))


def key_from_target(target: Column, prefix: str = ":en:", category: str = "Category") -> Column:
    """The lower-cased key under which a link's target is looked up among titles."""
    plain = F.lower(F.trim(F.translate(F.split_part(target, F.lit("#"), F.lit(1)), "_", " ")))
    name = category.lower()
    own = F.when(F.startswith(plain, F.lit(prefix)), F.trim(F.substr(plain, F.lit(len(prefix) + 1))))
    colon = F.when(F.startswith(plain, F.lit(f":{name}:")), F.substr(plain, F.lit(2)))
    return F.replace(F.coalesce(own, colon, plain), F.lit(f"{name}: "), F.lit(f"{name}:"))


def anchor_or_original(anchor: Column, prefix: str = ":en:") -> Column:
    return F.coalesce(F.nullif(clean_anchor(anchor, prefix), F.lit("")), anchor)


def letters_digits(text: Column) -> Column:
    """Every code point that is neither letter nor digit becomes one blank."""
    return F.regexp_replace(text, r"[^\p{L}\p{Nd}]", " ")


def without_marked_parentheticals(text: Column) -> Column:
    """Drops innermost parentheses that hold a placeholder, then all placeholders."""
    return F.regexp_replace(F.regexp_replace(text, MARKED, ""), PLACEHOLDER, "")


def clean_text(text: Column) -> Column:
    out = without_marked_parentheticals(text)
    for pattern, new in CLEANUP:
        out = F.regexp_replace(out, pattern, new)
    return out


def capitalize_first(text: Column) -> Column:
    return F.concat(F.upper(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def uncapitalize_first(text: Column) -> Column:
    return F.concat(F.lower(F.substr(text, F.lit(1), F.lit(1))), F.substr(text, F.lit(2)))


def transclusions(wikitext: Column) -> Column:
    """What stands between each latest opening brace and the next closing one."""
    return F.regexp_extract_all(wikitext, F.lit(r"\{([^{}]+)\}"), F.lit(1))


def last_transclusion(wikitext: Column) -> Column:
    return F.try_element_at(transclusions(wikitext), F.lit(-1))


def is_disambiguation(transclusion: Column, names: tuple[str, ...]) -> Column:
    return F.lower(F.split_part(transclusion, F.lit("|"), F.lit(1))).isin(*names)


def count_matches(text: Column, part: Column) -> Column:
    """Occurrences that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def word_count(text: Column) -> Column:
    """Parts between runs of blanks; a leading run leaves an empty first part, trailing ones none."""
    return F.size(F.split(F.regexp_replace(text, r"\s+$", ""), r"\s+"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def case_of(tokens_: Column) -> Column:
    """UPPER, LOWER, UPPER_FIRST or MIXED of the tokens that have a letter."""
    worded = F.filter(tokens_, lambda t: F.regexp_like(t, F.lit(r"\p{L}")))
    all_are = lambda pattern: F.forall(worded, lambda t: F.regexp_like(t, F.lit(pattern)))
    return (
        F.when(F.size(worded) == 0, "MIXED")
        .when(all_are(r"^\p{Lu}+$"), "UPPER")
        .when(all_are(r"^\p{Ll}+$"), "LOWER")
        .when(all_are(r"^\p{Lu}+$|^\p{Lu}\p{Ll}*$"), "UPPER_FIRST")
        .otherwise("MIXED")
    )


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def title_case(text: Column) -> Column:
    """Each token's first letter upper, the text between tokens as it is; all-upper texts are lowered first."""
    base = F.when(case_of(tokens(text)) == "UPPER", F.lower(text)).otherwise(text)
    return F.array_join(F.transform(pieces(base), capitalize_first), "")


def sentence_case(text: Column) -> Column:
    base = F.when(case_of(tokens(text)) == "UPPER", F.lower(text)).otherwise(text)
    return capitalize_first(base)


def case_variants(text: Column) -> Column:
    """Title and sentence case of texts in one case, those that differ from the text."""
    both = F.array_distinct(F.array(title_case(text), sentence_case(text)))
    return F.when(case_of(tokens(text)).isin("LOWER", "UPPER"), F.array_except(both, F.array(text))).otherwise(F.array().cast("array<string>"))


def page_type_name(number: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in PAGE_TYPES.items() for x in (v, k))), number)


def markup_text(text: Column) -> Column:
    """Non-breaking blanks become blanks; blank texts become null."""
    return F.nullif(F.trim(F.replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), F.lit("&nbsp;"), F.lit(" "))), F.lit(""))
