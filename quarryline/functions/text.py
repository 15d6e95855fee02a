"""Text, JSON and markup functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that Python's and RE2's ``\s`` share in ASCII text.
SPACE = r"[ \t\n\r\f\x0B]+"


#: Letters, the two dashes and the four curly quotes that scans spell out one by one.
SPELT = "[A-Za-z\u2013\u2014\u2018\u2019\u201c\u201d]"


def words(text: Column) -> Column:
    """White-space words."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased white-space words."""
    return words(F.lower(text))


def folded(text: Column) -> Column:
    """The text for comparison, letter case aside: a letter whose upper case is longer (sharp s) equals that.

    Capitals beside the usual ones go by hand, as Spark takes upper(lower(x)) for upper(x)."""
    return F.upper(F.translate(text, "\u1e9e\u212a\u212b\u2126", "\u00dfk\u00e5\u03c9"))


def clean_text(text: Column) -> Column:
    """One space between words, none around."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def collapse_spaces(text: Column) -> Column:
    """Runs of spaces become one; other white space stays; ends are stripped."""
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def ocr_clean(text: Column) -> Column:
    """Letters spelt out one by one (five or more, single spaces between) are joined; then spaces are collapsed.

    A space goes if the text around it is such a run: lone letters on both sides, and enough of them.
    """
    run = rf"(?<![^\s])(?:{SPELT} ){{4,}}{SPELT}(?![^\s])"
    parts = F.split(F.regexp_replace(text, f"({run})", "\u0001$1\u0001"), "\u0001")
    joined = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, " ", "")).otherwise(p))
    return collapse_spaces(F.array_join(joined, ""))


def inline_markup(text: Column, italics: bool = True) -> Column:
    """Bold, italic, code, links and strike-through of Markdown as markup, after escaping."""
    # Patterns and markup are fixed values of the output format.
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (r"\*\*(.*?)\*\*", "<b>$1</b>"), ("__(.*?)__", "<b>$1</b>")]
    if italics:
        steps += [(r"(?<!\w)\*([^*\n]+?)\*(?!\w)", "<i>$1</i>"), (r"(?<!\w)_([^_\n]+?)_(?!\w)", "<i>$1</i>")]
    steps += [
        ("`([^`]+?)`", '<font name="Courier" size="9" color="darkred">$1</font>'),
        (r"\[([^\]]+?)\]\(([^)]+?)\)", '<link href="$2" color="blue"><u>$1</u></link>'),
        ("~~(.*?)~~", "<strike>$1</strike>"),
    ]
    return reduce(lambda t, s: F.regexp_replace(t, *s), steps, text)


def json_text(raw: Column) -> Column:
    """The JSON part of a model's answer: without fences, from the first brace or bracket to the last."""
    # The fences' and brackets' patterns are fixed values.
    text = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    found = F.regexp_extract(text, r"(?s)(\{.*\}|\[.*\])", 1)
    return F.trim(F.when(found != "", found).otherwise(text))


def parsed_json(raw: Column) -> Column:
    """The JSON as a variant, null if it doesn't parse."""
    return F.try_parse_json(json_text(raw))


def json_or(raw: Column, default: str) -> Column:
    """The JSON as a variant, or that of ``default`` where there is none."""
    return F.coalesce(parsed_json(raw), F.parse_json(F.lit(default)))


def has_json(raw: Column) -> Column:
    return parsed_json(raw).isNotNull()


def has_citation(text: Column) -> Column:
    return text.rlike(r"\[.+?\]")


def cost_estimate(text: Column) -> Column:
    """Tokens by words / 0.75, at a millionth each."""
    return F.size(words(text)) / F.lit(0.75) * F.lit(1e-6)
