"""Text expressions: folding, canonical forms, tokens, lines, aliases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from billquarry import vocabulary as V

# Python's word, digit and case rules are Unicode-wide; these flags give Java the same.
U = "(?U)"
IU = "(?iU)"

LINE_BREAK = "\r\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"
# looked for one by one, which reads bytes and is quicker than any pattern
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
# what ``\s`` matches under (?U) besides the space and the line feed, and all line breaks: Latin ones listed singly, as one bit
# set, and a range around the wider ones, with other characters in it
_OTHER_BLANKS = "[\\t\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x85\\xa0\\u1680-\\u3000]"


@lru_cache(maxsize=1)
def _folding_tables() -> tuple[str, str, list[tuple[str, str]]]:
    """Characters whose compatibility decomposition, case-folded and without marks, differs.

    The table is computed from the Unicode database instead of being listed:
    one-character results go to ``translate``, longer ones to ``replace``.
    """
    source, target, longer = [], [], []
    blocks = [(0x00A0, 0x0250), (0x0621, 0x064B), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0xFB50, 0xFE00), (0xFE70, 0xFF61)]
    for first, last in blocks:
        for code in range(first, last):
            char = chr(code)
            if char != char.lower() or unicodedata.combining(char):
                continue
            folded = "".join(
                c for c in unicodedata.normalize("NFKD", char).casefold() if not unicodedata.combining(c)
            )
            if folded == char:
                continue
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            elif first < 0x2000 and folded.isalnum():
                longer.append((char, folded))
    return "".join(source), "".join(target), longer


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times inside one expression.

    Inside higher-order functions Catalyst does not share repeated parts, so a
    value used twice would be computed twice at every level of nesting.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def filled(c: Column) -> Column:
    """A text, NULL when it is empty. Computed once: under a condition or in a lambda ``nullif`` computes its argument twice."""
    return let(c, lambda v: F.when(v != "", v))


def fold(c: Column) -> Column:
    """Case-folded text without marks; Arabic alef forms unified, tatweel dropped."""
    source, target, longer = _folding_tables()
    pairs = [p for p in longer if p[0] in "ßŉǰĳǆǉǌǳﬁﬂ"]

    def tabled(low: Column) -> Column:
        folded = replaced = F.translate(low, source, target)
        for char, replacement in pairs:
            replaced = F.replace(replaced, F.lit(char), F.lit(replacement))
        # hardly any text has letters that become two; looking for them is cheaper than replacing them
        return F.regexp_replace(F.when(any_in(low, *[char for char, _ in pairs]), replaced).otherwise(folded), "[\\p{M}ـ]", "")

    # plain ASCII, a byte a character, needs no table
    return F.when(F.octet_length(c) > F.length(c), let(F.lower(c), tabled)).otherwise(F.lower(c))


def canonical(c: Column) -> Column:
    """Lower-case letters and digits only (accents kept)."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def compact(c: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def word_tokens(c: Column) -> Column:
    """Word tokens of folded text, repeats kept, in order."""
    return F.regexp_extract_all(fold(c), F.lit(U + r"\w+"), F.lit(0))


def long_tokens(c: Column) -> Column:
    """Word tokens of folded text longer than one character."""
    return F.filter(word_tokens(c), lambda t: F.length(t) > 1)


def plain_tokens(c: Column) -> Column:
    """Word tokens of lower-cased (not folded) text."""
    return F.regexp_extract_all(F.lower(c), F.lit(U + r"\w+"), F.lit(0))


def led(pattern: str) -> str:
    """The same pattern, looking at a first letter before the word border in front of it: most places do not hold it."""
    first = re.match(r"\\b([a-z])", pattern)
    return f"(?={first[1]}){pattern}" if first else pattern


def any_of(patterns: list[str]) -> str:
    """One pattern for several that begin with a word border and a plain letter; the letter is looked at first."""
    letters = {re.match(r"\\b([a-z])", p)[1] for p in patterns}
    return "(?=[" + "".join(sorted(letters)) + "])(?:" + "|".join(patterns) + ")"


def sought(c: Column) -> Column:
    """Lower-cased text in which a lower-case pattern under (?U) finds what it finds in the text itself under (?iU).

    Four letters beyond ASCII that (?iU) takes for s, i and k are replaced by these. Patterns are quicker without regard to
    case, and looking for a plain word first, without which a pattern cannot match, costs a small part of either.
    """
    letters = "\u017f\u0131\u0130\u212a"
    return F.lower(F.when(any_in(c, *letters), F.translate(c, letters, "siik")).otherwise(c))


def any_in(c: Column, *words: str) -> Column:
    """Whether a text holds one of the words."""
    return reduce(or_, [c.contains(w) for w in words])


def plain_spaces(c: Column) -> Column:
    """True only where spaces and line feeds are all the white space and all the line breaks of a text."""
    return ~c.rlike(_OTHER_BLANKS)


def plain_blanks(c: Column) -> Column:
    """As above, and no two spaces follow each other."""
    return ~c.contains("  ") & plain_spaces(c)


def split_lines(c: Column) -> Column:
    """Lines of a text; a final line break opens no further line."""
    def cut(s: Column) -> Column:
        # most texts break lines with a plain line feed, which splits without a pattern
        return F.when(any_in(s, *RARE_BREAKS), F.split(s, LINE_BREAK)).otherwise(F.split(s, "\n"))

    return let(let(c, cut), lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p))


def tail(c: Column, n: int) -> Column:
    """Last n characters."""
    return F.substring(c, -n, n)


def western_digits(c: Column) -> Column:
    """Arabic digits and separators as Western ones; texts without any are left alone."""
    # one range around them all; other characters in it stay as they are
    return F.when(c.rlike("[٠-۹]"), F.translate(c, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹٫٬٪", "01234567890123456789. %")).otherwise(c)


def squeeze(c: Column) -> Column:
    """Every run of blanks as one space; single spaces, nearly all of them, are passed over."""
    return F.regexp_replace(c, U + r"\s(?:\s+|(?<! ))", " ")


def strip_chars(c: Column, chars: str) -> Column:
    """Trim any of the given characters from both ends."""
    return F.btrim(c, F.lit(chars))


def match(c: Column, pattern: str) -> Column:
    """Case-insensitive, Unicode-aware search."""
    return F.coalesce(c, F.lit("")).rlike(IU + pattern)


def grab(c: Column, pattern: str, group: int = 1, flags: str = IU) -> Column:
    """First match of a pattern's group, NULL when there is none or it is empty."""
    return filled(F.regexp_extract(F.coalesce(c, F.lit("")), flags + pattern, group))


def grab_all(c: Column, pattern: str, group: int = 1, flags: str = IU) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(flags + pattern), F.lit(group))


def non_empty(c: Column) -> Column:
    """Trimmed text, NULL when blank."""
    return F.nullif(F.trim(c), F.lit(""))


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols])


def count_contained(c: Column, words: list[str]) -> Column:
    """How many of the words occur as substrings."""
    total = F.lit(0)
    for word in words:
        total = total + c.contains(word).cast("int")
    return total


def needed(pattern: str) -> list[str] | None:
    """Plain words of which a text must hold one to match: the longest of each branch; None where a branch is not words and blanks."""
    words = []
    for branch in pattern.split("|"):
        pieces = re.split(r"\\b|\\s[+*]|\[[^]]*\]", branch)
        if not all(re.fullmatch(r"[^\W\d_]*", p) for p in pieces) or not any(pieces):
            return None
        words.append(max(pieces, key=len))
    return words


def word_first(pattern: str) -> str:
    """The same pattern, looking for its first word as such, which skips ahead, and then back at the border in front of it."""
    first = re.match(r"\\b([a-z]{4,})(?![*+?{])", pattern)
    return f"{first[1]}(?<=\\b{first[1]}){pattern[first.end():]}" if first and "|" not in pattern else led(pattern)


def has_pattern(lowered: Column, pattern: str) -> Column:
    """Whether a lower-case pattern occurs in lower-cased text, whose words are looked for first."""
    words, found = needed(pattern), lowered.rlike(U + word_first(pattern))
    return any_in(lowered, *words) & found if words else found


def count_matched(lowered: Column, patterns: list[str]) -> Column:
    """How many of the lower-case patterns occur in lower-cased text."""
    total = F.lit(0)
    for pattern in patterns:
        total = total + has_pattern(lowered, pattern).cast("int")
    return total


def strip(c: Column) -> Column:
    """Without white space at both ends; most texts begin and end with plain printed characters."""
    return F.when(c.rlike(r"\A[!-~](?s:.*[!-~])?\z"), c).otherwise(F.regexp_replace(c, U + r"^\s+|\s+$", ""))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_")


def answer_language(question: Column) -> Column:
    return let(
        fold(question),
        lambda folded: F.when(folded.rlike(U + r"(?:en|in)\s+(?:arabe|arabic)\b|بالعربية|بالعربي"), "ar")
        .when(folded.rlike(U + r"(?:en|in)\s+(?:francais|french)\b|بالفرنسية|بالفرنسي"), "fr")
        .when(folded.rlike("[ء-ي]"), "ar")
        .otherwise("fr"),
    )


def expand_question(question: Column) -> Column:
    """The question followed by the synonyms of every concept it mentions."""
    return let(
        fold(question),
        lambda folded: F.concat_ws(" ", question, *[F.when(folded.rlike(U + p), F.lit(terms)) for p, terms in V.CONCEPTS]),
    )


def section_hint(line: Column) -> Column:
    """Section a line announces, by ordered rules; NULL when it announces none."""
    return let(fold(line), _section)


def _section(value: Column) -> Column:
    arabic = F.octet_length(value) > F.length(value)

    def has(pattern: str, latin: str, other: str = "") -> Column:
        """A pattern, tried where one of the pieces stands that a match of it holds: most lines hold none."""
        pieces = any_in(value, *latin.split())
        return (pieces | (arabic & any_in(value, *other.split("|"))) if other else pieces) & value.rlike(U + pattern)

    customer = has(r"\b(?:client|customer|bill to)\b|الحريف|العميل", "client customer bill", "الحريف|العميل")
    invoice = has(r"\b(?:facture|invoice|echeance|date)\b|فاتورة|تاريخ", "facture invoice echeance date", "فاتورة|تاريخ")
    return (
        F.when(
            has(r"\b(?:designation|description)\b|البيان|وصف", "designation description", "البيان|وصف")
            & value.rlike(U + r"\b(?:qte|qty|quantity|quantite|prix|price|pu|unite)\b|كمية|سعر"),
            "line_items",
        )
        .when(
            has(
                r"\b(?:total|subtotal|montant\s+(?:h\.?t|t\.?t\.?c)|net\s+a\s+payer|timbre|t\.?v\.?a|vat)\b"
                r"|المبلغ الجملي|دون احتساب|الطابع", "total montant payer timbre tv t.v vat", "المبلغ الجملي|دون احتساب|الطابع",
            )
            & ~has(r"\b(?:code|identifiant|matricule)\s+(?:t\.?\s*v\.?\s*a|fiscal)", "code identifiant matricule"),
            "totals",
        )
        .when(
            has(r"\b(?:payment|paiement|paye|especes|iban|rib|arretee)\b|طريقة الدفع|نقدا", "pay paiement especes iban rib arretee", "طريقة الدفع|نقدا"),
            "payment_information",
        )
        .when(customer & invoice, "other")
        .when(customer & ~any_in(value, "signature", "cachet"), "customer")
        .when(has(r"\b(?:supplier|fournisseur|emetteur)\b|المورد", "supplier fournisseur emetteur", "المورد"), "supplier")
        .when(invoice, "invoice_info")
    )
