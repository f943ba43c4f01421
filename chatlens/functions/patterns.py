"""Patterns of sensitive data, with the labels that replace them."""

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of sensitive data; ``regex`` is in Java syntax.

    Most texts hold none, so each pattern comes with a cheap screen that every match passes: a literal
    it contains (``needs``) and simpler regexes that all occur in it (``forms``, cheapest first).
    ``forms_with_letters`` tells that a form can match letters. ``scan`` finds what ``regex`` finds in linear
    time; what its first group takes is no part of the match.
    """

    name: str
    regex: str
    label: str
    needs: str | None = None
    forms: tuple[str, ...] = ()
    forms_with_letters: bool = False
    scan: str | None = None


_DIGITS = "[0-9]{4}"
_CARD_FORMS = (_DIGITS, "[0-9]{12}")
# The last ten characters of a tax code, position by position. The classes are spelt out, as the regex
# engine looks up a list of characters faster than it compares with ranges.
_LETTER = "[ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz]"
_DIGIT_OR_CODE = "[0123456789LMNPQRSTUVlmnpqrstuv]"
_MONTH = "[ABCDEHLMPRSTabcdehlmprst]"
_PLACE = "[ABCDEFGHIJKLMZabcdefghijklmz]"
_TAX_CODE_TAIL = (
    f"{_DIGIT_OR_CODE}{{2}}{_MONTH}{_DIGIT_OR_CODE}{{2}}{_PLACE}{_DIGIT_OR_CODE}{{3}}{_LETTER}"
)

# Regexes, labels and their order decide what is found and how it is written.
CODICE_FISCALE = Pattern(
    "CODICE_FISCALE",
    r"\b(?:[A-Za-z][AEIOUaeiou][AEIOUXaeioux]|[AEIOUaeiou]X{2}|[B-DF-HJ-NP-TV-Zb-df-hj-np-tv-z]{2}[A-Za-z]){2}(?:[\dLMNP-Vlmnp-v]{2}(?:[A-EHLMPR-Ta-ehlmpr-t](?:[04LQ][1-9MNP-Vlmnp-v]|[15MR][\dLMNP-Vlmnp-v]|[26NS][0-8LMNP-Ulmnp-u])|[DHPSdhps][37PTpt][0L]|[ACELMRTacelmr-t][37PTpt][01LM]|[AC-EHLMPR-Tac-ehlmpr-t][26NSns][9Vv])|(?:[02468LNQSUlnqsu][048LQU048lqu]|[13579MPRTV13579mprtv][26NS26ns])B[26NS26ns][9Vv])(?:[A-MZa-mz][1-9MNP-Vlmnp-v][\dLMNP-Vlmnp-v]{2}|[A-Ma-m][0L](?:[1-9MNP-Vlmnp-v][\dLMNP-Vlmnp-v]|[0L][1-9MNP-Vlmnp-v]))[A-Za-z]\b",
    "Codice Fiscale",
    forms=(_TAX_CODE_TAIL,),
    forms_with_letters=True,
)
# Matches what \b[\w\-\.]+@([\w-]+\.)+[\w-]{2,}\b matches. The engine recurses once per repeat of a
# group, and overflows its stack on hosts of a few thousand labels; possessive repeats do not recurse.
# A label can end an address unless it is one character followed by hyphens only (_DEAD); the address
# ends at the last word character of the last label that can (_LIVE). Each repeat takes dead labels and
# the live one after them, so what trails the last live label is given back as a whole.
_DEAD = r"\.[\w-]-*+(?![\w-])"
_LIVE = r"\.[\w-]-*+\w(?:-*+\w)*+"
_HOST = rf"[\w-]++(?:-*+(?:{_DEAD})*+{_LIVE})++\b"
# A letter beyond ASCII right after the host moves the last word boundary: the address then ends behind
# the last hyphen of the last label, or else at the end of an earlier one.
_INNER = rf"(?:-*+(?:{_DEAD}(?=\.))*+{_LIVE}(?=-*+\.))"
_HYPHEN = rf"[\w-]++{_INNER}*+-*+(?:{_DEAD}(?=\.))*+\.[\w-](?:\w*+-)++\b"
_AT_HOST = rf"@(?:{_HYPHEN}(?![\w.-])|{_HOST}|{_HYPHEN}|[\w-]++{_INNER}++\b)"
# From every word border the part before the sign is read to its end, so a long run of borders without the
# sign takes quadratic time. All borders of a run lead to the same sign: the first one decides. It is where
# the run begins, or behind what stands there before it; or where the match before ended.
_FIRST_BORDER = r"(?:\G|(?<![\w.-]))(?:\b|(?!\b)([.-]++|\w++)\b)"
EMAIL = Pattern(
    "EMAIL",
    rf"\b[\w\-\.]++{_AT_HOST}",
    "Email",
    needs="@",
    scan=rf"{_FIRST_BORDER}[\w.-]++{_AT_HOST}",
)
IBAN = Pattern(
    "IBAN",
    r"\b[A-Za-z]{2}[0-9]{2}(?:[ ]?[0-9]{4}){4}(?!(?:[ ]?[0-9]){3})(?:[ ]?[0-9]{1,2})?\b",
    "IBAN",
    forms=(_DIGITS, "[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}"),
)
VISA = Pattern("VISA", r"\b4[0-9]{12}(?:[0-9]{3})?\b", "Numero carta di credito", forms=_CARD_FORMS)
MASTERCARD = Pattern(
    "MASTERCARD",
    r"\b(5[1-5][0-9]{14}|2(22[1-9][0-9]{12}|2[3-9][0-9]{13}|[3-6][0-9]{14}|7[0-1][0-9]{13}|720[0-9]{12}))\b",
    "Numero carta di credito",
    forms=_CARD_FORMS,
)
AMEX = Pattern("AMEX", r"\b3[47][0-9]{13}\b", "Numero carta di credito", forms=_CARD_FORMS)
MAESTRO = Pattern(
    "MAESTRO",
    r"\b(5018|5020|5038|6304|6759|6761|6763)[0-9]{8,15}\b",
    "Numero carta di credito",
    forms=_CARD_FORMS,
)
VISA_MASTERCARD = Pattern(
    "VISA_MASTERCARD",
    r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14})\b",
    "Numero carta di credito",
    forms=_CARD_FORMS,
)
PHONE_NUMBER = Pattern(
    "PHONE_NUMBER",
    r"\b[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}\b",
    "Numero di telefono",
    forms=(_DIGITS, r"[0-9]{3}[)]?[-\s.]?[0-9]{3}[-\s.]?[0-9]{4}"),
)
# Matches what (http|ftp|https):\/\/([\w_-]+(?:(?:\.[\w_-]+)+))([\w.,@?^=%&:\/~+#-]*[\w@?^=%&\/~+#-])
# matches: beyond the first character after a dot, a host is made of characters the tail takes as well.
LINK = Pattern(
    "LINK",
    r"(http|ftp|https):\/\/[\w_-]+\.[\w_-][\w.,@?^=%&:\/~+#-]*[\w@?^=%&\/~+#-]",
    "Link",
    needs="://",
)
DEFAULT_PATTERNS = (
    CODICE_FISCALE,
    EMAIL,
    IBAN,
    VISA,
    MASTERCARD,
    AMEX,
    MAESTRO,
    VISA_MASTERCARD,
    PHONE_NUMBER,
    LINK,
)
CARDS = ("VISA", "MASTERCARD", "AMEX", "MAESTRO", "VISA_MASTERCARD")

#: Which kind names a text that holds several; cards count as one kind.
LABEL_PRECEDENCE = ("CODICE_FISCALE", "EMAIL", "IBAN", *CARDS, "PHONE_NUMBER", "LINK")
WHOLE_MESSAGE_PRECEDENCE = ("CODICE_FISCALE", "IBAN", *CARDS, "PHONE_NUMBER", "EMAIL", "LINK")
FIRST_KIND_PRECEDENCE = ("CODICE_FISCALE", "EMAIL", "IBAN", "PHONE_NUMBER", "LINK", *CARDS)

#: Names given to the labels that are found in redacted texts, in order of precedence.
REDACTED_CATEGORIES = (
    ("Codice Fiscale", "Codice Fiscale"),
    ("Email", "Email"),
    ("IBAN", "IBAN"),
    ("Numero di telefono", "Telefono"),
    ("Link", "Link"),
    ("Numero carta di credito", "Carta di credito"),
)

NO_MATCH = "False"

#: Optional replacement for IBAN: the default one takes digits only after the check digits and so
#: misses the countries that put letters there. Capitals only, or runs of short words would match.
IBAN_GENERAL = replace(
    IBAN,
    regex=r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?\b",
    forms=("[0-9]{2}",),
)


def by_name(patterns: tuple[Pattern, ...]) -> dict[str, Pattern]:
    return {p.name: p for p in patterns}


def passes_screen(text: Column, pattern: Pattern) -> Column:
    """False only where the pattern cannot match."""
    tests = [text.rlike(form) for form in pattern.forms]
    if pattern.needs is not None:
        tests.insert(0, F.contains(text, F.lit(pattern.needs)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def first_test(pattern: Pattern) -> str | None:
    """The test a screen begins with."""
    return pattern.needs or next(iter(pattern.forms), None)


def matches(text: Column, pattern: Pattern) -> Column:
    """Whether the regex matches."""
    return text.rlike(pattern.scan or pattern.regex)


def replaced(text: Column, pattern: Pattern) -> Column:
    """The text with the label in place of every match."""
    label = quoted_replacement(pattern.label)
    if pattern.scan is None:
        return F.regexp_replace(text, pattern.regex, label)
    return F.regexp_replace(text, pattern.scan, "$1" + label)


def found(text: Column, pattern: Pattern) -> Column:
    """Whether the text holds a match; null for null text."""
    return passes_screen(text, pattern) & matches(text, pattern)


# Labels of letters, brackets and inner blanks cannot be part of anything a literal or a form without
# letters matches.
_PLAIN_LABEL = re.compile(r"[A-Za-z<>\[\]_]([A-Za-z<>\[\]_ ]*[A-Za-z<>\[\]_])?")


def screen_outlives(pattern: Pattern, earlier: Sequence[Pattern]) -> bool:
    """Whether the screen of the original text still holds after earlier patterns were replaced."""
    if not earlier:
        return True
    plain = all(_PLAIN_LABEL.fullmatch(p.label) for p in earlier)
    return plain and not pattern.forms_with_letters


def quoted_replacement(label: str) -> str:
    r"""Label for ``regexp_replace``, where ``$`` and ``\`` are special."""
    return label.replace("\\", "\\\\").replace("$", "\\$")
