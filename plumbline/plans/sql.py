"""Fragments of the SQL counterparts."""

from plumbline.functions.text import AREA_BY_SECTION
from plumbline.operators.segment import INLINE_EXAMPLES

#: Unicode white space, as a class of RE2.
SPACE = r"[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TOP = "array_to_string(string_split(section, '.')[1:2], '.')"
AREA = f"CASE {TOP} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in AREA_BY_SECTION.items()) + " END"
EXAMPLES = INLINE_EXAMPLES.replace("(?iU)", "(?i)")


def trimmed(c: str) -> str:
    return f"regexp_replace({c}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def flat(c: str) -> str:
    """With white space collapsed and none at either end."""
    return f"trim(regexp_replace({c}, '{SPACE}+', ' ', 'g'), ' ')"


def quoted(text: str) -> str:
    """A literal, line breaks included."""
    return "'" + text.replace("'", "''") + "'"
