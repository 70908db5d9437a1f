"""Text as Column expressions: one definition each of white space, tokens and sentences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"(?U)\s+"
#: The guideline's areas by top section, and sub-topics by section.
AREA_BY_SECTION = {
    "3.1": "biometrics",
    "3.2": "critical-infrastructure",
    "3.3": "education",
    "3.4": "employment",
    "3.5": "essential-services",
    "3.6": "law-enforcement",
    "3.7": "migration",
    "3.8": "justice-democracy",
}
SUB_TOPICS = {
    "3.2.2": "digital",
    "3.2.3": "road-traffic",
    "3.2.4": "water",
    "3.2.5": "gas",
    "3.2.6": "heating",
    "3.2.7": "electricity",
}
#: Fixed value: wording that gives a verdict away.
LEGAL_WORDING = (
    r"(?iU)high-?\s?risk|annex|article\s*\d|art\.\s*\d|point\s*\d|use case|exception|exempt|excluded|out of scope|outside (the )?scope|not covered|is covered|\bfalls?\b|qualif"
    r"|classif(y|ied|ication) as|safety component|safety function|profiling|recital|GDPR|AI Act|filter mechanism|materially influenc|narrow procedural|preparatory task"
    r"|should (not )?be considered|cannot be|could apply|section \d|\d+\(\d\)|\bsubject to\b"
)
TERMINALS = (".", "?", "!", '"', "'", ")", "]")
MAX_CHARS = 1800


def stripped(c: Column) -> Column:
    """Without white space at either end, any Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, SPACE, " "))


def bm25_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[A-Za-z0-9]+"), 0)


def word_set(c: Column) -> Column:
    """The distinct lower-cased words between white space; empty for null."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), SPACE), lambda x: x != ""))


def _non_empty(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def redaction_sentences(c: Column) -> Column:
    """Split after a full stop or semicolon before a capital or a bracket."""
    return F.split(stripped(c), r"(?U)(?<=[.;])\s+(?=[A-Z(])")


def statements(c: Column) -> Column:
    """Split after a terminator; blank parts dropped; empty for null."""
    return _non_empty(F.split(stripped(F.coalesce(c, F.lit(""))), r"(?U)(?<=[.!?])\s+"))


def clauses(c: Column) -> Column:
    return F.split(c, r"(?U)(?<=[.;:])\s+")


def packed(c: Column, limit: int = MAX_CHARS) -> Column:
    """Clauses packed greedily into parts of up to ``limit`` characters; a longer clause stays whole. A short text is its own part."""

    def step(acc: Column, s: Column) -> Column:
        full = (F.length(acc["buf"]) + F.length(s) + 1 > limit) & (acc["buf"] != "")
        joined = F.trim(F.concat(acc["buf"], F.lit(" "), s))
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(stripped(acc["buf"])))).otherwise(acc["parts"]).alias("parts"),
            F.when(full, s).otherwise(joined).alias("buf"),
        )

    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("buf"))
    many = F.aggregate(
        clauses(c),
        start,
        step,
        lambda acc: F.when(
            acc["buf"] != "",
            F.concat(acc["parts"], F.array(stripped(acc["buf"]))),
        ).otherwise(acc["parts"]),
    )
    return F.when(F.length(c) <= limit, F.array(c)).otherwise(many)


def without_legal_wording(c: Column) -> Column:
    """The text without the sentences that give the verdict away."""
    return F.array_join(F.filter(redaction_sentences(c), lambda s: ~s.rlike(LEGAL_WORDING)), " ")


def replaced(c: Column, pairs: Column) -> Column:
    """Literal replacements ``old`` to ``new``, one after the other."""
    return F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p["old"], p["new"]))


def top_section(section: Column) -> Column:
    return F.substring_index(section, ".", 2)


def looked_up(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def area_of(section: Column) -> Column:
    return looked_up(top_section(section), AREA_BY_SECTION)


def heading_path(section: Column, title: Column) -> Column:
    base = F.when(section.startswith("2"), "General principles").otherwise(
        F.coalesce(area_of(section), F.lit("Annex III"))
    )
    return F.when(
        section.isNotNull() & (section != ""),
        stripped(F.concat(base, F.lit(" | "), section, F.lit(" "), F.coalesce(title, F.lit("")))),
    )


def governing_section(label_source: Column) -> Column:
    return F.nullif(
        F.regexp_extract(F.coalesce(label_source, F.lit("")), r"(?i)section\s+([0-9]+(?:\.[0-9]+)+)", 1),
        F.lit(""),
    )


def passages(hits: Column, heading: bool = False) -> Column:
    """Numbered passages of an array of structs with ``text`` (and ``heading_path``); '' for none."""

    def one(h: Column, i: Column) -> Column:
        tag = F.when(
            F.coalesce(h["heading_path"], F.lit("")) != "",
            F.concat(F.lit(" ["), h["heading_path"], F.lit("]")),
        ).otherwise("") if heading else F.lit("")
        return F.concat(
            F.lit("[Passage "),
            (i + 1).cast("string"),
            F.lit("]"),
            tag,
            F.lit("\n"),
            F.coalesce(h["text"], F.lit("")),
        )

    return F.coalesce(F.array_join(F.transform(hits, one), "\n\n"), F.lit(""))


def json_object(raw: Column) -> Column:
    """From the first to the last brace, null without one."""
    return F.nullif(F.regexp_extract(F.coalesce(raw, F.lit("")), r"(?s)\{.*\}", 0), F.lit(""))


def escaped(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, c)


def ends_well(c: Column, terminals: Sequence[str] = TERMINALS) -> Column:
    return F.right(F.regexp_replace(c, r"(?U)\s+$", ""), F.lit(1)).isin(*terminals)


def flags(**conditions: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(cond, name) for name, cond in conditions.items()]))
