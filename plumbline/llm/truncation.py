"""Texts cut off by a field limit or in transfer.

Three steps. First a stack automaton reads each text once: brackets, quotes and markup elements go on and off the stack, sentence ends, escapes, broken multibyte
characters and ellipses are its events; what is open or broken at the end shows a cut. Second, texts without such a sign and without a terminator are weighed against the baseline of
their source: where whole texts often lack a terminator, a missing one says little. Third, how many of these are whole: how often sentences of all texts end, and how often they go on, after
the same last words, from the longest context of up to six words that is known; a last word that no text knows is a part of one. A text is cut where the share of whole
ones for its last words is under the share of cut ones among the unterminated texts of its source, within ``LOW`` and ``HIGH``.

Null, blank and placeholder texts are never cut; texts of fewer than three words only where an ellipsis or a broken character shows it.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Bitmap, Lexicon, lower_words, word_hash
from plumbline.session import cut_lineage, spread

#: Bounds of the limit that a source's baseline sets on the share of whole sentences with the same last words.
LOW, HIGH = 0.45, 0.6
LEAST_WORDS = 3

#: How a text may end, and what may stand around words.
_CLOSERS = "\"'”’»)]}*_"
_TERMINATED = re.compile(r"[.!?。！？।][" + re.escape(_CLOSERS) + r"]*$")
_ELLIPSIS = re.compile(
    r"\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…|cut|truncated|more)\s*\]|\(\s*(?:\.{3}|…)\s*\))\s*[" + re.escape(_CLOSERS) + r"]*$",
    re.IGNORECASE,
)
_BROKEN_CHARACTER = re.compile(r"(?:�|Ã|Â|â€|â|[\ud800-\udfff])$")
_DANGLING = re.compile(r"[,;:/&(\[{<–—-]$")
_PARENTHESIS = re.compile(r"\s\([^()]*(?:\([^()]*\)[^()]*)*\)$")
#: Abbreviations whose point ends no sentence.
_ABBREVIATED = re.compile(r"\b(?:e\.g|i\.e|cf|resp|incl|approx|art|no|sec|para|pp?|vs)\.$", re.IGNORECASE)
_PAIRS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«", "“": "„"}
_EDGE = "\"'“”„‘’«»()[]{}<>*_.,;:!?…–—-"
#: Elements that stay open without harm.
_NEVER_CLOSED = {
    "area", "base", "br", "col", "dd", "dt", "embed", "hr", "img", "input", "li", "link", "meta", "option", "p",
    "source", "td", "th", "tr", "track", "wbr",
}
#: The automaton's events.
_EVENT = re.compile(
    r"(?P<escape>&\#?[A-Za-z0-9]{0,8}\Z|\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?\Z|(?<![\d\s])%[0-9A-Fa-f]?\Z)|(?P<unfinished><[/A-Za-z!][^<>]*\Z)"
    r"|</(?P<closes>[A-Za-z][A-Za-z0-9]*)\s*>|<(?P<opens>[A-Za-z][A-Za-z0-9]*)(?:\s[^<>]*)?>|(?P<bracket>[(\[{)\]}])|(?P<quote>[\"“”„«»])|(?P<stop>[.!?]\s)"
)
_QUIET = re.compile(r"[(\[{<&\\%\"“„«]")

_M = np.array([xxhash.xxh64_intdigest(f"context {i}") | 1 for i in range(10)], dtype=np.uint64)
_START = np.uint64(word_hash("\x02"))
_NAME = word_hash("\x03name")
_ORDERS = 6  # contexts of six, four and three words, of two before a name, of two words and of one


def _token(raw: str) -> tuple[int, int, bool, bool]:
    """Hash of the bare word, hash of its class when inside a sentence, whether a sentence ends here, whether it looks like a name."""
    core = raw.strip(_EDGE)
    bare = "".join("#" if c.isdigit() else c for c in core.lower())
    name = core[:1].isupper() and core[1:].islower() and core.isalpha()
    h = word_hash(bare)
    return h, _NAME if name else h, _TERMINATED.search(raw) is not None and not _ELLIPSIS.search(raw), name


_LEXICON = Lexicon(_token, (np.uint64, np.uint64, bool, bool))
_BACK = 5


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _contexts(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For each token of these texts, one after the other, none empty: an array of ``_ORDERS`` context hashes, the longest first, 0 where there's none;
    whether a sentence ends there."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    exact, kind, ends, names = _LEXICON.look_up([t for text in texts for t in text])
    n = len(exact)
    begins = np.zeros(n, dtype=bool)
    begins[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    names = names & ~(begins | np.concatenate(([True], ends[:-1])))
    # Between the texts there's room for the words that a first word doesn't have before it.
    place = np.arange(n) + _BACK * np.cumsum(begins)
    past = np.full(n + _BACK * len(texts), _START, np.uint64)
    past[place] = np.where(ends, _START, np.where(names, np.uint64(_NAME), exact))
    one, two, three, four, five = (past[place - i] for i in range(1, _BACK + 1))
    with np.errstate(over="ignore"):
        by2 = exact * _M[0] + one * _M[1]
        by3 = by2 + two * _M[2]
        by4 = by3 + three * _M[3]
        named = np.uint64(_NAME) * _M[0] + one * _M[1] + two * _M[2]
        by6 = by4 + four * _M[8] + five * _M[9]
        out = np.stack(
            [
                _mix(by6),
                _mix(by4 + _M[4]),
                _mix(by3 + _M[5]),
                np.where(names, _mix(named + _M[7]), np.uint64(0)),
                _mix(by2 + _M[6]),
                _mix(exact * _M[0]),
            ],
            axis=1,
        )
    return out, ends


def _matches(top: str, closer: str) -> bool:
    return top == _PAIRS.get(closer, closer)


def structure(text: str) -> str | None:
    """What the stack automaton finds open or broken at the end of ``text``: 'broken escape', 'open markup', 'open bracket', 'open quote' or null.

    A bracket or quote counts while the sentence that opened it goes on, since a later sentence shows that it was forgotten; an element counts until it is closed.
    """
    if not _QUIET.search(text):
        return None
    stack: list[tuple[str, str, int]] = []
    sentence = 0
    for m in _EVENT.finditer(text):
        kind, found = m.lastgroup, m.group(m.lastgroup)
        if kind == "escape":
            return "broken escape"
        if kind == "unfinished":
            return "open markup"
        if kind == "stop":
            sentence += 1
        elif kind == "opens":
            if found.lower() not in _NEVER_CLOSED and not m.group().endswith("/>"):
                stack.append(("markup", found.lower(), sentence))
        elif kind == "closes":
            while any(k == "markup" and x == found.lower() for k, x, _ in stack) and stack.pop()[:2] != ("markup", found.lower()):
                pass
        else:
            closes = bool(stack) and stack[-1][0] != "markup" and found not in "([{«„" and _matches(stack[-1][1], found)
            if closes:
                stack.pop()
            elif found in "([{«„“\"":
                stack.append((kind, found, sentence))
    still = {kind for kind, _, since in stack if kind == "markup" or since == sentence}
    return next((f"open {kind}" for kind in ("markup", "bracket", "quote") if kind in still), None)


def judge(text: str | None) -> tuple[str, list[int]]:
    """The evidence in the text alone, and for 'unterminated' the contexts of its last word."""
    if not isinstance(text, str):
        return "blank", []
    body = text.strip().strip("​﻿").strip()
    n_words = len(lower_words(body))
    if not n_words:
        return "blank", []
    if _BROKEN_CHARACTER.search(body):
        return "broken character", []
    ellipsis = _ELLIPSIS.search(body)
    if ellipsis:
        return (
            "terminated" if _TERMINATED.search(
                body[: ellipsis.start()]
            ) and body[ellipsis.start()].isspace() else "ellipsis"
        ), []
    if n_words < LEAST_WORDS:
        return "blank", []
    terminated = _TERMINATED.search(body) is not None
    found = structure(body)
    # Behind a terminator it may have been forgotten, unless the point is that of an abbreviation.
    if found and (not terminated or (found == "open bracket" and _ABBREVIATED.search(body))):
        return found, []
    if terminated:
        return "terminated", []
    if _DANGLING.search(body):
        return "dangling mark", []
    inner = _PARENTHESIS.sub("", body)
    if inner != body and _TERMINATED.search(inner):
        return "terminated", []
    return "unterminated", _contexts([inner.split()[-10:]])[0][-1].view(np.int64).tolist()


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        seen = [judge(t) for t in pdf["text"]]
        yield pdf[["origin", "key", "source"]].assign(evidence=[x[0] for x in seen], contexts=[x[1] for x in seen])


def _counter(wanted) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Counts of the contexts that pass the broadcast filter."""

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
        contexts, ends = (np.concatenate(x) for x in zip(*held, strict=True))
        keys, at = np.unique(contexts, return_inverse=True)
        n_end = np.bincount(at, weights=ends, minlength=len(keys)).astype(np.int64)
        n = np.bincount(at, minlength=len(keys)).astype(np.int64)
        return pd.DataFrame({"context": keys.view(np.int64), "n_end": n_end, "n_on": n - n_end})

    def passing(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        contexts, ends = _contexts(texts)
        # Nobody knows how the last word of an unterminated text would go on.
        last = np.cumsum([len(t) for t in texts]) - 1
        known = np.ones(len(ends), dtype=bool)
        known[last] = ends[last]
        flat, repeated = contexts[known].ravel(), np.repeat(ends[known], _ORDERS)
        keep = wanted.value.has(flat) & (flat != 0)
        return flat[keep], repeated[keep]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for pdf in batches:
            part: list[list[str]] = []
            n = 0
            for k, text in enumerate(pdf["text"], 1):
                tokens = text.split() if isinstance(text, str) else []
                if len(tokens) >= LEAST_WORDS:
                    part.append(tokens)
                    n += len(tokens)
                if part and (n > 30_000 or k == len(pdf)):
                    held.append(passing(part))
                    size += len(held[-1][0])
                    part, n = [], 0
            if size > 2_000_000:
                yield merged(held)
                held, size = [], 0
        if held:
            yield merged(held)

    return count


def judged_rows(df: DataFrame) -> DataFrame:
    """``df``: (``origin``, ``key`` long, ``source``, ``text``), where ``origin`` and ``key`` name a row.

    Returns (``origin``, ``key``, ``source``, ``evidence``, ``whole_share``, ``is_cut``), a row for each of ``df``. ``whole_share``: of the sentences with
    the same last words, the share that ended there; null where the text alone decides.
    """
    source = spread(df).select(
        "origin",
        F.col("key").cast("long").alias("key"),
        F.col("source").cast("string").alias("source"),
        F.col("text").cast("string").alias("text"),
    )
    judged = cut_lineage(
        source.mapInPandas(_judged, "origin string, key long, source string, evidence string, contexts array<long>")
    )
    wanted = df.sparkSession.sparkContext.broadcast(
        Bitmap.of(judged.where("evidence = 'unterminated'").select("contexts"))
    )
    counts = source.select("text").mapInPandas(
        _counter(wanted),
        "context long, n_end long, n_on long",
    ).groupBy("context").agg(F.sum("n_end").alias("n_end"), F.sum("n_on").alias("n_on"))
    tails = judged.where("evidence = 'unterminated'").select(
        "origin",
        "key",
        F.posexplode("contexts").alias("order", "context"),
    ).where("context <> 0")
    # The tail contexts repeat: each is looked up once.
    known = tails.select("context").distinct().join(counts.hint("merge"), "context")
    seen = F.col("n_end") + F.col("n_on")
    best = (
        tails.join(known.hint("merge"), "context")
        .groupBy("origin", "key")
        .agg(F.min(F.struct((seen < 2).alias("rare"), "order", (F.col("n_end") / seen).alias("share"))).alias("best"), F.max((F.col("order") == _ORDERS - 1).cast("int")).alias("known_word"))
        .select("origin", "key", F.when(F.col("known_word") == 1, F.col("best.share")).otherwise(0.0).alias("share"))
    )
    unterminated = F.col("evidence") == "unterminated"
    joined = judged.join(best.hint("merge"), ["origin", "key"], "left").withColumn(
        "whole_share",
        F.when(unterminated, F.coalesce("share", F.lit(0.0))),
    )
    # Of the unterminated texts of a source, the expected share of cut ones; half in a source that has none.
    of_source = joined.groupBy(F.col("origin").alias("of_origin"), F.col("source").alias("of_source")).agg(
        (1 - F.coalesce(F.avg("whole_share"), F.lit(0.5))).alias("cut_here")
    )
    structural = ~F.col("evidence").isin("blank", "terminated", "unterminated")
    cut = structural | (
        unterminated
        & (F.col("whole_share") < F.greatest(F.least("cut_here", F.lit(HIGH)), F.lit(LOW)))
    )
    same = F.col("origin").eqNullSafe(F.col("of_origin")) & F.col("source").eqNullSafe(F.col("of_source"))
    return joined.join(of_source, same).select(
        "origin",
        "key",
        "source",
        "evidence",
        "whole_share",
        cut.alias("is_cut"),
    )


def cut_shares(judged: DataFrame) -> DataFrame:
    """(``origin``, ``source``, ``n_rows``, ``n_cut``, ``n_by_structure``, ``cut_share``) from ``judged_rows``; blank texts count as rows. ``n_by_structure``: cut ones
    that the text alone shows, without its terminator's baseline and its last words."""
    n_cut = F.sum(F.col("is_cut").cast("long"))
    by_structure = F.sum((F.col("is_cut") & (F.col("evidence") != "unterminated")).cast("long"))
    return judged.groupBy("origin", "source").agg(
        F.count("*").alias("n_rows"),
        n_cut.alias("n_cut"),
        by_structure.alias("n_by_structure"),
        (n_cut / F.count("*")).alias("cut_share"),
    )
