"""Keyword-stuffed pages and link lists.

Replication: a page's phrases are its shingles of ``PHRASE`` words, digits masked; a phrase is replicated when at least ``ELSEWHERE`` hosts other than the page's own have
it, counted over all pages, or when the page itself repeats it. A page is stitched when most of its words lie in replicated phrases or are
keywords that it repeats all over. List density: a page's units (sentences and lines, wrapped lines joined) are lists when they're links, carry hardly any
function words, or consist of such keywords; the share of characters in such units is the density. A page is spam when it is both stitched and mostly lists:
templated prose is replicated but no list, a catalogue of its own wording is a list but not replicated.

The phrases of dense pages alone are looked up, so a first reading finds the dense pages and a bitmap of their phrases, and a second one emits of each page the phrases in
the bitmap, once a batch, to count hosts.

Null and empty texts aren't spam; a page without a url counts under its source; repeated pages are judged alike. A page of fewer words than a phrase has is stitched by keywords alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import Bitmap, Lexicon, lower_words, shingles, word_hash
from plumbline.session import cut_lineage, spread

#: Search phrases are of two or three words, so shingles of two words find them in any order; see the README for the
#: figures with five.
PHRASE = 2
ELSEWHERE = 2
DENSITY = STITCHED = 0.5

_MARKUP_BREAK = re.compile(r"<(?:br|p|li|div|tr|ul|ol|h[1-6])\b[^>]*>|</(?:p|li|div|tr|ul|ol|h[1-6])>", re.IGNORECASE)
_BREAK = re.compile("[\r\v\f\x85  ]")
_TAG = re.compile(r"<[^<>]{1,200}>")
_LINK = re.compile(r"(?:\b[a-z]+:)?//\w|\bwww\.\w", re.IGNORECASE)
_REFERENCE = re.compile(r"^\W{0,3}\[?\d+[\].)]\s+\w+\W+\w+\W+.*//\S+$|^\[\d+\]\s+\w+.*//\S+$")
_STOP = re.compile(r"(?<=[.!?])[\"”’»)]*\s+")
_QUOTED = re.compile(r">+\s?")
_TERMINATED = re.compile(r"[.!?][\"'”’»)\]]*$")
_DIGITS = re.compile(r"\d")

#: Function words of the pages' languages.
_FUNCTION = frozenset(
    (
        "a an the of to in on for and or by with from at as is are was be been that this it its which who they not no if when where how than so such may must can could would will our your were one some those these their had has have does do "
        "der die das den dem des ein eine einer eines und oder von zu zur zum im für auf mit nach aus bei ist sind wird werden dass nicht wenn wer bis rund pro welche soll ob nur ich sich "
        "le la les l un une du de et ou à au aux en pour par sur avec dans que qui est sont ne pas si d s aucun toute doit quelles selon "
        "el los las lo y o del al con para se es sin no su qué solo según unas "
        "il gli di che e per non het een van op z w na się"
    ).split()
)


def _properties(word: str) -> tuple[int, int, bool]:
    """Of a lower-cased word: the hash of it with digits masked; of it without digits, 0 for function words and mere digits; whether it's a function word."""
    plain = word.isalpha()
    bare = word if plain else _DIGITS.sub("", word)
    function = bare in _FUNCTION
    return word_hash(word if plain else _DIGITS.sub("#", word)), 0 if function or not bare else word_hash(bare), function


_LEXICON = Lexicon(_properties, (np.uint64, np.uint64, bool))


def _plain(text: str) -> str:
    plain = html.unescape(text) if "&" in text else text
    if "<" in plain:
        plain = _TAG.sub(" ", _MARKUP_BREAK.sub("\n", plain))
    return _BREAK.sub("\n", plain)


def _units(plain: str) -> list[tuple[str, bool]]:
    """Sentences and lines, each with whether it has a link."""
    links = "//" in plain or "www." in plain.lower()
    has_link = (lambda x: _LINK.search(x) is not None) if links else lambda _: False
    lines: list[tuple[str, bool]] = []
    open_line = False
    for raw in plain.split("\n"):
        line = raw.strip()
        if line.startswith(">"):
            line = _QUOTED.sub("", line, count=1).strip()
        if not line:
            open_line = False
            continue
        link = has_link(line)
        if open_line and line[0].islower() and not link and not lines[-1][1]:
            lines[-1] = (lines[-1][0] + " " + line, False)
        else:
            lines.append((line, link))
        open_line = not _TERMINATED.search(line)
    return [(u, link) for line, link in lines for u in ([line] if link else _STOP.split(line)) if u.strip()]


def _looks_like_prose(unit: str, words: list[str]) -> bool:
    return len(words) >= 6 and unit[:1].isupper() and _TERMINATED.search(unit) is not None and len({_DIGITS.sub("#", w) for w in words}) >= 0.7 * len(words)


class _Part:
    """Some pages read at once: ``density`` of each, and for each word its page, its masked hash and whether it's a keyword that the page repeats all over."""

    def __init__(self, texts: list[str]) -> None:
        units: list[tuple[str, bool]] = []
        words: list[list[str]] = []
        owner: list[int] = []
        for page, text in enumerate(texts):
            for unit in _units(_plain(text)):
                found = lower_words(unit[0])
                if found:
                    units.append(unit)
                    words.append(found)
                    owner.append(page)
        n_units = len(units)
        sizes = np.fromiter(map(len, words), np.int64, n_units)
        self.hashed, content, function = _LEXICON.look_up([w for ws in words for w in ws])
        unit_of = np.repeat(np.arange(n_units), sizes)
        page_of_unit = np.array(owner, dtype=np.int64)
        self.page = page_of_unit[unit_of]
        has = content != 0
        n_content = np.bincount(self.page[has], minlength=len(texts))
        with np.errstate(over="ignore"):
            _, at, times = np.unique(
                (content + self.page.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[has],
                return_inverse=True,
                return_counts=True,
            )
        self.keyword = np.zeros(len(content), dtype=bool)
        self.keyword[has] = times[at] >= np.maximum(4, n_content / 40)[self.page[has]]
        count = lambda x: np.bincount(unit_of[x], minlength=n_units)
        own, heavy, little = count(has), count(self.keyword), count(function)
        listed = (own >= 2) & (heavy >= 0.6 * own)
        sentence = ~listed & (little >= 0.15 * sizes) & (sizes >= 4)
        for k in np.flatnonzero(~listed & ~sentence):
            listed[k] = not _looks_like_prose(units[k][0], words[k])
        for k, (unit, link) in enumerate(units):
            if link:
                listed[k] = not _REFERENCE.match(unit)
        chars = np.fromiter((len(u) for u, _ in units), np.float64, n_units)
        total = np.bincount(page_of_unit, weights=chars, minlength=len(texts))
        self.density = np.bincount(page_of_unit, weights=chars * listed, minlength=len(texts)) / np.maximum(total, 1)


def list_density(text: str) -> float:
    return float(_Part([text]).density[0])


def _parts(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """The places of the pages with a text, in parts of about 300,000 characters or one longer page."""
    sizes = np.array([len(t) if isinstance(t, str) and t.strip() else 0 for t in pdf["text"]], dtype=np.int64)
    at = np.flatnonzero(sizes)
    if len(at):
        yield from np.split(at, np.flatnonzero(np.diff(np.cumsum(sizes[at]) // 300_000)) + 1)


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pages with a text: the density, and for those over ``DENSITY`` the words and the keywords among them."""
    for pdf in batches:
        for at in _parts(pdf):
            part = _Part([pdf["text"].iat[i] for i in at])
            bounds = np.searchsorted(part.page, np.arange(len(at) + 1))
            dense = part.density > DENSITY
            words = [
                part.hashed[a:b].view(np.int64) if d else None
                for d, a, b in zip(dense, bounds, bounds[1:], strict=False)
            ]
            keywords = [part.keyword[a:b] if d else None for d, a, b in zip(dense, bounds, bounds[1:], strict=False)]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].to_numpy()[at],
                    "host": pdf["host"].to_numpy()[at],
                    "density": part.density,
                    "words": words,
                    "keywords": keywords,
                }
            )


def _with_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [shingles(np.asarray(w, np.int64).view(np.uint64), PHRASE).view(np.int64) for w in pdf["words"]]
        yield pdf.assign(phrases=pd.Series(found, dtype=object, index=pdf.index))[["spot", "host", "phrases"]]


def _on_hosts(wanted) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The phrases of each host's pages that pass the broadcast bitmap, once a batch."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts, hosts = pdf["text"].tolist(), pdf["host"].to_numpy()
            found = []
            for at in _parts(pdf):
                words = [lower_words(_plain(texts[i])) for i in at]
                sizes = np.fromiter(map(len, words), np.int64, len(words))
                page = np.repeat(at, sizes)
                phrases = shingles(_LEXICON.look_up([w for ws in words for w in ws])[0], PHRASE)
                n = len(phrases)
                kept = wanted.value.has(phrases) & (page[:n] == page[len(page) - n :])
                found.append((hosts[page[:n][kept]], phrases[kept]))
            if found:
                yield pd.DataFrame(
                    {
                        "host": np.concatenate([h for h, _ in found]),
                        "phrase": np.concatenate([p for _, p in found]).view(np.int64),
                    }
                ).drop_duplicates()

    return read


def _covered(words: np.ndarray, keywords: np.ndarray, replicated: np.ndarray) -> tuple[float, float]:
    """Share of the words within phrases on other hosts; that share with repeated phrases and keywords. ``replicated``: the phrases on other hosts, sorted."""
    phrases = shingles(words, PHRASE)
    other = np.zeros(len(words), dtype=bool)
    again = keywords.copy()
    if len(phrases):
        _, at, times = np.unique(phrases, return_inverse=True, return_counts=True)
        elsewhere, repeated = np.isin(phrases, replicated), (times > 1)[at]
        for i in range(PHRASE):
            other[i : i + len(phrases)] |= elsewhere
            again[i : i + len(phrases)] |= repeated
    return float(other.mean()), float((other | again).mean())


def _stitched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for words, keywords, replicated in zip(pdf["words"], pdf["keywords"], pdf["replicated"], strict=True):
            known = np.empty(0, np.uint64) if replicated is None else np.asarray(replicated, np.int64).view(np.uint64)
            rows.append(_covered(np.asarray(words, np.int64).view(np.uint64), np.asarray(keywords, bool), known))
        yield pdf[["spot"]].assign(on_hosts=[r[0] for r in rows], stitched=[r[1] for r in rows])


def page_evidence(documents: DataFrame) -> DataFrame:
    """(``doc_id``, ``density``, ``on_hosts``, ``stitched``, ``evidence``, ``is_spam``) for the pages with words. ``documents``: (``doc_id``, ``text``, ``url``, ``source``).

    ``on_hosts`` is the share of words within phrases of other hosts, ``stitched`` that with phrases and keywords repeated in the page; both are null for pages that aren't dense, whose
    phrases count for the others only. ``evidence`` of a spam page: 'other hosts' when their phrases alone are most of it, else 'own repetition'.
    """
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z]+:)?//([^/?#]+)", 1)), F.lit("")), "source", F.lit(""))
    pages = spread(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("text").cast("string").alias("text"),
            F.xxhash64(host).alias("host"),
        )
    )
    seen = cut_lineage(
        pages.mapInPandas(
            _evidence,
            "doc_id long, host long, density double, words array<long>, keywords array<boolean>",
        ).withColumn("spot", F.monotonically_increasing_id())
    )
    dense = seen.where("words is not null")
    phrases = dense.select("spot", "host", "words").mapInPandas(
        _with_phrases,
        "spot long, host long, phrases array<long>",
    )
    wanted = documents.sparkSession.sparkContext.broadcast(Bitmap.of(phrases.select("phrases")))
    counted = pages.select("host", "text").mapInPandas(
        _on_hosts(wanted),
        "host long, phrase long",
    ).distinct().groupBy("phrase").agg(F.count("*").alias("n_hosts"))
    # Every page has its own phrases itself, so one host of the count is its own.
    replicated = counted.where(F.col("n_hosts") > ELSEWHERE).select("phrase")
    own = phrases.select("spot", F.explode(F.array_distinct("phrases")).alias("phrase"))
    found = own.join(replicated.hint("merge"), "phrase").groupBy("spot").agg(
        F.collect_list("phrase").alias("replicated")
    )
    shares = dense.select("spot", "words", "keywords").join(found.hint("merge"), "spot", "left").mapInPandas(
        _stitched,
        "spot long, on_hosts double, stitched double",
    )
    joined = seen.select("spot", "doc_id", "density").join(shares.hint("merge"), "spot", "left")
    spam = F.coalesce(F.col("stitched") > STITCHED, F.lit(False))
    evidence = F.when(spam, F.when(F.col("on_hosts") > STITCHED, "other hosts").otherwise("own repetition"))
    return joined.select("doc_id", "density", "on_hosts", "stitched", evidence.alias("evidence"), spam.alias("is_spam"))


def spam_pages(documents: DataFrame) -> DataFrame:
    return page_evidence(documents).where("is_spam").select("doc_id")
