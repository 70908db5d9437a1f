"""Defective prompt and response pairs, each with one kind of defect.

In this order: 'empty' (null, blank, a placeholder, a bare label), 'echo' (the response repeats its prompt: shingle
containment finds candidates, the longest common subsequence of their sentences verifies), 'truncated' (see ``truncation``),
'refusal' (a sentence aligns with a refusal template), 'other_language' (most words aren't English), 'no_label' (a sound
response whose label is none of the allowed ones).

A response is compared with every different prompt of its id. For ids with more than ``FEW_PROMPTS`` different prompts, one shingle
index of all their prompts leaves the responses that may be candidates; these meet the prompts in blocks of about ``BLOCK``
by ``BLOCK``, each with an index of its own, and are verified alike, so that the number of prompts doesn't change a result. A response without
a prompt can have any defect but 'echo'. Repeated rows are judged alike, each on its own row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.truncation import judged_rows
from plumbline.llm.words import hashes, lcs_length, plain_words, shingles
from plumbline.session import cut_lineage

LABELS = ("high-risk", "not-high-risk")
FEW_PROMPTS = 16
#: Prompts and responses of an id with many prompts that one task holds at once.
BLOCK = 1024
#: Share of the response's five-word shingles that a candidate prompt holds at least.
CANDIDATE = 0.12
#: An echo has at least this share of its words in aligned sentences of the prompt, and of the prompt's words in its
#: own.
ECHO_OF_RESPONSE, ECHO_OF_PROMPT = 0.75, 0.6
_LEAST_WORDS = 8

#: Placeholders, as words without punctuation.
PLACEHOLDERS = {
    "", "na", "n a", "none", "null", "nan", "nil", "tbd", "todo", "undefined", "empty", "missing", "unknown",
    "no explanation", "not available", "not applicable", "no answer", "no response",
}
BARE_LABEL = re.compile(r"^(?:(?:the )?(?:label|answer|result|classification|verdict)(?: is)? )?(?:not )?high risk$")

#: Refusal templates; their words occur in this order within a sentence, with 'we' for 'i', 'us' for 'me',
#: 'are' for 'am'.
_TEMPLATES = [
    t.split()
    for t in (
        "i cannot provide assessment", "i cannot provide answer", "i cannot give opinion", "i cannot give assessment", "i cannot offer advice", "i cannot make determination", "i cannot answer", "i cannot assess this", "i cannot judge this", "i cannot help", "i cannot assist", "i cannot classify", "i cannot comment", "i cannot decide", "i cannot evaluate",
        "i can not provide", "i can not help", "i can t help", "i can t assist", "i can t provide", "i can t answer", "i can t assess", "i can t judge", "i can t classify", "i can t decide", "i can t comment",
        "i am unable to", "i m unable to", "i am not able to", "i m not able to", "i won t be able to", "i will not be able to", "i would not be able to",
        "i must decline", "i have to decline", "i decline to", "i refuse to", "i must refuse", "i would rather not", "i d rather not", "i prefer not to", "i would prefer not to", "i will refrain from", "i must refrain", "i must abstain", "i abstain from",
        "not possible for me to", "impossible for me to", "no assessment will be given by me", "no opinion will be given by me", "no answer will be given by me", "matter on which i do not comment", "i do not comment on", "i don t comment",
        "i am not allowed to", "i m not allowed to", "outside what i am allowed to", "i am not permitted to", "i am not in a position to", "i m not in a position to", "i am not qualified to", "keep me from giving", "prevent me from giving", "expertise that i do not have",
    )
]
#: Refusals without a person. They begin with the first word, after an apology at most, and the other
#: words follow in this order.
_IMPERSONAL = [
    t.split()
    for t in (
        "unable to assess", "unable to classify", "unable to judge", "unable to evaluate", "unable to answer", "unable to decide", "unable to provide", "unable to help", "unable to assist", "not able to assess", "not able to answer",
        "this system cannot be assessed", "the system cannot be assessed", "this description cannot be assessed", "the description cannot be assessed", "it cannot be assessed", "this cannot be assessed", "this question cannot be answered", "the question cannot be answered", "this request cannot be answered", "the request cannot be answered",
        "this system can t be assessed", "the system can t be assessed", "this system cannot be evaluated", "the system cannot be evaluated", "no assessment can be", "no assessment is possible", "no classification can be", "no classification is possible", "no answer can be", "no answer is possible", "no judgement can be", "no opinion can be", "no determination can be",
        "an assessment is not possible", "assessment is not possible", "a classification is not possible", "an assessment cannot be", "a classification cannot be given", "an answer cannot be",
    )
]
_ALIKE = {"we": "i", "us": "me", "are": "am", "re": "m", "ourselves": "me", "myself": "me"}
_APOLOGY = {"sorry", "unfortunately", "regrettably", "apologies", "i", "am", "m", "but", "very", "afraid", "that"}

#: Frequent function words by language.
_ENGLISH = frozenset(
    "the of and to in a is that it for as with on by be this not which are from at or an has was its but so because no because may can only".split()
)
_OTHERS = frozenset(
    (
        "der die das und ist nicht ein eine einer zu den von mit für auf dem des wird werden im als auch nach weil sich "
        "le la les des du et est une dans pour qui que pas par sur ce au aux donc comme ne "
        "el los las del y es una por para con se como no que un ello al lo porque "
        "il lo gli di che è e una per con si del della non viene quindi da dell "
        "het een van en is niet dat op te voor met wordt daarom omdat zijn aan "
        "jest w z na do nie się i co za że może ponieważ są od zatem jako od "
        "o os as um uma não com mais ou "
        "och att som det är för av inte på"
    ).split()
) - _ENGLISH
#: Without one of these no template aligns.
_HINT = re.compile(
    r"\b(?:I|i|[Mm]e|ME|[Ww]e|WE|us|US)\b|\b(?i:unable|not able|can(?:not|\W?t) be|(?:not|is) possible|no \w+ can be)\b"
)
_SENTENCE = re.compile(r"(?<=[.!?;])\s+")
#: No placeholder or bare label has more words.
_SHORT = 8


def is_empty(words: list[str]) -> bool:
    if len(words) > _SHORT:
        return False
    line = " ".join(words)
    return line in PLACEHOLDERS or BARE_LABEL.match(line) is not None


def _occurs(template: list[str], words: list[str]) -> bool:
    return lcs_length(template, words) == len(template)


def is_refusal(text: str) -> bool:
    if not _HINT.search(text):
        return False
    for sentence in _SENTENCE.split(text):
        words = [_ALIKE.get(w, w) for w in plain_words(sentence)]
        have = set(words)
        if ("i" in have or "me" in have) and any(have.issuperset(t) and _occurs(t, words) for t in _TEMPLATES):
            return True
        start = next((k for k, w in enumerate(words) if w not in _APOLOGY), len(words))
        bare = words[start:]
        if any(have.issuperset(t) and bare[:1] == t[:1] and _occurs(t, bare) for t in _IMPERSONAL):
            return True
    return False


def is_other_language(words: list[str]) -> bool:
    if len(words) < 3:
        return False
    english = sum(w in _ENGLISH for w in words)
    other = sum(w in _OTHERS for w in words)
    if other > english and other >= 2:
        return True
    return len(words) >= _LEAST_WORDS and english < 0.06 * len(words)


@lru_cache(maxsize=4096)
def _known(text: str) -> frozenset:
    return frozenset(plain_words(text))


@lru_cache(maxsize=4096)
def _parsed(text: str) -> tuple[list[list[str]], list[str], frozenset]:
    """Words by sentence, all words, the shingles."""
    parts = [w for s in _SENTENCE.split(text) if (w := plain_words(s))]
    words = [w for part in parts for w in part]
    return parts, words, frozenset(shingles(hashes(words)).tolist())


def _aligned(parts: list[list[str]], others: list[list[str]], whole: list[str]) -> float:
    """Share of the words of ``parts`` in the best common subsequence of each with one of ``others``."""
    n = sum(map(len, parts))
    return sum(max((lcs_length(p, o) for o in others), default=0) for p in parts) / n if n else 0.0


def is_echo(response: str, prompts: list[str], words: list[str] | None = None) -> bool:
    words = plain_words(response) if words is None else words
    if len(words) < _LEAST_WORDS:
        return False
    for prompt in prompts:
        known = _known(prompt)
        # No alignment has more words than the other side knows.
        if sum([w in known for w in words]) < ECHO_OF_RESPONSE * len(words):
            continue
        of, all_words, there = _parsed(prompt)
        parts, _, held = _parsed(response)
        own = set(words)
        if not there or len(held & there) < CANDIDATE * max(1, len(held)) or sum([w in own for w in all_words]) < ECHO_OF_PROMPT * len(all_words):
            continue
        common = lcs_length(words, all_words)
        if max(common / len(words), _aligned(parts, of, all_words)) >= ECHO_OF_RESPONSE and max(common / len(all_words), _aligned(of, parts, words)) >= ECHO_OF_PROMPT:
            return True
    return False


def _with_defect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = []
        for text, prompts, cut, labelled, echoes in zip(pdf["text"], pdf["prompts"], pdf["is_cut"], pdf["labelled"], pdf["echoes"], strict=True):
            words = plain_words(text) if isinstance(text, str) else []
            if is_empty(words):
                found.append("empty")
            elif echoes or (prompts is not None and is_echo(text, list(prompts), words)):
                found.append("echo")
            elif cut:
                found.append("truncated")
            elif is_refusal(text):
                found.append("refusal")
            elif is_other_language(words):
                found.append("other_language")
            else:
                found.append(None if labelled else "no_label")
        yield pdf[["row_no"]].assign(defect=pd.Series(found, dtype=object, index=pdf.index))


def _held(text: str) -> np.ndarray:
    return np.unique(shingles(hashes(plain_words(text))))


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf[["id", "pair"]].assign(
            held=pd.Series([_held(t).view(np.int64) for t in pdf["text"]], dtype=object, index=pdf.index)
        )


def _echoing(pdf: pd.DataFrame) -> pd.DataFrame:
    """The responses of a block that repeat one of its prompts, which are the rows without ``pair``."""
    is_prompt = pdf["pair"].isna()
    prompts, answers = pdf.loc[is_prompt, "text"].tolist(), pdf[~is_prompt]
    sets = [_held(t) for t in prompts]
    every = np.concatenate([np.empty(0, dtype=np.uint64), *sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], np.repeat(np.arange(len(sets)), [len(s) for s in sets])[order]
    found = []
    for pair, text in zip(answers["pair"], answers["text"], strict=True):
        held = _held(text)
        spans = zip(np.searchsorted(every, held), np.searchsorted(every, held, "right"), strict=True)
        common = np.bincount(np.concatenate([owner[:0], *(owner[a:b] for a, b in spans)]), minlength=len(sets))
        near = [k for k in np.argsort(-common, kind="stable") if common[k] and common[k] >= CANDIDATE * len(held)]
        if is_echo(text, [prompts[k] for k in near]):
            found.append(pair)
    return pd.DataFrame({"pair": pd.Series(found, dtype=object)})


def _pair() -> Column:
    return F.md5(F.concat_ws("\0", "id", "text"))


def _echoes_of_many(answers: DataFrame, asked: DataFrame, many: DataFrame) -> DataFrame:
    """(``spot``, ``echoed``): for ids with many prompts, the rows with the pairs of id and response that are echoes."""
    hot = answers.join(many, "id", "left_semi").where("text is not null").select(
        "spot",
        "id",
        "text",
        _pair().alias("pair"),
    )
    different = hot.select("id", "pair", "text").dropDuplicates(["id", "pair"])
    prompts = asked.join(many, "id", "left_semi").select("id", F.lit(None).cast("string").alias("pair"), "text")
    index, held = (t.mapInPandas(_shingled, "id string, pair string, held array<long>") for t in (prompts, different))
    pooled = held.select("id", "pair", F.size("held").alias("of"), F.explode("held").alias("shingle")).join(
        index.select("id", F.explode("held").alias("shingle")).distinct().hint("merge"),
        ["id", "shingle"],
    )
    likely = pooled.groupBy("id", "pair").agg(F.count("*").alias("n"), F.max("of").alias("of")).where(
        F.col("n") >= CANDIDATE * F.col("of")
    )
    suspects = cut_lineage(different.join(likely.select("id", "pair").hint("merge"), ["id", "pair"], "left_semi"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    sizes = suspects.groupBy("id").agg(blocks(F.count("*")).alias("slices")).join(
        many.select("id", blocks(F.col("n")).alias("blocks")),
        "id",
    )
    placed = lambda t, own, of, other, others: t.join(sizes.hint("merge"), "id").select("id", "pair", "text", F.pmod(F.xxhash64("text"), F.col(of)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other))
    met = placed(prompts, "block", "blocks", "slice", "slices").unionByName(
        placed(suspects, "slice", "slices", "block", "blocks")
    )
    tasks = max(
        met.sparkSession.sparkContext.defaultParallelism,
        int(met.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    echoed = met.repartition(tasks, "id", "block", "slice").groupBy("id", "block", "slice").applyInPandas(
        _echoing,
        "pair string",
    ).distinct()
    return hot.join(echoed.hint("merge"), "pair").groupBy("spot").agg(F.collect_set("pair").alias("echoed"))


def pair_defects(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """``responses``: (``row_no``, ``id``, ``config``, ``explanation``, ``pred_label``); ``prompts``: (``row_no``, ``id``, ``source``, ``system_description``).

    Returns (``row_no``, ``defect``) for the defective responses.
    """
    name, number = F.lower(F.trim("id")), F.col("row_no").cast("long")
    answers = responses.select(
        number.alias("row_no"),
        F.coalesce(number, F.lit(-1 << 63)).alias("spot"),
        name.alias("id"),
        F.col("explanation").alias("text"),
        F.coalesce(F.lower(F.trim("pred_label")).isin(*LABELS), F.lit(False)).alias("labelled"),
    )
    asked = prompts.where("id is not null and system_description is not null").select(
        name.alias("id"),
        F.col("system_description").alias("text"),
    ).distinct()
    texts = responses.select(F.lit("responses").alias("origin"), F.col("row_no").alias("key"), F.col("config").alias("source"), F.col("explanation").alias("text")).unionByName(
        prompts.select(F.lit("prompts").alias("origin"), F.col("row_no").alias("key"), "source", F.col("system_description").alias("text"))
    )
    cut = judged_rows(texts).where("origin = 'responses' and is_cut").select(
        F.col("key").alias("spot"),
        "is_cut",
    ).distinct()
    n_prompts = asked.groupBy("id").agg(F.count("*").alias("n"))
    few = asked.join(n_prompts.where(F.col("n") <= FEW_PROMPTS), "id").groupBy("id").agg(
        F.collect_list("text").alias("prompts")
    )
    echoes = _echoes_of_many(answers, asked, n_prompts.where(F.col("n") > FEW_PROMPTS))
    joined = answers.join(few.hint("merge"), "id", "left").join(cut.hint("merge"), "spot", "left").join(
        echoes.hint("merge"),
        "spot",
        "left",
    )
    filled = joined.select(
        "row_no",
        "text",
        "prompts",
        F.coalesce("is_cut", F.lit(False)).alias("is_cut"),
        "labelled",
        F.coalesce(F.array_contains("echoed", _pair()), F.lit(False)).alias("echoes"),
    )
    return filled.mapInPandas(_with_defect, "row_no long, defect string").where("defect is not null")
