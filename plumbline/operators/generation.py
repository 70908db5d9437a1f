"""Prompts, pluggable models and judges, and run records.

A model is any picklable object with ``complete(system, user) -> (text, usage)``; it lives in the Arrow workers, one per partition. A call that keeps
failing gives an empty reply and the error, cut to 300 characters, in ``usage``; the run goes on.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import time
import urllib.request
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from plumbline import schemas
from plumbline.functions.labels import parsed_reply
from plumbline.functions.text import passages, stripped
from plumbline.operators.common import latest

CONFIGS = {"baseline1_plain_llm": False, "baseline2_standard_rag": True, "agent_structured": True}
_TASK = "Decide whether the described AI system is high-risk under Article 6 of the EU AI Act by way of Annex III."
_REPLY = 'Reply with one JSON object only: {"label": "high-risk" or "not-high-risk", "%s": "..."}'


_STEPS = (
    "State the intended purpose.",
    "Find the Annex III point, 1 to 8, that covers it; without one the system is not high-risk on this route.",
    "Where a point covers it, test the conditions of Article 6(3)(a) to (d): one met and no profiling of natural persons exempts it; profiling never is exempt.",
    "Give the label, the point and the condition, with the passages.",
)
#: The system prompt of each configuration, and what ends its user prompt.
SYSTEM = {
    "baseline1_plain_llm": f"{_TASK} Use what you know; there is no reference text.\n\n{_REPLY % 'reason'}",
    "baseline2_standard_rag": f"{_TASK} Rely on the passages given and base the explanation on them.\n\n{_REPLY % 'explanation'}",
    "agent_structured": f"{_TASK} Work from the passages only, in these steps:\n" + "\n".join(
        f"{i}. {s}" for i, s in enumerate(_STEPS, 1)
    ) + f"\n\n{_REPLY % 'explanation'}",
}
ENDING = {
    "baseline1_plain_llm": "",
    "baseline2_standard_rag": "\n\nClassify the system and explain by the passages.",
    "agent_structured": "\n\nGo through the steps and return the JSON.",
}
PASSAGES, DESCRIPTION = "Passages from the guidelines:\n", "AI system description:\n"


def _prompt(config: str) -> tuple[Column, Column]:
    described = F.concat(F.lit(DESCRIPTION), F.coalesce("system_description", F.lit("")))
    if CONFIGS[config]:
        described = F.concat(F.lit(PASSAGES), passages(F.col("hits"), heading=True), F.lit("\n\n"), described)
    return F.lit(SYSTEM[config]), F.concat(described, F.lit(ENDING[config]))


#: Prompt builders by configuration; add your own.
BUILDERS: dict[str, Callable[[], tuple[Column, Column]]] = {name: partial(_prompt, name) for name in CONFIGS}


def config_cross(
    rows: DataFrame,
    configs: Sequence[str] | None = None,
    row_ids: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Every configuration over every row, after the id filter and then the limit in row order."""
    wanted = [c for c in CONFIGS if configs is None or c in configs]
    if row_ids is not None:
        rows = rows.where(F.col("id").isin(*row_ids)) if row_ids else rows.limit(0)
    if limit is not None:
        rows = rows.orderBy("row_no").limit(limit)
    return rows.withColumn("config", F.explode(F.array(*[F.lit(c) for c in wanted]).cast("array<string>")))


def with_prompts(crossed: DataFrame) -> DataFrame:
    """``crossed`` has ``config``, ``system_description`` and ``hits``; other configurations get null prompts."""
    system = user = F.lit(None).cast("string")
    for name, build in BUILDERS.items():
        s, u = build()
        system, user = F.when(F.col("config") == name, s).otherwise(system), F.when(
            F.col("config") == name,
            u,
        ).otherwise(user)
    return crossed.withColumn("system", system).withColumn("user", user)


class StubModel:
    """Replies without a model, from a hash of the prompt; for tests."""

    def complete(self, system: str, user: str) -> tuple[str, dict]:
        label = "high-risk" if hashlib.sha1(user.encode()).digest()[0] % 3 == 0 else "not-high-risk"
        return json.dumps({"label": label, "explanation": f"The description leads to {label}."}), {
            "input_tokens": len(user.split()),
            "output_tokens": 8,
        }


@dataclass
class HttpModel:
    """Any endpoint of the common chat-completions form."""

    model: str
    base_url: str
    api_key_env: str = "OPENAI_API_KEY"
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout_s: float = 120.0

    def complete(self, system: str, user: str) -> tuple[str, dict]:
        body = {
            "model": self.model,
            "temperature": self.temperature,
            "max_tokens": self.max_tokens,
            "messages": [{"role": "system", "content": system}, {"role": "user", "content": user}],
        }
        request = urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions",
            json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {os.environ.get(self.api_key_env, '')}"},
        )
        with urllib.request.urlopen(request, timeout=self.timeout_s) as reply:
            found = json.load(reply)
        usage = found.get("usage") or {}
        return found["choices"][0]["message"]["content"] or "", {
            "input_tokens": usage.get("prompt_tokens"),
            "output_tokens": usage.get("completion_tokens"),
        }


@dataclass
class MessagesModel:
    """An endpoint of the messages form, where the system prompt stands apart; ``project`` and ``region`` choose the hosted variant, which takes a bearer token."""

    model: str
    base_url: str = "https://api.anthropic.com"
    api_key_env: str = "ANTHROPIC_API_KEY"
    temperature: float = 0.0
    max_tokens: int = 1024
    timeout_s: float = 120.0
    project: str = ""
    region: str = ""

    def request(self, system: str, user: str) -> urllib.request.Request:
        body = {
            "max_tokens": self.max_tokens,
            "temperature": self.temperature,
            "system": system,
            "messages": [{"role": "user", "content": user}],
        }
        secret = os.environ.get(self.api_key_env, "")
        if self.project:
            place = f"https://{self.region}-aiplatform.googleapis.com/v1/projects/{self.project}/locations/{self.region}/publishers/anthropic/models/{self.model}:rawPredict"
            return urllib.request.Request(
                place,
                json.dumps({"anthropic_version": "vertex-2023-10-16", **body}).encode(),
                {"Content-Type": "application/json", "Authorization": f"Bearer {secret}"},
            )
        return urllib.request.Request(
            f"{self.base_url.rstrip('/')}/v1/messages",
            json.dumps({"model": self.model, **body}).encode(),
            {"Content-Type": "application/json", "x-api-key": secret, "anthropic-version": "2023-06-01"},
        )

    def complete(self, system: str, user: str) -> tuple[str, dict]:
        with urllib.request.urlopen(self.request(system, user), timeout=self.timeout_s) as reply:
            found = json.load(reply)
        usage = found.get("usage") or {}
        text = "".join(part.get("text", "") for part in found.get("content") or [] if part.get("type") == "text")
        return text, {"input_tokens": usage.get("input_tokens"), "output_tokens": usage.get("output_tokens")}


#: Model factories by name; add your own.
MODELS: dict[str, Callable[..., object]] = {
    "stub": lambda **_: StubModel(),
    "openai_compatible": HttpModel,
    "anthropic": MessagesModel,
    "vertex": MessagesModel,
}


def get_model(name: str, **options) -> object:
    if name not in MODELS:
        raise ValueError(f"no model named {name!r}; there are {sorted(MODELS)}")
    return MODELS[name](**options)


def completed(
    model: object,
    system: str,
    user: str,
    attempts: int = 4,
    pause: Callable[[float], None] = time.sleep,
) -> tuple[str, dict]:
    for attempt in range(attempts):
        try:
            return model.complete(system, user)
        except Exception as e:  # a failing endpoint must not end the run
            if attempt + 1 == attempts:
                return "", {"error": repr(e)[:300]}
            pause(2.0**attempt)
    return "", {"error": "no attempt"}


def over_workers(rows: DataFrame, workers: int | None = None) -> DataFrame:
    """``rows`` in at least ``workers`` tasks, all cores unless given: calls take long, so that few small rows aren't few tasks, as the planner would have it."""
    session = rows.sparkSession
    least = workers or session.sparkContext.defaultParallelism
    return rows.repartition(max(least, int(session.conf.get("spark.sql.shuffle.partitions"))))


def generate(prompted: DataFrame, model: object, attempts: int = 4, workers: int | None = None) -> DataFrame:
    """Run records of rows with (``row_no``, ``id``, ``label``, ``config``, ``system``, ``user``, ``hits``, ``edge_case_type``, ``annex_iii_area``). The rows pass through the workers that call
    the model, so they are computed once; each action on the result calls the model again, so write it first and read that."""
    slim = F.transform(
        "hits",
        lambda h: F.struct(h["id"].alias("id"), h["text"].alias("text"), h["score"].alias("score")),
    )
    kept = prompted.select(
        "row_no", "id", "config", F.col("label").alias("gold_label"), "edge_case_type", "annex_iii_area", F.slice(slim, 1, 5).alias("retrieved_top5"), F.slice(F.transform("hits", lambda h: h["id"]), 1, 10).alias("retrieved_top10_ids"), "system", "user",
    )
    schema = StructType(
        [f for f in kept.schema.fields if f.name not in ("system", "user")]
        + [StructField("raw", StringType()), StructField("usage", schemas.RUNS["usage"].dataType)]
    )

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [
                completed(model, s, u, attempts)
                for s, u in zip(batch["system"].to_pylist(), batch["user"].to_pylist(), strict=True)
            ]
            usage = [{k: r[1].get(k) for k in ("input_tokens", "output_tokens", "error")} for r in replies]
            usage_type = pa.struct(
                [("input_tokens", pa.int32()), ("output_tokens", pa.int32()), ("error", pa.string())]
            )
            columns = [batch[f.name] for f in schema.fields[:-2]] + [
                pa.array([r[0] for r in replies], pa.string()),
                pa.array(usage, usage_type),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    called = over_workers(kept, workers).mapInArrow(call, schema).withColumn("p", parsed_reply(F.col("raw")))
    return called.select(
        "row_no", "id", "config", "gold_label", F.col("p.label").alias("pred_label"), F.col("p.explanation").alias("explanation"), F.col("p.parse_ok").alias("parse_ok"), "edge_case_type", "annex_iii_area", "retrieved_top5", "retrieved_top10_ids", "usage", "raw",
    )


def stratified_sample(rows: DataFrame, n_each: int = 3) -> DataFrame:
    """The first high-risk row of each area up to ``n_each`` areas, then the first rows that are neither high-risk nor filter cases, then filter cases; in row order
    within a stratum. A row may be in two strata. Each stratum is a partial top-n, so no group is gathered."""
    high = rows.where("label = 'high-risk'").groupBy("annex_iii_area").agg(
        F.min("row_no").alias("row_no")
    ).orderBy("row_no").limit(n_each).select("row_no", F.lit("high-risk").alias("stratum"))
    plain = rows.where("label = 'not-high-risk' and edge_case_type = 'none'").orderBy("row_no").limit(n_each).select(
        "row_no",
        F.lit("not-high-risk").alias("stratum"),
    )
    cases = rows.where("edge_case_type = 'article-6-3-filter'").orderBy("row_no").limit(n_each).select(
        "row_no",
        F.lit("filter").alias("stratum"),
    )
    picked = F.broadcast(high.unionByName(plain).unionByName(cases))  # three times n_each rows
    return rows.join(picked, "row_no").select("stratum", "row_no", "id", "annex_iii_area", "label", "edge_case_type")


def sample_tally(runs: DataFrame, sample: DataFrame) -> DataFrame:
    """Right predictions of each configuration on the sampled ids."""
    hits = F.sum((F.col("pred_label") == F.col("gold_label")).cast("long"))
    return runs.join(F.broadcast(sample.select("id").distinct()), "id").groupBy("config").agg(
        F.count("*").alias("n"),
        F.coalesce(hits, F.lit(0).cast("long")).alias("n_right"),
    )


class Judge:
    """Statements of an answer, and which of them the context supports, by a model. Replies that aren't JSON or name no statement fall back: to sentences, and to no support."""

    name = "llm"

    def __init__(self, model: object):
        self.model = model

    @staticmethod
    def _object(text: str) -> dict | None:
        m = re.search(r"\{.*\}", text or "", re.DOTALL)
        try:
            found = json.loads(m.group(0)) if m else None
        except ValueError:
            return None
        return found if isinstance(found, dict) else None

    def statements(self, question: str, answer: str) -> list[str]:
        text, _ = completed(
            self.model,
            'List the distinct claims of the answer as sentences that stand alone. Reply with JSON only: {"statements": ["..."]}',
            f"Question:\n{question}\n\nAnswer:\n{answer}",
        )
        found = (self._object(text) or {}).get("statements")
        claims = [s.strip() for s in found if isinstance(s, str) and s.strip()] if isinstance(found, list) else []
        return claims or [s for part in re.split(r"(?<=[.!?])\s+", answer.strip()) if (s := part.strip())]

    def verdicts(self, context: str, claims: list[str]) -> list[dict]:
        numbered = "\n".join(f"{i}. {s}" for i, s in enumerate(claims, 1))
        text, _ = completed(
            self.model,
            'For each statement: 1 if the context supports it, else 0. Reply with JSON only: {"verdicts": [{"statement": "...", "verdict": 0, "reason": "..."}]}',
            f"Context:\n{context}\n\nStatements:\n{numbered}",
        )
        found = self._object(text)
        if found is None or not isinstance(found.get("verdicts"), list):
            return [{"statement": s, "verdict": 0, "reason": "judge-parse-failed"} for s in claims]
        return matched_verdicts(claims, [v if isinstance(v, dict) else {} for v in found["verdicts"]])


def matched_verdicts(claims: list[str], replies: list[dict]) -> list[dict]:
    """A reply for each claim by its text, the last of equal ones; else by place, if there are as many replies as claims; else no support."""
    by_text = {r["statement"].strip(): r for r in replies if isinstance(r.get("statement"), str)}
    same_length = len(claims) == len(replies)
    out = []
    for i, claim in enumerate(claims):
        reply = by_text.get(claim.strip(), replies[i] if same_length else {})
        out.append(
            {
                "statement": claim,
                "verdict": int(bool(reply.get("verdict", 0))),
                "reason": str(reply.get("reason") or ""),
            }
        )
    return out


def with_questions(runs: DataFrame, questions: DataFrame) -> DataFrame:
    """``runs`` with ``question``, the last description of their id; '' where there's none."""
    asked = latest(questions.select("id", "row_no", "system_description"), ["id"], "row_no").select(
        "id",
        F.col("system_description").alias("question"),
    )
    return runs.join(asked, "id", "left").withColumn("question", F.coalesce("question", F.lit("")))


#: Judge factories by name; add your own. The stub is built-in functions only and has no factory.
JUDGES: dict[str, Callable[..., Judge]] = {
    "openai_compatible": lambda **options: Judge(HttpModel(**options)),
    "anthropic": lambda **options: Judge(MessagesModel(**options)),
}


def get_judge(name: str, **options) -> Judge | None:
    """A judge by name; null for the stub."""
    if name == "stub":
        return None
    if name not in JUDGES:
        raise ValueError(f"no judge named {name!r}; there are {sorted([*JUDGES, 'stub'])}")
    return JUDGES[name](**options)


def judged_runs(runs: DataFrame, questions: DataFrame, judge: Judge, workers: int | None = None) -> DataFrame:
    """Faithfulness rows by a model's verdicts; the last question of an id counts, a missing one is empty. Errors skip the row as 'judge-error'. Each action on the result calls the model again."""
    source = with_questions(runs, questions).select(
        "row_no",
        "id",
        "config",
        passages(F.col("retrieved_top5")).alias("context"),
        stripped(F.coalesce("explanation", F.lit(""))).alias("explanation"),
        "question",
    )
    schema = "row_no long, id string, config string, faithfulness double, skipped_reason string, n_statements int, n_supported int, statements array<struct<statement:string,verdict:int,reason:string>>, judge string, error string"

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                reason, error, found = None, None, []
                try:
                    if not r.context:
                        reason = "no-retrieved-context"
                    elif not r.explanation:
                        reason = "no-explanation"
                    elif claims := judge.statements(r.question or "", r.explanation):
                        found = judge.verdicts(r.context, claims)
                    else:
                        reason = "no-statements-extracted"
                except Exception as e:  # one row's trouble must not end the run
                    reason, error, found = "judge-error", repr(e)[:300], []
                good = sum(v["verdict"] for v in found)
                rows.append(
                    (
                        r.row_no,
                        r.id,
                        r.config,
                        good / len(found) if found else None,
                        reason,
                        len(found),
                        good,
                        found,
                        judge.name,
                        error,
                    )
                )
            yield pd.DataFrame(
                rows,
                columns=[
                    c.split()[0]
                    for c in (
                        "row_no", "id", "config", "faithfulness", "skipped_reason", "n_statements", "n_supported",
                        "statements", "judge", "error",
                    )
                ],
            )

    return over_workers(source, workers).mapInPandas(score, schema)
