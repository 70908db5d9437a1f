"""Labels in model replies."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from plumbline.functions.text import json_object, stripped

LABELS = ("high-risk", "not-high-risk")


@F.pandas_udf(
    StructType(
        [StructField("ok", BooleanType()), StructField("label", StringType()), StructField("explanation", StringType())]
    )
)
def _strict(objects: pd.Series) -> pd.DataFrame:
    """Strict JSON: Spark's readers take an object followed by something else. A value that isn't a string counts as none."""
    rows = []
    for text in objects:
        try:
            found = json.loads(text) if isinstance(text, str) else None
        except (ValueError, RecursionError):
            found = None
        if isinstance(found, dict):
            label, explanation = found.get("label"), found.get("explanation") or found.get("reason")
            rows.append(
                (True, label if isinstance(label, str) else None, explanation if isinstance(explanation, str) else "")
            )
        else:
            rows.append((False, None, ""))
    return pd.DataFrame(rows, columns=["ok", "label", "explanation"])


def literal_label(raw: Column) -> Column:
    """A label named in the text: the negative one first."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(low.contains("not-high-risk") | low.contains("not high-risk"), "not-high-risk").when(
        low.contains("high-risk"),
        "high-risk",
    )


def parsed_reply(raw: Column) -> Column:
    """Struct (``label``, ``explanation``, ``parse_ok``). A label outside the vocabulary is sought in the text; finding one there leaves ``parse_ok`` as
    the JSON was, finding none makes it false."""
    strict = _strict(json_object(raw))
    label = F.lower(stripped(strict["label"]))
    known = F.coalesce(label.isin(*LABELS), F.lit(False))
    final = F.when(known, label).otherwise(literal_label(raw))
    return F.struct(
        final.alias("label"),
        F.coalesce(strict["explanation"], F.lit("")).alias("explanation"),
        (strict["ok"] & final.isNotNull()).alias("parse_ok"),
    )
