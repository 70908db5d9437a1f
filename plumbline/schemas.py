"""Explicit schemas of the relations; JSON is never read by inference."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, StringType, StructField, StructType

_S, _I, _D, _B = StringType(), IntegerType(), DoubleType(), BooleanType()


def _of(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


CORPUS_CHUNKS = _of(
    id=_S, source_doc=_S, section=_S, section_title=_S, annex_iii_area=_S, para_num=_S, part=_I, heading_path=_S,
    text=_S, char_len=_I,
)
TEST_SET = _of(
    id=_S, source=_S, annex_iii_area=_S, annex_iii_point=_S, system_description=_S, label=_S, label_source=_S,
    edge_case_type=_S, notes=_S, needs_review=ArrayType(_S),
)
RUNS = _of(
    id=_S, config=_S, gold_label=_S, pred_label=_S, explanation=_S, parse_ok=_B, edge_case_type=_S, annex_iii_area=_S, retrieved_top5=ArrayType(_of(id=_S, text=_S, score=_D)), retrieved_top10_ids=ArrayType(_S),
    usage=_of(input_tokens=_I, output_tokens=_I, error=_S), raw=_S,
)
CORRECTNESS = _of(id=_S, gold=_S, pred=_S, parse_ok=_B, correct=_B, edge_case_type=_S, area=_S)
FAITHFULNESS = _of(
    id=_S,
    config=_S,
    faithfulness=_D,
    skipped_reason=_S,
    n_statements=_I,
    n_supported=_I,
    statements=ArrayType(_of(statement=_S, verdict=_I, reason=_S)),
    judge=_S,
    error=_S,
)
