"""Delimited records read with reject tables: valid rows come out typed, others with the reason of failure.

Each worker writes its records of each file to a file in memory and reads these with DuckDB, rejects stored. A record stands between its
number and a mark as first and last fields, so that accepted rows name their record and a surplus or missing field can't be forgiven. An unclosed quote makes DuckDB swallow the
records after it; a swallowed mark betrays that. What isn't accepted cleanly is read again, each record a file of its own,
and the first line-level error in the reject table is joined to it and gives the reason. An exact reading of the record checks that: it is the reason where DuckDB reports no error or another one,
as it takes some quotes that the format forbids. ``rejects`` tells which of them settled each record.

A null or empty record has one field at most and fails by 'column_count'. Repeated records are judged alike; texts of
any length are read whole; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import spread

FIELDS = (
    "id", "source", "annex_iii_area", "annex_iii_point", "system_description", "label", "label_source",
    "edge_case_type", "notes",
)
LABELS = ("high-risk", "not-high-risk")
#: A private-use character, which no valid record holds.
_MARK = "\ue000"
#: Records with one of these are read exactly only. DuckDB gives up on a file where a carriage return stands beside line feeds, and so on whole batches of files.
_UNREAD = re.compile(f"[{_MARK}\\x00\\r]")
_FILES_AT_ONCE = 200
#: The reason that a kind of error in DuckDB's reject table proposes.
_PROPOSED = {"UNQUOTED VALUE": "quoting", "MISSING COLUMNS": "column_count", "TOO MANY COLUMNS": "column_count"}
_FIELD = re.compile(r'"((?:[^"]|"")*)"|([^",]*)')


def exact_fields(record: str) -> list[str] | None:
    """The fields of a record, or null when its quoting is broken."""
    out, at = [], 0
    while True:
        m = _FIELD.match(record, at)
        out.append(m.group(2) if m.group(1) is None else m.group(1).replace('""', '"'))
        at = m.end()
        if at == len(record):
            return out
        if record[at] != ",":
            return None
        at += 1


def _read(connection, contents: list[str], width: int) -> tuple[list[tuple], list[tuple[int, str, str]]]:
    """Accepted rows of these file contents; (file, kind of error, message) of the rejects."""
    handles = [os.memfd_create(f"records-{k}") for k in range(len(contents))]
    try:
        longest = 0
        for handle, content in zip(handles, contents, strict=True):
            data = content.encode("utf-8", "replace")
            longest = max(longest, len(data))
            with os.fdopen(os.dup(handle), "wb") as out:
                out.write(data)
        paths = [f"/proc/{os.getpid()}/fd/{h}" for h in handles]
        columns = ", ".join(f"'c{i}': 'VARCHAR'" for i in range(width + 2))
        size = max(1 << 16, longest + 1024)
        connection.execute("DROP TABLE IF EXISTS reject_errors; DROP TABLE IF EXISTS reject_scans")
        rows = connection.execute(
            f"SELECT * FROM read_csv({paths!r}, header=false, auto_detect=false, delim=',', quote='\"', escape='\"', columns={{{columns}}}, strict_mode=true, store_rejects=true, rejects_limit=0, max_line_size={size}, buffer_size={4 * size}, parallel=false)"
        ).fetchall()
        errors = connection.execute(
            "SELECT s.file_path, e.error_type, e.error_message FROM reject_errors e JOIN reject_scans s USING (scan_id, file_id)"
        ).fetchall()
        by_path = {p: k for k, p in enumerate(paths)}
        return rows, [(by_path[p], str(kind), str(message)) for p, kind, message in errors]
    finally:
        for handle in handles:
            os.close(handle)


def _read_all(connection, contents: list[str], width: int) -> tuple[list[tuple], list[tuple[int, str, str]]]:
    """``_read``, where a file at which DuckDB gives up costs that file only."""
    import duckdb

    try:
        return _read(connection, contents, width)
    except duckdb.Error as e:
        if len(contents) == 1:
            return [], [(0, "UNREADABLE", str(e))]
    half = len(contents) // 2
    rows, errors = _read_all(connection, contents[:half], width)
    more, others = _read_all(connection, contents[half:], width)
    return rows + more, errors + [(half + k, kind, message) for k, kind, message in others]


def _is_whole(record: str, fields: list[str | None]) -> bool:
    """Whether these fields, bare or quoted with quotes doubled, are all there is in the record: DuckDB forgives an empty surplus field and some quotes."""
    at = 0
    for k, field in enumerate(fields):
        text = field or ""
        quoted = '"' + text.replace('"', '""') + '"'
        if k and not record.startswith(",", at):
            return False
        at += k > 0
        if record.startswith(quoted, at):
            at += len(quoted)
        elif '"' not in text and "," not in text and record.startswith(text, at):
            at += len(text)
        else:
            return False
    return at == len(record)


def _accepted(rows: list[tuple], records: list[str | None]) -> dict[int, list[str | None]]:
    """Record number and fields of the rows that are one record each."""
    out = {}
    for row in rows:
        number, fields, last = row[0], list(row[1:-1]), row[-1]
        if last == _MARK and number and number.startswith(_MARK) and number[1:].isdigit() and not any(v and _MARK in v for v in fields) and _is_whole(records[int(number[1:])], fields):
            out[int(number[1:])] = fields
    return out


def _framed(number: int, record: str) -> str:
    return f"{_MARK}{number},{record},{_MARK}\n"


def parse_records(records: list[str | None], files: list[str | None], width: int = len(FIELDS)) -> list[
    tuple[str | None, str | None, list[str | None] | None]
]:
    """For each record: reason of failure or null, what DuckDB said of it first, and its fields when it's valid."""
    import duckdb

    connection = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB"})
    try:
        readable = [i for i, r in enumerate(records) if isinstance(r, str) and not _UNREAD.search(r)]
        by_file: dict[str | None, list[int]] = {}
        for i in readable:
            by_file.setdefault(files[i], []).append(i)
        clean: dict[int, list[str | None]] = {}
        contents = ["".join(_framed(i, records[i]) for i in numbers) for numbers in by_file.values()]
        for lo in range(0, len(contents), _FILES_AT_ONCE):
            clean |= _accepted(_read_all(connection, contents[lo : lo + _FILES_AT_ONCE], width)[0], records)
        said: dict[int, str] = {}
        again = [i for i in readable if i not in clean]
        for lo in range(0, len(again), _FILES_AT_ONCE):
            part = again[lo : lo + _FILES_AT_ONCE]
            rows, errors = _read_all(connection, [_framed(i, records[i]) for i in part], width)
            clean |= _accepted(rows, records)
            for k, kind, message in errors:
                said.setdefault(part[k], f"{kind}: {message.splitlines()[0] if message else ''}")
    finally:
        connection.close()
    out: list[tuple[str | None, str | None, list[str | None] | None]] = []
    for i, record in enumerate(records):
        if i in clean:
            out.append((None, None, clean[i]))
            continue
        fields = exact_fields(record) if isinstance(record, str) else []
        checked = "quoting" if fields is None else "column_count" if len(fields) != width else None
        reason = _PROPOSED.get(said.get(i, "").partition(":")[0])
        out.append(
            (
                reason if reason == checked else checked,
                said.get(i),
                None if checked or fields is None else [f or None for f in fields],
            )
        )
    return out


_SCHEMA = "row_no long, file_name string, received_at timestamp, error string, detail string, " + ", ".join(
    f"{f} string" for f in FIELDS
)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = parse_records(
            pdf["raw_line"].where(pdf["raw_line"].notna(), None).tolist(),
            pdf["file_name"].where(pdf["file_name"].notna(), None).tolist(),
        )
        out = pdf[["row_no", "file_name", "received_at"]].reset_index(drop=True)
        out["error"] = pd.Series([x[0] for x in found], dtype=object)
        out["detail"] = pd.Series([x[1] for x in found], dtype=object)
        for k, field in enumerate(FIELDS):
            out[field] = pd.Series([x[2][k] if x[2] else None for x in found], dtype=object)
        yield out


def read_records(raw: DataFrame) -> DataFrame:
    """``raw``: (``row_no``, ``file_name``, ``raw_line``, ``received_at``). A row for each, with ``error``, ``detail`` and the fields as they stand."""
    unnamed = F.lit(-(2**63))  # stands for null, which would turn the numbers of a batch into floating point
    source = raw.select(
        F.coalesce(F.col("row_no").cast("long"), unnamed).alias("row_no"),
        F.col("file_name").cast("string").alias("file_name"),
        F.col("raw_line").cast("string").alias("raw_line"),
        F.col("received_at").cast("timestamp").alias("received_at"),
    )
    return spread(source).mapInPandas(_parsed, _SCHEMA).withColumn("row_no", F.nullif("row_no", unnamed))


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def value_reason(id_: Column, label: Column) -> Column:
    """'bad_id', 'bad_label' or null."""
    good_id = F.coalesce(_trimmed(id_).rlike(r"^anx3-[0-9]{3,}\z"), F.lit(False))
    good_label = F.coalesce(F.lower(_trimmed(label)).isin(*LABELS), F.lit(False))
    return F.when(~good_id, "bad_id").when(~good_label, "bad_label")


def with_reasons(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """All rows of both tables: (``origin``, ``row_no``, ``reason``, ``detail``, the fields, ``arrived_at``); ``reason`` is null for the valid ones."""
    parsed = read_records(raw).select(
        F.lit("test_set_raw").alias("origin"), "row_no", F.coalesce("error", value_reason(F.col("id"), F.col("label"))).alias("reason"), "detail", *FIELDS, F.col("received_at").alias("arrived_at")
    )
    present = loaded.select(
        F.lit("test_set").alias("origin"), F.col("row_no").cast("long").alias("row_no"), value_reason(F.col("id"), F.col("label")).alias("reason"), F.lit(None).cast("string").alias("detail"), *FIELDS, F.col("loaded_at").cast("timestamp").alias("arrived_at")
    )
    return parsed.unionByName(present)


def rejected(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    return with_reasons(raw, loaded).where("reason is not null").select("origin", "row_no", "reason")


def rejects(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """The failing rows with what settled their reason: (``origin``, ``row_no``, ``reason``, ``settled_by``, ``detail``).

    ``settled_by``: 'reject table', 'exact reading' where the reject table has no error for the record or another one, 'value' for ids and labels. ``detail`` is the line-level error; its
    numbers of columns count the record's number and the mark."""
    kinds = F.create_map(*[F.lit(x) for pair in _PROPOSED.items() for x in pair])
    by_table = F.coalesce(kinds[F.substring_index("detail", ":", 1)] == F.col("reason"), F.lit(False))
    settled = F.when(F.col("reason").isin("bad_id", "bad_label"), "value").when(
        by_table,
        "reject table",
    ).otherwise("exact reading")
    return with_reasons(raw, loaded).where("reason is not null").select(
        "origin",
        "row_no",
        "reason",
        settled.alias("settled_by"),
        "detail",
    )


def typed_rows(raw: DataFrame, loaded: DataFrame) -> DataFrame:
    """The valid rows of both tables as typed test rows: ids trimmed, labels in lower case, blank texts null, the point split in number and letter."""
    point = F.regexp_extract_all(_trimmed(F.col("annex_iii_point")), F.lit(r"^([0-9]+)(?:\(([a-z])\))?$"), 1)
    letter = F.nullif(F.regexp_extract(_trimmed(F.col("annex_iii_point")), r"^[0-9]+\(([a-z])\)$", 1), F.lit(""))
    cleaned = {c: F.nullif(_trimmed(F.col(c)), F.lit("")) for c in FIELDS}
    return with_reasons(raw, loaded).where("reason is null").select(
        "origin",
        "row_no",
        *[(F.lower(cleaned[c]) if c == "label" else cleaned[c]).alias(c) for c in FIELDS],
        F.get(point, 0).cast("int").alias("point_number"),
        letter.alias("point_letter"),
        "arrived_at",
    )
