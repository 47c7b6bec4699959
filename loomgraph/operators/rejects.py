"""Rows that fail to parse: delimited lines into typed rows, and rejects with their reason.

Noise and broken quoting are found by whole-column regular expressions; the remaining lines go through pyarrow's CSV
reader, whose invalid-row callback names lines with a wrong number of fields; fields are read as strings, cast as
vectors, and cells that fail are labelled. Work is per Arrow batch inside Spark tasks; nothing is shuffled.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The two layouts, their labels, and what messages of the export shell begin with.
LAYOUTS = {"nodes": ["node_id", "label", "name", "sab"], "edges": ["source", "target", "predicate", "sab", "confidence"]}
MESSAGES = r"^(?:WARNING|Failed|java\.)"
SPACE = " \t\n\r" + "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
MARK = chr(0xFEFF)

WS = r"[ \t\n\r\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
QUOTED = r'"(?:[^"]|"")*"'
FIELD = rf'{WS}(?:{QUOTED}{WS}|[^",]*)'
GOOD_QUOTES = rf"^(?:{FIELD})(?:,{FIELD})*\z"
CONTROL = r"[\x{0}-\x{8}\x{b}\x{c}\x{e}-\x{1f}\x{7f}-\x{9f}\x{fffd}]"
NUMBER = r"^(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"

OUT = pa.schema(
    [("line_id", pa.int64()), ("layout", pa.string()), ("reason", pa.string())]
    + [(c, pa.string()) for c in ("node_id", "label", "name", "source", "target", "predicate", "sab")]
    + [("confidence", pa.float64())]
)
DDL = "line_id long, layout string, reason string, node_id string, label string, name string, source string, target string, predicate string, sab string, confidence double"


def _flatten_bare_breaks(line: str) -> str:
    """Line ends outside quotes become spaces; only lines with quotes and such line ends come here."""
    return re.sub(r'("(?:[^"]|"")*")|[\r\n]', lambda m: m.group(1) or " ", line)


def _parse(index: pa.Array, text: pa.Array, columns: list[str]) -> tuple[pa.Table, list[int]]:
    """Fields of well-quoted lines, with the position of each line, and positions of lines with a wrong number.

    The reader miscounts the fields of a line with a NUL once it has met many quoted lines, so a NUL goes in as another
    control character: the line is no row either way.
    """
    text = pc.replace_substring(text, "\0", "\x01")
    has_quote = pc.match_substring(text, '"')
    bare = pc.binary_join_element_wise('"', pc.replace_substring(text, ",", '","'), '"', "")
    quoted = pc.replace_substring_regex(text, rf"(^|,){WS}({QUOTED}){WS}", r"\1\2")
    rest = pc.replace_substring_regex(quoted, QUOTED, "")
    broken = pc.and_(has_quote, pc.match_substring_regex(rest, r"[\r\n]"))
    if pc.any(broken).as_py():
        quoted = pc.replace_with_mask(quoted, broken, pa.array([_flatten_bare_breaks(x) for x in quoted.filter(broken).to_pylist()], pa.string()))
    rows = pc.binary_join_element_wise(index.cast(pa.string()), pc.if_else(has_quote, quoted, bare), ",")
    data = ("\n".join(rows.to_pylist()) + "\n").encode()
    wrong: list[int] = []

    def invalid(row: pacsv.InvalidRow) -> str:
        wrong.append(int(row.text.split(",", 1)[0]))
        return "skip"

    names = ["_at", *columns]
    parsed = pacsv.read_csv(
        io.BytesIO(data),
        read_options=pacsv.ReadOptions(column_names=names, use_threads=False, block_size=len(data) + 1),
        parse_options=pacsv.ParseOptions(newlines_in_values=True, invalid_row_handler=invalid),
        convert_options=pacsv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()) | {"_at": pa.int64()}, strings_can_be_null=False),
    ).combine_chunks()
    for i, c in enumerate(columns, 1):
        parsed = parsed.set_column(i, c, pc.utf8_trim(parsed[c], SPACE))
    return parsed, wrong


def _bad_values(t: pa.Table, layout: str) -> pa.Array:
    bad = pa.chunked_array([pa.array([False] * len(t), pa.bool_())])
    for c in LAYOUTS[layout]:
        bad = pc.or_(bad, pc.match_substring_regex(t[c], CONTROL))
    if layout == "nodes":
        bad = pc.or_(bad, pc.equal(t["node_id"], ""))
        return pc.or_(bad, pc.invert(pc.is_in(pc.utf8_lower(t["label"]), pa.array(["concept", "code"]))))
    bad = pc.or_(bad, pc.or_(pc.equal(t["source"], ""), pc.equal(t["target"], "")))
    bad = pc.or_(bad, pc.invert(pc.match_substring_regex(t["predicate"], r"^[a-z][a-z0-9_]*$")))
    number = _numbers(t["confidence"])
    return pc.or_(bad, pc.and_(pc.not_equal(t["confidence"], ""), pc.fill_null(pc.greater(number, 1.0), True)))


def _numbers(column: pa.ChunkedArray) -> pa.ChunkedArray:
    return pc.if_else(pc.match_substring_regex(column, NUMBER), column, pa.scalar(None, pa.string())).cast(pa.float64())


def _layout_rows(ids: pa.Array, text: pa.Array, layout: str) -> pa.Table:
    n = len(ids)
    columns = LAYOUTS[layout]
    reason = pa.array([None] * n, pa.string())
    body = pc.utf8_ltrim(pc.fill_null(text, ""), SPACE + MARK)
    noise = pc.or_(pc.equal(pc.utf8_trim(body, SPACE), ""), pc.match_substring_regex(body, MESSAGES))
    header = "^" + ",".join(rf'{WS}(?:{c}|"{WS}{c}{WS}"){WS}' for c in columns) + r"\z"
    noise = pc.or_(noise, pc.match_substring_regex(body, header))
    quoting = pc.and_(pc.match_substring(body, '"'), pc.invert(pc.match_substring_regex(body, GOOD_QUOTES)))
    reason = pc.if_else(noise, "noise", pc.if_else(quoting, "quoting", reason))
    fields = {c: pa.nulls(n, pa.string()) for c in columns}
    open_ = pc.is_null(reason)
    if pc.any(open_).as_py():
        at = pa.array(range(n), pa.int64()).filter(open_)
        parsed, wrong = _parse(at, body.filter(open_), columns)
        bad = _bad_values(parsed, layout)
        place = parsed["_at"].to_numpy()
        named = reason.to_numpy(zero_copy_only=False)
        named[wrong] = "columns"
        named[place[bad.to_numpy()]] = "value"
        reason = pa.array(named, pa.string(), from_pandas=True)
        good = parsed.filter(pc.invert(bad))
        where = pa.array(range(n), pa.int64())
        found = pc.index_in(where, good["_at"].combine_chunks())
        fields = {c: good[c].combine_chunks().take(found) if len(good) else pa.nulls(n, pa.string()) for c in columns}
    out = {"line_id": ids, "layout": pa.array([layout] * n, pa.string()), "reason": reason} | fields
    if layout == "edges":
        out["confidence"] = _numbers(pa.chunked_array([pc.fill_null(fields["confidence"], "")])).combine_chunks()
    return pa.table([out.get(f.name, pa.nulls(n, f.type)) for f in OUT], schema=OUT)


def _other_rows(ids: pa.Array, layout: pa.Array, text: pa.Array) -> pa.Table:
    """Lines of no known layout: noise where blank or a message, else ``columns``, as no number of fields is right."""
    body = pc.utf8_ltrim(pc.fill_null(text, ""), SPACE + MARK)
    noise = pc.or_(pc.equal(pc.utf8_trim(body, SPACE), ""), pc.match_substring_regex(body, MESSAGES))
    quoting = pc.and_(pc.match_substring(body, '"'), pc.invert(pc.match_substring_regex(body, GOOD_QUOTES)))
    reason = pc.if_else(noise, "noise", pc.if_else(quoting, "quoting", "columns"))
    out = {"line_id": ids, "layout": layout, "reason": reason}
    return pa.table([out.get(f.name, pa.nulls(len(ids), f.type)) for f in OUT], schema=OUT)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        t = pa.table(batch)
        t = t.set_column(1, "layout", t["layout"].cast(pa.string())).set_column(2, "line", t["line"].cast(pa.string()))
        known = pc.fill_null(pc.is_in(t["layout"], pa.array(list(LAYOUTS))), False)
        for layout in LAYOUTS:
            part = t.filter(pc.fill_null(pc.equal(t["layout"], layout), False)).combine_chunks()
            if len(part):
                yield from _layout_rows(part["line_id"].combine_chunks(), part["line"].combine_chunks(), layout).to_batches()
        rest = t.filter(pc.invert(known)).combine_chunks()
        if len(rest):
            yield from _other_rows(rest["line_id"].combine_chunks(), rest["layout"].combine_chunks(), rest["line"].combine_chunks()).to_batches()


def parse_lines(lines: DataFrame) -> DataFrame:
    """One row per line: ``reason`` null and typed fields for a valid line, else the first reason that applies
    (``noise``, ``quoting``, ``columns``, ``value``) and null fields.

    Needs line_id, layout, line; other columns are ignored. A null line is noise; a line of unknown or null layout
    is ``columns`` unless noise or ``quoting`` comes first. Repeated rows are judged each; an empty confidence is null.
    """
    return lines.select(F.col("line_id").cast("long"), "layout", "line").mapInArrow(_split, DDL)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter("reason is not null").select("line_id", "reason")


def valid(parsed: DataFrame, layout: str) -> DataFrame:
    return parsed.filter((F.col("layout") == layout) & F.col("reason").isNull()).select("line_id", *LAYOUTS[layout])
