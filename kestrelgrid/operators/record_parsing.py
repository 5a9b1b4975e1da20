"""Delimited records into valid rows and rejects with a reason.

Each Arrow batch is handled as one byte buffer. Numpy masks mark quotes; the parity of the quotes before a byte, counted
from its record's start, tells whether the byte stands inside quotes. Delimiters outside quotes end fields, and every
rule about quotes is a test of the bytes beside a quote, so no record is read byte by byte in Python.

Defined results
---------------
* NULL record: ``column_count``. Empty record: one empty field.
* A record whose file, delimiter or header is unknown: ``no_header``.
* One carriage return at the end is not part of a record. A delimiter of several bytes is allowed.
* Repeated rows are kept as often as they come. Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A number: ASCII digits, an optional sign, point and exponent. Java's and RE2's syntax alike.
NUMBER = r"^ *[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)? *$"
CLOCK = r"^ *[0-9]{2}:[0-5][0-9]:[0-5][0-9]\.[0-9]{3} *$"
#: The quote, and what stands for a delimiter of several bytes: a byte that UTF-8 never holds.
_QUOTE, _SEPARATOR = 0x22, b"\xff"


def split_records(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, delimiters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Field borders of records that lie in one buffer.

    buffer: bytes; starts, ends: each record's borders; delimiters: each record's delimiter byte. Result: bad_quotes
    (a flag for each record), the positions of all delimiters outside quotes, ascending, and the index of the first of
    each record, with the total at the end.
    """
    n = len(starts)
    lengths = ends - starts
    record = np.repeat(np.arange(n), lengths)
    at = np.arange(len(record)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    data = buffer[at]
    quote = data == _QUOTE
    before = np.cumsum(quote) - quote
    first = np.cumsum(lengths) - lengths
    base = np.zeros(n, dtype=np.int64)
    filled = lengths > 0
    base[filled] = before[first[filled]]
    inside = ((before - base[record]) & 1).astype(bool)
    delimiter = (data == delimiters[record]) & ~inside
    # the neighbours of every byte; a record's borders count as delimiters
    is_first, is_last = np.zeros(len(data), bool), np.zeros(len(data), bool)
    is_first[first[filled]] = True
    is_last[(first + lengths - 1)[filled]] = True
    after_border = is_first | np.concatenate([[False], delimiter[:-1]]) if len(data) else is_first
    after_quote = np.concatenate([[False], quote[:-1]]) & ~is_first if len(data) else is_first
    raw_delimiter = data == delimiters[record]
    to_border = is_last | np.concatenate([raw_delimiter[1:], [False]]) if len(data) else is_last
    to_quote = np.concatenate([quote[1:], [False]]) & ~is_last if len(data) else is_last
    wrong = quote & np.where(inside, ~(to_border | to_quote), ~(after_border | after_quote))
    bad = np.zeros(n, bool)
    bad[record[wrong]] = True
    bad |= (np.bincount(record[quote], minlength=n) & 1).astype(bool)
    found = np.flatnonzero(delimiter)
    return bad, at[found], np.searchsorted(record[found], np.arange(n + 1))


def _unquoted(field: str) -> str:
    return field[1:-1].replace('""', '"') if len(field) > 1 and field[0] == field[-1] == '"' else field


def _codes(column: pa.Array) -> tuple[np.ndarray, list]:
    """The number of each value among the different ones, and these, a NULL being one of them."""
    encoded = pc.dictionary_encode(column, null_encoding="encode")
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary.to_pylist()


def parse_batch(raw: pa.Array, delims: pa.Array, headers: pa.Array, wanted: tuple[str, ...] = ()) -> tuple[pa.Array, ...]:
    """(fields, structure, a column for each wanted name) of the records.

    ``fields`` are lists of the unquoted fields, NULL where there are none; ``structure`` the reason against the record by
    structure, or NULL; a wanted name's column holds the field under that header name (the first, if there are several),
    NULL where there is none. Fields are cut out of the batch's one buffer by their borders; headers are read once for each different one.
    """
    n = len(raw)
    d, marks = _codes(delims)
    h, lines = _codes(headers)
    files, file = np.unique(h * len(marks) + d, return_inverse=True)
    own = [(lines[k // len(marks)], marks[k % len(marks)]) for k in files.tolist()]
    names = [header_names(line, mark) if line is not None and mark else None for line, mark in own]
    known = np.array([x is not None for x in names], bool)[file]
    width = np.array([len(x) if x is not None else -1 for x in names], np.int64)[file]
    ones = [_one_byte(mark) for mark in marks]
    texts = pc.replace_substring_regex(pc.fill_null(raw.cast(pa.large_string()), ""), r"\r\z", "")
    offsets, buffer = np.frombuffer(texts.buffers()[1], np.int64)[: n + 1], texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8)[: offsets[-1]] if buffer else np.zeros(0, np.uint8)
    bad, cuts, index = split_records(data, offsets[:-1], offsets[1:], np.frombuffer(b"".join(ones), np.uint8)[d])
    # a record's last field ends with the record, the others at their delimiter, which is taken out
    last = index[1:] + np.arange(n)
    ends, gone = np.empty(len(cuts) + n, np.int64), np.empty(len(cuts) + n, np.int64)
    inner = np.ones(len(ends), bool)
    inner[last] = False
    ends[inner], gone[inner] = cuts, np.arange(len(cuts))
    ends[last], gone[last] = offsets[1:], index[1:]
    kept = np.ones(len(data), bool)
    kept[cuts] = False
    values = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(np.concatenate([[0], ends - gone])), pa.py_buffer(data[kept].tobytes()))
    quoted = pc.and_(pc.and_(pc.starts_with(values, '"'), pc.ends_with(values, '"')), pc.greater(pc.binary_length(values), 1))
    if pc.any(quoted).as_py():
        values = pc.if_else(quoted, pc.replace_substring(pc.utf8_slice_codeunits(values, 1, -1), '""', '"'), values)
    count = np.diff(index) + 1
    wide = np.array([one == _SEPARATOR and bool(mark) for one, mark in zip(ones, marks)], bool)[d] & known
    reason = np.where(~known, 3, np.where(bad, 1, np.where(count != width, 2, 0)))
    reason[pc.is_null(raw).to_numpy(zero_copy_only=False) & known] = 2
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last + 1]).astype(np.int32)), values.cast(pa.string()), mask=pa.array(reason > 0))
    if wide.any():
        lists = _with_wide_delimiters(raw, [own[k][1] for k in file.tolist()], np.flatnonzero(wide), width, lists, reason)
    structure = pa.array(["quoting", "column_count", "no_header"]).take(pa.array(reason - 1, mask=reason == 0))
    begin = lists.offsets.to_numpy()[:-1].astype(np.int64)
    columns = []
    for name in wanted:
        place = np.array([x.index(name) if x is not None and name in x else -1 for x in names], np.int64)[file]
        columns.append(lists.values.take(pa.array(begin + place, mask=(place < 0) | (reason > 0))))
    return lists, structure, *columns


def _with_wide_delimiters(raw: pa.Array, delims: list[str], rows: np.ndarray, width: np.ndarray, lists: pa.Array, reason: np.ndarray) -> pa.Array:
    """``lists`` with the records whose delimiter has several bytes, read one by one; their reasons are set."""
    own = []
    for k in rows.tolist():
        text, delim = raw[k].as_py(), delims[k]
        line = (text or "").encode().removesuffix(b"\r").replace(delim.encode(), _SEPARATOR)
        bad, cuts, _ = split_records(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]), np.frombuffer(_SEPARATOR, np.uint8))
        borders = [-1, *cuts.tolist(), len(line)]
        fields = [_unquoted(line[a + 1 : b].replace(_SEPARATOR, delim.encode()).decode()) for a, b in zip(borders, borders[1:])]
        reason[k] = 2 if text is None else 1 if bad[0] else 2 if len(fields) != width[k] else 0
        own.append(None if reason[k] else fields)
    place = np.arange(len(lists))
    place[rows] = len(lists) + np.arange(len(rows))
    return pa.concat_arrays([lists, pa.array(own, pa.list_(pa.string()))]).take(pa.array(place))


def _one_byte(delim: str | None) -> bytes:
    return delim.encode() if delim and len(delim.encode()) == 1 else _SEPARATOR


def header_names(header: str, delim: str) -> list[str]:
    """Names of a header line, by the same rules as records."""
    one = _one_byte(delim)
    line = header.encode().removesuffix(b"\r").replace(delim.encode(), one)
    _, cuts, _ = split_records(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]), np.frombuffer(one, np.uint8))
    borders = [-1, *cuts.tolist(), len(line)]
    return [_unquoted(line[a + 1 : b].replace(_SEPARATOR, delim.encode()).decode()).strip() for a, b in zip(borders, borders[1:])]


def parse_records(records: DataFrame, keep: tuple[str, ...] = ("row_id", "file_no", "line_no", "raw"), wanted: tuple[str, ...] = ("timestamp", "accuracy_h")) -> DataFrame:
    """records: (row_id, file_no, line_no, raw, delim, header_line), the last two NULL where the file is unknown.

    Result: (the columns of ``keep``, structure string, f_<name> string for each wanted name): ``structure`` is ``quoting``,
    ``column_count`` or ``no_header`` for records that can't be cut into fields, else NULL.
    """
    kept = records.select(*dict.fromkeys([*keep, "raw", "delim", "header_line"]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, *cut = parse_batch(*(batch.column(k) for k in ("raw", "delim", "header_line")), wanted)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *cut], [*keep, "structure", *(f"f_{k}" for k in wanted)])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(parse, ", ".join([*(f"{k} {kinds[k]}" for k in keep), "structure string", *(f"f_{k} string" for k in wanted)]))


def number(text: Column) -> Column:
    """A finite DOUBLE, or NULL where the text isn't one."""
    value = F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def clock_seconds(text: Column) -> Column:
    """Seconds of a number or of HH:MM:SS.mmm, or NULL where the text is neither or is below 0."""
    parts = F.split(F.trim(text), ":")
    clock = F.when(text.rlike(CLOCK), F.get(parts, F.lit(0)).try_cast("double") * 3600 + F.get(parts, F.lit(1)).try_cast("double") * 60 + F.get(parts, F.lit(2)).try_cast("double"))
    value = F.coalesce(clock, number(text))
    return F.when(value >= 0, value)


def judge_samples(parsed: DataFrame) -> DataFrame:
    """Adds ``reason`` to parse_records' rows: structure first, then ``timestamp``, then ``accuracy_h``; NULL where valid.

    A file whose header has no such field isn't judged by it. ``t`` and ``acc_h`` are the values read.
    """
    stamp, acc = F.col("f_timestamp"), F.col("f_accuracy_h")
    with_values = parsed.withColumn("t", clock_seconds(stamp)).withColumn("acc_h", number(acc))
    blank = F.trim(acc) == ""
    bad_stamp = stamp.isNotNull() & F.col("t").isNull()
    bad_acc = acc.isNotNull() & ~blank & ~F.coalesce((F.col("acc_h") > 0) & (F.col("acc_h") < 1000), F.lit(False))
    return with_values.withColumn("reason", F.when(F.col("structure").isNotNull(), F.col("structure")).when(bad_stamp, "timestamp").when(bad_acc, "accuracy_h"))
