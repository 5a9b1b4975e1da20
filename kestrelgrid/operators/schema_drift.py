"""Files whose fields are added, renamed, removed or retyped, into one table and a report of the changes.

Payloads are read as records of (path, value, written form). ``field_forms`` keeps, of each file, what it says of each
field, among it a profile of its values: how much of it is numbers, their middle and spread, how steadily they rise, how long
and how different its texts are, and where it stands in the record. ``schema_changes`` compares each file with the one before
it of the same producer and stream. Names of one quantity in the table of names are renames of each other; where a name is in
no table, a field that went and one that came are one field renamed if their profiles are each other's nearest and near.
``typed_records`` projects all files onto typed columns, with what could not be read.

A producer with a third of all files is not one task's work: files are numbered inside (producer, stream, hour), fields
carried forward inside runs of 1,024 files, and only an hour's count and a run's outcome, one row for each quantity, are
carried on. Payloads are read once, into a table in the shared folder.

Defined results
---------------
* Repeated rows of a file count once. Files with one ``written_at`` stand in the order of ``file_id``.
* NULL payloads, and lines that are no JSON object: no fields, no records. A CSV line shorter or longer than its header
  is read as far as both go. NULL producers or streams stand together as one.
* Two names of one quantity in a file: the first by name carries it, any other stands for itself.
* Empty tables: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import csv
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrelgrid.functions.field_names import QUANTITIES, quantities_of, unit_of
from kestrelgrid.sources.derived import written

_INTEGER = re.compile(r"[+-]?[0-9]+")
_PLAIN = re.compile(r"([+-]?[0-9]+)|([+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)|(true|false)")
FORMS = ("integer", "decimal", "boolean", "string")
#: Values a profile needs, and the largest distance of two profiles of one field.
PROFILED, NEAR_PROFILE = 3, 0.5
#: Files whose fields are carried forward in one task.
RUN = 1024


class _Number(str):
    """A JSON number as it is written."""


def form_of(text: str) -> str | None:
    text = text.strip()
    if not text:
        return None
    found = _PLAIN.fullmatch(text)
    return FORMS[found.lastindex - 1] if found else "string"


def profile_of(texts: list[str], forms: list[str], place: float) -> list[float] | None:
    """What a field's values look like: share of numbers, logarithms of their size and of their spread, share of rises, logarithm of the length of texts, share of different ones, place in the record. NULL for under ``PROFILED`` values."""
    n = len(texts)
    if n < PROFILED:
        return None
    values = [float(text) for text, form in zip(texts, forms) if form in ("integer", "decimal")]
    share, size, spread, rises = len(values) / n, 0.0, 0.0, 0.0
    if values:
        rises = sum(b > a for a, b in zip(values, values[1:])) / max(1, len(values) - 1)
        values.sort()
        low, mid, high = (values[(len(values) - 1) * k // 4] for k in (1, 2, 3))
        size, spread = math.log10(min(abs(mid) + high - low, 1e300) + 1e-9), math.log10(min(high - low, 1e300) + 1e-9)
    return [share, size, spread, rises, math.log10(1 + sum(map(len, texts)) / n), len(set(texts)) / n, place]


def profile_distance(a: Column, b: Column) -> Column:
    """Weighted sum of the differences of two profiles; sizes and spreads count by the power of ten, three at most, so that fields of two units are further apart than two flights."""
    weights = (1.0, 0.25, 0.15, 0.5, 0.5, 0.5, 0.2)
    gaps = [F.least(F.abs(F.get(a, F.lit(k)) - F.get(b, F.lit(k))), F.lit(3.0)) * w for k, w in enumerate(weights)]
    # how numbers are written says little of what they are
    words = 1 - F.least(F.get(a, F.lit(0)), F.get(b, F.lit(0)))
    return sum((gaps[k] * words if k in (4, 5) else gaps[k] for k in range(len(weights))), F.lit(0.0))


def _flat(value: object, path: str) -> Iterator[tuple[str, str, str | None]]:
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from _flat(inner, f"{path}.{key}" if path else str(key))
    elif value is None:
        yield path, "", None
    elif isinstance(value, bool):
        yield path, "true" if value else "false", "boolean"
    elif isinstance(value, _Number):
        yield path, str(value), "integer" if _INTEGER.fullmatch(value) else "decimal"
    elif isinstance(value, str):
        yield path, value, "string" if value.strip() else None
    else:
        yield path, json.dumps(value), "string"


def read_payload(payload: str | None, layout: str | None) -> Iterator[list[tuple[str, str, str | None]]]:
    """Records as lists of (path, text, form); a CSV header comes first, as a record without forms."""
    if not payload:
        return
    if layout == "csv":
        lines = [line.removesuffix("\r") for line in payload.split("\n")]
        delimiter = max(",;|\t", key=lines[0].count)
        csv.field_size_limit(1 << 30)
        rows = csv.reader(lines, delimiter=delimiter)
        header = next(rows)
        yield [(name, "", None) for name in header]
        for row in rows:
            if row:
                yield [(name, text, form_of(text)) for name, text in zip(header, row)]
        return
    for line in payload.split("\n"):
        try:
            value = json.loads(line, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict):
            yield list(_flat(value, ""))


def read_fields(files: DataFrame) -> DataFrame:
    """(file_id, producer, log_stream, written_at, path, quantity, profile, integer, decimal, boolean, string) of each field of each delivered file: how many values have each form."""
    kept = files.select("file_id", "producer", "log_stream", "written_at", "layout", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, paths, quantities, profiles, counts = [], [], [], [], {form: [] for form in FORMS}
            for i, (payload, layout) in enumerate(zip(batch.column("payload").to_pylist(), batch.column("layout").to_pylist())):
                seen: dict[str, dict] = {}
                texts: dict[str, tuple[list[str], list[str]]] = {}
                for record in read_payload(payload, layout):
                    for path, text, form in record:
                        own = seen.setdefault(path, dict.fromkeys(FORMS, 0))
                        if form:
                            own[form] += 1
                            held = texts.setdefault(path, ([], []))
                            held[0].append(text)
                            held[1].append(form)
                place = {path: k / len(seen) for k, path in enumerate(seen)}
                names = sorted(seen)
                profiles += [profile_of(*texts.get(name, ([], [])), place[name]) for name in names]
                index += [i] * len(names)
                paths += names
                quantities += quantities_of(names)
                for form in FORMS:
                    counts[form] += [seen[name][form] for name in names]
            rows = batch.select(["file_id", "producer", "log_stream", "written_at"]).take(pa.array(index, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(paths, pa.string()), pa.array(quantities, pa.string()), pa.array(profiles, pa.list_(pa.float64())), *(pa.array(counts[f], pa.int64()) for f in FORMS)], [*rows.schema.names, "path", "quantity", "profile", *FORMS])

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("file_id", "producer", "log_stream", "written_at"))
    return kept.mapInArrow(read, f"{schema}, path string, quantity string, profile array<double>, " + ", ".join(f"{f} bigint" for f in FORMS))


def field_forms(files: DataFrame) -> DataFrame:
    """(file_id, producer, log_stream, written_at, path, quantity, profile, form, n_values) of each field of each file.

    ``form`` is that of all values, decimal for integers and decimals together, string for any other mixture, and NULL
    where the field has no value.
    """
    return _merged_forms(read_fields(files), ["producer", "log_stream", "written_at", "quantity", "profile"]).select("file_id", "producer", "log_stream", "written_at", "path", "quantity", "profile", "form", "n_values")


def _merged_forms(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each file and path: second deliveries of a file say the same, so the largest count is the count."""
    n = {form: F.col(form) for form in FORMS}
    total = sum(n.values(), F.lit(0))
    form = (
        F.when(total == 0, F.lit(None))
        .when(n["integer"] == total, "integer")
        .when(n["boolean"] == total, "boolean")
        .when(n["integer"] + n["decimal"] == total, "decimal")
        .otherwise("string")
    )
    merged = rows.groupBy("file_id", "path").agg(*[F.first(k).alias(k) for k in keep], *[F.max(f).alias(f) for f in FORMS])
    return merged.select("file_id", "path", *keep, form.alias("form"), total.alias("n_values"))


def file_order(files: DataFrame) -> DataFrame:
    """(file_id, producer, log_stream, hour, place, n_files): place from 1 among the files of producer and stream."""
    whose = ["producer", "log_stream"]
    one = files.groupBy("file_id").agg(*[F.coalesce(F.first(k, ignorenulls=True), F.lit("")).alias(k) for k in whose], F.min("written_at").alias("written_at"))
    one = one.withColumn("hour", F.coalesce(F.date_format("written_at", "yyyy-MM-dd HH"), F.lit("")))
    placed = one.withColumn("rank", F.row_number().over(Window.partitionBy(*whose, "hour").orderBy(F.col("written_at").asc_nulls_first(), "file_id")))
    hours = placed.groupBy(*whose, "hour").agg(F.count("*").alias("n"))
    by_hour = Window.partitionBy(*whose).orderBy("hour")
    hours = hours.select(*whose, "hour", (F.sum("n").over(by_hour) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(*whose)).alias("n_files"))
    return placed.join(hours, [*whose, "hour"]).select("file_id", *whose, "hour", (F.col("before") + F.col("rank")).alias("place"), "n_files")


def schema_changes(files: DataFrame) -> DataFrame:
    """(file_id, change_kind, old_field, new_field) of each file against the one before it of its producer and stream."""
    order = file_order(files.select("file_id", "producer", "log_stream", "written_at"))
    read = written(read_fields(files).drop("producer", "log_stream", "written_at"))
    # one exchange by file serves the count and the join
    fields = _merged_forms(read.drop("profile").repartition("file_id"), ["quantity"]).drop("n_values").join(order.drop("hour"), "file_id").withColumn("run", F.floor(F.col("place") / RUN))
    whose = ["producer", "log_stream", "quantity"]
    in_run = Window.partitionBy(*whose, "run").orderBy("place")
    earlier = in_run.rowsBetween(Window.unboundedPreceding, -1)
    near = fields.select(
        "file_id", *whose, "run", "place", "n_files", "path", "form",
        F.lag(F.struct("place", "path")).over(in_run).alias("prev"),
        F.lead("place").over(in_run).alias("next_place"),
        F.last("form", ignorenulls=True).over(earlier).alias("prev_form"),
    )
    runs = fields.groupBy(*whose, "run").agg(
        F.max(F.struct("place", "path")).alias("last"), F.min("place").alias("first_place"), F.max(F.when(F.col("form").isNotNull(), F.struct("place", "form"))).getField("form").alias("last_form")
    )
    over = Window.partitionBy(*whose).orderBy("run")
    runs = runs.select(
        *whose, "run",
        F.lag("last").over(over).alias("run_prev"),
        F.lead("first_place").over(over).alias("run_next"),
        F.last("last_form", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("run_form"),
    )
    rows = near.join(runs, [*whose, "run"]).select(
        "file_id", "producer", "log_stream", "quantity", "place", "n_files", "path", "form",
        F.coalesce("prev", "run_prev").alias("prev"), F.coalesce("next_place", "run_next").alias("next_place"), F.coalesce("prev_form", "run_form").alias("prev_form"),
    )
    old = F.col("prev.path")
    stayed = F.coalesce(F.col("prev.place") == F.col("place") - 1, F.lit(False))
    kinds = [
        F.when((F.col("place") > 1) & ~stayed, _change("added", F.lit(""), F.col("path"))),
        F.when(stayed & (old != F.col("path")), _change("renamed", old, F.col("path"))),
        F.when(stayed & (F.col("form") != F.col("prev_form")), _change("retyped", old, F.col("path"))),
    ]
    named = F.col("quantity").isin(*QUANTITIES)
    rows = rows.withColumn("own", F.struct("path", named.alias("named"), F.col("file_id").alias("file"), F.coalesce("form", "prev_form").alias("form")))
    here = rows.select("file_id", F.explode(F.filter(F.array(*kinds), lambda c: c.isNotNull())).alias("c"), "own").select("file_id", "c.*", "own")
    gone = rows.where((F.col("place") < F.col("n_files")) & (F.coalesce("next_place", F.lit(-1)) != F.col("place") + 1))
    gone = gone.select("producer", "log_stream", (F.col("place") + 1).alias("place"), F.lit("removed").alias("change_kind"), F.col("path").alias("old_field"), F.lit("").alias("new_field"), "own")
    gone = gone.join(order.select("producer", "log_stream", "place", "file_id"), ["producer", "log_stream", "place"])
    changes = written(here.unionByName(gone.select("file_id", "change_kind", "old_field", "new_field", "own")))
    again = _renamed_by_profile(changes, read)
    plain = ["file_id", "change_kind", "old_field", "new_field"]
    taken = again.select("file_id", F.lit("added").alias("change_kind"), F.lit("").alias("old_field"), "new_field").unionByName(again.select("file_id", F.lit("removed").alias("change_kind"), "old_field", F.lit("").alias("new_field")))
    kinds = F.array(F.lit("renamed"), F.when(F.col("old_form") != F.col("new_form"), "retyped"))
    more = again.withColumn("change_kind", F.explode(F.array_compact(kinds)))
    return changes.select(*plain).join(taken, plain, "left_anti").unionByName(more.select(*plain))


def _renamed_by_profile(changes: DataFrame, read: DataFrame) -> DataFrame:
    """(file_id, old_field, new_field, old_form, new_form) of the fields that went and came in one file and are each other's nearest by profile, one of them at least in no table of names.

    A file's fields, not its rows, meet.
    """
    pairs = None
    for kind in ("removed", "added"):
        side = changes.where(F.col("change_kind") == kind).select("file_id", F.col("own").alias(kind))
        pairs = side if pairs is None else pairs.join(side, "file_id").where(~(F.col("removed.named") & F.col("added.named")))
    for kind in ("removed", "added"):
        profile = read.where("profile IS NOT NULL").select(F.col("file_id").alias("file"), "path", F.col("profile").alias(f"{kind}_profile"))
        pairs = pairs.join(profile, (F.col(f"{kind}.file") == profile["file"]) & (F.col(f"{kind}.path") == profile["path"])).drop("file", "path").dropDuplicates(["file_id", "removed", "added"])
    pairs = pairs.withColumn("far", profile_distance(F.col("removed_profile"), F.col("added_profile"))).where(F.col("far") <= NEAR_PROFILE)
    first = lambda own, other: F.row_number().over(Window.partitionBy("file_id", f"{own}.path").orderBy("far", f"{other}.path"))
    best = pairs.withColumns({"a": first("removed", "added"), "b": first("added", "removed")}).where("a = 1 AND b = 1")
    return best.select("file_id", F.col("removed.path").alias("old_field"), F.col("added.path").alias("new_field"), F.col("removed.form").alias("old_form"), F.col("added.form").alias("new_form"))


def _change(kind: str, old: Column, new: Column) -> Column:
    return F.struct(F.lit(kind).alias("change_kind"), old.alias("old_field"), new.alias("new_field"))


def typed_records(files: DataFrame, columns: dict[str, str], candidates: Callable[[list[str]], dict[str, list[str]]] | None = None) -> DataFrame:
    """(file_id, producer, flight_id, rec_no, a column for each quantity, failed array of (quantity, field, value)).

    columns: quantity -> kind, one of seconds, degrees, metres, count, flag, text. ``failed`` holds what has a value that
    is not of that kind; the column is NULL there. candidates: of a file's names, those of each quantity in their order; a
    record takes the first that isn't blank in it. Without it the first name of a quantity carries it.
    """
    kept = files.select("file_id", "producer", "flight_id", "layout", "payload")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, number, maps = [], [], []
            for i, (payload, layout) in enumerate(zip(batch.column("payload").to_pylist(), batch.column("layout").to_pylist())):
                records = [{path: text for path, text, _ in record} for record in read_payload(payload, layout)]
                names = sorted({path for record in records for path in record})
                if candidates is not None:
                    asked = {q: paths for q, paths in candidates(names).items() if q in columns}
                else:
                    asked = {q: [path] for path, q in zip(names, quantities_of(names)) if q in columns}
                for k, record in enumerate(records[layout == "csv" :]):
                    index.append(i)
                    number.append(k + 1)
                    first = ((q, next((p for p in paths if record.get(p, "").strip()), None)) for q, paths in asked.items())
                    maps.append([(q, {"field": path, "unit": unit_of(path), "text": record[path].strip()}) for q, path in first if path is not None])
            rows = batch.select(["file_id", "producer", "flight_id"]).take(pa.array(index, pa.int64()))
            cell = pa.struct([("field", pa.string()), ("unit", pa.string()), ("text", pa.string())])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(number, pa.int32()), pa.array(maps, pa.map_(pa.string(), cell))], [*rows.schema.names, "rec_no", "cells"])

    kinds = dict(kept.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in ("file_id", "producer", "flight_id"))
    rows = kept.mapInArrow(read, f"{schema}, rec_no int, cells map<string,struct<field:string,unit:string,text:string>>")
    cell = {q: F.try_element_at("cells", F.lit(q)) for q in columns}
    values = rows.select("file_id", "producer", "flight_id", "rec_no", *[_typed(cell[q], kind).alias(q) for q, kind in columns.items()], "cells")
    lost = [F.when(cell[q].isNotNull() & F.col(q).isNull(), F.struct(F.lit(q).alias("quantity"), cell[q].getField("field").alias("field"), cell[q].getField("text").alias("value"))) for q in columns]
    failed = F.filter(F.array(*lost), lambda c: c.isNotNull()).alias("failed")
    return values.select("file_id", "producer", "flight_id", "rec_no", *columns, failed).dropDuplicates(["file_id", "rec_no"])


_LENGTH = {"ft": 0.3048, "feet": 0.3048, "foot": 0.3048, "mm": 0.001, "cm": 0.01, "m": 1.0, "": 1.0}
_TIME = {"ms": 0.001, "millisecond": 0.001, "milliseconds": 0.001, "s": 1.0, "sec": 1.0, "": 1.0}


def _typed(cell: Column, kind: str) -> Column:
    """A cell as its kind: units in the cell come before those in the field's name."""
    text, unit = cell.getField("text"), cell.getField("unit")
    shape = r"^([+-]?[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?) *([A-Za-z]*)$"
    value = F.nullif(F.regexp_extract(text, shape, 1), F.lit("")).try_cast("double")
    tail = F.lower(F.regexp_extract(text, shape, 2))
    said = F.when(tail == "", unit).otherwise(tail)
    if kind == "text":
        return text
    if kind == "flag":
        low = F.lower(text)
        return F.when(low.isin("1", "true", "rec", "yes", "on"), True).when(low.isin("0", "false", "idle", "no", "off"), False)
    if kind == "count":
        return F.regexp_extract(text, r"^([0-9]+)(?:\.0*)?(?: of [0-9]+)?$", 1).try_cast("bigint")
    if kind == "degrees":
        sign = F.when(tail.isin("s", "w"), -1.0).when(tail.isin("n", "e", "", "deg"), 1.0)
        return value * sign
    if kind == "metres":
        return value * _factor(said, _LENGTH)
    if kind == "seconds":
        part = F.split(text, ":")
        clock = F.when(text.rlike(r"^[0-9]+:[0-5][0-9]:[0-5][0-9](\.[0-9]+)?$"), F.get(part, F.lit(0)).try_cast("double") * 3600 + F.get(part, F.lit(1)).try_cast("double") * 60 + F.get(part, F.lit(2)).try_cast("double"))
        return F.coalesce(clock, value * _factor(said, _TIME))
    raise ValueError(f"unknown kind {kind}")


def _factor(unit: Column, factors: dict[str, float]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in factors.items() for x in pair]), unit)
