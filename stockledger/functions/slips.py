"""Packing-slip answers (text of the external reading service) -> validated lines.

H7 parse_slip_responses, H8 slip_lines, B17 valid_slip_lines, D12 slip_totals, A7 load_slip_files.
An answer is read by ``read_slip``, a batch of them at a time in the tasks; all else
is built-in expressions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stockledger.sources import files

# fixed allowed confidence values and their default
CONFIDENCE_VALUES = ("high", "medium", "low")
DEFAULT_CONFIDENCE = "medium"
# fixed: white space the submission form strips from item ids
FORM_SPACE = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
HEADER = ("vendor", "po_number", "ship_date", "notes")
LINES = "array<struct<item_id:string,qty:int,description:string,confidence:string>>"


def _unfenced(text: str) -> str:
    """Text after the first ```json up to the next ```, else after the first ```, else all of it."""
    for fence in ("```json", "```"):
        if fence in text:
            return text.split(fence, 1)[1].split("```", 1)[0].strip()
    return text.strip()


def _object(pairs: list[tuple]) -> dict:
    """An object's fields; no name may come twice."""
    found = dict(pairs)
    if len(found) != len(pairs):
        raise ValueError("repeated name")
    return found


class _Fraction(str):
    """The text of a number that has a fraction or an exponent."""


def _number(kind):
    def read(digits: str):
        if len(digits) > 1000:
            raise ValueError("number of over 1,000 digits")
        return kind(digits)
    return read


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


_DECODER = json.JSONDecoder(object_pairs_hook=_object, parse_int=_number(int), parse_float=_number(_Fraction), parse_constant=_no_constant)
_WHOLE = re.compile(r"[ \t\n\x0b\f\r]*([+-]?[0-9]+(?:_[0-9]+)*)(?:(?:\.0*) *|[ \t\n\x0b\f\r]*)")


def _is_text(v) -> bool:
    return isinstance(v, str) and not isinstance(v, _Fraction)


def _whole(v) -> int | None:
    """A whole number given as number, numeric text or truth value; None otherwise or beyond int."""
    if isinstance(v, _Fraction):
        if "e" in v or "E" in v or len(v) > 38:      # a double: written with an exponent from 10 million on
            v = float(v)
            v = int(v) if abs(v) < 1e7 and v.is_integer() else None
        else:
            v = str(v)
    if isinstance(v, str):
        m = _WHOLE.fullmatch(v)
        v = int(m[1].replace("_", "")) if m and len(v) < 4000 else None
    return int(v) if isinstance(v, int) and -(1 << 31) <= v < 1 << 31 else None


def _line(x) -> tuple | None:
    """(item_id, qty, description, confidence) of a line, None if it is no valid one."""
    if not isinstance(x, dict):
        return None
    item, qty, about, sure = x.get("item_id"), _whole(x.get("qty")), x.get("description"), x.get("confidence", DEFAULT_CONFIDENCE)
    if not _is_text(item) or qty is None or qty < 1 or not (about is None or _is_text(about)) or not _is_text(sure) or sure not in CONFIDENCE_VALUES:
        return None
    return item, qty, about, sure


def read_slip(text: str | None) -> tuple[list[tuple], list[str | None]]:
    """(lines, header) of one answer; an answer of any other shape has no lines and a note of why."""
    failed = lambda why: ([], [None, None, None, f"Failed to parse response: {why}"])
    body = _unfenced(text or "")
    try:
        slip = _DECODER.decode(body) if body.startswith("{") else None
    except (ValueError, RecursionError):
        slip = None
    if slip is None:
        return failed("not valid JSON")
    items = slip.get("items", [])
    lines = [_line(x) for x in items] if isinstance(items, list) else [None]
    if None in lines:
        return failed("invalid line item")
    header = [slip.get(c) for c in HEADER]
    if not all(v is None or _is_text(v) for v in header):
        return failed("invalid header")
    return lines, header


def _texts(values: list) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:      # an escaped half of a surrogate pair
        return pa.array([v and v.encode("utf-8", "replace").decode() for v in values], pa.string())


def parse_slip_responses(df: DataFrame, text_col: str = "response") -> DataFrame:
    """H7: add ``slip`` (header + validated items).

    The answer must be one JSON object, with nothing after it.  ``items`` may be
    absent, else it is an array of objects: item_id a text, qty a whole number
    >= 1 (numeric text accepted), description a text or null, confidence one of
    three texts (absent -> medium).  The header fields are texts or null.  Any
    other shape empties the whole slip and records a note.
    """
    cols = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_col).cast(pa.binary()).to_pylist()
            slips = [read_slip(None if x is None else x.decode("utf-8", "replace")) for x in texts]
            ends = np.cumsum([0, *(len(lines) for lines, _ in slips)], dtype=np.int32)
            fields = list(zip(*(x for lines, _ in slips for x in lines))) or [()] * 4
            item, qty, about, sure = fields
            lines = pa.StructArray.from_arrays([_texts(item), pa.array(qty, pa.int32()), _texts(about), _texts(sure)],
                                               ["item_id", "qty", "description", "confidence"])
            header = [_texts([h[i] for _, h in slips]) for i in range(len(HEADER))]
            slip = pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), lines), *header], ["items", *HEADER])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), slip], [*cols, "slip"])

    kind = StructType.fromDDL(f"slip struct<items:{LINES},{','.join(f'{c}:string' for c in HEADER)}>")
    return df.mapInArrow(run, StructType([*df.schema.fields, *kind.fields]))


def slip_lines(parsed: DataFrame, id_col: str = "slip_id") -> DataFrame:
    """H8: one row per line item, with the slip header."""
    return parsed.select(id_col, "slip.vendor", "slip.po_number", "slip.ship_date",
                         F.posexplode("slip.items").alias("line_no", "line")) \
        .select(id_col, "vendor", "po_number", "ship_date", "line_no", "line.*")


def valid_slip_lines(lines: DataFrame) -> DataFrame:
    """Lines kept at submission -- an item id that is not all white space, and qty > 0."""
    blank = F.coalesce(F.col("item_id"), F.lit("")).rlike(r"\A" + FORM_SPACE + r"*\z")
    return lines.filter(~blank & (F.coalesce(F.col("qty"), F.lit(0)) > 0))


def slip_totals(lines: DataFrame, id_col: str = "slip_id") -> DataFrame:
    """Lines and units per slip."""
    return lines.groupBy(id_col).agg(F.count(F.lit(1)).alias("lines"), F.sum("qty").alias("units"))


# fixed media types by file extension; every other image is taken as JPEG
MEDIA_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "webp": "image/webp", "gif": "image/gif",
               "pdf": "application/pdf"}
IMAGE_EXTENSIONS = ("bmp", "tif", "tiff", "heic", "heif", "avif", "jfif", "jpe", "ico", "svg")

# tasks of a read of slip files, for each core
TASKS_A_CORE = 8


def load_slip_files(spark, path: str, max_bytes: int = 20 * 1024 * 1024) -> tuple[DataFrame, DataFrame]:
    """(slip files with a media type, rejected files with a reason).

    Listing and reading are distributed (``sources.files``): the files are listed once, by
    tasks, and the content is only read for accepted files, so the driver holds folders
    and no files.  A store that pyarrow cannot open is read by Spark's ``binaryFile``,
    which lists on the driver; it packs at most 32 files into a partition, so partitions
    are merged to a fixed number a core.  A file that is too large or no slip is a reject
    (files of no bytes are not listed).
    """
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    if store := files.opened(spark, path):
        df = files.listed(spark, store, tasks)
    else:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract(F.col("path"), r"\.([A-Za-z0-9]+)\z", 1))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext)
    media = F.coalesce(known, F.when(ext.isin(*IMAGE_EXTENSIONS), F.lit("image/jpeg")))
    reason = F.when(media.isNull(), F.lit("not_an_image_or_pdf")).when(F.col("length") > max_bytes, F.lit("too_large"))
    ok = df.filter(reason.isNull()).withColumn("media_type", media)
    if store:
        ok = files.with_content(ok, store, tasks)
    return (ok.select("path", "length", "modificationTime", "media_type", "content").coalesce(tasks),
            df.filter(reason.isNotNull()).select("path", "length", "modificationTime", reason.alias("reason")).coalesce(tasks))
