"""Tables from files: delimited text, SQL dumps, Parquet and JSON.

Text columns are read as text and typed by facts about all rows (``lattice``). The encoding is
judged by all lines (``charset``). Files are split among tasks whatever their size: by Spark's
own CSV source if they are UTF-8 and no record holds a line break, else by ``splits``.
"""

from __future__ import annotations

import codecs
import csv
import io
import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.errors import ParseError
from veilframe.sources.charset import encoding_of
from veilframe.sources.lattice import typed
from veilframe.sources.splits import Delimited, lines_of, records, starts
from veilframe.sources.sqldump import read_sql

#: What stands for null, separators in the order they are tried.
NULLS = ("", "NA", "N/A", "null", "NULL")
SEPARATORS = ("\t", "|", ";", ",")
EXTENSIONS = (".csv", ".txt", ".sql", ".parquet", ".json")
_PREFIX = 100_000
#: A header is no longer than this.
_LONGEST = 1 << 26


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def file_size(spark: SparkSession, path: str) -> int:
    fs, p = _file(spark, path)
    try:
        return fs.getContentSummary(p).getLength()
    except Exception:  # noqa: BLE001  Java's text may quote the path's store
        raise ParseError("the file cannot be read") from None


def prefix(spark: SparkSession, path: str, n: int = _PREFIX) -> bytes:
    """The first bytes of a file, from wherever Spark can read it."""
    fs, p = _file(spark, path)
    with_in = fs.open(p)
    try:
        return bytes(with_in.readNBytes(n))
    finally:
        with_in.close()


def file_encoding(spark: SparkSession, path: str) -> str:
    """A mark at the start of the file, or what all of its lines say."""
    head = prefix(spark, path, 4)
    if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return "utf-16-le" if head[:1] == b"\xff" else "utf-16-be"
    return encoding_of(lines_of(spark, path).select("value"))


def _line_end(spark: SparkSession, path: str, code: str) -> str:
    """What ends lines: \\r only where the file's start has no \\n."""
    text = codecs.getincrementaldecoder(code)("replace").decode(prefix(spark, path))
    return "\r" if "\r" in text and "\n" not in text else "\n"


def sniff_separator(text: str) -> str:
    """The separator that every one of the first lines has equally often, and most."""
    rows = [line for line in text.splitlines()[:50] if line.strip()][:10]
    best, most = None, 0
    for sep in SEPARATORS:
        counts = {line.count(sep) for line in rows}
        if len(counts) == 1 and (n := counts.pop()) > most:
            best, most = sep, n
    if best is None:
        raise ParseError("no separator fits all lines")
    return best


def _start(spark: SparkSession, path: str, code: str, enough) -> str:
    """The start of a file's text, longer and longer until ``enough`` says so or the file ends."""
    n = _PREFIX
    while True:
        raw = prefix(spark, path, n)
        text = codecs.getincrementaldecoder(code)("replace").decode(raw).lstrip("\ufeff")
        if len(raw) < n or enough(text):
            return text
        if n >= _LONGEST:
            raise ParseError("the header does not end")
        n *= 8


def _first_record(text: str, sep: str, end: str = "\n") -> str | None:
    """The first record that is not blank, if it is whole."""
    grammar, held, state = Delimited(sep), [], 0
    for line in text.split(end)[:-1]:
        held.append(line)
        state = grammar.line(state, line)[0]
        if state == 0:
            if (record := end.join(held)).strip():
                return record.removesuffix("\r")
            held = []
    return None


def read_delimited(spark: SparkSession, path: str, sep: str = ",", encoding: str | None = None) -> DataFrame:
    """A table with a header row. Short rows end in nulls, longer ones are an error."""
    if not prefix(spark, path).strip() and file_size(spark, path) <= _PREFIX:
        raise ParseError("the file is empty")
    code = encoding or file_encoding(spark, path)
    end = _line_end(spark, path, code)
    try:
        start = _start(spark, path, code, lambda text: _first_record(text, sep, end))
        names = _header(_first_record(start, sep, end) or start.strip("\r\n"), sep)
        extra = "_extra"
        while extra in names:
            extra += "_"
        fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))] + [T.StructField(extra, T.StringType())])
        options = {"sep": sep, "escape": '"', "maxColumns": "1000000", "maxCharsPerColumn": "-1"}
        grammar, lines = Delimited(sep), lines_of(spark, path, code, end)
        if code == "utf-8":
            lines = lines.where(F.contains("value", F.lit(b'"')))
        begins, within = starts(lines, grammar, code, end)
        if code == "utf-8" and not within:
            df = spark.read.options(**options).option("header", True).option("enforceSchema", True).schema(fields).csv(path)
        else:
            df = _from_records(records(spark, path, grammar, begins, code, end), fields, options)
        seen = df.agg(F.count(F.lit(1)).alias("n"), F.count(F.col(extra)).alias("long")).first()
    except (PySparkException, UnicodeDecodeError):
        raise ParseError("the file is not well formed") from None
    if not seen.n:
        raise ParseError("the file has no rows")
    if seen.long:
        raise ParseError(f"{seen.long} rows have more fields than the header")
    return typed(df.drop(extra).toDF(*names), NULLS)


def _from_records(found: DataFrame, fields: T.StructType, options: dict[str, str]) -> DataFrame:
    """The fields of each record but the first, which is the header; blank ones are left out."""
    place = F.struct("block", "phase", "seq")
    text = F.regexp_replace("text", r"\r?[\r\n]$", "")
    found = found.select(place.alias("place"), text.alias("text")).where(F.trim("text") != "")
    first = found.agg(F.min("place").alias("place")).first().place
    if first is None:
        raise ParseError("the file has no rows")
    header = F.struct(*[F.lit(v).cast(k).alias(c) for c, v, k in zip(("block", "phase", "seq"), first, ("long", "int", "long"), strict=True)])
    return found.where(F.col("place") > header).select(F.from_csv("text", fields.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r")).select("r.*")


def _header(text: str, sep: str) -> list[str]:
    csv.field_size_limit(1 << 30)
    row = next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])
    out: list[str] = []
    have: set[str] = set()
    for name in row:
        n = name
        while n in have:
            n += "_duplicated"
        out.append(n)
        have.add(n)
    return out


def read_text(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A table whose separator is found from its first lines."""
    if not prefix(spark, path).strip() and file_size(spark, path) <= _PREFIX:
        raise ParseError("the file is empty")
    code = encoding or file_encoding(spark, path)

    def whole(text: str) -> list[str]:
        lines = text.splitlines(keepends=True)
        return lines if not lines or lines[-1].endswith(("\n", "\r")) else lines[:-1]

    def enough(text: str) -> bool:
        lines = whole(text)
        return len(lines) >= 50 or sum(1 for x in lines if x.strip()) >= 10

    text = _start(spark, path, code, enough)
    return read_delimited(spark, path, sniff_separator("".join(whole(text)) if enough(text) else text), code)


def read_table(spark: SparkSession, path: str, max_bytes: int | None = None, encoding: str | None = None) -> DataFrame:
    """A table from a file, by its extension. ``encoding``: of a text file, where it is known."""
    kind = (re.search(r"\.[^./\\]+$", path.rstrip("/")) or [""])[0].lower()
    if kind not in EXTENSIONS:
        raise ParseError(f"files of these kinds can be read: {', '.join(EXTENSIONS)}")
    size = file_size(spark, path)
    if not size:
        raise ParseError("the file is empty")
    if max_bytes is not None and size > max_bytes:
        raise ParseError(f"the file is larger than {max_bytes} bytes")
    try:
        if kind == ".csv":
            return read_delimited(spark, path, encoding=encoding)
        if kind == ".txt":
            return read_text(spark, path, encoding)
        if kind == ".sql":
            return read_sql(spark, path, encoding or file_encoding(spark, path))
        return spark.read.parquet(path) if kind == ".parquet" else spark.read.json(path)
    except PySparkException:
        raise ParseError("the file is not well formed") from None
