"""INSERT statements of one table, as a table.

A scanner walks over tokens, so that comment marks inside strings are text. A dump is split
among tasks (``splits``): its lexer is a small automaton over lines, and behind a comma or
semicolon outside of strings, comments and brackets it is cut. Pieces that begin in the middle
of an INSERT get its table and columns from the last one before. Tasks return values with
the kind of literal they were; kinds and facts about the numbers decide the columns' types.
All else in a dump is passed over.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.errors import ParseError
from veilframe.kept import keep
from veilframe.sources.lattice import converted, facts, number_kind
from veilframe.sources.splits import Step, lines_of, records, starts

Header = tuple[str, list[str] | None]  # table and columns

_SPACE = re.compile(r"(?:\s+|--[^\n]*|/\*.*?\*/)+", re.S)
_NAME = re.compile(r'(?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d][\w$]*)(?:\s*\.\s*(?:"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d][\w$]*))*')
_PART = re.compile(r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^,"`\[]+')
_INSERT = re.compile(r"INSERT\s+INTO\s+", re.I)
_WORD = re.compile(r"[^\s,();]+")
_INTEGER = re.compile(r"[+-]?\d+$")
_FLOAT = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
_HEX = re.compile(r"0[xX][0-9A-Fa-f]{1,16}$")
#: Escapes of a string literal.
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"', "0": "\0"}


def _skip(s: str, at: int) -> int:
    m = _SPACE.match(s, at)
    return m.end() if m else at


_QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\]++|\\.|{q}{q})*+){q}", re.S) for q in "'\""}
_ESCAPED = re.compile(r"""\\(x[0-9A-Fa-f]{2}|.)|''|\"\"""", re.S)


def _unescaped(m: re.Match) -> str:
    x = m[1]
    if x is None:
        return m[0][0]
    return chr(int(x[1:], 16)) if len(x) == 3 else _ESCAPES.get(x, "\\" + x)


def string_literal(s: str, at: int) -> tuple[str, int]:
    """The string that begins at a quote, and where it ends."""
    quote = s[at]
    m = _QUOTED[quote].match(s, at)
    if not m:
        raise ParseError("a string is not closed")
    inner = m[1]
    if "\\" in inner or quote in inner:
        other = "\"\"" if quote == "'" else "''"
        inner = _ESCAPED.sub(lambda x: x[0] if x[0] == other else _unescaped(x), inner)
    return inner, m.end()


def literal(s: str, at: int) -> tuple[str | None, str, int]:
    """(value as text, kind of literal, where it ends)."""
    if s[at] in "'\"":
        text, at = string_literal(s, at)
        return text, "string", at
    if s[at] == "(":
        raise ParseError("expressions are not supported")
    m = _WORD.match(s, at)
    word = m[0] if m else ""
    end = at + len(word)
    if _skip(s, end) < len(s) and s[_skip(s, end)] == "(":
        raise ParseError("expressions are not supported")
    up = word.upper()
    if up == "NULL":
        return None, "null", end
    if up in ("TRUE", "FALSE"):
        return up.lower(), "boolean", end
    if _HEX.match(word):
        return str(int(word, 16)), "integer", end
    if _INTEGER.match(word):
        return word, "integer", end
    if _FLOAT.match(word):
        return word, "float", end
    if up == "DEFAULT" or up.startswith("CURRENT_"):
        raise ParseError("DEFAULT and CURRENT values are not supported")
    raise ParseError("a value is no literal")


def column_list(spec: str) -> list[str]:
    """Names between commas, with their quotes or brackets taken off."""
    out, at = [], 0
    while at < len(spec):
        at = _skip(spec, at)
        m = _PART.match(spec, at)
        if not m:
            raise ParseError("a column name is not closed")
        name, at = m[0].strip(), _skip(spec, m.end())
        if name[0] in '"`' and len(name) > 1:
            name = name[1:-1].replace(name[0] * 2, name[0])
        elif name[0] == "[":
            name = name[1:-1]
        out.append(name)
        if at < len(spec):
            if spec[at] != ",":
                raise ParseError("column names are not separated by commas")
            at += 1
    return out


def _closing(s: str, at: int) -> int:
    """Where the parenthesis that opens at ``at`` closes, past quoted names."""
    k = at + 1
    while k < len(s):
        if s[k] == ")":
            return k
        if s[k] in '"`[':
            m = _PART.match(s, k)
            k = m.end() if m and m.end() > k + 1 else len(s)
        else:
            k += 1
    raise ParseError("a column list is not closed")


def _header(s: str, at: int) -> tuple[Header | None, int]:
    """What an INSERT that ends its first words at ``at`` fills, and where its rows begin; None if it has no VALUES."""
    name = _NAME.match(s, _skip(s, at))
    if not name:
        raise ParseError("an INSERT names no table")
    table, at = name[0], _skip(s, name.end())
    columns = None
    if s.startswith("(", at):
        end = _closing(s, at)
        columns, at = column_list(s[at + 1 : end]), _skip(s, end + 1)
    if s[at : at + 6].upper() != "VALUES":
        return None, at
    return (table, columns), at + 6


def statements(s: str, header: Header | None = None) -> Iterator[tuple[str, list[str] | None, list[str | None], list[str]]]:
    """(table, columns, values, kinds) of each row of each INSERT; with a header, the text begins among its rows."""
    at = 0
    while at < len(s):
        if header is None:
            at = _skip(s, at)
            if at >= len(s):
                return
            m = _INSERT.match(s, at)
            if not m:
                at = string_literal(s, at)[1] if s[at] in "'\"" else (w.end() if (w := _NAME.match(s, at)) else at + 1)
                continue
            header, at = _header(s, m.end())
            if header is None:
                continue
        table, columns = header
        header = None
        while True:
            at = _skip(s, at)
            while s.startswith(",", at):
                at = _skip(s, at + 1)
            if not s.startswith("(", at):
                break
            values, kinds, at = [], [], at + 1
            while True:
                at = _skip(s, at)
                if at >= len(s):
                    raise ParseError("a row is not closed")
                if s[at] == ")":
                    at += 1
                    break
                if s[at] == ",":
                    at += 1
                    continue
                value, kind, at = literal(s, at)
                values.append(value)
                kinds.append(kind)
            if columns is not None and len(values) != len(columns):
                raise ParseError("a row has not as many values as there are columns")
            yield table, columns, values, kinds


#: The lexer's states between pieces of text: plain, two kinds of string, two kinds of quoted name, two kinds of comment.
_PLAIN, _BLOCK, _LINE = 0, 5, 6
_ENDS = (None, re.compile(r"(?:[^'\\]++|\\.|'')*+'", re.S), re.compile(r'(?:[^"\\]++|\\.|"")*+"', re.S), re.compile(r"(?:[^`]++|``)*+`"), re.compile(r"[^\]]*+\]"), re.compile(r".*?\*/", re.S), re.compile(r"[^\n]*+\n"))
_OPENS = {"'": 1, '"': 2, "`": 3, "[": 4, "/*": _BLOCK, "--": _LINE}
_TOKEN = re.compile(r"""--|/\*|['"`\[(),;]|[^\s'"`\[(),;/-]++|[/-]""")


def _tokens(text: str, state: int) -> Iterator[tuple[int, str, int]]:
    """(state, token, place) of what is outside of strings and comments; the last one has an empty token."""
    at = 0
    while True:
        if state != _PLAIN:
            m = _ENDS[state].match(text, at)
            if not m:
                break
            at, state = m.end(), _PLAIN
            continue
        m = _TOKEN.search(text, at)
        if not m:
            break
        at = m.end()
        state = _OPENS.get(m[0], _PLAIN)
        if state not in (_BLOCK, _LINE):
            yield state, m[0], m.start()
    yield state, "", len(text)


#: What closes each state; without it a text ends in the state that it begins in.
_CLOSERS = (None, "'", '"', "`", "]", "*/", "\n")
#: Whole strings, quoted names and comments, of which a sign is left unless it is a comment.
_STRING, _QUOTE, _TICK, _BRACKET = r"(?:[^'\\]++|\\.|'')*+'", r'(?:[^"\\]++|\\.|"")*+"', r"(?:[^`]++|``)*+`", r"[^\]]*+\]"
_COMMENT = r"/\*.*?\*/|--[^\n]*+\n"
_CLOSED = re.compile(rf"""(')(?:{_STRING})|(")(?:{_QUOTE})|(`)(?:{_TICK})|(\[)(?:{_BRACKET})|{_COMMENT}""", re.S)
_OUTSIDE = re.compile(rf"""(?:[^'"`\[/-]++|'(?:{_STRING})|"(?:{_QUOTE})|`(?:{_TICK})|\[(?:{_BRACKET})|{_COMMENT}|/(?!\*)|-(?!-))*+""", re.S)


def _outside(text: str, at: int = 0) -> tuple[str, int]:
    """What is outside of strings and comments from a plain place on, a quote for each string, and the state at the end."""
    end = _OUTSIDE.match(text, at).end()
    state = _PLAIN if end == len(text) else _OPENS.get(text[end]) or _OPENS[text[end : end + 2]]
    return _CLOSED.sub(r"\1\2\3\4", text[at:end]), state


class Dump:
    """Records of a dump: what stands up to a comma or semicolon at a line's end, outside of brackets."""

    states = 7

    def line(self, state: int, text: str) -> Step:
        at = 0
        if state != _PLAIN:
            m = _ENDS[state].match(text) if _CLOSERS[state] in text else None
            if not m:
                return state, False, 0, False
            at = m.end()
        plain, state = _outside(text, at)
        _, anew, rest = plain.rpartition(";")  # a statement ends, whatever was open
        return state, bool(anew), rest.count("(") - rest.count(")"), state == _PLAIN and plain.rstrip().endswith((",", ";"))


def last_header(text: str) -> Header | str | None:
    """The INSERT whose rows a text of whole records ends in; an empty string if no statement is open, None if the text does not say."""
    if ";" not in text and not _INSERT.search(text):
        return None
    plain, state = _outside(text)
    if state == _PLAIN and ";" not in plain and not _INSERT.search(plain):
        return None
    found: Header | str | None = None
    depth = 0
    for _, token, at in _tokens(text, _PLAIN):
        if token in ("(", ")"):
            depth += 1 if token == "(" else -1
        elif token == ";":
            found, depth = "", 0
        elif depth == 0 and token[:6].upper() == "INSERT" and (m := _INSERT.match(text, at)):
            try:
                found = _header(text, m.end())[0] or ""
            except ParseError:  # told when the piece is parsed
                found = ""
    return found


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with what they leave open, as JSON."""
    for b in batches:
        each = [last_header(text) for text in b.column("text").to_pylist()]
        yield b.append_column("leaves", pa.array([None if x is None else json.dumps(x) for x in each], pa.string()))


def _parse(sent):
    """Values of pieces; the broadcast has, in order, the places at which another INSERT is open, and which one."""
    texts, words = pa.list_(pa.string()), pa.list_(pa.string())
    names = ["table", "columns", "values", "kinds", "error"]

    def batch(rows: list) -> pa.RecordBatch:
        t, c, v, k = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(c, texts), pa.array(v, texts), pa.array(k, words), pa.nulls(len(rows), pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, open_ = sent.value
        for b in batches:
            for place, text in zip(zip(*[b.column(c).to_pylist() for c in ("block", "phase", "seq")], strict=True), b.column("text").to_pylist(), strict=True):
                k = bisect_left(places, place) - 1
                header = json.loads(open_[k]) if k >= 0 else ""
                rows: list = []
                try:
                    for table, columns, values, kinds in statements(text, tuple(header) if header else None):
                        rows.append((table, columns or [f"col_{i}" for i in range(len(values))], values, kinds))
                        if len(rows) == 4096:
                            yield batch(rows)
                            rows = []
                except ParseError as e:
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, texts), pa.nulls(1, texts), pa.nulls(1, words), pa.array([str(e)])], names)
                if rows:
                    yield batch(rows)

    return run


#: Characters of a piece that is parsed at once, and bytes of a line beyond which pieces end at commas.
_PIECE, _LONG = 1 << 20, 1 << 24


def _cut_at(spark: SparkSession, path: str, code: str) -> str:
    """What lines end in: a line break, or a comma where lines are very long."""
    if code.startswith("utf-16"):
        return "\n"
    try:
        longest = lines_of(spark, path, code).agg(F.max(F.octet_length("value"))).first()[0]
    except PySparkException:  # a line that no task can hold
        return ","
    return "," if (longest or 0) > _LONG else "\n"


def pieces(spark: SparkSession, path: str, code: str, end: str, size: int = _PIECE) -> tuple[DataFrame, tuple[list, list]]:
    """Pieces of whole records, and where in their order which INSERT begins to be open."""
    begins, _ = starts(lines_of(spark, path, code, end), Dump(), code, end)
    found = records(spark, path, Dump(), begins, code, end, size)
    told = found.mapInArrow(_effects, "block long, phase int, seq long, text string, leaves string").where("leaves is not null").select("block", "phase", "seq", "leaves")
    # Of pieces in a row that leave the same open, the first is enough: one row for each change, and for each block.
    before = F.lag("leaves").over(Window.partitionBy("block").orderBy("phase", "seq"))
    rows = sorted((tuple(r)[:3], r.leaves) for r in told.withColumn("before", before).where(~F.col("leaves").eqNullSafe(F.col("before"))).collect())
    kept = [x for k, x in enumerate(rows) if not k or rows[k - 1][1] != x[1]]
    return found, ([p for p, _ in kept], [x for _, x in kept])


def read_sql(spark: SparkSession, path: str, code: str = "utf-8") -> DataFrame:
    """The one table that a dump fills; two tables or two column lists are an error."""
    found, open_ = pieces(spark, path, code, _cut_at(spark, path, code))
    sent = spark.sparkContext.broadcast(open_)
    rows = keep(found.mapInArrow(_parse(sent), "table string, columns array<string>, values array<string>, kinds array<string>, error string"), "dump")
    wrong = rows.where("error is not null").select("error").first()
    if wrong:
        raise ParseError(wrong.error)
    tables = rows.groupBy("table", "columns").agg(F.count(F.lit(1)).alias("n")).limit(2).collect()
    if not tables:
        raise ParseError("there is no INSERT with rows")
    if len(tables) > 1:
        raise ParseError("more than one table, or column lists that differ")
    names = tables[0].columns
    seen = rows.agg(*[F.collect_set(F.element_at("kinds", i + 1)).alias(f"k{i}") for i in range(len(names))]).first()
    kinds = [set(seen[i]) - {"null"} for i in range(len(names))]
    for i, k in enumerate(kinds):
        if len(k) > 1 and k != {"integer", "float"} and "string" not in k:
            raise ParseError(f"the values of column {i + 1} are of different kinds")
    columns = [F.element_at("values", i + 1) for i in range(len(names))]
    numbers = [i for i, k in enumerate(kinds) if k and k <= {"integer", "float"}]
    types = dict(zip(numbers, map(number_kind, facts(rows, [columns[i] for i in numbers])), strict=True))
    return rows.select(*[converted(columns[i], types.get(i, "boolean" if kinds[i] == {"boolean"} else "string"), name) for i, name in enumerate(names)])
