"""Loading lines of which some don't parse: blocks on a columnar path, bisection down to the bad records."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.sources import ntriples as nt

#: Lines of a block. About one line in 25 may fail before most blocks have to be halved.
BLOCK = 32

_SPACE = re.compile(nt.SPACE)
_IRI, _BLANK, _LITERAL = (re.compile(x) for x in (nt.IRI, nt.BLANK, nt.LITERAL))
_XSD_END = r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>\z"
_BAD_ESCAPE = re.compile(r"\\(?:u(?![0-9A-Fa-f]{4})|U(?![0-9A-Fa-f]{8}))")
_BAD_STRING_ESCAPE = re.compile(r"\\(?![tbnrf\"'\\uU])")
_FORBIDDEN = re.compile(r"[\x00-\x20<\"{}|^]")


def _why_iri(line: str, at: int, what: str) -> str:
    if at >= len(line):
        return f"{what} missing"
    if line[at] != "<":
        return f"{what} is not an IRI" if what == "predicate" else f"{what} is no term"
    end = line.find(">", at)
    if end < 0:
        return f"{what}: IRI not closed"
    body = line[at + 1 : end]
    if _BAD_ESCAPE.search(body):
        return f"{what}: bad unicode escape in IRI"
    return f"{what}: forbidden character in IRI" if _FORBIDDEN.search(body) else f"{what}: malformed IRI"


def _why_literal(line: str, at: int) -> str:
    m = re.compile(r'"(?:[^"\\]|\\.)*"', re.S).match(line, at)
    if not m:
        return "object: quote not closed"
    if _BAD_ESCAPE.search(m[0]):
        return "object: bad unicode escape in literal"
    return "object: bad string escape" if _BAD_STRING_ESCAPE.search(m[0].replace("\\\\", "")) else "object: malformed literal"


def diagnose(line: str) -> str:
    """Why a data line is not a valid triple; the empty string if it is one."""
    at = _SPACE.match(line).end()
    terms = []
    for what, kinds in (("subject", (_IRI, _BLANK)), ("predicate", (_IRI,)), ("object", (_LITERAL, _IRI, _BLANK))):
        m = next((m for k in kinds if (m := k.match(line, at))), None)
        if m is None:
            if what == "object" and line[at : at + 1] == '"':
                return _why_literal(line, at)
            if what == "subject" and line[at : at + 1] == '"':
                return "subject is a literal"
            return _why_iri(line, at, what)
        terms.append((what, m[0]))
        at = _SPACE.match(line, m.end()).end()
    if line[at : at + 1] == ".":
        at = _SPACE.match(line, at + 1).end()
    if at < len(line):
        rest = line[at:]
        if terms[2][1].startswith('"') and rest[0] in "@^":
            return "object: malformed language tag or type"
        return "more than three terms" if rest[0] in '<_"' else "text after the triple"
    for what, t in terms:
        if len(t.removesuffix(nt.XSD_STRING).encode()) > nt.MAX_TERM_BYTES:
            return f"{what} is too long"
    return ""


def _block_texts(lines: pa.Array, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Each block as one text: its lines, each ended by NUL."""
    size = ends - starts
    at = np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    held = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), lines.take(pa.array(at)))
    return pc.binary_join_element_wise(pc.binary_join(held, "\0"), "", "\0")


def find_bad(lines: pa.Array, block: int = BLOCK) -> np.ndarray:
    """Positions of the lines that the fast path doesn't accept, ascending.

    The fast path takes blocks of lines and has one verdict for each: whether all of its lines are triples. All blocks are judged by one
    vectorised call, which finds no more than a match of the whole block; then both halves of all blocks that failed, and so on
    down to single lines. Lines that could hold too long a term, or hold a NUL, fail on it though they may be valid: the strict parser decides.
    """
    n = len(lines)
    odd = pc.or_(pc.greater(pc.binary_length(lines), nt.MAX_TERM_BYTES), pc.match_substring(lines, "\0")).to_numpy(zero_copy_only=False)
    starts = np.arange(0, n, block)
    ends = np.minimum(starts + block, n)
    bad = [np.flatnonzero(odd)]
    odd_before = np.r_[0, np.cumsum(odd)]
    while len(starts):
        # A block with such a line fails without being read.
        fails = odd_before[ends] > odd_before[starts]
        read = np.flatnonzero(~fails)
        if len(read):
            fails[read] = ~pc.match_substring_regex(_block_texts(lines, starts[read], ends[read]), nt.NUL_ENDED_LINES).to_numpy(zero_copy_only=False)
        starts, ends = starts[fails], ends[fails]
        single = ends - starts == 1
        bad.append(starts[single])
        starts, ends = starts[~single], ends[~single]
        half = (starts + ends) // 2
        starts, ends = np.r_[starts, half], np.r_[half, ends]
    return np.unique(np.concatenate(bad))


def parse_batch(lines: pa.Array, block: int = BLOCK, terms: bool = True) -> pa.StructArray:
    """(s, p, o, reason) for each line; reason is null for valid lines, else the terms are (and all are without ``terms``)."""
    reasons: list[str | None] = [None] * len(lines)
    for i in find_bad(lines, block).tolist():
        reasons[i] = diagnose(lines[i].as_py()) or None
    why = pa.array(reasons, pa.string())
    none = pa.nulls(len(lines), pa.string())
    if not terms:
        return pa.StructArray.from_arrays([none, none, none, why], ["s", "p", "o", "reason"])
    # What the strict parser accepts too is parsed like the rest.
    got = pc.extract_regex(pc.if_else(pc.is_null(why), lines, none), nt.LINE)
    s, p, o = (pc.if_else(got.is_valid(), got.field(k), none) for k in "spo")
    if pc.any(pc.ends_with(o, nt.XSD_STRING)).as_py():
        o = pc.replace_substring_regex(o, pattern=_XSD_END, replacement="")
    return pa.StructArray.from_arrays([s, p, o, why], ["s", "p", "o", "reason"])


def split_rows(df: DataFrame, keys: list[str], column: str = "line", block: int = BLOCK, terms: bool = True) -> DataFrame:
    """Each data line of ``df`` with (s, p, o) or, where it doesn't parse, ``reason``; plus the columns ``keys``.

    The lines are read in Arrow batches and judged in blocks of ``block`` lines by one vectorised call (:func:`find_bad`); failing blocks are
    halved until the bad lines stand alone, and only those are looked at by the strict parser that names the reason. ``terms`` says whether
    s, p and o are wanted. No shuffle: the rows stay where they were read. Terms must have 1 to 16382 bytes.

    Null, empty and comment lines are no data and give no row. A line of any length is handled; repeated rows come out
    repeatedly (each line is judged for itself; see :func:`rejected` and :func:`accepted`). Keys may be null, and may
    be called s, p, o or reason: their values are returned as ``key_<name>`` then. Other columns are not read.
    """
    names = {k: f"key_{k}" if k in ("s", "p", "o", "reason", column) else k for k in keys}
    src = df.where(nt.is_data(F.col(column))).select(*[F.col(k).alias(v) for k, v in names.items()], F.col(column).alias("_text"))
    kinds = dict(src.dtypes)
    schema = ", ".join([f"`{v}` {kinds[v]}" for v in names.values()] + [f"{k} string" for k in ("s", "p", "o", "reason", "_text")])

    def run(batches):
        for b in batches:
            if b.num_rows:
                text = b.column(b.num_columns - 1)
                got = parse_batch(text.cast(pa.string()), block, terms)
                why = got.field(3)
                kept = pc.if_else(pc.is_valid(why), text, pa.scalar(None, text.type))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[got.field(k) for k in range(4)], kept], names=[*names.values(), "s", "p", "o", "reason", "_text"])

    return src.mapInArrow(run, schema)


def rejected(df: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """(keys, reason, line) of the lines that don't parse; a repeated key counts once.

    Only the few rejected rows are shuffled to find repeats. Of different bad lines under one key the least remains.
    """
    out = split_rows(df, keys, column, terms=False).where(F.col("reason").isNotNull())
    names = out.columns[: len(keys)]
    return out.groupBy(*names).agg(F.min(F.struct(F.col("_text").alias("line"), "reason")).alias("x")).select(*names, "x.line", "x.reason")


def accepted(df: DataFrame, keys: list[str], column: str = "line") -> DataFrame:
    """(keys, s, p, o) of the valid lines; a repeated key counts once (the least triple under it)."""
    out = split_rows(df, keys, column).where(F.col("reason").isNull())
    names = out.columns[: len(keys)]
    return out.groupBy(*names).agg(F.min(F.struct("s", "p", "o")).alias("x")).select(*names, "x.s", "x.p", "x.o")
