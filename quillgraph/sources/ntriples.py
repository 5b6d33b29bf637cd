"""N-Triples lines: the grammar, and its use as JVM expressions.

same pattern as the JVM does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The grammar of the lines and its limits.
SPACE = r"[ \t\n\x0B\f\r]*"
_HEX = r"(?:u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"
_PLAIN = r"[^\x00-\x20<>\"{}|^\\]"
_PLAIN_NO_U = r"[^\x00-\x20<>\"{}|^\\uU]"


def _grammar(star: str = "*", not_in_literals: str = "") -> tuple[str, str, str]:
    """IRI, literal and whole line without anchors; ``star`` repeats the parts of a term."""
    iri = rf"<(?:{_PLAIN}|\\+(?:{_PLAIN_NO_U}|{_HEX})){star}\\*>"
    literal = rf"\"(?:[^{not_in_literals}\"\\]|\\(?:[tbnrf\"'\\]|{_HEX})){star}\"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^{iri})?"
    line = rf"{SPACE}(?P<s>{iri}|{BLANK}){SPACE}(?P<p>{iri}){SPACE}(?P<o>{literal}|{iri}|{BLANK}){SPACE}(?:\.{SPACE})?"
    return iri, literal, line


BLANK = r"_:[*\-_:A-Za-z0-9]*"
XSD_STRING = "^^<http://www.w3.org/2001/XMLSchema#string>"
MAX_TERM_BYTES = 16382

IRI, LITERAL, _LINE = _grammar()
LINE = rf"\A{_LINE}\z"
#: Any number of lines, each ended by NUL, that all are triples; NUL, which literals may hold otherwise, is in none of them.
NUL_ENDED_LINES = rf"\A(?:{_grammar(not_in_literals=chr(92) + 'x00')[2]}\x00)*\z"
#: For the JVM: repetition that never gives back, which it runs in a loop and not by recursion (terms may be long).
_JVM_LINE = rf"\A{_grammar('*+')[2]}\z".replace("?P<", "?<")


def is_data(line: Column) -> Column:
    """Whether a line holds data: it is neither null nor empty and doesn't begin with ``#``."""
    return line.isNotNull() & (line != "") & ~line.startswith("#")


def strip_xsd_string(term: Column) -> Column:
    """Drop a trailing ``^^xsd:string``; null stays null."""
    short = F.substring(term, F.lit(1), F.length(term) - len(XSD_STRING))
    return F.when(term.endswith(XSD_STRING), short).otherwise(term)


def parse_columns(line: Column) -> dict[str, Column]:
    """s, p and o of a line, empty strings where it doesn't parse."""
    got = {k: F.regexp_extract(line, _JVM_LINE, i) for i, k in enumerate("spo", 1)}
    return got | {"o": strip_xsd_string(got["o"])}


def parse_lines(df: DataFrame, column: str = "line") -> DataFrame:
    """The triples of the valid lines of ``df`` (s, p, o added), by JVM expressions only.

    Null, empty, comment and invalid lines give no row.
    """
    out = df.where(is_data(F.col(column))).withColumns(parse_columns(F.col(column)))
    fits = [(F.octet_length(k) >= 1) & (F.octet_length(k) <= MAX_TERM_BYTES) for k in "spo"]
    return out.where(fits[0] & fits[1] & fits[2])


def read_ntriples(spark: SparkSession, path: str | list[str], prefix: str = "") -> DataFrame:
    """(s, p, o) of N-Triples text: a file, a list or a flat directory; ``.gz`` and ``.bz2`` are read as such.

    Uncompressed files are split by bytes (``spark.sql.files.maxPartitionBytes``); ``prefix`` filters file names.
    """
    reader = spark.read.option("pathGlobFilter", f"{prefix}*") if prefix else spark.read
    return parse_lines(reader.text(path).withColumnRenamed("value", "line")).select("s", "p", "o")


def serialize(s: Column, p: Column, o: Column) -> Column:
    """A line of N-Triples."""
    return F.concat(F.concat_ws(" ", s, p, o), F.lit(" ."))
