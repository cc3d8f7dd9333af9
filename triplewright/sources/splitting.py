"""Turtle and OBO files read in pieces: a file of many statements is shared out to many tasks.

Spark's text source cuts a file at a separator and deals its byte ranges to tasks. A Turtle statement ends with a dot at a line's end, an OBO stanza before a
line that begins with a bracket; each piece is read by itself, with the prefixes and base of its file, which a first pass collects (a few lines per file).

Where a dot at a line's end may stand within something (a long string, a comment), or prefixes can't be told without reading in order (declared twice with
different values, or over several lines), the file is read as a whole by one task, as syntaxes.load does; the first pass tells which files these are. Blank
node labels have one meaning in a file, whatever piece they stand in; nodes without a label are named by their piece's byte range and text, and their order in it.
TriG, RDF/XML and JSON-LD nest their statements and aren't cut. Files with CR LF line ends are right, but one piece each.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.plans import sparql_parser as S
from triplewright.sources import syntaxes
from triplewright.sources.rdf import DEFAULT_GRAPH

#: Files whose directives are broadcast.
MOST_FILES = 10_000
SEPARATOR = {"turtle": ".\n", "obo": "\n["}
_DIRECTIVE = r"(?:@prefix\s+[\w.-]*:\s*<[^>]*>\s*\.|@base\s+<[^>]*>\s*\.|(?i:prefix)\s+[\w.-]*:\s*<[^>]*>|(?i:base)\s+<[^>]*>)"
_DIRECTIVES, _BEGINS = rf"^\s*(?:{_DIRECTIVE}\s*)+(?:#[^.]*)?$", r"^\s*(?:@prefix|@base|(?i:prefix|base)\s)"
#: Lines that make a cut at ".\n" unsafe.
_UNSAFE = r"""\"\"\"|'''|(?:^|\s)#.*\.\s*$"""
_STANZA = re.compile(r"^(?:Term|Typedef|Instance)\]")


def surveyed(spark: SparkSession, path: str) -> DataFrame:
    """(file, whole, head) of Turtle files: whether a file must be read as a whole, and its directives."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    begins, complete = F.col("value").rlike(_BEGINS), F.col("value").rlike(_DIRECTIVES)
    told = lines.where(begins | F.col("value").rlike(_UNSAFE))
    facts = told.groupBy("file").agg(F.bool_or(~complete | (~begins & F.col("value").rlike(_UNSAFE))).alias("whole"), F.collect_set(F.when(complete, F.col("value"))).alias("lines"))
    # several values of a prefix, or several bases, depend on their order
    found = F.flatten(F.transform("lines", lambda x: F.regexp_extract_all(x, F.lit(r"(?i)(prefix\s+[\w.-]*:|base)\s*<[^>]*>"), F.lit(0))))
    squeezed = F.array_distinct(F.transform(found, lambda d: F.regexp_replace(F.regexp_replace(d, r"(?i)^(prefix|base)", ""), r"\s+", "")))
    names = F.transform(squeezed, lambda d: F.substring_index(d, "<", 1))
    out = facts.select("file", (F.col("whole") | (F.size(squeezed) > F.size(F.array_distinct(names)))).alias("whole"), F.array_join("lines", "\n").alias("head"))
    every = lines.select("file").distinct()
    return every.join(out, "file", "left").select("file", F.coalesce("whole", F.lit(False)).alias("whole"), F.coalesce("head", F.lit("")).alias("head"))


def _scope(name: str) -> str:
    return hashlib.md5(name.encode()).hexdigest()[:8] + "_"


class _Statements(syntaxes._Turtle):
    """Statements with given prefixes and base; nodes without a label are numbered from 0."""

    def __init__(self, text: str, prefixes: dict, base: str):
        super().__init__(text)
        self.prefixes, self.base = dict(prefixes), base

    def named(self, scope: str, piece: str) -> list[tuple]:
        numbers: dict[str, int] = {}

        def name(t):
            if not isinstance(t, S.Var):
                return t
            if t.name.startswith("_n"):
                return f"_:{scope}{t.name.lstrip('_')}"
            return f"_:{scope}{piece}b{numbers.setdefault(t.name, len(numbers))}"

        return [tuple(map(name, t)) for t in self.triples()]


def load(spark: SparkSession, path: str, syntax: str, graph: str | None = None) -> DataFrame:
    """Distinct quads of Turtle or OBO files, in `graph`; a piece that can't be read fails the job with its file's name."""
    if syntax not in SEPARATOR:
        raise ValueError(f"{syntax!r} isn't read in pieces; {', '.join(SEPARATOR)} are")
    records = spark.read.option("lineSep", SEPARATOR[syntax]).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    whole: list[str] = []
    if syntax == "turtle":
        files = surveyed(spark, path)
        whole = [r.file for r in files.where("whole").select("file").collect()]  # names of the few files that can't be cut
        heads = files.where("not whole").select("file", "head")
        # broadcast while it is small, so that pieces stay where they are read; beyond that they are numbered by what they are
        records = records.join(F.broadcast(heads) if heads.count() <= MOST_FILES else heads, "file")
    else:
        records = records.withColumn("head", F.lit(""))

    def run(batches):
        heads: dict[str, tuple[dict, str]] = {}
        numbers: dict = {}  # of pieces with nodes that have no label
        for batch in batches:
            rows = []
            for file, start, value, head in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if syntax == "obo":
                        rows += syntaxes.obo("\n[" + value) if _STANZA.match(value) else []
                        continue
                    if head not in heads:
                        first = syntaxes._Turtle(head)
                        first.triples()
                        heads[head] = first.prefixes, first.base
                    # equal pieces of a byte range are told apart by their count
                    mark = f"{start}_{hashlib.md5(value.encode()).hexdigest()[:16]}"
                    n = 0
                    if "[" in value or "(" in value:
                        n = numbers[file, mark] = numbers.get((file, mark), -1) + 1
                    rows += _Statements(value.removeprefix("\ufeff") + " .", *heads[head]).named(_scope(file), f"{mark}_{n}_")
                except Exception as e:
                    raise ValueError(f"{file}: {e}") from e
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["s", "p", "o"])

    found = records.select("file", "start", "value", "head").mapInArrow(run, "s string, p string, o string")
    quads = found.select(F.lit(graph or DEFAULT_GRAPH).alias("g"), "s", "p", "o")
    for file in whole:
        quads = quads.unionByName(syntaxes.load(spark, file, syntax, graph))
    return quads.distinct()
