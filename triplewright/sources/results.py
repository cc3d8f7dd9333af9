"""Query results as text: JSON, XML, CSV and TSV of solutions, a line or an element per row, made in the rows' own tasks.

Each function gives one column `line`; `write` puts head, lines and foot into files whose contents, in the order of their names, are one document.
Terms are as in functions.terms; null is unbound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.operators.staging import stage

#: Media types of the formats, the first of which is the default.
MEDIA = {"json": "application/sparql-results+json", "xml": "application/sparql-results+xml", "csv": "text/csv", "tsv": "text/tab-separated-values"}


def format_for(accept: str | None) -> str:
    """The format that an Accept header asks for, JSON if none is known."""
    for wanted in (part.split(";")[0].strip().lower() for part in (accept or "").split(",")):
        for name, media in MEDIA.items():
            if wanted == media or name == "json" and wanted == "application/json" or name == "xml" and wanted == "application/xml":
                return name
    return "json"


def _parts(t: Column) -> tuple[Column, Column, Column, Column]:
    """Kind, text, language and datatype of a term; a blank node's text is its label, a plain string has no datatype."""
    kind = F.when(T.is_iri(t), "uri").when(T.is_blank(t), "bnode").when(T.is_literal(t), "literal")
    text = F.when(T.is_blank(t), t.substr(F.lit(3), F.length(t))).otherwise(T.lexical(t))
    tag = F.nullif(T.lang(t), F.lit(""))
    kind_of = T.datatype(t)
    return kind, text, tag, F.when(T.is_literal(t) & tag.isNull() & (kind_of != T.XSD + "string"), kind_of)


def json_lines(df: DataFrame) -> DataFrame:
    """A binding object per row; unbound variables are left out."""

    def binding(name: str) -> Column:
        kind, text, tag, datatype = _parts(F.col(f"`{name}`"))
        return F.when(kind.isNotNull(), F.struct(kind.alias("type"), text.alias("value"), tag.alias("xml:lang"), datatype.alias("datatype"))).alias(name)

    return df.select(F.to_json(F.struct(*map(binding, df.columns))).alias("line"))


def _escaped(c: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def xml_lines(df: DataFrame) -> DataFrame:
    """A result element per row."""

    def binding(name: str) -> Column:
        kind, text, tag, datatype = _parts(F.col(f"`{name}`"))
        attribute = F.when(tag.isNotNull(), F.concat(F.lit(' xml:lang="'), tag, F.lit('"'))).when(datatype.isNotNull(), F.concat(F.lit(' datatype="'), _escaped(datatype), F.lit('"'))).otherwise("")
        return F.when(kind.isNotNull(), F.concat(F.lit(f'<binding name="{name}"><'), kind, attribute, F.lit(">"), _escaped(text), F.lit("</"), kind, F.lit("></binding>"))).otherwise("")

    return df.select(F.concat(F.lit("<result>"), *map(binding, df.columns), F.lit("</result>")).alias("line"))


def csv_lines(df: DataFrame) -> DataFrame:
    """Plain values, quoted where they hold a comma, a quote or a line end; unbound is empty."""

    def cell(name: str) -> Column:
        t = F.col(f"`{name}`")
        text = F.when(T.is_blank(t), t).otherwise(T.lexical(t))
        return F.coalesce(F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text), F.lit(""))

    return df.select(F.concat_ws(",", *map(cell, df.columns)).alias("line"))


def tsv_lines(df: DataFrame) -> DataFrame:
    """Terms as they are written in queries; backslashes, quotes, tabs and line ends in a literal are escaped; unbound is empty."""

    def cell(name: str) -> Column:
        t = F.col(f"`{name}`")
        inner = T.lexical(t)
        shown = inner
        for sign, name_ in (("\\", "\\\\"), ('"', '\\"'), ("\t", "\\t"), ("\n", "\\n"), ("\r", "\\r")):
            shown = F.replace(shown, F.lit(sign), F.lit(name_))
        literal = F.concat(F.lit('"'), shown, t.substr(F.length(inner) + 2, F.length(t)))
        return F.coalesce(F.when(T.is_literal(t), literal).otherwise(t), F.lit(""))

    return df.select(F.concat_ws("\t", *map(cell, df.columns)).alias("line"))


LINES = {"json": json_lines, "xml": xml_lines, "csv": csv_lines, "tsv": tsv_lines}


def head(names: list[str], kind: str) -> str:
    """What stands before the lines of a document."""
    if kind == "json":
        return '{"head":{"vars":[' + ",".join(f'"{n}"' for n in names) + ']},"results":{"bindings":['
    if kind == "xml":
        return '<?xml version="1.0"?><sparql xmlns="http://www.w3.org/2005/sparql-results#"><head>' + "".join(f'<variable name="{n}"/>' for n in names) + "</head><results>"
    return ",".join(names) if kind == "csv" else "\t".join("?" + n for n in names)


def foot(kind: str) -> str:
    return {"json": "]}}", "xml": "</results></sparql>"}.get(kind, "")


def document(df: DataFrame, kind: str, most: int = 100_000) -> str:
    """A whole document of a result of up to `most` rows; a larger one is an error here and goes to files by write()."""
    lines = [r.line for r in LINES[kind](df).limit(most + 1).collect()]
    if len(lines) > most:
        raise ValueError(f"the result has more than {most} rows: write it to files")
    return head(df.columns, kind) + ("" if kind in ("json", "xml") else "\n") + ("," if kind == "json" else "\n").join(lines) + foot(kind)


def write(df: DataFrame, path: str, kind: str = "json") -> None:
    """The document as text files below path: head, lines and foot in the order of the files' names, lines in the order of the result's partitions."""
    write_lines(stage(LINES[kind](df).withColumn("at", F.monotonically_increasing_id())), path, head(df.columns, kind), foot(kind), kind == "json")


def write_lines(lines: DataFrame, path: str, before: str, after: str, commas: bool) -> None:
    """Written (line, at) as text files below path by `at`, between two more lines if those aren't empty; with commas, every line but the first follows one."""
    if commas:
        first = lines.agg(F.min("at")).first()[0]
        lines = lines.withColumn("line", F.when(F.col("at") == first, F.col("line")).otherwise(F.concat(F.lit(","), "line")))
    ends = [(before, -1), (after, (1 << 63) - 1)]
    whole = lines.unionByName(lines.sparkSession.createDataFrame([x for x in ends if x[0]], "line string, at long"))
    whole.repartitionByRange("at").sortWithinPartitions("at").select("line").write.text(path)
