"""SPARQL 1.1 updates on a store of versioned graphs.

An operation's WHERE clause is a query like any other; its solutions fill the templates, which give a set of quads to delete and one to insert. Both
come from the store as it was before the operation; deletions go first. Operations of one text see each other's results.

The store. Quads lie in directories by the version that wrote them, sorted by graph; a manifest (g, v) says which version of a graph counts. An
update reads the graphs it touches, writes them anew as one version, and puts a new manifest beside the old ones by a rename: readers see the store
before or after, never between, and a text whose operations fail leaves it as it was. Two writers at once: the second rename fails. `compact` writes what
counts as one version; `forget` drops versions that no manifest since one names.

Not there: LOAD (files are read by the sources). Blank nodes of templates are made anew for each solution. The default graph that is written to is
DEFAULT_GRAPH; what WHERE reads without GRAPH, WITH or USING is all graphs, as queries do.
"""

from __future__ import annotations

import functools
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators.staging import stage
from triplewright.plans import sparql
from triplewright.plans import sparql_parser as S
from triplewright.plans.sparql import DEFAULT_GRAPH
from triplewright.plans.sparql_parser import SparqlError, Unsupported, Var

QUAD = ["g", "s", "p", "o"]


@dataclass
class Change:
    """Templates of quads to delete and to insert for each solution; where is None if templates have no variables."""

    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    where: object = None
    graph: str | None = None
    using: list[str] = field(default_factory=list)
    named: list[str] = field(default_factory=list)


@dataclass
class Whole:
    """CLEAR, DROP, COPY, MOVE or ADD of whole graphs. source and target: a graph, DEFAULT, NAMED or ALL."""

    op: str
    source: str
    target: str | None = None
    silent: bool = False


def _allowed(text: str) -> None:
    bare = S._COMMENT.sub(" ", text)
    if S._SERVICE.search(re.sub(r"[?$]\w+|\b[\w-]*:[\w.-]*", " ", bare)):
        raise Unsupported("SERVICE is not supported")


class Parser(S.Parser):
    check = staticmethod(_allowed)

    def parse(self) -> list[Change | Whole]:
        out = []
        while True:
            self.prologue()
            if self.peek()[0] == "end":
                return out
            out.append(self.operation())
            if not self.op(";") and self.peek()[0] != "end":
                raise SparqlError(f"unexpected {self.peek()[1]!r}")

    def prologue(self) -> None:
        while w := self.word("PREFIX", "BASE"):
            if w == "PREFIX":
                name = self.next()[1]
                self.prefixes[name[:-1]] = self.next()[1][1:-1]
            else:
                self.base = self.next()[1][1:-1]

    def operation(self) -> Change | Whole:
        if op := self.word("CLEAR", "DROP", "CREATE"):
            silent = bool(self.word("SILENT"))
            return Whole(op, self.graphs(every=op != "CREATE"), silent=silent)
        if op := self.word("COPY", "MOVE", "ADD"):
            silent, source = bool(self.word("SILENT")), self.graphs()
            self.need("TO")
            return Whole(op, source, self.graphs(), silent)
        if self.word("LOAD"):
            raise Unsupported("LOAD is not supported: read the file as a source")
        out = Change()
        if self.word("WITH"):
            out.graph = self.constant()
        kind = self.word("INSERT", "DELETE")
        if not kind:
            raise SparqlError(f"not an update: {self.peek()[1]!r}")
        if self.word("DATA"):
            quads = self.quads(out.graph)
            if any(isinstance(x, Var) and (kind == "DELETE" or not x.name.startswith(("_n", "_b"))) for q in quads for x in q):
                raise SparqlError(f"{kind} DATA holds variables or blank nodes that it can't")
            setattr(out, kind.lower(), quads)
            return out
        if kind == "DELETE" and self.word("WHERE"):
            out.delete = self.quads(out.graph)
            out.where = S.Group([S.Triples([q[1:] for q in out.delete if q[0] in (DEFAULT_GRAPH, out.graph)])] if any(q[0] in (DEFAULT_GRAPH, out.graph) for q in out.delete) else [])
            for g in dict.fromkeys(q[0] for q in out.delete if q[0] not in (DEFAULT_GRAPH, out.graph)):
                out.where.parts.append(S.Graph(g, S.Group([S.Triples([q[1:] for q in out.delete if q[0] == g])])))
            if out.graph is None and any(q[0] == DEFAULT_GRAPH for q in out.delete):
                out.using = [DEFAULT_GRAPH]  # the pattern is what is deleted, so it is looked for there
            self.no_blank(out.delete)
            return out
        setattr(out, kind.lower(), self.quads(out.graph))
        if kind == "DELETE" and self.word("INSERT"):
            out.insert = self.quads(out.graph)
        self.no_blank(out.delete)
        while self.word("USING"):
            (out.named if self.word("NAMED") else out.using).append(self.constant())
        self.need("WHERE")
        out.where = self.group()
        return out

    @staticmethod
    def no_blank(quads: list) -> None:
        if any(isinstance(x, Var) and x.name.startswith(("_n", "_b")) for q in quads for x in q):
            raise SparqlError("what is deleted can't hold blank nodes")

    def constant(self) -> str:
        term = self.term()
        if not isinstance(term, str) or not term.startswith("<"):
            raise SparqlError("a graph's IRI is needed here")
        return term

    def graphs(self, every: bool = False) -> str:
        if w := self.word("DEFAULT", *(("NAMED", "ALL") if every else ())):
            return DEFAULT_GRAPH if w == "DEFAULT" else w
        self.word("GRAPH")
        return self.constant()

    def quads(self, graph: str | None) -> list[tuple]:
        """(graph, s, p, o) between braces."""
        self.need("{")
        out = []
        while not self.op("}"):
            if self.op("."):
                continue
            if self.word("GRAPH"):
                g = self.term()
                self.need("{")
                out += [(g, *t) for t in self.triples_until("}")]
            elif self.peek()[0] == "end":
                raise SparqlError("unclosed quads")
            else:
                out += [(graph or DEFAULT_GRAPH, *t) for t in self.triples_same_subject()]
        return out


def _filled(compiler, solutions, templates: list) -> DataFrame:
    """Quads of templates for all solutions; those that aren't quads (unbound or out of place) are left out."""
    marked = [x for n in solutions.names for x in (F.col(n).isNull(), F.col(n))]
    new = F.concat(F.lit("_"), F.hex(F.xxhash64(F.lit(0), *marked)), F.hex(F.xxhash64(F.lit(1), *marked)))  # nulls are marked: hashes pass over them
    parts = []
    for quad in templates:
        if any(isinstance(x, S.Path) for x in quad):
            raise SparqlError("a template holds no paths")
        columns = [(F.concat(F.lit(f"_:{x.name}"), new) if isinstance(x, Var) and x.name.startswith(("_b", "_n")) else compiler.expr(x, solutions.names).term).alias(n) for n, x in zip(QUAD, quad)]
        parts.append(solutions.df.select(*columns))
    whole = functools.reduce(DataFrame.unionByName, parts)
    return whole.where("g is not null and s is not null and p is not null and o is not null and startswith(g, '<') and not startswith(s, '\"') and startswith(p, '<')").distinct()


def changes(quads: DataFrame, change: Change) -> tuple[DataFrame, DataFrame]:
    """(deleted, inserted) quads of a change to quads."""
    none = quads.select(*QUAD).limit(0)
    default = change.using or ([change.graph] if change.graph else [])
    compiler = sparql.Compiler(quads, default, change.named)
    if change.where is None:
        solutions = sparql.Solutions(quads.sparkSession.range(1).select(F.lit(uuid.uuid4().hex).alias("_once")), ["_once"], set())  # blank nodes of data are new each time
    else:
        solutions = compiler.select(S.Query("SELECT", change.where, star=True))
        solutions = sparql.Solutions(stage(solutions.df), solutions.names, solutions.maybe)
    return tuple(_filled(compiler, solutions, t) if t else none for t in (change.delete, change.insert))


class QuadStore:
    """Quads of one folder, by versions of graphs."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @staticmethod
    def create(quads: DataFrame, path: str) -> QuadStore:
        store = QuadStore(quads.sparkSession, path)
        store._commit(quads.select(*QUAD), None, -1)
        return store

    # files
    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def versions(self) -> list[int]:
        """Numbers of the manifests, the last of which counts."""
        system, folder = self._hadoop(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in system.listStatus(folder)] if system.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        return self.spark.read.schema("g string, v long").parquet(f"{self.path}/manifests/{self.versions()[-1] if version is None else version}")

    def quads(self, version: int | None = None) -> DataFrame:
        """All quads of the newest version, or of one that is named."""
        stored = self.spark.read.schema("g string, s string, p string, o string, v long").parquet(f"{self.path}/quads")
        return stored.join(self.manifest(version), ["g", "v"], "left_semi").select(*QUAD)

    def _commit(self, written: DataFrame, touched: DataFrame | None, before: int) -> None:
        """Writes graphs anew as version before + 1. touched (g): graphs whose former versions no longer count; None: all."""
        v, name = before + 1, uuid.uuid4().hex
        # a version's number is its own even if another writer wins the manifest: readers go by (g, v) of a manifest
        label = v << 32 | (hash(name) & 0xFFFFFFFF)
        rows = written.distinct().repartitionByRange("g", "s", "p", "o").sortWithinPartitions("g", "s", "p", "o")
        rows.write.option("compression", "zstd").parquet(f"{self.path}/quads/v={label}")
        now = self.spark.read.schema("g string").parquet(f"{self.path}/quads/v={label}").distinct().withColumn("v", F.lit(label).cast("long"))
        if touched is not None:
            now = now.unionByName(self.manifest(before).join(touched, "g", "left_anti").select("g", "v"))
        now.coalesce(1).write.parquet(f"{self.path}/manifests/.{name}")  # a row per graph
        system, made = self._hadoop(f"{self.path}/manifests/.{name}")
        target = self._hadoop(f"{self.path}/manifests/{v}")[1]
        if system.exists(target) or not system.rename(made, target):
            raise RuntimeError("another writer has changed the store: nothing was changed")

    # updates
    def update(self, text: str) -> None:
        """All operations of a text, as one version."""
        operations = Parser(text).parse()
        before = self.versions()[-1]
        quads, touched = self.quads(before), None
        for op in operations:
            gone, more, hit = self._whole(quads, op) if isinstance(op, Whole) else (*changes(quads, op), None)
            gone, more = stage(gone), stage(more)
            hit = gone.select("g").unionByName(more.select("g")) if hit is None else hit
            touched = hit if touched is None else touched.unionByName(hit)
            # only graphs that are touched are read and written again
            quads = stage(quads.join(gone, QUAD, "left_anti").unionByName(more).join(stage(touched.distinct()), "g", "left_semi").distinct()).unionByName(quads.join(stage(touched.distinct()), "g", "left_anti"))
        if touched is not None and not (touched := stage(touched.distinct())).isEmpty():
            self._commit(quads.join(touched, "g", "left_semi").select(*QUAD), touched, before)

    def _whole(self, quads: DataFrame, op: Whole) -> tuple[DataFrame, DataFrame, DataFrame | None]:
        none = quads.limit(0)
        of = lambda g: quads if g == "ALL" else quads.where(F.col("g") != DEFAULT_GRAPH) if g == "NAMED" else quads.where(F.col("g") == g)
        if op.op == "CREATE":
            return none, none, None
        source = of(op.source)
        if not op.silent and op.op != "ADD" and op.source not in ("ALL", "NAMED", DEFAULT_GRAPH) and source.isEmpty() and op.op in ("DROP", "MOVE", "COPY"):
            raise SparqlError(f"there is no graph {op.source}")
        if op.op in ("CLEAR", "DROP"):
            return source, none, None
        if op.source == op.target:
            return none, none, None
        more = source.withColumn("g", F.lit(op.target)).select(*QUAD)
        gone = {"ADD": none, "COPY": of(op.target), "MOVE": of(op.target).unionByName(source)}[op.op]
        return gone, more, None

    # housekeeping
    def compact(self) -> None:
        """All that counts as one version."""
        before = self.versions()[-1]
        self._commit(self.quads(before), None, before)

    def forget(self, since: int) -> None:
        """Drops manifests before a version, and versions of graphs that no later manifest names."""
        held = {r.v for n in self.versions() if n >= since for r in self.manifest(n).select("v").distinct().collect()}  # at most one per update kept
        for n in self.versions():
            if n < since:
                system, target = self._hadoop(f"{self.path}/manifests/{n}")
                system.delete(target, True)
        system, folder = self._hadoop(f"{self.path}/quads")
        for s in system.listStatus(folder):
            name = s.getPath().getName()
            if name.startswith("v=") and int(name[2:]) not in held:
                system.delete(s.getPath(), True)
