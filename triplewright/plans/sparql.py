"""SPARQL algebra on DataFrames of quads (g, s, p, o), each column a term.

A solution sequence is a DataFrame with a column per variable; unbound is null. Patterns become filtered scans,
natural joins become equi joins, EXISTS and MINUS semi and anti joins: order and strategy of joins stay with the optimizer. Property paths of unbounded length are
fixpoints whose rounds are written to the shared folder.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import terms as T
from triplewright.operators.hierarchy import reachable
from triplewright.plans import sparql_parser as S
from triplewright.plans.sparql_parser import Call, Exists, Path, SparqlError, Var

DEFAULT_GRAPH = "<urn:graph:default>"


@dataclass
class Solutions:
    df: DataFrame
    names: list[str]
    #: Variables that may be unbound.
    maybe: set[str] = field(default_factory=set)
    #: Filters over variables from outside.
    pending: list = field(default_factory=list)


#: Kinds of values that have an order.
ORDERED = ("num", "str", "bool", "dateTime", "date")


class Value:
    """A compiled expression: a term, or a native boolean, number or string that becomes a term when needed."""

    def __init__(self, kind: str, column: Column, whole: Column | None = None, constant: str | None = None):
        self.kind, self.column = kind, column
        #: The term itself, if it is one and the same for all rows.
        self.constant = constant
        #: Of a number: its value as an integer of up to 38 digits, null if it isn't one by its type.
        self._whole = whole

    @property
    def term(self) -> Column:
        if self.kind == "num":
            return T.from_number(self.column) if self._whole is None else F.when(self._whole.isNotNull(), T.typed(self._whole, T.XSD + "integer")).otherwise(T.from_number(self.column))
        return {"term": lambda c: c, "bool": T.from_boolean, "str": T.plain}[self.kind](self.column)

    @property
    def text(self) -> Column:
        return self.column if self.kind == "str" else T.lexical(self.term)

    @property
    def num(self) -> Column:
        return self.column if self.kind == "num" else T.number(self.term)

    @property
    def whole(self) -> Column:
        if self.kind == "num":
            return F.lit(None).cast("decimal(38,0)") if self._whole is None else self._whole
        return T.integer(self.term)

    @property
    def kinds(self) -> tuple[str, ...]:
        """Kinds of values that it can have, as far as comparing goes."""
        if self.kind != "term":
            return (self.kind,)
        return ORDERED if self.constant is None else (T.kind_of(self.constant),)

    def as_kind(self, kind: str) -> Column:
        """Its value if it is of a kind, else null."""
        if kind == self.kind != "term":
            return self.column
        if kind == "num":
            return self.num if self.constant is None else F.lit(float(T.lexical_of(self.constant)))
        return {"str": T.string, "bool": T.boolean}[kind](self.term) if kind in ("str", "bool") else T.moment(self.term, kind)

    @property
    def small(self) -> bool:
        """A constant number that a double holds exactly, with all its neighbours among the integers."""
        return self.constant is not None and T.kind_of(self.constant) == "num" and abs(float(T.lexical_of(self.constant))) < 1 << 53

    @property
    def bool(self) -> Column:
        """Effective boolean value; null is an error."""
        if self.kind == "bool":
            return self.column
        if self.kind == "num":
            return (self.column != 0) & ~F.isnan(self.column)
        if self.kind == "str":
            return self.column != ""
        t = self.column
        dt, n = T.datatype(t), T.number(t)
        return F.when(dt == T.XSD + "boolean", T.lexical(t).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(dt == T.XSD + "string", T.lexical(t) != "")


class Compiler:
    def __init__(self, quads: DataFrame, default_graphs: list[str] = (), named_graphs: list[str] = (), disjoint: bool = False):
        self.spark: SparkSession = quads.sparkSession
        self.disjoint = disjoint
        self.quads, self.default, self.named = quads, list(default_graphs), list(named_graphs)

    # scans
    def triples(self, graph) -> DataFrame:
        """Triples (s, p, o), and g if the graph is a variable. The default graph is the union of all (or of FROM), without duplicates."""
        if graph is None:
            quads = self.quads.where(F.col("g").isin(self.default)) if self.default else self.quads
            once = self.disjoint or len(self.default) == 1
            return quads.select("s", "p", "o") if once else quads.select("s", "p", "o").distinct()
        quads = self.quads.where(F.col("g").isin(self.named)) if self.named else self.quads
        if isinstance(graph, Var):
            return quads.where(F.col("g") != DEFAULT_GRAPH).select("g", "s", "p", "o")
        return quads.where(F.col("g") == graph).select("s", "p", "o")

    def scan(self, graph, s, p, o) -> Solutions:
        # constants and projection go below the union's duplicate removal: they reach the scan
        df = self.triples(graph)
        bound: dict[str, str] = {}
        for column, node in (("g", graph), ("s", s), ("p", p), ("o", o)):
            if isinstance(node, Var):
                if node.name in bound:
                    df = df.where(F.col(column) == F.col(bound[node.name]))
                else:
                    bound[node.name] = column
            elif node is not None and column != "g":
                df = df.where(F.col(column) == node)
        return Solutions(df.select(*(F.col(c).alias(n) for n, c in bound.items())), list(bound))

    # property paths
    def pairs(self, graph, path) -> DataFrame:
        """Pairs (s, o) that a path of one or more fixed steps connects, with g if the graph is a variable; duplicates count."""
        by = ["g"] if isinstance(graph, Var) else []
        if isinstance(path, str):
            return self.triples(graph).where(F.col("p") == path).select(*by, "s", "o")
        a = path.args
        if path.op == "inv":
            return self.pairs(graph, a[0]).select(*by, F.col("o").alias("s"), F.col("s").alias("o"))
        if path.op == "seq":
            return functools.reduce(lambda x, y: x.withColumnRenamed("o", "m").join(y.withColumnRenamed("s", "m"), [*by, "m"]).select(*by, "s", "o"), (self.pairs(graph, x) for x in a))
        if path.op == "alt":
            return functools.reduce(DataFrame.unionByName, (self.pairs(graph, x) for x in a))
        if path.op == "neg":
            forward, back = [t for t, b in a if not b], [t for t, b in a if b]
            out = []
            if forward or not back:
                out.append(self.triples(graph).where(~F.col("p").isin(forward)).select(*by, "s", "o"))
            if back:
                out.append(self.triples(graph).where(~F.col("p").isin(back)).select(*by, F.col("o").alias("s"), F.col("s").alias("o")))
            return functools.reduce(DataFrame.unionByName, out)
        if path.op == "plus":
            return reachable(self.pairs(graph, a[0]), "s", "o", by=by)
        nodes = self.triples(graph)
        same = nodes.select(*by, F.col("s").alias("s")).unionByName(nodes.select(*by, F.col("o").alias("s"))).distinct().select(*by, "s", F.col("s").alias("o"))
        one = self.pairs(graph, a[0]) if path.op == "opt" else reachable(self.pairs(graph, a[0]), "s", "o", by=by)
        return one.unionByName(same).distinct()

    def path(self, graph, s, path, o) -> Solutions:
        by = ["g"] if isinstance(graph, Var) else []
        unbounded = path.op in ("plus", "star") and isinstance(s, str) != isinstance(o, str)
        if unbounded:  # from the constant end only
            edges = self.pairs(graph, path.args[0])
            a, b, constant = ("s", "o", s) if isinstance(s, str) else ("o", "s", o)
            seeds = self.spark.createDataFrame([(constant,)], f"{a} string")
            if by:
                seeds = self.triples(graph).select("g").distinct().withColumn(a, F.lit(constant))
            found = reachable(edges, a, b, seeds, by)
            if path.op == "star":
                found = found.unionByName(seeds.select(*by, a, F.col(a).alias(b)).select(*by, "s", "o")).distinct()
            df = found
        else:
            df = self.pairs(graph, path)
            zero = path.op in ("star", "opt") and isinstance(s, str) and isinstance(o, str) and s == o
            if zero:
                if by:
                    return Solutions(self.triples(graph).select(F.col("g").alias(graph.name)).distinct(), [graph.name])
                return Solutions(self.spark.createDataFrame([(1,)], "_one int").select(), [])
        bound: dict[str, str] = {graph.name: "g"} if by else {}
        for column, node in (("s", s), ("o", o)):
            if isinstance(node, str):
                df = df.where(F.col(column) == node)
            elif node.name in bound:
                df = df.where(F.col(bound[node.name]) == F.col(column))
            else:
                bound[node.name] = column
        return Solutions(df.select(*(F.col(c).alias(n) for n, c in bound.items())), list(bound))

    # joins
    def split(self, left: Solutions, right: Solutions, how: str, pending: list) -> Solutions | None:
        """The join in two parts, by whether a shared variable is bound in one side's rows: each part is an equi join. None if there is no such variable.

        A left, semi or anti join is shared out by its left rows only; by the right ones as well if it is an inner join.
        """
        for side, other, swap in ((left, right, False), (right, left, True)):
            for n in side.names:
                if n not in other.names or n not in side.maybe or n in other.maybe or swap and how != "inner":
                    continue
                bound = Solutions(side.df.where(F.col(n).isNotNull()), side.names, side.maybe - {n}, side.pending)
                free = Solutions(side.df.where(F.col(n).isNull()).drop(n), [x for x in side.names if x != n], side.maybe - {n}, side.pending)
                parts = [self.join(other, x, how, pending) if swap else self.join(x, other, how, pending) for x in (bound, free)]
                names = left.names if how in ("left_semi", "left_anti") else left.names + [x for x in right.names if x not in left.names]
                both = [p.df.select(*(F.col(x) if x in p.names else F.lit(None).cast("string").alias(x) for x in names)) for p in parts]
                maybe = set().union(*(p.maybe for p in parts)) | {x for x in names if any(x not in p.names for p in parts)}
                return Solutions(both[0].unionByName(both[1]), names, maybe)
        return None

    def join(self, left: Solutions, right: Solutions, how: str = "inner", pending: list = ()) -> Solutions:
        if in_parts := self.split(left, right, how, pending):
            return in_parts
        shared = [n for n in left.names if n in right.names]
        loose = [n for n in shared if n in left.maybe or n in right.maybe]
        renamed = right.df.select(*(F.col(n).alias(f"_r_{n}" if n in shared else n) for n in right.names))
        condition = None
        for n in shared:
            same = F.col(n) == F.col(f"_r_{n}")
            if n in left.maybe:
                same = same | F.col(n).isNull()
            if n in right.maybe:
                same = same | F.col(f"_r_{n}").isNull()
            condition = same if condition is None else condition & same
        extra = [f for f in pending]
        names = left.names + [n for n in right.names if n not in shared]
        for f in extra:
            c = F.coalesce(self.expr(f, names).bool, F.lit(False))
            condition = c if condition is None else condition & c
        if how in ("left_semi", "left_anti"):
            return Solutions(left.df.join(renamed, condition if condition is not None else F.lit(True), how), left.names, left.maybe)
        df = left.df.join(renamed, condition, how) if condition is not None else left.df.join(renamed, F.lit(True), how) if how != "inner" else left.df.crossJoin(renamed)
        df = df.select(*(F.coalesce(F.col(n), F.col(f"_r_{n}")).alias(n) if n in loose else F.col(n) for n in names))
        maybe = {n for n in names if (n in left.maybe and (n not in right.names or n in right.maybe)) or (n not in left.names and (n in right.maybe or how == "left"))}
        if how == "left":
            maybe |= {n for n in left.maybe}
        return Solutions(df, names, maybe)

    def one(self) -> Solutions:
        return Solutions(self.spark.range(1).select(), [])

    # groups
    def group(self, node, graph=None) -> Solutions:
        if isinstance(node, S.Query):
            return self.select(node, graph)
        if isinstance(node, Var | str):
            raise SparqlError("not a group")
        out: Solutions | None = None
        filters = []

        def add(new: Solutions):
            nonlocal out
            out = new if out is None else self.join(out, new)

        for part in node.parts if isinstance(node, S.Group) else [node]:
            if isinstance(part, S.Triples):
                for solutions in self.ordered(part.patterns, graph):
                    add(solutions)
            elif isinstance(part, S.Group | S.Query):
                add(self.group(part, graph))
            elif isinstance(part, S.Union_):
                branches = [self.group(g, graph) for g in part.groups]
                names = list(dict.fromkeys(n for b in branches for n in b.names))
                df = functools.reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (b.df for b in branches))
                add(Solutions(df.select(*names), names, {n for n in names if any(n not in b.names or n in b.maybe for b in branches)}))
            elif isinstance(part, S.Graph):
                add(self.group(part.group, part.term))
            elif isinstance(part, S.Optional_):
                inner = self.inner(part.group, graph)
                out = self.join(out or self.one(), inner, "left", inner.pending)
            elif isinstance(part, S.Minus):
                inner, out = self.group(part.group, graph), out or self.one()
                shared = [n for n in inner.names if n in out.names]
                if shared:
                    bound = [n for n in shared if n not in out.maybe and n not in inner.maybe]
                    if not bound:  # solutions that share no bound variable stay
                        some = functools.reduce(lambda x, y: x | y, (F.col(n).isNotNull() for n in shared))
                        kept = Solutions(out.df.where(~some), out.names, out.maybe)
                        rest = self.join(Solutions(out.df.where(some), out.names, out.maybe), inner, "left_anti")
                        out = Solutions(kept.df.unionByName(rest.df), out.names, out.maybe)
                    else:
                        out = self.join(out, inner, "left_anti")
            elif isinstance(part, S.Filter):
                filters.append(part.expr)
            elif isinstance(part, S.Bind):
                out = out or self.one()
                value = self.expr(part.expr, out.names).term
                out = Solutions(out.df.withColumn(part.var.name, value), [*out.names, part.var.name], out.maybe | {part.var.name})
            elif isinstance(part, S.Values):
                add(self.values(part))
            else:
                raise SparqlError(f"unexpected {part}")
        out = out or self.one()
        for f in filters:
            out = self.filter(out, f, graph)
        return out

    def inner(self, node, graph) -> Solutions:
        """A group whose filters over variables that it does not bind are left pending."""
        if not isinstance(node, S.Group):
            return self.group(node, graph)
        bare = S.Group([p for p in node.parts if not isinstance(p, S.Filter)])
        out = self.group(bare, graph)
        for p in node.parts:
            if isinstance(p, S.Filter):
                if S.variables(p.expr) <= set(out.names):
                    out = self.filter(out, p.expr, graph)
                else:
                    out.pending.append(p.expr)
        return out

    def ordered(self, patterns: list, graph) -> list[Solutions]:
        """Scans of a basic graph pattern, each after one that it shares a variable with where possible."""
        left, seen, out = list(patterns), set(), []
        while left:
            def cost(t):
                names = {x.name for x in t if isinstance(x, Var)}
                return (bool(seen) and not names & seen, -sum(isinstance(x, str) for x in t))

            s, p, o = best = min(left, key=cost)
            left.remove(best)
            seen |= {x.name for x in best if isinstance(x, Var)}
            out.append(self.path(graph, s, p, o) if isinstance(p, Path) else self.scan(graph, s, p, o))
        return out

    def values(self, node: S.Values) -> Solutions:
        names = [v.name for v in node.vars]
        df = self.spark.createDataFrame([tuple(r) for r in node.rows], ", ".join(f"`{n}` string" for n in names)) if names else self.spark.range(len(node.rows)).select()
        return Solutions(df, names, {n for i, n in enumerate(names) if any(r[i] is None for r in node.rows)})

    def filter(self, out: Solutions, expr, graph) -> Solutions:
        if isinstance(expr, Call) and expr.name == "&&":
            return self.filter(self.filter(out, expr.args[0], graph), expr.args[1], graph)
        negated = isinstance(expr, Call) and expr.name == "!" and isinstance(expr.args[0], Exists)
        if negated or isinstance(expr, Exists):
            e = expr.args[0] if negated else expr
            inner = self.inner(e.group, graph)
            return self.join(out, inner, "left_anti" if e.negated != negated else "left_semi", inner.pending)
        marks: dict = {}
        marked = self.marked(out, expr, graph, marks)
        return Solutions(marked.df.where(F.coalesce(self.expr(expr, out.names, marks or None).bool, F.lit(False))).select(*out.names), out.names, out.maybe)

    def marked(self, out: Solutions, expr, graph, marks: dict) -> Solutions:
        """out with a column for each EXISTS inside an expression: whether its group has a solution for the row."""
        if isinstance(expr, Exists):
            inner = self.inner(expr.group, graph)
            shared = [n for n in inner.names if n in out.names]
            if inner.pending or any(n in out.maybe or n in inner.maybe for n in shared):
                raise SparqlError("EXISTS inside an expression needs bound variables, and no outer ones in its filters")
            flag = f"_exists{len(marks)}"
            marks[id(expr)] = Value("bool", F.coalesce(F.col(flag), F.lit(False)) != F.lit(expr.negated))
            found = (inner.df.select(*shared).distinct() if shared else inner.df.limit(1).select()).withColumn(flag, F.lit(True))
            return Solutions(out.df.join(found, shared, "left") if shared else out.df.join(found, F.lit(True), "left"), out.names, out.maybe)
        if isinstance(expr, Call):
            for x in expr.args:
                out = self.marked(out, x, graph, marks)
        return out

    # expressions
    def expr(self, e, names: list[str], aggregates: dict | None = None) -> Value:
        if isinstance(e, Var):
            return Value("term", F.col(e.name) if e.name in names else F.lit(None).cast("string"))
        if isinstance(e, str):
            return Value("term", F.lit(e), constant=e)
        if aggregates is not None and id(e) in aggregates:
            return aggregates[id(e)]
        if isinstance(e, Exists):
            raise SparqlError("EXISTS stands in filters only")
        f, n = e.name, len(e.args)
        a = [self.expr(x, names, aggregates) for x in e.args] if f not in ("BOUND",) else []
        if f == "BOUND":
            return Value("bool", F.col(e.args[0].name).isNotNull() if e.args[0].name in names else F.lit(False))
        if f in ("&&", "||"):
            return Value("bool", a[0].bool & a[1].bool if f == "&&" else a[0].bool | a[1].bool)
        if f == "!":
            return Value("bool", ~a[0].bool)
        if f in ("=", "!=", "<", ">", "<=", ">="):
            return Value("bool", self.compare(f, a[0], a[1]))
        if f == "IN":
            return Value("bool", functools.reduce(lambda x, y: x | y, (self.compare("=", a[0], x) for x in a[1:]), F.lit(False)))
        if f in ("+", "-", "*", "/"):
            x, y = a[0].num, a[1].num
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: F.when(y != 0, x / y)}[f]()
            exact = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}.get(f)  # beyond 38 digits: null, the double counts
            return Value("num", out, exact(a[0].whole, a[1].whole).cast("decimal(38,0)") if exact else None)
        if f == "neg":
            return Value("num", -a[0].num, -a[0].whole)
        if f == "IF":
            return Value("term", F.when(a[0].bool, a[1].term).when(~a[0].bool, a[2].term))
        if f == "COALESCE":
            return Value("term", F.coalesce(*(x.term for x in a)))
        if f in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
            return Value("bool", {"ISBLANK": T.is_blank, "ISLITERAL": T.is_literal}.get(f, T.is_iri)(a[0].term))
        if f == "ISNUMERIC":
            return Value("bool", F.when(a[0].term.isNotNull(), a[0].num.isNotNull()))
        if f == "SAMETERM":
            return Value("bool", a[0].term == a[1].term)
        if f == "LANGMATCHES":
            tag, want = F.lower(a[0].text), F.lower(a[1].text)
            return Value("bool", F.when(want == "*", tag != "").otherwise((tag == want) | tag.startswith(F.concat(want, F.lit("-")))))
        text = a[0].text if n else None
        strings = {
            "STR": lambda: text, "LANG": lambda: T.lang(a[0].term), "UCASE": lambda: F.upper(text), "LCASE": lambda: F.lower(text),
            "CONCAT": lambda: F.concat(*(x.text for x in a)), "ENCODE_FOR_URI": lambda: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(text), r"\+", "%20"), r"\*", "%2A"), "%7E", "~"),
            "SUBSTR": lambda: text.substr(a[1].num.cast("int"), a[2].num.cast("int") if n > 2 else F.length(text)),
            "REPLACE": lambda: F.regexp_replace(text, F.concat(F.lit(f"(?{self.constant(e.args[3])})") if n > 3 and self.constant(e.args[3]) else F.lit(""), a[1].text), a[2].text),
            "STRBEFORE": lambda: F.when(F.instr(text, self.constant(e.args[1])) > 0, F.substring_index(text, self.constant(e.args[1]), 1)).otherwise(""),
            "STRAFTER": lambda: F.when(F.instr(text, self.constant(e.args[1])) > 0, text.substr(F.instr(text, self.constant(e.args[1])) + len(self.constant(e.args[1])), F.length(text))).otherwise(""),
            "MD5": lambda: F.md5(text), "SHA1": lambda: F.sha1(text), "SHA256": lambda: F.sha2(text, 256), "SHA384": lambda: F.sha2(text, 384), "SHA512": lambda: F.sha2(text, 512),
            "STRUUID": lambda: F.expr("uuid()"), "TZ": lambda: F.regexp_extract(text, r"(Z|[+-]\d\d:\d\d)$", 1),
        }
        if f in strings:
            return Value("str", strings[f]())
        booleans = {
            "CONTAINS": lambda: text.contains(a[1].text), "STRSTARTS": lambda: text.startswith(a[1].text), "STRENDS": lambda: text.endswith(a[1].text),
            "REGEX": lambda: text.rlike(("(?" + self.constant(e.args[2]) + ")" if n > 2 and self.constant(e.args[2]) else "") + self.constant(e.args[1])),
        }
        if f in booleans:
            return Value("bool", booleans[f]())
        # fields as they are written, whatever the zone
        stamp = {"YEAR": r"^(-?\d{4,})-", "MONTH": r"^-?\d{4,}-(\d\d)", "DAY": r"^-?\d{4,}-\d\d-(\d\d)", "HOURS": r"T(\d\d):", "MINUTES": r"T\d\d:(\d\d)", "SECONDS": r"T\d\d:\d\d:(\d\d(?:\.\d+)?)"}
        numbers = {"STRLEN": lambda: F.length(text), "ABS": lambda: F.abs(a[0].num), "CEIL": lambda: F.ceil(a[0].num), "FLOOR": lambda: F.floor(a[0].num), "ROUND": lambda: F.floor(a[0].num + 0.5), "RAND": lambda: F.rand()}
        if f in stamp:
            return Value("num", F.regexp_extract(text, stamp[f], 1).try_cast("double"))
        if f == "TIMEZONE":
            sign, hours, minutes = (F.regexp_extract(text, r"([+-])(\d\d):(\d\d)$", i) for i in (1, 2, 3))
            part = lambda x, unit: F.when(x.try_cast("int") > 0, F.concat(x.try_cast("int").cast("string"), F.lit(unit))).otherwise("")
            length = F.concat(part(hours, "H"), part(minutes, "M"))
            zone = F.when(text.endswith("Z") | ((sign != "") & (length == "")), "PT0S").when(sign != "", F.concat(F.when(sign == "-", "-PT").otherwise("PT"), length))
            return Value("term", T.typed(zone, T.XSD + "dayTimeDuration"))
        if f in numbers:
            return Value("num", numbers[f]().cast("double"))
        others = {
            "DATATYPE": lambda: T.iri(T.datatype(a[0].term)), "IRI": lambda: T.iri(text), "URI": lambda: T.iri(text), "UUID": lambda: T.iri(F.concat(F.lit("urn:uuid:"), F.expr("uuid()"))),
            "NOW": lambda: T.typed(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), T.XSD + "dateTime"), "BNODE": lambda: F.concat(F.lit("_:"), F.expr("uuid()")),
            "STRLANG": lambda: F.concat(F.lit('"'), text, F.lit('"@'), a[1].text), "STRDT": lambda: F.concat(F.lit('"'), text, F.lit('"^^<'), a[1].text, F.lit(">")),
        }
        if f in others:
            return Value("term", others[f]())
        if f.startswith(f"<{T.XSD}"):
            kind = f[len(T.XSD) + 1 : -1]
            if kind == "string":
                return Value("str", text)
            if kind == "boolean":
                return Value("bool", a[0].bool)
            if kind == "integer":
                whole = F.regexp_extract(text, r"^\s*[+-]?\d+", 0).try_cast("decimal(38,0)")
                return Value("num", F.coalesce(whole.cast("double"), F.floor(text.try_cast("double")).cast("double")), whole)
            if kind in ("decimal", "double", "float"):
                return Value("num", text.try_cast("double"))
            return Value("term", F.concat(F.lit('"'), text, F.lit(f'"^^{f}')))
        raise SparqlError(f"unknown function {f}")

    @staticmethod
    def constant(e) -> str:
        if not isinstance(e, str) or not e.startswith('"'):
            raise SparqlError("a constant string is needed here")
        return e[1 : e.rindex('"')]

    def compare(self, op: str, x: Value, y: Value) -> Column:
        """Numbers, strings, booleans, dateTimes and dates with their like; null, an error, where there is no order between two terms.

        Terms of different known kinds are different; a literal of an unknown type is equal to itself, different from what is no literal, and an error otherwise.
        """

        def apply(op, a, b):
            return {"=": a == b, "<": a < b, ">": a > b, "<=": a <= b, ">=": a >= b}[op]

        def values(op):
            for kind in ORDERED:
                if kind in x.kinds and kind in y.kinds:
                    # integers beyond a double's exactness count by their digits
                    if kind == "num" and not (x.small or y.small):
                        yield apply(op, x.whole, y.whole)
                    yield apply(op, x.as_kind(kind), y.as_kind(kind))

        if op not in ("=", "!="):
            return F.coalesce(*values(op), F.lit(None).cast("boolean"))
        a, b = x.term, y.term
        if {"iri", "blank"} & {*x.kinds, *y.kinds}:
            equal = a == b
        else:
            open_ = [T.unknown(v.term) & T.is_literal(w.term) for v, w in ((x, y), (y, x)) if v.kinds == ORDERED or v.kinds == ("other",)]
            rest = F.when(a.isNull() | b.isNull(), None).when(a == b, True)
            if open_:
                rest = rest.when(functools.reduce(lambda p, q: p | q, open_), None)
            equal = F.coalesce(*values("="), rest.otherwise(False))
        return ~equal if op == "!=" else equal

    # queries
    def aggregate(self, call: Call, names: list[str]) -> tuple[str, Column]:
        f = call.name
        if f == "COUNT" and not call.args:
            return "num", (F.count_distinct(F.struct(*names)) if call.distinct else F.count("*")).cast("double")
        v = self.expr(call.args[0], names)
        if f == "COUNT":
            return "num", (F.count_distinct(v.term) if call.distinct else F.count(v.term)).cast("double")
        if f in ("SUM", "AVG"):
            total = F.sum_distinct(v.num) if call.distinct else F.sum(v.num)
            n = F.count_distinct(v.num) if call.distinct else F.count(v.num)
            out = F.coalesce(total if f == "SUM" else total / F.nullif(n, F.lit(0)), F.lit(0.0))
            # a value that is no number is an error, not nothing
            return "num", out if v.kind == "num" else F.when(F.count(v.term) == F.count(v.num), out)
        if f in ("MIN", "MAX"):
            keyed = F.struct(v.num.alias("n"), v.text.alias("x"), v.term.alias("t"))
            return "term", (F.min if f == "MIN" else F.max)(F.when(v.term.isNotNull(), keyed))["t"]
        if f == "SAMPLE":
            return "term", F.min(v.term)
        return "str", F.coalesce(F.array_join(F.array_sort(F.collect_set(v.text) if call.distinct else F.collect_list(v.text)), call.separator), F.lit(""))

    def select(self, q: S.Query, graph=None) -> Solutions:
        out = self.group(q.where, graph)
        if q.values:
            out = self.join(out, self.values(q.values))
        wanted = q.select or [(Var(n), Var(n)) for n in out.names if not n.startswith(("_b", "_n"))]
        every = [e for e, _ in q.select] + q.having + [e for e, _ in q.order_by]
        aggregates: dict | None = None
        if q.group_by or any(map(S.has_aggregate, every)):
            calls: list[Call] = []

            def find(e):
                if isinstance(e, Call):
                    if e.name in S.AGGREGATES:
                        calls.append(e)
                    else:
                        for x in e.args:
                            find(x)

            for e in every:
                find(e)
            keys = [self.expr(e, out.names).term.alias(v.name) for e, v in q.group_by]
            made = [self.aggregate(c, out.names) for c in calls]
            columns = [c.alias(f"_a{i}") for i, (_, c) in enumerate(made)]
            df = out.df.groupBy(*keys).agg(*columns) if columns else out.df.select(*keys).distinct()
            aggregates = {id(c): Value(made[i][0], F.col(f"_a{i}")) for i, c in enumerate(calls)}
            out = Solutions(df, [v.name for _, v in q.group_by], set(out.maybe))
            for h in q.having:
                out.df = out.df.where(F.coalesce(self.expr(h, out.names, aggregates).bool, F.lit(False)))
        df, names = out.df, list(out.names)
        for e, v in wanted:
            if not (isinstance(e, Var) and e.name == v.name and e.name in names):
                df = df.withColumn(v.name, self.expr(e, names, aggregates).term)
                names.append(v.name)
        order = []
        for e, down in q.order_by:
            for key in T.sort_keys(self.expr(e, names, aggregates).term):
                order.append(key.desc_nulls_last() if down else key.asc_nulls_first())
        shown = [v.name for _, v in wanted]
        if q.distinct:
            df = df.select(*shown).distinct()
        if order:
            df = df.orderBy(*order)
        df = df.select(*shown)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Solutions(df, shown, {n for n in shown if n in out.maybe or n not in out.names})


def run(quads: DataFrame, text: str, default_graphs: list[str] = (), named_graphs: list[str] = (), decode: bool = False, disjoint: bool = False) -> DataFrame:
    """Result of a query. SELECT: a column per variable; ASK: one boolean `answer`; CONSTRUCT and DESCRIBE: distinct s, p, o.

    Graph IRIs given by the caller take the place of FROM clauses. decode: lexical forms instead of terms.
    disjoint: the caller knows that no triple stands in more than one graph; then the union of graphs needs no shuffle for duplicates.
    """
    q = S.parse(text)
    compiler = Compiler(quads, list(default_graphs) or q.default_graphs, list(named_graphs) or q.named_graphs, disjoint)
    if q.form == "SELECT":
        out = compiler.select(q).df
        return out.select(*(T.lexical(F.col(c)).alias(c) for c in out.columns)) if decode else out
    if q.form == "ASK":
        found = compiler.group(q.where).df.limit(1)
        return found.agg((F.count("*") > 0).alias("answer"))
    if q.form == "DESCRIBE":
        return describe(compiler, q)
    solutions = compiler.select(S.Query("SELECT", q.where, star=True, order_by=q.order_by, limit=q.limit, offset=q.offset))
    parts = []
    for pattern in q.template:
        columns = []
        for name, node in zip("spo", pattern):
            if isinstance(node, Var) and node.name.startswith(("_b", "_n")):
                columns.append(F.concat(F.lit(f"_:{node.name}_"), F.xxhash64(*solutions.names).cast("string")).alias(name))
            else:
                columns.append(compiler.expr(node, solutions.names).term.alias(name))
        parts.append(solutions.df.select(*columns).where("s is not null and p is not null and o is not null and not startswith(s, '\"') and startswith(p, '<')"))
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def describe(compiler: Compiler, q: S.Query) -> DataFrame:
    """Triples of each resource, and of the blank nodes that they lead to."""
    constants = [t for t in q.describe if isinstance(t, str)]
    seeds = compiler.spark.createDataFrame([(c,) for c in constants], "s string")
    if q.where is not None:
        out = compiler.group(q.where)
        for v in [Var(n) for n in out.names] if q.star else [t for t in q.describe if isinstance(t, Var)]:
            seeds = seeds.unionByName(out.df.select(F.col(v.name).alias("s")))
    triples = compiler.triples(None)
    seeds = seeds.where("s is not null").distinct()
    inside = triples.where("startswith(o, '_:')").select("s", "o")
    nodes = seeds.unionByName(reachable(inside, "s", "o", seeds).select(F.col("o").alias("s"))).distinct()
    return triples.join(nodes, "s", "left_semi").distinct()
