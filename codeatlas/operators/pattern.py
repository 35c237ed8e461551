"""Structural pattern search: a pattern's tree met with the trees of source files, by joins on a table of their nodes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tree as T
from ..functions import text as X
from ..shared import stored

#: The paths that a language's search reads.
PATHS = {
    "typescript": r"\.(ts|tsx|mts|cts)$",
    "javascript": r"\.(js|jsx|mjs|cjs)$",
    "csharp": r"\.cs$",
}


def add_language(name: str, paths: str, grammar: T.Grammar = T.SCRIPT) -> None:
    """Make a language known to the search and to table functions: a regular expression for the paths that it reads, and its grammar."""
    re.compile(paths)
    PATHS[name] = paths
    T.GRAMMARS[name] = grammar


def metavariables(pattern: str) -> list[str]:
    """Names of the metavariables of a pattern, each once."""
    return list(dict.fromkeys(re.findall(r"\$+([A-Z_][A-Z0-9_]*)", pattern)))


@dataclass
class Var:
    """A node that the pattern asks for: what it must be, and where it stands by nodes that are known before it.

    of: the variable whose child it is; next: the sibling before it and whether others may stand between; first, last: whether it
    must be of's first or last child.
    """

    kinds: tuple[str, ...]
    text: str | None = None
    of: int | None = None
    next: tuple[int, bool] | None = None
    first: bool = False
    last: bool = False
    empty: bool | None = None
    least: int = 0


@dataclass
class Plan:
    """The variables of a pattern, from the one that its literals make rarest on, and the stretches of source that its names take."""

    vars: list[Var] = field(default_factory=list)
    names: list[tuple[str, tuple[int, str], tuple[int, str]]] = field(default_factory=list)  # name, where it begins, where it ends: a variable and start, end, inner or rim
    begin: int = 0
    end: tuple[int, str] = (0, "end")


_ANY = ("word", "number", "text", "mark", "group", "chain")


def compiled(pattern: str, language: str = "typescript") -> Plan | None:
    """The plan of a pattern; None if it holds nothing to look for.

    A pattern of one part fits a run of neighbours in a part, whatever stands before and after it, so modifiers do not
    hinder; one that is a chain fits the beginning of a chain; one of several parts fits parts in a row. Below that
    brackets and parts must fit whole. $NAME takes one value: a token, a bracket or a chain, or all of a part
    that it is alone in, or what comes before the members of a chain that it begins; the same text each time. At the end of a
    pattern that begins with a word it takes all that is left of the statement. $$$ and $$$NAME take any number of
    neighbours, as few as possible.
    """
    parts = T.parse(pattern, language, True).children
    plan = Plan()
    if not parts or all(c.kind == "rest" for p in parts for c in p.children):
        return None
    if len(parts) > 1:
        at = _row(plan, parts, None, False, False)
        plan.begin, plan.end = at[0], (at[-1], "end")
        return plan
    row = parts[0].children
    if len(row) == 1 and row[0].kind == "chain":
        plan.vars.append(Var(("chain",)))
        last = _chain(plan, row[0], 0, False)
        plan.end = (last, "end")
        return plan
    at = _row(plan, row, None, False, False)
    plan.begin, plan.end = at[0], (at[-1], "end")
    if row[-1].kind == "meta" and row[0].kind == "word" and len(row) > 1:
        plan.vars.append(Var(("part",), of=-1 - at[-1]))  # the part that holds the last node
        plan.names[-1] = (plan.names[-1][0], (at[-1], "start"), (len(plan.vars) - 1, "end"))
        plan.end = (len(plan.vars) - 1, "end")
    return plan


def _row(plan: Plan, row: list[T.Node], of: int | None, first: bool, last: bool) -> list[int]:
    """Variables for neighbours; the places of those that are not gaps. first, last: whether they must be all that of holds on that side."""
    at, gap, rest = [], False, None
    for n, node in enumerate(row):
        sole = node.kind == "part" and len(node.children) == 1
        if node.kind == "rest" or sole and node.children[0].kind == "rest":
            name = (node if node.kind == "rest" else node.children[0]).text[3:]
            gap = True
            rest = (name, at[-1] if at else None)
            continue
        i = len(plan.vars)
        plan.vars.append(Var(("part",) if node.kind == "part" else _kinds(node), node.text if node.kind not in ("part", "chain", "meta") else None, of, (at[-1], gap) if at else None, first and not at and not gap))
        if rest and rest[0]:
            plan.names.append((rest[0], (rest[1], "end") if rest[1] is not None else (of, "inner") if of is not None else (i, "start"), (i, "start")))
        gap, rest = False, None
        at.append(i)
        if node.kind == "meta":
            plan.names.append((node.text[1:], (i, "start"), (i, "end")))
        elif sole and node.children[0].kind == "meta":
            plan.names.append((node.children[0].text[1:], (i, "start"), (i, "end")))
        elif node.kind == "part":
            _row(plan, node.children, i, True, True)
        elif node.kind == "group":
            if node.children:
                _row(plan, node.children, i, True, True)
            else:
                plan.vars[i].empty = True
        elif node.kind == "chain":
            _chain(plan, node, i, True)
    if at and last and not gap:
        plan.vars[at[-1]].last = True
    if rest and rest[0]:
        begin = (rest[1], "end") if rest[1] is not None else (of, "inner")
        if of is not None:
            plan.names.append((rest[0], begin, (of, "rim")))
    return at


def _chain(plan: Plan, chain: T.Node, i: int, whole: bool) -> int:
    """Variables for the links of a chain; the place of the last. A name at the beginning takes all links before the others."""
    row = chain.children
    if row[0].kind == "meta":
        at = _row(plan, row[1:], i, False, whole)
        plan.vars[at[0]].least = 1
        plan.names.append((row[0].text[1:], (i, "start"), (at[0], "before")))
    else:
        at = _row(plan, row, i, True, whole)
    return at[-1]


def _kinds(node: T.Node) -> tuple[str, ...]:
    return _ANY if node.kind == "meta" else (node.kind,)


def _fits(v: Var) -> Column:
    """What a variable asks of a node by itself."""
    asked = F.col("kind").isin(*v.kinds)
    if v.text is not None:
        asked &= F.col("text") == v.text
    if v.empty:
        asked &= F.col("n") == 0
    if v.first:
        asked &= F.col("ord") == 0
    if v.least:
        asked &= F.col("ord") >= v.least
    return asked


def _rank(v: Var) -> tuple:
    """Rarest first: words, other tokens, then nodes without a text of their own."""
    return (v.text is None, "word" not in v.kinds, v.kinds == _ANY)


def matches(nodes: DataFrame, plan: Plan) -> DataFrame:
    """path, line, col, start, end and names (name to begin and end) of every place that a plan fits, from a table of nodes (path, tree.NODES).

    The rarest token of the pattern is looked up first. From it each join adds a node that stands to a known one as a
    parent, a child or a sibling: equalities of path and number, and of place but where the pattern leaves a gap.
    """
    columns = ["pre", "parent", "ord", "n", "start", "end", "line", "col"]

    def rows(i: int) -> DataFrame:
        return nodes.filter(_fits(plan.vars[i])).select("path", F.struct(*columns).alias(f"v{i}"))

    links = _links(plan)
    known = [min(range(len(plan.vars)), key=lambda i: (_rank(plan.vars[i]), i))]
    found = rows(known[0])
    while len(known) < len(plan.vars):
        near = [(a, b, how) for a, b, how in links if a in known and b not in known]
        a, b, how = min(near, key=lambda x: (_rank(plan.vars[x[1]]), x[1]))
        va, vb = F.col(f"v{a}"), F.col(f"v{b}")
        other = rows(b)
        keys = {"child": [vb["parent"] == va["pre"]], "parent": [vb["pre"] == va["parent"]], "after": [vb["parent"] == va["parent"], vb["ord"] == va["ord"] + 1], "later": [vb["parent"] == va["parent"], vb["ord"] > va["ord"]], "before": [vb["parent"] == va["parent"], vb["ord"] == va["ord"] - 1], "sooner": [vb["parent"] == va["parent"], vb["ord"] < va["ord"]]}[how]
        here = other.withColumnRenamed("path", "__path")
        condition = F.col("path") == F.col("__path")
        for k in keys:
            condition &= k
        found = found.join(here, condition).drop("__path")
        known.append(b)
        for c, d, other_how in links:  # whatever else ties the new node to known ones
            if d == b and c in known and c not in (a, b) and other_how in ("child", "after", "later"):
                vc = F.col(f"v{c}")
                tie = {"child": vb["parent"] == vc["pre"], "after": (vb["parent"] == vc["parent"]) & (vb["ord"] == vc["ord"] + 1), "later": (vb["parent"] == vc["parent"]) & (vb["ord"] > vc["ord"])}[other_how]
                found = found.filter(tie)
            if c == b and d in known and d not in (a, b) and other_how in ("child", "after", "later"):
                vd = F.col(f"v{d}")
                tie = {"child": vd["parent"] == vb["pre"], "after": (vd["parent"] == vb["parent"]) & (vd["ord"] == vb["ord"] + 1), "later": (vd["parent"] == vb["parent"]) & (vd["ord"] > vb["ord"])}[other_how]
                found = found.filter(tie)
    for i, v in enumerate(plan.vars):
        if v.last:
            found = found.filter(F.col(f"v{i}.ord") == F.col(f"v{v.of}.n") - 1)
    first = F.col(f"v{plan.begin}")
    places = F.struct(*(F.col(f"v{i}.ord").alias(f"o{i}") for i in range(len(plan.vars))))
    names = F.array(*(F.struct(F.lit(n).alias("name"), _edge(*a).alias("begin"), _edge(*b).alias("end")) for n, a, b in plan.names)) if plan.names else F.array().cast("array<struct<name:string,begin:int,end:int>>")
    row = F.struct(first["line"].alias("line"), first["col"].alias("col"), first["start"].alias("start"), _edge(*plan.end).alias("end"), names.alias("names"))
    return found.groupBy("path", first["pre"].alias("pre")).agg(F.min_by(row, places).alias("m")).select("path", "m.*")


def _edge(i: int, side: str) -> Column:
    v = F.col(f"v{i}")
    return {"start": v["start"], "end": v["end"], "before": v["start"], "inner": v["start"] + 1, "rim": v["end"] - 1}[side]


def _links(plan: Plan) -> list[tuple[int, int, str]]:
    """How variables stand to each other, both ways."""
    out = []
    for i, v in enumerate(plan.vars):
        if v.of is not None and v.of >= 0:
            out += [(v.of, i, "child"), (i, v.of, "parent")]
        elif v.of is not None:
            out += [(-1 - v.of, i, "parent"), (i, -1 - v.of, "child")]
        if v.next:
            j, gap = v.next
            out += [(j, i, "later" if gap else "after"), (i, j, "sooner" if gap else "before")]
    return out


def candidates(contents: DataFrame, language: str) -> DataFrame:
    """The rows (path, content) that a language's search reads: its extensions, without declaration files."""
    path: Column = F.col("path")
    return contents.filter(path.rlike(PATHS[language]) & ~path.endswith(".d.ts"))


def clamp(limit: object, most: int = 500, default: int = 50) -> int:
    """A limit between 1 and most; what is no number counts as default."""
    try:
        return min(most, max(1, int(float(limit))))
    except (TypeError, ValueError, OverflowError):
        return default


#: The most and the usual number of results of each kind of answer.
LIMITS = {"pattern_route": (500, 50), "pattern": (200, 50), "search": (50, 20), "neighbours": (100, 30)}


def limit_of(kind: str, limit: object = None) -> int:
    """A limit for one kind of answer: its usual number without one, and within its bounds otherwise."""
    most, default = LIMITS[kind]
    return default if limit is None else clamp(limit, most, default)


def search(contents: DataFrame, pattern: str, language: str, nodes: DataFrame | None = None) -> DataFrame:
    """path, line, column, text, captures of every match in the files (path, content) of a language.

    nodes are the files' nodes if they are known already; else files that hold every word of the pattern are read into trees. What
    a match and its names take is cut from the contents of the files that match.
    """
    rows = candidates(contents, language)
    plan = compiled(pattern, language)
    shape = "path string, line int, column int, text string, captures map<string,string>"
    if plan is None:
        return contents.sparkSession.createDataFrame([], shape)
    words = {v.text for v in plan.vars if v.text is not None and v.kinds != ("group",)}
    rows = rows.filter(X.all_of([F.col("content").contains(w) for w in sorted(words)]))
    nodes = stored(T.nodes(rows, language), "nodes") if nodes is None else nodes
    found = matches(nodes, plan).join(rows.select("path", "content"), "path")

    def cut(begin: Column, end: Column) -> Column:
        return F.substring(F.col("content"), begin + 1, F.greatest(end - begin, F.lit(0)))

    def bare(text: Column) -> Column:
        return F.regexp_replace(text, r"^[\s,;]+|[\s,;]+$|[\s]*(\?\.|\.)$", "")

    taken = F.transform("names", lambda x: F.struct(x["name"].alias("name"), bare(cut(x["begin"], x["end"])).alias("text")))
    out = found.select("path", "line", F.col("col").alias("column"), cut(F.col("start"), F.col("end")).alias("text"), taken.alias("taken"))
    said = lambda x: F.struct(x["name"], F.regexp_replace(x["text"], r"\s+", ""))
    same = F.size(F.array_distinct(F.transform("taken", said))) == F.size(F.array_distinct(F.transform("taken", lambda x: x["name"])))
    first = F.filter("taken", lambda x, i: ~F.exists(F.slice("taken", 1, i), lambda y: y["name"] == x["name"]))
    return out.filter(same).select("path", "line", "column", "text", F.map_from_entries(first).alias("captures"))


def first(matches: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The limit first matches by path and place, and whether there are more. They are found once and stored."""
    limit = clamp(limit)
    some = stored(matches.orderBy("path", "line", "column").limit(limit + 1), "first")
    return some.orderBy("path", "line", "column").limit(limit), some.count() > limit
