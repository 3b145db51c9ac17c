"""Triples(s, p, o, g): building them, and graph patterns as joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import escape_literal

# fixed values: classes of the kinds of symbols
RDF_CLASS = {"function": "Function", "method": "Method", "constructor": "Method", "class": "Class", "struct": "Struct", "enum": "Enum", "interface": "Trait", "trait": "Trait", "module": "Module", "namespace": "Module", "package": "Module", "constant": "Constant", "variable": "Variable", "field": "Variable", "parameter": "Variable"}


def triples_of(df: DataFrame, subject: Column, pairs: dict[str, Column], graph: Column | None = None) -> DataFrame:
    """One row for each non-null value: the row's subject, a predicate and the value as text; a single pass."""
    made = F.array(*[F.struct(F.lit(p).alias("p"), c.cast("string").alias("o")) for p, c in pairs.items()])
    return df.select(subject.cast("string").alias("s"), F.explode(made).alias("t"), (graph if graph is not None else F.lit("default")).alias("g")).select("s", "t.p", "t.o", "g").where("o is not null")


def symbol_triples(symbols: DataFrame) -> DataFrame:
    """Triples of symbols(repo, path, name, kind, start_line, end_line, signature)."""
    kind = F.lit("Symbol")
    for k, v in RDF_CLASS.items():
        kind = F.when(F.col("kind") == k, v).otherwise(kind)
    me = F.concat_ws("/", F.lit("urn:code"), "repo", "path", F.concat(F.col("name"), F.lit("#L"), F.col("start_line")))
    return triples_of(symbols, me, {"type": kind, "name": F.col("name"), "kind": F.col("kind"), "filePath": F.col("path"), "startLine": F.col("start_line"), "endLine": F.col("end_line"), "signature": F.col("signature")}, F.col("repo")).unionByName(
        symbols.select(F.concat_ws("/", F.lit("urn:code"), "repo", "path").alias("s"), F.lit("definesSymbol").alias("p"), me.alias("o"), F.col("repo").alias("g"))
    )


Pattern = tuple[str, str, str]


def match(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Bindings of a basic graph pattern: '?x' is a variable, all else a constant.

    Each pattern is a filtered, pruned scan; patterns meet in natural joins on the variables they share, those with
    a variable in common with what is bound first, so that no cross product arises. Patterns without a shared variable are refused.
    """
    left: DataFrame | None = None
    todo = list(patterns)
    while todo:
        bound = set() if left is None else set(left.columns)
        at = next((i for i, p in enumerate(todo) if not bound or bound & {x[1:] for x in p if x.startswith("?")}), None)
        if at is None:
            raise ValueError("the pattern falls into parts that share no variable")
        pattern = todo.pop(at)
        rows, cols, seen = triples, [], {}
        for place, term in zip("spo", pattern):
            if not term.startswith("?"):
                rows = rows.where(F.col(place) == term)
            elif term[1:] in seen:
                rows = rows.where(F.col(place) == F.col(seen[term[1:]]))
            else:
                seen[term[1:]] = place
                cols.append(F.col(place).alias(term[1:]))
        rows = rows.select(*cols)
        left = rows if left is None else left.join(rows, sorted(set(left.columns) & set(rows.columns)))
    return left


# fixed values: the named queries and what they ask for
TEMPLATES: dict[str, str] = {
    "find_functions": "SELECT ?name ?file ?line WHERE { ?f type Function . ?f name ?name . ?f filePath ?file . ?f startLine ?line }",
    "find_functions_by_name": "SELECT ?name ?file ?line WHERE { ?f type Function . ?f name ?name . ?f filePath ?file . ?f startLine ?line . FILTER(CONTAINS(LCASE(?name), '{name}')) }",
    "find_calls": "SELECT ?caller ?callee WHERE { ?a calls ?b . ?a name ?caller . ?b name ?callee }",
    "find_security_findings": "SELECT ?rule ?severity ?file WHERE { ?f ruleId ?rule . ?f severity ?severity . ?f filePath ?file }",
    "find_symbols_in_file": "SELECT ?name ?kind WHERE { ?s filePath {file} . ?s name ?name . ?s kind ?kind }",
    "find_imports": "SELECT ?from ?to WHERE { ?from imports ?to }",
}

_QUERY = re.compile(r"^\s*(?:PREFIX\s+\S+\s+\S+\s+)*(SELECT|ASK)\s*(DISTINCT)?\s*(.*?)\s*(?:WHERE)?\s*\{(.*)\}\s*(.*)$", re.I | re.S)


def sparql(triples: DataFrame, query: str, limit: int | None = 1000, offset: int = 0) -> DataFrame:
    """SELECT and ASK with basic graph patterns, UNION, FILTER (CONTAINS, LCASE, =, !=, <, >), ORDER BY, LIMIT and OFFSET.

    limit holds where the query names none; with a limit of None such a query gives all its rows.
    """
    m = _QUERY.match(query)
    if not m:
        raise ValueError("not a query this engine reads")
    form, distinct, what, body, tail = m.groups()
    sides = re.findall(r"\{([^{}]*)\}", body) if re.search(r"\bUNION\b", body, re.I) else [body]
    result: DataFrame | None = None
    for side in sides:
        filters = re.findall(r"FILTER\s*\((.*?)\)\s*(?=\.|$|\n|FILTER)", side, re.I | re.S)
        rest = re.sub(r"FILTER\s*\(.*?\)\s*(?=\.|$|\n|FILTER)", "", side, flags=re.I | re.S)
        patterns = [tuple(x.strip("<>'\"") for x in re.findall(r"\?\w+|<[^>]+>|'[^']*'|\"[^\"]*\"|[^\s.]\S*", part))[:3] for part in re.split(r"\s\.\s|\s\.$|;\s", f"{rest.strip()} ") if part.strip(" .")]
        rows = match(triples, patterns)
        for f in filters:
            sql = re.sub(r"\bLCASE\b", "lower", re.sub(r"\bCONTAINS\b", "contains", f, flags=re.I), flags=re.I)
            rows = rows.where(re.sub(r"\?(\w+)", r"`\1`", sql))
        result = rows if result is None else result.unionByName(rows, allowMissingColumns=True)
    if form.upper() == "ASK":
        return result.limit(1).agg((F.count("*") > 0).alias("answer"))
    names = re.findall(r"\?(\w+)", what)
    result = result.select(*names) if names else result
    if distinct:
        result = result.distinct()
    order = re.search(r"ORDER\s+BY\s+((?:(?:ASC|DESC)?\s*\(?\?\w+\)?\s*)+)", tail, re.I)
    if order:
        keys = re.findall(r"(ASC|DESC)?\s*\(?\?(\w+)\)?", order[1], re.I)
        result = result.orderBy(*[F.desc(n) if d.upper() == "DESC" else F.asc(n) for d, n in keys])
    skip, most = re.search(r"OFFSET\s+(\d+)", tail, re.I), re.search(r"LIMIT\s+(\d+)", tail, re.I)
    result = result.offset(int(skip[1]) if skip else offset)
    return result if not most and limit is None else result.limit(min(int(most[1]) if most else limit, 10000))


def run_template(triples: DataFrame, name: str, limit: int | None = 1000, **params: str) -> DataFrame:
    """The named query with its parameters filled in; a limit of None gives all rows."""
    query = TEMPLATES[name]
    for k, v in params.items():
        if not re.fullmatch(r"[\w./:#-]*", v):
            raise ValueError(f"parameter {k} holds characters that are not allowed")
        query = query.replace("{" + k + "}", v)
    return sparql(triples, query, limit)


def nquads(triples: DataFrame) -> DataFrame:
    """One N-Quads line for each triple; objects that are URNs or URLs become references."""
    o = F.when(F.col("o").rlike(r"^(urn:|https?://)\S+$"), F.concat(F.lit("<"), F.col("o"), F.lit(">"))).otherwise(F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"')))
    return triples.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <urn:code:"), F.col("p"), F.lit("> "), o, F.lit(" <urn:graph:"), F.col("g"), F.lit("> .")).alias("value"))


def parse_nquads(lines: DataFrame) -> DataFrame:
    """Triples of lines(value) that nquads() wrote; lines of another form are left out."""
    p = r'^<([^>]*)> <urn:code:([^>]*)> (?:<([^>]*)>|"((?:[^"\\]|\\.)*)") <urn:graph:([^>]*)> \.$'
    part = lambda i: F.regexp_extract("value", p, i)
    plain = part(4)
    for a, b in (("\\\\", "\0"), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"'), ("\0", "\\")):
        plain = F.replace(plain, F.lit(a), F.lit(b))
    return lines.where(F.col("value").rlike(p)).select(part(1).alias("s"), part(2).alias("p"), F.when(part(3) != "", part(3)).otherwise(plain).alias("o"), part(5).alias("g"))
