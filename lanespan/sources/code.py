"""Source code as tables: functions and the calls in them, by syntax tree, and the statement that a kernel's frame dispatches from.

Files are parsed one by one where Spark has put them; all else is joins. A file that does not parse has no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BODY, STATEMENT = 25, 6
SCHEMA = "path string, kind string, name string, def_line int, begin int, end int, token string, line int, text string, branch string"


def files(spark: SparkSession, pattern: str, roots: list[str] | None = None) -> DataFrame:
    """path, text of the files that match; the first of the roots that a path begins with is left out of it."""
    path = F.regexp_replace(F.input_file_name(), "^file:/*", "/")
    for r in roots or []:
        path = F.when(path.startswith(r), F.substring(path, len(r.rstrip("/")) + 2, 10_000)).otherwise(path)
    return spark.read.text(pattern, wholetext=True).select(path.alias("path"), F.col("value").alias("text"))


def called(node: ast.expr) -> str | None:
    """The last name of what is called: f(x), a.b.f(x), f[grid](x)."""
    while isinstance(node, ast.Subscript):
        node = node.value
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


class Reader(ast.NodeVisitor):
    """Rows of one file."""

    def __init__(self, path: str, text: str):
        self.path, self.lines, self.rows = path, text.splitlines(), []
        self.functions: list[tuple] = []
        self.tests: list[str] = []

    def taken(self, first: int, last: int) -> str:
        return "\n".join(x.rstrip() for x in self.lines[first - 1 : last]).rstrip("\n")

    def visit_FunctionDef(self, node) -> None:
        documented = isinstance(node.body[0], ast.Expr) and isinstance(node.body[0].value, ast.Constant) and isinstance(node.body[0].value.value, str)
        begin = node.body[0].end_lineno + 1 if documented else node.body[0].lineno
        begin = min(begin, node.end_lineno)
        own = (node.name, node.lineno, begin, node.end_lineno)
        self.rows.append((self.path, "def", *own, None, None, self.taken(begin, min(node.end_lineno, begin + BODY - 1)), None))
        self.functions.append(own)
        outer, self.tests = self.tests, []
        for child in node.body:
            self.visit(child)
        self.functions.pop()
        self.tests = outer

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_If(self, node: ast.If) -> None:
        self.statement(node.test, node.lineno, node.test.end_lineno)
        self.tests.append(self.lines[node.lineno - 1].strip())
        for child in node.body:
            self.visit(child)
        self.tests.pop()
        for child in node.orelse:
            self.visit(child)

    def generic_visit(self, node: ast.AST) -> None:
        inner = [c for field in ("body", "orelse", "handlers", "finalbody", "cases") for c in getattr(node, field, None) or [] if isinstance(c, ast.AST)] if isinstance(node, (ast.stmt, ast.excepthandler, ast.Module, ast.match_case)) else []
        if isinstance(node, ast.stmt) and not isinstance(node, ast.ClassDef):
            first = inner[0].lineno - 1 if inner and hasattr(inner[0], "lineno") else node.end_lineno
            self.statement(node, node.lineno, max(node.lineno, first))
        for child in inner:
            self.visit(child)

    def statement(self, node: ast.AST, first: int, last: int) -> None:
        todo, names = [node], []
        while todo:  # the statement's own expressions, not the statements within it
            n = todo.pop()
            if isinstance(n, ast.Call) and (name := called(n.func)):
                names.append(name)
            todo += [c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.stmt, ast.excepthandler, ast.match_case))]
        for own in self.functions:
            for name in dict.fromkeys(names):
                self.rows.append((self.path, "call", *own, name, first, self.taken(first, min(last, first + STATEMENT - 1)), self.tests[-1] if self.tests else None))


def index(sources: DataFrame) -> DataFrame:
    """The functions (kind def; text: the first lines of the body without its docstring) and calls (kind call; text: the statement, branch: the condition it depends on) of files (path, text)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            rows = []
            for path, text in zip(b["path"], b["text"], strict=True):
                r = Reader(path, text or "")
                try:
                    r.visit(ast.parse(text or ""))
                except (SyntaxError, ValueError):
                    continue
                rows += r.rows
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({"line": "Int32", "def_line": "Int32", "begin": "Int32", "end": "Int32"})

    return sources.select("path", "text").mapInPandas(read, SCHEMA)


def call_tokens(after: Column, op: Column, leaf: Column) -> Column:
    """Names that tell the dispatching statement, the most specific first: functions of the frames behind it, the operator and its last part, the kernel's name, without kernel endings, and without its first words."""
    base = F.regexp_replace(leaf, r"_kernel(_v\d+)?(_persist)?$", "")
    words = F.split(base, "_")
    shorter = F.transform(F.array(F.lit(1), F.lit(2)), lambda k: F.when(k < F.size(words), F.array_join(F.slice(words, k + 1, F.greatest(F.lit(1), F.size(words))), "_")))
    known = F.when(F.coalesce(op, F.lit("")).contains("unknown"), F.lit(None)).otherwise(op)
    all_ = F.concat(F.coalesce(after, F.array().cast("array<string>")), F.array(known, F.substring_index(known, "::", -1), leaf, base), F.coalesce(shorter, F.array().cast("array<string>")), F.array(F.regexp_replace(base, "_impl$", "")))
    return F.array_distinct(F.filter(all_, lambda x: F.coalesce(x != "", F.lit(False))))


def resolved(entries: DataFrame, code: DataFrame) -> DataFrame:
    """entries (id, path, function, hint, tokens) with def_line, drift, line, snippet, branch, body, evidence.

    Of functions of that name the nearest to the hinted line counts; in it the first call of the first token that is called.
    Without one the beginning of the body is given. Evidence: statement, body, no function, or no file.
    """
    named = code.withColumnsRenamed({"path": "__path", "name": "__name"})
    pairs = entries.join(named.where("kind = 'def'"), (F.col("path") == F.col("__path")) & (F.col("function") == F.col("__name")))
    near = pairs.groupBy("id").agg(F.min(F.struct(F.abs(F.col("def_line") - F.col("hint")).alias("off"), "def_line", F.col("text").alias("body"))).alias("d")).select("id", "d.def_line", "d.body")
    asked = entries.select("id", "path", "function", F.posexplode("tokens").alias("rank", "asked")).join(near.select("id", F.col("def_line").alias("__def")), "id")
    calls = named.where("kind = 'call'")
    hit = asked.join(calls, (F.col("path") == F.col("__path")) & (F.col("function") == F.col("__name")) & (F.col("__def") == F.col("def_line")) & (F.col("asked") == F.col("token")))
    hit = hit.groupBy("id").agg(F.min(F.struct("rank", "line", F.col("text").alias("snippet"), "branch")).alias("c")).select("id", "c.line", "c.snippet", "c.branch")
    there = code.select(F.col("path").alias("__file")).distinct()
    x = entries.join(near, "id", "left").join(hit, "id", "left").join(there, F.col("path") == F.col("__file"), "left")
    evidence = F.when(F.col("line").isNotNull(), "statement").when(F.col("def_line").isNotNull(), "body").when(F.col("__file").isNotNull(), "no function").otherwise("no file")
    return x.select("id", "def_line", (F.col("def_line") != F.col("hint")).alias("drift"), "line", "snippet", "branch", F.when(F.col("line").isNull(), F.col("body")).alias("body"), evidence.alias("evidence"))


def coverage(rows: DataFrame) -> DataFrame:
    """Counts over resolved(): total, found functions, statements, bodies only, drifted, unresolved."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count("def_line").alias("functions"), F.count("line").alias("statements"), F.count("body").alias("bodies"), F.count_if("drift").alias("drifted"), F.count_if(F.col("def_line").isNull()).alias("unresolved"))
