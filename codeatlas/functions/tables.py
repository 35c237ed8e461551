"""Table functions for SQL: nodes, symbols and metadata of the source files in a table, for all languages that are known when they are registered.

    SELECT * FROM syntax_nodes(TABLE(SELECT path, language, content FROM files) PARTITION BY path)
    SELECT * FROM file_symbols(TABLE(SELECT path, language, content FROM files) PARTITION BY path)

Spark deals the rows of the table to the functions by path, so files are read side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from . import tree as T
from .symbols import ts_symbols

_NODES = f"path string, {T.NODES}"
_SYMBOLS = "path string, name string, kind string, line int, exported boolean"
_SCRIPTS = ("typescript", "javascript", "tsx", "jsx")


def declared(source: str, grammar: T.Grammar) -> Iterator[tuple]:
    """name, kind, line, exported of what the parts of a source declare, by the declaring words of a grammar."""
    root = T.parse(source, grammar)
    ends = T.line_ends(source)
    todo = [root]
    while todo:
        group = todo.pop()
        inner = []
        for part in group.children:
            row = T.flat(part)
            at = next((i for i, t in enumerate(row) if t.kind == "word" and t.text in grammar.declares), None)
            if at is not None and at + 1 < len(row) and row[at + 1].kind == "word":
                public = any(t.text in grammar.exports for t in row[:at])
                yield row[at + 1].text, grammar.declares[row[at].text], T.line_of(part, ends), public
            inner += [c for c in row if c.kind == "group" and c.text == "{"]
        todo += reversed(inner)


def register(spark: SparkSession) -> None:
    """Make the table functions known to a session, with the languages that are known now."""
    grammars = dict(T.GRAMMARS)

    @udtf(returnType=_NODES)
    class SyntaxNodes:
        def eval(self, file: Row) -> Iterator[tuple]:
            if file["content"] is not None and file["language"] in grammars:
                for row in T.numbered(T.parse(file["content"], grammars[file["language"]]), file["content"]):
                    yield file["path"], *row

    @udtf(returnType=_SYMBOLS)
    class FileSymbols:
        def eval(self, file: Row) -> Iterator[tuple]:
            content, language = file["content"], file["language"]
            if content is None or language not in grammars:
                return
            if language in _SCRIPTS:
                for s in ts_symbols(content):
                    yield file["path"], s["name"], s["kind"], s["line"], s["exported"]
            else:
                for found in declared(content, grammars[language]):
                    yield file["path"], *found

    spark.udtf.register("syntax_nodes", SyntaxNodes)
    spark.udtf.register("file_symbols", FileSymbols)
