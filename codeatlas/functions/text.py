"""Column functions on paths, names and texts. All of them stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File extensions that are never indexed.
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".svg", ".webp", ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".zip", ".tar",
    ".gz", ".bz2", ".7z", ".rar", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".exe", ".dll", ".so", ".dylib", ".o", ".a",
    ".woff", ".woff2", ".ttf", ".eot", ".lock", ".bin", ".dat", ".db", ".sqlite",
]
#: Extension to language.
LANGUAGES = {
    ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".py": "python", ".rb": "ruby", ".go": "go",
    ".rs": "rust", ".java": "java", ".kt": "kotlin", ".cs": "csharp", ".cpp": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".swift": "swift",
    ".php": "php", ".sql": "sql", ".sh": "shell", ".bash": "shell", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml",
    ".md": "markdown", ".html": "html", ".css": "css", ".scss": "scss",
}
MAX_FILE_BYTES = 2 * 1024 * 1024


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def lit_array(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_path(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The last extension in lower case, with its dot; empty for none and for names that only begin with a dot."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.try_element_at(table, extension(path))


def is_binary(path: Column) -> Column:
    return extension(path).isin(BINARY_EXTENSIONS)


def cluster_key(path: Column) -> Column:
    """The first two segments of a path."""
    return F.substring_index(path, "/", 2)


def folder_key(path: Column, most: int = 4) -> Column:
    """The first directory segments, most of them at most; (root) for files outside directories."""
    folder = F.array_join(F.slice(F.split(dir_path(path), "/"), 1, most), "/")
    return F.when(folder == "", F.lit("(root)")).otherwise(folder)


def file_type(path: Column) -> Column:
    """The extension without its dot, a dot file's own name, or (no ext)."""
    name = file_name(path)
    return F.when(name.rlike(r"^\.[^.]+$"), F.lower(name)).when(extension(path) != "", extension(path)).otherwise(F.lit("(no ext)"))


def name_tokens(name: Column, separators: str = "[-_]+") -> Column:
    """Words of an identifier in lower case: cut at case changes, separators and white space."""
    spaced = F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(F.regexp_replace(spaced, separators, " ")), r"\s+"), lambda x: x != "")


def evidence_tokens(name: Column) -> Column:
    """Like name_tokens(); dots and slashes part words too."""
    return name_tokens(name, "[-_./]+")


def has(text: Column, term: str) -> Column:
    """Whether a lower-case term occurs in the text, as it stands and not as a pattern."""
    return F.coalesce(F.lower(text).contains(F.lit(term)), F.lit(False))


def any_has(texts: Column, term: str) -> Column:
    return F.coalesce(F.exists(texts, lambda x: has(x, term)), F.lit(False))


def _best(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def export_match(exports: Column, term: str) -> Column:
    """2 if an export is the term, 1 if one holds it, else 0."""
    return _best(F.transform(exports, lambda e: F.when(F.lower(e) == term, 2.0).when(has(e, term), 1.0).otherwise(0.0)))


def symbol_match(symbols: Column, term: str) -> Column:
    """2.5 if a symbol's name is the term, 1.5 if one of its words is, 1 if the name holds it, else 0."""
    score = lambda n: F.when(F.lower(n) == term, 2.5).when(F.array_contains(name_tokens(n), term), 1.5).when(has(n, term), 1.0).otherwise(0.0)
    return _best(F.transform(symbols, lambda s: score(s["name"])))


def snippet(text: Column, term: str, around: int = 24) -> Column:
    """What surrounds the first place of the term; null without one."""
    at = F.instr(F.lower(text), term)
    start = F.greatest(F.lit(1), at - around)
    return F.when(at > 0, trimmed(F.substring(text, start, at + len(term) + around - start)))


def normal_path(path: Column) -> Column:
    """A path without empty and . segments; .. goes one up, and nowhere at the root."""
    segments = F.filter(F.split(path, "/"), lambda s: (s != "") & (s != "."))
    step = lambda up, s: F.when(s == "..", F.slice(up, 1, F.greatest(F.size(up) - 1, F.lit(0)))).otherwise(F.concat(up, F.array(s)))
    return F.array_join(F.aggregate(segments, F.array().cast("array<string>"), step), "/")


def json_texts(json: Column) -> Column:
    """A JSON array of strings; the empty array for null, invalid JSON and other values."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def json_symbols(json: Column) -> Column:
    """A JSON array of symbols without those that lack a field of the right type."""
    parsed = F.coalesce(F.from_json(json, "array<struct<name:string,kind:string,line:int,exported:boolean>>"), F.array())
    whole = lambda s: s["name"].isNotNull() & s["kind"].isNotNull() & s["line"].isNotNull() & s["exported"].isNotNull()
    return F.filter(parsed, whole)


def capped_json(text: Column, cap: int = 262_144) -> Column:
    """text of cap characters at most; a longer one ends with a note of how much is left out."""
    note = lambda kept: F.concat(F.lit("... [truncated "), (F.length(text) - kept).cast("string"), F.lit(" chars]"))
    kept = F.greatest(F.lit(0), F.lit(cap) - F.length(note(F.lit(0))))
    return F.when(F.length(text) <= cap, text).otherwise(F.concat(F.left(text, kept), note(kept)))


def identity_key(root_path: Column, remote_url: Column) -> Column:
    """SHA-256 of the normal form of a remote URL, or of the root path without one."""
    url = trimmed(remote_url)
    bare = F.when(url.rlike(r"^[\w-]+@[\w.-]+:.+$"), F.regexp_replace(url, r"^[\w-]+@([\w.-]+):(.+)$", "$1/$2")).otherwise(F.regexp_replace(url, "^https?://", ""))
    normal = F.lower(F.regexp_replace(F.regexp_replace(bare, r"\.git$", ""), "/$", ""))
    return F.sha2(F.when(F.coalesce(remote_url, F.lit("")) != "", normal).otherwise(root_path), 256)


def like_path(path: Column, part: str, wildcards: bool = True) -> Column:
    """Case-insensitive search in a path; % and _ in part are wildcards unless wildcards is false."""
    if wildcards:
        return path.ilike(f"%{part}%")
    return F.lower(path).contains(part.lower())


def query_terms(query: str, distinct: bool = True) -> list[str]:
    """The terms of a query, parted by bars; equal ones (in lower case) count once unless distinct is false."""
    terms = [t.strip() for t in query.split("|") if t.strip()]
    first: dict[str, str] = {}
    for t in terms:
        first.setdefault(t.lower(), t)
    return list(first.values()) if distinct else terms


def sphere_point(i: Column, n: Column) -> Column:
    """Point i of n on a unit sphere, by the golden angle: struct x, y, z."""
    y = F.lit(1.0) - F.try_divide(i * 2.0, F.greatest(n - 1, F.lit(1)))
    ring = F.sqrt(F.greatest(F.lit(0.0), 1 - y * y))
    turn = i * F.lit(3.141592653589793 * (3 - 5**0.5))
    return F.struct((F.cos(turn) * ring).alias("x"), y.alias("y"), (F.sin(turn) * ring).alias("z"))


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def all_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns, F.lit(True))


def sum_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))
