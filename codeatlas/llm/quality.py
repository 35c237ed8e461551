"""Quality rules, line first: lines are judged one by one, documents by what is left of them."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import BLANKS, sliced

SYMBOLS = "#*$%&|<>"
#: Phrases of page furniture, in lower case.
BOILERPLATE = (
    "accept cookies",
    "all rights reserved",
    "click here",
    "enable javascript",
    "log in",
    "privacy policy",
    "sign up",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
    "we use cookies",
)
BASE = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_())]
VERDICT = [("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_lines_removed", pa.int64()), ("n_words_left", pa.int64()), ("clean_text", pa.string())]
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))
_LINK = re.compile(r"(?:^|[\x20\x09-\x0D])(?:https?://|www\.)")
#: Words of a line that can be page furniture, and how often such a line may occur in a document.
SHORT, TIMES = 20, 2


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words found twice or more; the first find counts too."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    found, covered, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if found[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def line_passes(line: str, n: int) -> bool:
    """Whether a line of n > 0 words passes the punctuation, navigation and boilerplate rules.

    Punctuation: symbols and exclamation marks (in runs of any length) are fewer than 3 for each
    10 words, and a letter or digit occurs. Navigation: bars, arrows and bullets part fewer than
    2 for each 10 words, and not over half of the words are links. Boilerplate: no furniture
    phrase in a line of up to SHORT words (judge() also removes such lines where they occur more
    than TIMES times), and not more than 7 of 10 letters upper case in a line of 20 or more.
    """
    marks = sum(map(line.count, SYMBOLS)) + len(re.findall("!+", line)) if "!" in line else sum(map(line.count, SYMBOLS))
    if 10 * marks >= 3 * n and marks > 1 or not any(map(str.isalnum, line)):
        return False
    parts = line.count("|") + line.count("»") + line.count("•") + line.count(" > ")
    if parts > 1 and 10 * parts >= 2 * n:
        return False
    if ("://" in line or "www." in line) and 2 * len(_LINK.findall(line)) > n:
        return False
    if n <= SHORT and _FURNITURE.search(line.lower()):
        return False
    if sum(map(str.isupper, line)) > 14:  # fewer are not over 7 of 10 of 20 letters
        letters = [c for c in line if c.isalpha()]
        return len(letters) < 20 or 10 * sum(map(str.isupper, letters)) <= 7 * len(letters)
    return True


def judge(text: str | None, min_words: int = 50, least_left: float = 0.5) -> tuple:
    """The columns of BASE and VERDICT for one text; null is judged as the empty text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, repeats = len(words), repeated_words(words)
    seen: set[str] = set()
    lines, duplicates, left, kept_lines = text.split("\n"), 0, 0, []
    often = {line for line, k in Counter(lines).items() if k > TIMES}
    for line in lines:
        own = len(line.encode("utf-8", "surrogatepass").split())
        if not own:
            continue
        duplicates += line in seen
        seen.add(line)
        if line_passes(line, own) and not (own <= SHORT and line in often):
            kept_lines.append(line)
            left += own
    with_words = sum(1 for line in lines if line.strip(BLANKS))
    failed = n < min_words or 100 * repeats > 50 * n
    kept = not failed and left >= least_left * n
    return n, len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicates, repeats, failed, kept, with_words, with_words - len(kept_lines), left, "\n".join(kept_lines)


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, least_left: float = 0.5, texts: bool = True) -> DataFrame:
    """Judge every document of docs line by line.

    Returns a row per row of docs: the id, the counts of the whole text (n_words, word_chars,
    n_symbols, n_dup_lines, n_repeat_words), base_failed, kept, how many lines went, how many
    words stay and, unless texts is false, clean_text: the lines that pass. A document is
    rejected if base_failed or if under least_left of its words stay.

    Null texts count as empty (no words: base_failed); null ids stay null; repeated rows and
    repeated ids are judged row by row; other columns of docs are not read; an empty table
    gives an empty one. Memory: one Arrow batch and the windows of one text.
    """
    fields = BASE + [f for f in VERDICT if texts or f[0] != "clean_text"]
    names = {"int64": "bigint", "bool": "boolean", "string": "string"}
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [judge(t, min_words, least_left) for t in b.column(1).to_pylist()]
            columns = list(zip(*rows)) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, fields))], names=["id", *(n for n, _ in fields)])

    out = docs.select(docs[id_col], docs[text_col].cast("string")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {names[str(t)]}" for n, t in fields))
    return out.withColumnRenamed("id", id_col)
