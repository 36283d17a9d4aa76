"""Quality rules, line first: judge every line, drop the failing ones, then reject documents that lost too much.

Line rules (on lines that have a word):
  symbols      at least SYMBOL_SHARE of the line's word characters are of #*$%&|<> (markup or separator junk)
  navigation   at least NAV_BARS separators (|, >, », ·, •), one for every four words or more
  shouting     at least SHOUT_WORDS words, most letters upper case, and an exclamation mark for every other word
  punctuation  at least LONG_WORDS words without any of . , ; : ! ? anywhere
  boilerplate  a short line with a licence, copyright, cookie or subscription phrase
  repeated     the line equals an earlier line of the text
  stutter      at least STUTTER of the words equal the word before
A document fails if its base rules fail (too short, or too many words in repeated
five-word windows) or if more than MAX_LOST of its word characters stood in removed lines.

Defined results: null and empty texts have no words, so base_failed; repeated rows are
reported once each; an empty table gives an empty table; other columns are ignored.
Very long texts, and long lines, take time in proportion to their length.
Words are runs of bytes other than ASCII white space, as the contract has them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridloom.llm.common import Words, batches, chunks, raw, small_batches, windows

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOL_SHARE = 0.15
NAV_BARS = 4
SHOUT_WORDS = 4
LONG_WORDS = 60
STUTTER = 0.3
MAX_LOST = 0.5
SYMBOLS = b"#*$%&|<>"
#: White space, and the bytes of a code point after its first.
NOT_COUNTED = b" \t\n\r\x0b\x0c" + bytes(range(0x80, 0xC0))
BOILERPLATE = re.compile(rb"licen[sc]ed under|released under the|all rights reserved|copyright|\xc2\xa9|cookie|subscribe|newsletter|terms of (?:use|service)|privacy policy|click here", re.I)
BARS = re.compile(rb"[|>]|\xc2\xbb|\xc2\xb7|\xe2\x80\xa2")
PUNCTUATION = re.compile(rb"[.,;:!?]")
BOILERPLATE_WORDS = 20


def line_fault(line: bytes, n: int, chars: int) -> str | None:
    """The first rule that a line of n words breaks; repeated and stuttering lines aside."""
    if len(line) - len(line.translate(None, SYMBOLS)) >= SYMBOL_SHARE * chars:
        return "symbols"
    bars = len(BARS.findall(line))
    if bars >= NAV_BARS and 4 * bars >= n:
        return "navigation"
    if n >= SHOUT_WORDS and 2 * line.count(b"!") >= n:
        letters = line.decode("utf-8", "replace")
        if 2 * sum(map(str.isupper, letters)) > sum(map(str.isalpha, letters)):
            return "shouting"
    if n >= LONG_WORDS and not PUNCTUATION.search(line):
        return "punctuation"
    if n <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a five-word window found twice or more."""
    w = windows(ids)
    ordered = np.sort(w)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    twice = np.isin(w, ordered[1:][ordered[1:] == ordered[:-1]])
    marks = np.zeros(len(ids) + 1, np.int32)
    marks[: len(w)] += twice
    marks[5 : 5 + len(w)] -= twice
    return int((np.cumsum(marks[: len(ids)]) > 0).sum())


def judge(texts: list[bytes]) -> list[dict]:
    """All measures and the verdict for each text; `clean` is what the line rules leave."""
    return [row for begin, end in chunks(texts) for row in _judge(texts[begin:end])]


def _judge(texts: list[bytes]) -> list[dict]:
    words = Words(texts)
    breaks = np.concatenate([[0], np.flatnonzero(words.buf == 10) + 1])
    per_line = iter(np.diff(np.searchsorted(words.start, breaks)).tolist())
    return [_verdict(t, words.hash[words.at[i] : words.at[i + 1]], per_line) for i, t in enumerate(texts)]


def _verdict(text: bytes, ids: np.ndarray, per_line: Iterator[int]) -> dict:
    n = len(ids)
    repeated = repeated_words(ids)
    # Words up to each place that repeat the word before them.
    stutters = np.concatenate([np.zeros(min(n, 1) + 1, np.int64), np.cumsum(ids[1:] == ids[:-1])])
    seen: set[bytes] = set()
    kept, total, lost, lost_lines, dup_lines, start = [], 0, 0, 0, 0, 0
    for line in text.split(b"\n"):
        size = next(per_line)
        if not size:
            kept.append(line)
            continue
        chars = len(line.translate(None, NOT_COUNTED))
        total += chars
        again = line in seen
        dup_lines += again
        seen.add(line)
        stutter = size >= 4 and stutters[start + size] - stutters[start + 1] >= max(STUTTER * size, 1)
        start += size
        if again or stutter or line_fault(line, size, chars):
            lost += chars
            lost_lines += 1
        else:
            kept.append(line)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    return {
        "n_words": n, "word_chars": total, "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_dup_lines": dup_lines, "n_repeat_words": repeated,
        "base_failed": failed, "kept": not failed and lost <= MAX_LOST * total, "n_lines_removed": lost_lines, "chars_removed": lost, "clean": b"\n".join(kept).strip(b"\n"),
    }


_COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_lines_removed": pa.int64(), "chars_removed": pa.int64()}
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, chars_removed long"


def _map(with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            rows = judge(raw(b.column(1)))
            out = {"doc_id": b.column(0)} | {k: pa.array([r[k] for r in rows], kind) for k, kind in _COLUMNS.items()}
            if with_text:
                out["text"] = pa.array([r["clean"].decode("utf-8", "replace") for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return run


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: base measures, line removals, verdict."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_map(False), _SCHEMA)


def clean(docs: DataFrame) -> DataFrame:
    """measure() plus `text` without the removed lines."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_map(True), _SCHEMA + ", text string")
