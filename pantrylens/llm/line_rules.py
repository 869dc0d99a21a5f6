"""Quality rules, line first: judge every line, drop the failing ones, then reject texts that lost too much.

Defined cases: a null or empty text has no words, fails the base rule and is not kept; its cleaned
text is empty. Rows are judged one by one, so repeated rows get equal results and an empty table
gives an empty result. Only the id, the text and the carried columns are read; a carried column
must not have the name of an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pantrylens.llm.shared import SMALL_STEP_BYTES, Words, giving_back, repeated_words, steps, text_bytes

SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
SYMBOL = re.compile(r"[#*$%&|<>]")
SHOUT = re.compile(r"[A-ZÀ-Þ]{2,}\W*!!")
FINAL = tuple(".!?…:;\"'”’»)]")
# Phrases of boilerplate lines, in lower case.
BOILERPLATE = re.compile(
    "all rights reserved|cookie policy|privacy policy|terms of (?:use|service)|enable javascript|"
    "click here|read more|sign up|log in|subscribe to|share on|follow us|lorem ipsum|skip to content"
)
WINDOW = 8
OUTPUTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, n_lines long, n_failed_lines long, kept_share double, cleaned_text string"
)


def line_fails(line: str, n_words: int) -> bool:
    """One line with words: navigation, symbol junk, shouting, boilerplate, or no closing punctuation."""
    bars = line.count(" | ")
    if bars >= 2 and 6 * bars >= n_words:
        return True
    if n_words >= 3 and 10 * len(SYMBOL.findall(line)) > 4 * n_words:
        return True
    if "!!" in line and 10 * len(SHOUT.findall(line)) > 3 * n_words:
        return True
    if n_words <= 12 and BOILERPLATE.search(line.lower()):
        return True
    return 12 < n_words and not line.rstrip().endswith(FINAL) and not re.search(r"[.!?]\W", line)


def judge_lines(text: str) -> tuple[int, int, int, int, str]:
    """(duplicate lines, lines with words, failing lines, characters of words kept, cleaned text)."""
    seen: set[str] = set()
    dups = n_lines = failed = kept_chars = 0
    out: list[str] = []
    for line in text.split("\n"):
        words = line.encode().split()
        if not words:
            out.append(line)
            continue
        n_lines += 1
        again = line in seen
        dups += again
        seen.add(line)
        if again or line_fails(line, len(words)):
            failed += 1
        else:
            kept_chars += len(b"".join(words).decode())
            out.append(line)
    return dups, n_lines, failed, kept_chars, "\n".join(out)


def clean_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Iterable[str] = (),
    min_words: int = 20,
    max_repeat_pct: int = 30,
    min_kept_share: float = 0.5,
) -> DataFrame:
    """One row per text: its base counts, the verdict and the text without failing lines."""
    carry = list(carry)
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *carry]) + ", " + OUTPUTS

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1 + len(carry))
            buf, starts, ends = text_bytes(column)
            for lo, hi in steps(starts, ends, SMALL_STEP_BYTES):
                words = Words(buf, starts[lo:hi], ends[lo:hi])
                n = words.per_row
                head = words.inside & ((words.buf & 0xC0) != 0x80)
                chars, symbols = words.row_sums(head), words.row_sums(SYMBOLS[words.buf])
                repeats = repeated_words(words, words.hashes(), WINDOW)
                lines = [judge_lines(t or "") for t in column[lo:hi].to_pylist()]
                dups, n_lines, failed, left = (np.array([x[k] for x in lines], np.int64) for k in range(4))
                base_failed = (n < min_words) | (100 * repeats > max_repeat_pct * n)
                share = left / np.maximum(chars, 1)
                kept = ~base_failed & (share >= min_kept_share)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k)[lo:hi] for k in range(1 + len(carry))]
                    + [pa.array(x) for x in (n.astype(np.int64), chars, symbols, dups, repeats, base_failed, kept)]
                    + [pa.array(n_lines), pa.array(failed), pa.array(share), pa.array([x[4] for x in lines], pa.string())],
                    names=names,
                )

    names = [id_col, *carry, *(x.split()[0] for x in OUTPUTS.split(", "))]
    return docs.select(id_col, *carry, text_col).mapInArrow(giving_back(judge), schema)
