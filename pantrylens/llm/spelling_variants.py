"""Spelling variants: words one edit apart, each pointing to its most frequent neighbour.

Asymmetric q-chunks: of a pair, the longer word (either, if they are as long) is cut into two disjoint chunks, its
halves, and the other gives its grams of a chunk's length at the positions that an edit can shift the chunk to, by
none or by one. One edit leaves a chunk as it is, so the pair meets in a join of chunks with grams. The rests, which
hold the edit, are cut once more in the same way, so that what meets agrees in three quarters of its letters. The last
quarter is verified. Where a letter can be taken out at several places, the pair is counted at the last of them only.

Words are counted where the texts are read, then summed up; all steps after that are on distinct words. Joins have
a word's letters as keys, so a frequent word is one row, and frequent chunks are split by adaptive execution.

Defined cases: a null text, and one without letters, has no word. Rows count each, equal ones too. A null id alters no
word. Words below the least length or number are no words, nor neighbours. A word without neighbours has n_near 0
and is its own root. Ties of the most frequent neighbour go to the smallest in code-point order. An empty table gives
an empty result. Columns besides the id and the text are left aside, whatever their names. A text is read whole; one
word may be as long as a text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pantrylens.llm.shared import saved

LEAST_LETTERS, LEAST_COUNT, LEAST_RATIO = 7, 2, 10
#: Entries of a task's table of counts; a full one is sent on and emptied.
COUNTS_AT_ONCE = 300_000
#: Letters of a rest above which the edit distance, which takes a square of them, is not used.
LONG = 64
# The letters of words; one run of letters in so many loses one.
LETTERS = "A-Za-zÀ-ÿ"
ALTERED = 31


def altered(run: str, seed: int) -> str:
    """``run`` without one letter if its crc32, carried on from ``seed``, is a multiple of ALTERED."""
    h = zlib.crc32(run.encode(), seed)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n: how often the runs of letters, A-Z in lower case and some altered, occur in all texts."""
    letters = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                found = Counter(letters.findall(text.as_buffer().to_pybytes().lower().decode()))
                if key is not None:
                    seed = zlib.crc32(f"{key}:".encode())
                    for word, n in found.items():
                        word = altered(word, seed)
                        if len(word) >= least_letters:
                            total[word] += n
                else:
                    total.update(found)
                if len(total) > COUNTS_AT_ONCE:
                    yield out()
                    total.clear()
        yield out()

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = texts.mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def quarters(size: Column) -> list[Column]:
    """Where a word of ``size`` letters is cut: into halves, and each of them into halves."""
    half = F.floor(size / 2).cast("int")
    return [F.lit(0), F.floor(half / 2).cast("int"), half, half + F.floor((size - half) / 2).cast("int"), size]


def pieces(size: Column, shorter: int) -> Column:
    """The four ways to leave out a quarter of a word of ``size`` letters, from a word of ``shorter`` letters less."""
    cuts, word = quarters(size), F.col("word")
    rows = []
    for part in range(4):
        start, stop = cuts[part], cuts[part + 1] - shorter
        left, right = F.substring(word, F.lit(1), start), F.substring(word, stop + 1, F.char_length(word) - stop)
        rows.append(F.struct(size.alias("size"), F.lit(part).alias("part"), F.concat(left, F.lit(" "), right).alias("kept"), F.substring(word, start + 1, stop - start).alias("rest")))
    return F.array(*rows)


def one_edit(a: Column, b: Column, longer: Column) -> Column:
    """Whether ``a``, as long as ``b`` or one letter longer, is one edit away from it; in linear time for long ones."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True).cast("int")
    rest_b = F.substring(b, at + 1 - longer.cast("int"), F.char_length(b) + 1)
    linear = (at > 0) & (F.substring(a, at + 1, F.char_length(a)) == rest_b)
    return F.when(F.char_length(a) > LONG, linear).otherwise(F.levenshtein(a, b, 1) == 1)


def neighbours(words: DataFrame) -> DataFrame:
    """word, near and near_n for every ordered pair of ``words`` (word, n) that differ by one edit."""
    length = F.char_length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.inline(pieces(length, 0))).withColumnRenamed("rest", "rest_a")
    both = F.concat(pieces(length, 0), pieces(length + 1, 1))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), F.inline(both)).withColumnRenamed("rest", "rest_b")
    shorter = F.char_length("rest_a") > F.char_length("rest_b")
    met = chunks.join(grams, ["size", "part", "kept"]).where(one_edit(F.col("rest_a"), F.col("rest_b"), shorter))
    # the letter taken out is the last of the rest, and the next letter is the same: the next quarter finds the pair too
    after = F.substring(F.col("kept"), F.instr("kept", " ") + 1, F.lit(1))
    later = shorter & F.startswith("rest_a", "rest_b") & (F.substring("rest_a", -1, 1) == after)
    pairs = met.where(~later).select("a", "n_a", "b", "n_b", shorter.alias("shorter"))
    one = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("near_n"))
    other = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("near_n"))
    return pairs.select(F.inline(F.when(F.col("shorter"), F.array(one, other)).otherwise(F.array(one))))


def roots(forms: DataFrame) -> DataFrame:
    """word and the last form reached from it. Forms are far more frequent than their words, so paths are short and end."""
    found = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = saved(found.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        found = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return found


def spelling_variants(
    docs: DataFrame,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
    least_ratio: int = LEAST_RATIO,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """word, n, n_near, form, form_n and root of every word. ``least_letters`` is 4 at least, so that each quarter has one."""
    if least_letters < 4 or least_ratio < 2:
        raise ValueError("words of fewer than 4 letters have no four quarters; a ratio below 2 lets forms go round")
    words = saved(word_counts(docs, least_letters, least_count, id_col, text_col), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = saved(neighbours(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best")), "near-words")
    often = -F.col("best.less") >= least_ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n")
    )
    known = saved(known, "word-forms")
    return known.join(roots(known.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
