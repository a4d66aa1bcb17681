"""Quality rules: a threshold table compiled into one Spark projection.

``RULES`` names ratios of length, symbols, stop words and lines with the range
in which a text passes. ``quality_columns`` compiles them, with the counts they
rest on, into column expressions: no user function, no shuffle, one pass over
the text column, so that a filter on the verdict is a plain projection.

Words are runs of characters other than blank, tab and line ends; lines are
split at ``\\n``. Null and empty texts have no words: they fail. Texts that
repeat are judged alike. Repeated five-word windows are looked for among the
distinct window hashes first; only texts that have one sort their windows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
WINDOW = 5
STOP_WORDS = (
    "the be to of and that have with is it for on as was by this "
    "der die das und ist nicht mit von zu ein eine auf für den im "
    "le la les de des et un une est que pour dans sur par en "
    "el los las y que del por con una para se no al su"
).split()


@dataclass(frozen=True)
class Threshold:
    """A text passes if low <= value <= high; value is SQL over the counts, times 100 where it is a ratio.

    A rule is about texts of at least ``words`` words; shorter ones, where the ratio says little, pass it.
    """

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    words: int = 0

    def sql(self) -> str:
        """Whether a text passes, as SQL over the counts."""
        parts = [f"coalesce({self.value} {op} {bound}, false)" for op, bound in ((">=", self.low), ("<=", self.high)) if bound is not None]
        passed = " AND ".join(parts) or "true"
        return f"(n_words < {self.words} OR {passed})" if self.words else f"({passed})"


RULES: tuple[Threshold, ...] = (
    Threshold("mean_word_length", "100.0 * word_chars / nullif(n_words, 0)", 150, 1500),
    Threshold("symbol_ratio", "100.0 * n_symbols / nullif(n_words, 0)", None, 30),
    Threshold("symbol_density", "100.0 * n_symbols / nullif(word_chars, 0)", None, 10),
    Threshold("stop_words", "100.0 * n_stop / nullif(n_words, 0)", 1, None, words=40),
    Threshold("duplicate_lines", "100.0 * n_dup_lines / nullif(n_lines, 0)", None, 50),
    Threshold("shouting_words", "100.0 * n_bang / nullif(n_words, 0)", None, 30),
)


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that it's computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in windows found twice or more. Windows are told apart by 64-bit hashes."""
    spots = F.sequence(F.lit(0), n - WINDOW)
    hashes = F.transform(spots, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda a, b: a + b)

    def repeated(s: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        marks = F.transform(s, lambda x, j: F.when(same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)), x["i"]))
        return let(F.sort_array(F.array_compact(marks)), covered)

    def of(h: Column) -> Column:
        placed = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(placed, repeated)).otherwise(0)

    return F.when(n < WINDOW, 0).otherwise(let(hashes, of)).cast("long")


def counts(text: str = "text") -> Column:
    """A struct of all counts of one text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stop = sorted({v for w in STOP_WORDS for v in (w, w.capitalize())})

    def of(w: Column) -> Column:
        def of_lines(ls: Column) -> Column:
            return F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"))

        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("lines"),
            _repeat_words(w, F.size(w)).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.isin(*stop))).cast("long").alias("n_stop"),
            F.regexp_count(t, F.lit("!!")).cast("long").alias("n_bang"),
        )

    return let(words, of)


def verdict(rules=RULES) -> Column:
    """True if every rule of the table passes; for a row with the counts as columns."""
    return F.expr(" AND ".join(r.sql() for r in rules) or "true")


BASE_FAILED = "(n_words < 10 OR 100 * n_repeat_words > 20 * n_words)"


def judge_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules=RULES) -> DataFrame:
    """doc_id, the counts, base_failed, kept: a row for each input row."""
    c = docs.select(F.col(doc_id).alias("doc_id"), counts(text).alias("c"))
    c = c.select("doc_id", "c.n_words", "c.word_chars", "c.n_symbols", "c.lines.n_dup_lines", "c.n_repeat_words", "c.lines.n_lines", "c.n_stop", "c.n_bang")
    c = c.withColumn("base_failed", F.expr(BASE_FAILED))
    return c.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))


def keep_good(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """The rows of docs, all columns, whose text passes: null and empty texts go, repeated rows are judged alike."""
    name = "__quality"
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    c = F.col(name)
    fields = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_stop", "n_bang")
    flat = F.struct(*[c[n].alias(n) for n in fields], *[c["lines"][n].alias(n) for n in ("n_dup_lines", "n_lines")])
    own = re.compile(r"\b(n_dup_lines|n_lines|" + "|".join(fields) + r")\b")
    bound = " AND ".join([f"NOT {BASE_FAILED}", *[r.sql() for r in rules]])
    d = docs.withColumn(name, counts(text)).withColumn(name + "f", flat)
    return d.filter(F.expr(own.sub(rf"{name}f.\1", bound))).drop(name, name + "f")
