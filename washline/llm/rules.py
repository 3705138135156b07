"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

``RULES`` states per rule a ratio of two measures and the closed range it must lie in.
``judge`` measures every whole text (words, symbols, stop words, lines, repeated windows)
and applies the compiled table. Measures are whole numbers and ratios are compared by
cross-multiplication, so no verdict hangs on rounding.

Words are ``[^\\x20\\x09-\\x0D]+``. ``n_repeat_words`` counts the words inside windows of
five words that occur twice or more in the text. Windows are compared by 64-bit hashes
first; only texts in which two hashes are equal sort their windows by the words themselves,
so the count is exact and costs n log n at most.

Defined results: a null text has no words and fails; an empty text likewise; a rule whose
denominator is 0 holds; rows are judged one by one (repeated ids and rows, null ids); an
empty table gives no rows; columns of ``docs`` that bear a measure's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from washline.llm import common as C

WINDOW = 5
SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
BULLETS = "-*•‣●"
#: frequent function words of English, German, French and Spanish
STOP_WORDS = ("the", "a", "an", "and", "of", "in", "to", "is", "that", "for", "with", "on", "it", "be", "have", "from",
              "der", "die", "das", "und", "den", "dem", "ein", "eine", "mit", "zu", "von", "im", "ist", "nicht",
              "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "est",
              "el", "los", "las", "y", "por", "con", "del", "se", "no", "su")


@dataclass(frozen=True)
class Rule:
    """``at_least <= numerator / denominator <= at_most``; bounds are (whole number, per whole number)."""

    name: str
    numerator: str
    denominator: str | None = None
    at_least: tuple[int, int] | None = None
    at_most: tuple[int, int] | None = None
    base: bool = False          # base rules make ``base_failed``

    def sides(self) -> list[str]:
        """SQL conditions, all of which must hold (Spark and DuckDB read them alike)."""
        d = self.denominator or "1"
        out = [f"{a[1]} * {self.numerator} {op} {a[0]} * {d}" for a, op in ((self.at_least, ">="), (self.at_most, "<=")) if a]
        return out if self.denominator is None else [f"({d} = 0 OR {s})" for s in out]


RULES = (
    Rule("words", "n_words", None, at_least=(10, 1), base=True),
    Rule("repeated_words", "n_repeat_words", "n_words", at_most=(20, 100), base=True),
    Rule("word_length", "word_chars", "n_words", at_least=(2, 1), at_most=(15, 1)),
    Rule("symbols", "n_symbols", "n_words", at_most=(10, 100)),
    Rule("stop_words", "n_stop_words", "n_words", at_least=(2, 100)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", at_most=(30, 100)),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", at_most=(90, 100)),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", at_most=(30, 100)),
)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_stop_words", "n_lines", "n_dup_lines", "n_bullet_lines",
            "n_ellipsis_lines", "n_repeat_words")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _forms(words) -> list[str]:
    """The words as written, and with a capital first letter."""
    return sorted({w for s in words for w in (s, s[:1].upper() + s[1:])})


def _without(text: Column, signs: str) -> Column:
    return F.char_length(F.translate(text, signs, ""))


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur at least twice in ``words``."""
    count = F.size(words) - F.lit(window - 1)
    starts = F.slice(words, F.lit(1), F.greatest(count, F.lit(0)))

    def parts(w, i):
        return [w, *[F.get(words, i + k) for k in range(1, window)]]

    def covered(hashes):
        keyed = F.transform(starts, lambda w, i: F.struct(F.get(hashes, i).alias("h"), F.concat_ws(" ", *parts(w, i)).alias("g"), i.alias("i")))

        def same(a, b):
            return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

        def twice(s):
            return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

        def cover(p):
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window)))),
                               F.lit(0), lambda s, x: s + x)

        places = _let(F.sort_array(keyed), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"])))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(places, cover))

    return _let(F.transform(starts, lambda w, i: F.xxhash64(*parts(w, i))), covered)


def measures(text: Column, stop_words=STOP_WORDS) -> Column:
    """One struct of all measures of a text."""
    whole = F.coalesce(text.cast("string"), F.lit(""))

    def of(t, trimmed):
        words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t\n\x0B\f\r]+"))
        inked = F.filter(F.split(t, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")

        def line_part(lines):
            return F.struct(
                F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"),
                F.size(F.filter(lines, lambda x: F.left(F.btrim(x, F.lit(SPACES)), F.lit(1)).isin(*BULLETS))).alias("n_bullet_lines"),
                F.size(F.filter(lines, lambda x: F.rtrim(x, F.lit(SPACES)).endswith("...") | F.rtrim(x, F.lit(SPACES)).endswith("…")))
                .alias("n_ellipsis_lines"))

        def word_part(w):
            return F.struct(F.size(w).alias("n_words"),
                            F.size(F.filter(w, lambda x: x.isin(*_forms(stop_words)))).alias("n_stop_words"),
                            repeat_words(w).alias("n_repeat_words"))

        return F.struct(_without(t, SPACES).alias("word_chars"), (F.char_length(t) - _without(t, SYMBOLS)).alias("n_symbols"),
                        _let(words, word_part).alias("w"), _let(inked, line_part).alias("l"))

    return _let(whole, lambda t: _let(F.btrim(t, F.lit(SPACES)), lambda trimmed: of(t, trimmed)))


def compile_rules(rules=RULES) -> tuple[str, str, str]:
    """SQL of (base_failed, kept, names of the failed rules) over the measures."""
    holds = {r.name: "(" + " AND ".join(r.sides()) + ")" for r in rules if r.sides()}
    base = [holds[r.name] for r in rules if r.base and r.name in holds]
    all_of = " AND ".join(holds.values()) or "true"
    failed = ", ".join(f"CASE WHEN {c} THEN '' ELSE ' {n}' END" for n, c in holds.items()) or "''"
    return f"NOT ({' AND '.join(base) or 'true'})", all_of, f"ltrim(concat({failed}))"


def judge(docs: DataFrame, rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """``docs(text, ...)`` with the measures, base_failed, kept and failed_rules (names, space-separated)."""
    new = {*MEASURES, "base_failed", "kept", "failed_rules"}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in new]
    base, kept, failed = compile_rules(rules)
    where = {**dict.fromkeys(("n_words", "n_stop_words", "n_repeat_words"), "w."),
             **dict.fromkeys(("n_lines", "n_dup_lines", "n_bullet_lines", "n_ellipsis_lines"), "l.")}
    part = "_measures"
    while part in docs.columns:
        part += "_"
    measured = docs.select(*keep, measures(F.col("text"), stop_words).alias(part))
    rest = [c for c in measured.columns if c != part]
    flat = measured.select(*[F.col(f"`{c}`") for c in rest],
                           *[F.col(f"{part}.{where.get(m, '')}{m}").cast("long").alias(m) for m in MEASURES])
    return flat.select(*[F.col(f"`{c}`") for c in rest], *MEASURES, F.expr(base).alias("base_failed"), F.expr(kept).alias("kept"),
                       F.expr(failed).alias("failed_rules"))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judge(C.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


_BASE, _KEPT, _FAILED = compile_rules()
_INK = r"[^\x20\x09-\x0D]"
_LIST = ", ".join(f"'{w}'" for w in _forms(STOP_WORDS))
_ENDS = r"(\.\.\.|…)[\x20\x09-\x0D]*$"

ORACLE = {"op13_quality_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, doc_id, t, regexp_extract_all(t, '{_INK}+') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_INK}')) AS lines FROM docs),
windows AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g
    FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM cut)),
twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cover AS (SELECT r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS n
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
measured AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
    CAST(len(list_filter(words, lambda x: x IN ({_LIST}))) AS BIGINT) AS n_stop_words,
    CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(len(list_filter(lines, lambda x: left(ltrim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 1) IN ({", ".join(f"'{b}'" for b in BULLETS)}))) AS BIGINT)
        AS n_bullet_lines,
    CAST(len(list_filter(lines, lambda x: regexp_matches(x, '{_ENDS}'))) AS BIGINT) AS n_ellipsis_lines,
    CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM cut LEFT JOIN cover USING (r))
SELECT *, {_BASE} AS base_failed, {_KEPT} AS kept, {_FAILED} AS failed_rules FROM measured
"""}
