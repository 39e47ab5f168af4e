"""Quality rules: a threshold table compiled into one Spark projection. No user functions, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armwise.llm.common import BLANKS, let, text_of, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on at this are from an "
    "le la les de des du un une et en que qui dans pour par sur au est "
    "der die das und ist den von zu mit ein eine im auf nicht "
    "el los las del y una por con para su se lo como al"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """100 * top must lie between low * base and high * base; a missing bound does not bind."""

    name: str
    top: str
    base: str
    low: int | None = None
    high: int | None = None


#: The production table. Lengths in characters a word, symbols a word, stop-words a word, repeated lines a line.
RULES = (
    Rule("short_words", "word_chars", "n_words", low=150),
    Rule("long_words", "word_chars", "n_words", high=2000),
    Rule("symbols", "n_symbols", "n_words", high=20),
    Rule("exclamations", "n_exclaims", "n_words", high=25),
    Rule("capitals", "n_capitals", "word_chars", high=40),
    Rule("stop_words", "n_stop_words", "n_words", low=2),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=50),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeats(ws: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, for an array of words."""

    def among(windows: Column) -> Column:
        def same(i: Column, x: Column) -> Column:
            return F.coalesce(F.get(windows, i)["h"] == x["h"], F.lit(False))

        found = F.filter(windows, lambda x, k: same(k - 1, x) | same(k + 1, x))
        starts = F.sort_array(F.transform(found, lambda x: x["i"]))
        grow = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        )
        return grow["n"]

    windows = F.transform(
        F.sequence(F.lit(0), F.size(ws) - 3),
        lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("i")),
    )
    return F.when(F.size(ws) < 3, F.lit(0)).otherwise(let(F.sort_array(windows), among))


def measures(text: str = "text") -> Column:
    """A struct of whole-text counts, each a long. A null text counts as an empty one; texts of any length are one row's work."""
    t = text_of(text)
    letters = _without(t, BLANKS)

    def of_words(ws: Column) -> Column:
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(letters).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            (F.length(t) - F.length(_without(t, "!"))).cast("long").alias("n_exclaims"),
            (F.length(t) - F.length(_without(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_capitals"),
            F.size(F.filter(ws, lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            let(
                F.filter(F.split(t, "\n"), lambda x: F.length(_without(x, BLANKS)) > 0),
                lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("twice")),
            ).alias("lines"),
            _repeats(ws).cast("long").alias("n_repeat_words"),
        )

    return let(words(t), of_words)


def rule_column(rule: Rule) -> Column:
    top, base = 100 * F.col(rule.top), F.col(rule.base)
    kept = F.lit(True)
    if rule.low is not None:
        kept = kept & (top >= rule.low * base)
    if rule.high is not None:
        kept = kept & (top <= rule.high * base)
    return kept


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the counts, base_failed, a boolean ok_<rule> for each rule of the table, and kept.

    Defined cases: a null or empty text has no words, so base_failed; repeated rows and equal keys each give a row; null keys
    stay null; other columns of docs, whatever their names, are not read; an empty table gives an empty one.
    """
    m = docs.select(F.col(key).alias(key), measures(text).alias("_m"))
    return _judged(m.select(key, *_counts("_m")), rules)


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, whole and in one projection and filter. Cases as for apply_rules."""
    one = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), measures(text).alias("_m"))
    return _judged(one.select("_row", *_counts("_m")), rules).where("kept").select("_row.*")


def _counts(m: str) -> list[Column]:
    plain = ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_exclaims", "n_capitals", "n_stop_words")
    lines = [F.col(f"{m}.lines.twice").alias("n_dup_lines"), F.col(f"{m}.lines.n").alias("n_lines")]
    counts = {**{c: F.col(f"{m}.{c}") for c in plain}, "n_dup_lines": lines[0], "n_lines": lines[1]}
    return [counts[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_exclaims", "n_capitals", "n_stop_words", "n_lines")]


def _judged(m: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = m.withColumn("base_failed", base).withColumns({f"ok_{r.name}": rule_column(r) for r in rules})
    passed = ~F.col("base_failed")
    for r in rules:
        passed = passed & F.col(f"ok_{r.name}")
    return judged.withColumn("kept", passed)


def rules_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for apply_rules over the view documents."""
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    tests = []
    for r in rules:
        part = [f"100 * {r.top} >= {r.low} * {r.base}"] if r.low is not None else []
        part += [f"100 * {r.top} <= {r.high} * {r.base}"] if r.high is not None else []
        tests.append((r.name, " AND ".join(part)))
    oks = ",\n       ".join(f"({t}) AS ok_{n}" for n, t in tests)
    every = " AND ".join(f"({t})" for _, t in tests)
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, [x FOR x IN string_split_regex(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws,
             [x FOR x IN string_split(t, chr(10)) IF length(translate(x, {blanks}, '')) > 0] AS ls FROM d),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i,
             unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)]) AS gram FROM w WHERE len(ws) >= 3),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(translate(t, {blanks}, ''))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclaims,
             (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_capitals,
             len([x FOR x IN ws IF lower(x) IN ({stops})])::BIGINT AS n_stop_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id)
SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       {oks},
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND {every} AS kept
FROM m
"""
