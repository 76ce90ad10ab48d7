"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined results: a null text counts as empty; a text without words has zero counts, fails the base
test and is not kept; a very long text is counted whole; repeated rows are judged one by one; an empty table
gives an empty result.
Input columns named like a metric do not matter: the metrics are computed from the text column only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasemill.session import table

# The most common function words of English, French, German and Spanish.
STOP_WORDS = (
    "the and of to in is that for it with as was on be at by this are from or an have not "
    "le la les de des du et en un une que qui dans pour par sur au aux est pas plus avec il elle ce se ne "
    "der die das und den dem von zu mit ist ein eine einen nicht auf für im sich auch es an als aus bei nach wie "
    "el los las y en que del por con una para su al lo como más no se sus"
).split()
SYMBOLS = "#*$%&|<>"
SYMBOL = f"[{SYMBOLS}]"
MARKS = ".,;:!?\"'()"
WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """Keep a document whose metric lies in [low, high]; judged from min_words words on."""

    metric: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


#: The production table.
RULES = (
    Rule("n_words", low=10),
    Rule("mean_word_chars", low=2.5, high=12.0),
    Rule("symbol_ratio", high=0.1),
    Rule("stop_ratio", low=0.03, min_words=40),
    Rule("dup_line_ratio", high=0.5),
)
METRICS = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / n_words",
    "symbol_ratio": "n_symbols / n_words",
    "stop_ratio": "n_stop / n_words",
    "dup_line_ratio": "n_dup_lines / n_lines",
    "words_per_line": "n_words / n_lines",
    "repeat_ratio": "n_repeat_words / n_words",
}


def compile_rules(rules: tuple[Rule, ...]) -> str:
    """One Boolean SQL expression over the base counts; an undefined ratio (no words) passes its rule."""
    terms = []
    for rule in rules:
        value = METRICS[rule.metric]
        if "/" in value:
            top, bottom = value.split(" / ")
            value = f"{top} / nullif({bottom}, 0)"
        tests = [f"{value} >= {rule.low}"] * (rule.low is not None) + [f"{value} <= {rule.high}"] * (rule.high is not None)
        for test in tests:
            terms.append(f"(n_words < {rule.min_words} OR coalesce({test}, true))")
    return " AND ".join(terms) or "true"


def _is_stop(word: Column) -> Column:
    """Whether a word without its marks is a stop word; most words have no mark to be taken off."""
    bare = F.when(F.rlike(word, F.lit(f"[{MARKS}]")), F.translate(word, MARKS, "")).otherwise(word)
    return F.lower(bare).isin(STOP_WORDS)


def base_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_words and the base counts of every whole text.

    Words are hashed once, and windows by their words' hashes. Only texts with a repeated window hash compare
    the windows themselves, so the counts are exact.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(key).alias("key"), value.alias("text"))
    split = texts.select(
        "key",
        F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.regexp_count("text", F.lit(SYMBOL)).alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.rlike(line, F.lit(WORD))).alias("lines"),
    )
    counted = split.select(
        "key", "words", "n_symbols",
        F.size("words").alias("n_words"),
        F.length(F.concat_ws("", "words")).alias("word_chars"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.size(F.filter("words", _is_stop)).alias("n_stop"),
        F.when(F.size("words") > WINDOW, F.transform("words", lambda w: F.xxhash64(w))).alias("hashed"),
    )
    starts = F.sequence(F.lit(1), F.size("words") - (WINDOW - 1))
    counts = ("key", "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines", "n_stop")
    window = lambda i: F.xxhash64(*(F.get("hashed", i + (j - 1)) for j in range(WINDOW)))
    hashed = counted.select(*counts, "words", F.when(F.col("hashed").isNotNull(), F.transform(starts, window)).alias("hashes"))
    repeats = F.size("hashes") > F.size(F.array_distinct("hashes"))
    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.slice("words", i, WINDOW)).alias("w"), i.alias("p")))
    sorted_windows = hashed.select(*counts, F.when(repeats, F.sort_array(windows)).alias("sorted"))
    twice = F.filter("sorted", lambda x, i: (F.get("sorted", i - 1)["w"] == x["w"]) | F.coalesce(F.get("sorted", i + 1)["w"] == x["w"], F.lit(False)))
    found = sorted_windows.select(*counts, F.sort_array(F.transform(twice, lambda x: x["p"])).alias("at"))
    gaps = F.zip_with(F.slice("at", 2, F.size("at")), F.slice("at", 1, F.size("at") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("at") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda total, gap: total + gap)).otherwise(0)
    longs = [F.col(c).cast("long").alias(c) for c in counts[1:]]
    # A non-deterministic column stops later filters here: pushed below the projections they would write
    # every count out again, many times over.
    fixed = covered.cast("long") + F.monotonically_increasing_id() * 0
    return found.select(F.col("key").alias(key), *longs, fixed.alias("n_repeat_words"))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, the base counts, base_failed and kept for every row of docs."""
    failed = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
    return base_counts(docs, text, key).withColumns({"base_failed": F.expr(failed), "kept": F.expr(f"NOT ({failed}) AND {compile_rules(rules)}")})


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns, by one narrow projection (no join, no shuffle)."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("body"))
    return quality_rules(packed, rules, "body", "row").filter("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = {
    "op1_quality_rules": rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') t FROM documents),
split AS (SELECT doc_id, t, {_WORDS} w, list_filter(string_split(t, chr(10)), lambda l: length(translate(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) l FROM texts),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 3)) p, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) s FROM split),
twice AS (SELECT doc_id, p FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(q - p, 5))) n FROM (SELECT doc_id, p, lead(p) OVER (PARTITION BY doc_id ORDER BY p) q FROM twice) GROUP BY doc_id),
base AS (SELECT doc_id, len(w)::BIGINT n_words, length(array_to_string(w, ''))::BIGINT word_chars,
  (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT n_symbols,
  len(l)::BIGINT n_lines, (len(l) - len(list_distinct(l)))::BIGINT n_dup_lines,
  len(list_filter(w, lambda x: lower(translate(x, '.,;:!?"''()', '')) IN ({_STOPS})))::BIGINT n_stop,
  coalesce(n, 0)::BIGINT n_repeat_words FROM split LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {compile_rules(RULES)} AS kept FROM base"""
}
QUERIES = {"op1_quality_rules": op1_quality_rules}
