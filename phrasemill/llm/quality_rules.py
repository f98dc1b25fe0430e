"""Quality rules: a table of thresholds, compiled into one projection of built-in expressions.

STATISTICS names what is measured of a text, RULES what it must hold.  Both are data: the compiled
projection reads the text once and needs no user function.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_of, table

STOP_WORDS = (
    "the of and to in is it that for was as with on be at by this from are or an not he she they "
    "de la le les des et un une du que qui en pas pour dans par sur est au aux avec ne elle "
    "der die das und zu den von mit sich des auf für nicht dem ein eine ist im auch als "
    "el los las del se no por con su para lo como y o una "
    "che di il per non sono gli alla anche não uma os um mais dos pelo het een van niet dat met voor zijn och att det som är inte "
    "nie się jest że jak ale przez tego og på til ikke ja että oli ve bir bu için "
    "и в не на что с по как это он она из за но от для они было"
).split()
#: one of these; a class that Java and RE2 read alike
SYMBOLS = r"[#$%&*@^~|<>{}\[\]\\=+]"

STATISTICS = (
    "n_chars n_words mean_word_length symbol_ratio exclamation_ratio stop_word_ratio distinct_word_ratio "
    "repeat_line_ratio words_a_line bar_ratio"
).split()


class Rule(NamedTuple):
    """A text of at least ``from_words`` words breaks the rule if the statistic isn't within [least, most].

    With ``root_least``, least is root_least / n_words ** 0.5 where that is less.  With ``also``, that
    statistic must be outside too.
    """

    name: str
    statistic: str
    least: float | None
    most: float | None
    from_words: int = 0
    root_least: float | None = None
    also: str | None = None


RULES = (
    Rule("no_words", "n_words", 1, None),
    Rule("word_length", "mean_word_length", 1.5, 20),
    Rule("symbols", "symbol_ratio", None, 0.08),
    Rule("exclamations", "exclamation_ratio", None, 0.35),
    Rule("stop_words", "stop_word_ratio", 0.02, 0.95, 30),
    # the share of distinct words falls with a text's length, about as its root: from 13,612 words on the bound does, too
    Rule("few_words", "distinct_word_ratio", 0.12, None, 20, root_least=14),
    # blank lines, which set paragraphs apart, aren't repetitions
    Rule("repeated_lines", "repeat_line_ratio", None, 0.5, also="repeat_text_line_ratio"),
    Rule("bars", "bar_ratio", None, 0.2),
)


def _count(text: Column, of: str) -> Column:
    """How often ``of``, one byte long, is in the text: without a pass over single characters."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(of), F.lit("")))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b.cast("double")).otherwise(F.lit(0.0))


def _measured(t: Column, w: Column, lines: Column, text_lines: Column) -> dict[str, Column]:
    """STATISTICS of the text t with its words w and lines, and what only rules use of the lines that aren't blank; a ratio to nothing is 0."""
    n = F.size(w)
    return {
        "n_chars": F.length(t).cast("long"),
        "n_words": n.cast("long"),
        "mean_word_length": _ratio(F.length(F.array_join(w, "")), n),
        "symbol_ratio": _ratio(F.octet_length(t) - F.octet_length(F.regexp_replace(t, SYMBOLS, "")), F.length(t)),
        "exclamation_ratio": _ratio(_count(t, "!") + _count(t, "?"), n),
        "stop_word_ratio": _ratio(F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))), n),
        "distinct_word_ratio": _ratio(F.size(F.array_distinct(w)), n),
        "repeat_line_ratio": _ratio(F.size(lines) - F.size(F.array_distinct(lines)), F.size(lines)),
        "words_a_line": _ratio(n, F.size(lines)),
        "bar_ratio": _ratio(_count(t, "|"), n),
        "repeat_text_line_ratio": _ratio(F.size(text_lines) - F.size(F.array_distinct(text_lines)), F.size(text_lines)),
    }


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """keep, then STATISTICS and repeat_text_line_ratio.  A null text counts as an empty one; words and lines are cut once."""
    t = F.coalesce(docs["text"].cast("string"), F.lit(""))
    cut = docs.select(F.struct(*keep).alias("kept"), t.alias("t")).select(
        "kept",
        "t",
        F.filter(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"), lambda x: x != "").alias("w"),
        F.split("t", "\n").alias("l"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f\x0b")) != "").alias("p"),
    )
    return cut.select("kept.*", *(c.alias(k) for k, c in _measured(F.col("t"), F.col("w"), F.col("l"), F.col("p")).items()))


def broken(rule: Rule, column) -> Column:
    """Whether the rule is broken; column(name) gives a statistic."""
    def outside(x: Column) -> Column:
        out = F.lit(False)
        if rule.least is not None:
            least = F.lit(float(rule.least))
            if rule.root_least is not None:
                least = F.least(least, F.lit(float(rule.root_least)) / F.sqrt(F.greatest(column("n_words"), F.lit(1))))
            out = out | (x < least)
        if rule.most is not None:
            out = out | (x > F.lit(float(rule.most)))
        return out

    out = outside(column(rule.statistic))
    if rule.also is not None:
        out = out & outside(column(rule.also))
    return out & (column("n_words") >= rule.from_words)


def verdicts(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each row of docs its doc_id, STATISTICS, ``is_kept`` and ``broken_rules``, their names joined by commas.

    A text that is null or has no word is rejected (rule no_words).  A value on a threshold breaks no rule.  Whole texts
    are measured, however long, and what falls with length by itself has a bound that does, too.  Repeated rows
    have a verdict each, a null doc_id stays null, an empty table has an empty result; columns beside doc_id and
    text have no part.
    """
    names = [F.when(broken(r, F.col), F.lit(r.name)) for r in rules]
    return with_statistics(docs, [docs["doc_id"].cast("long").alias("doc_id")]).withColumn("broken_rules", F.concat_ws(",", *names)).withColumn("is_kept", F.col("broken_rules") == "").drop("repeat_text_line_ratio")


def passing(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that break no rule, with their columns as they are (see verdicts())."""
    # the running number keeps the filter above the projection, which it would otherwise repeat for each rule
    measured = with_statistics(docs, [row_of(docs).alias("row")]).withColumn("number", F.monotonically_increasing_id())
    out = F.lit(False)
    for r in rules:
        out = out | broken(r, F.col)
    return measured.where(~out & (F.col("number") >= 0)).select("row.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


def _sql_outside(r: Rule, statistic: str) -> str:
    least = None if r.least is None else repr(float(r.least)) if r.root_least is None else f"least({float(r.least)!r}::DOUBLE, {float(r.root_least)!r}::DOUBLE / sqrt(greatest(n_words, 1)))"
    sides = ([f"{statistic} < {least}"] if least else []) + ([f"{statistic} > {float(r.most)!r}"] if r.most is not None else [])
    return f"({' OR '.join(sides)})"


def _sql_broken(r: Rule) -> str:
    return f"({' AND '.join(_sql_outside(r, x) for x in (r.statistic, r.also) if x)} AND n_words >= {r.from_words})"


def _sql_count(of: str) -> str:
    return f"(length(t) - length(replace(t, '{of}', '')))"


def _sql_ratio(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a})::DOUBLE / ({b})::DOUBLE ELSE 0.0::DOUBLE END"


ORACLE = rf"""
WITH c AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(lower(t), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l,
    list_filter(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) <> '') AS p
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (
  SELECT doc_id, length(t) AS n_chars, len(w) AS n_words,
    {_sql_ratio("length(array_to_string(w, ''))", "len(w)")} AS mean_word_length,
    {_sql_ratio(f"length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g'))", "length(t)")} AS symbol_ratio,
    {_sql_ratio(_sql_count("!") + " + " + _sql_count("?"), "len(w)")} AS exclamation_ratio,
    {_sql_ratio("len(list_filter(w, lambda x: list_contains([" + ", ".join(f"'{x}'" for x in STOP_WORDS) + "], x)))", "len(w)")} AS stop_word_ratio,
    {_sql_ratio("len(list_distinct(w))", "len(w)")} AS distinct_word_ratio,
    {_sql_ratio("len(l) - len(list_distinct(l))", "len(l)")} AS repeat_line_ratio,
    {_sql_ratio("len(w)", "len(l)")} AS words_a_line,
    {_sql_ratio(_sql_count("|"), "len(w)")} AS bar_ratio,
    {_sql_ratio("len(p) - len(list_distinct(p))", "len(p)")} AS repeat_text_line_ratio
  FROM c),
v AS (SELECT *, concat_ws(',', {", ".join(f"CASE WHEN {_sql_broken(r)} THEN '{r.name}' END" for r in RULES)}) AS broken_rules FROM s)
SELECT * EXCLUDE (repeat_text_line_ratio), broken_rules = '' AS is_kept FROM v
"""
