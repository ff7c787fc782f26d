"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is an expression over built-in functions, so a scan of the texts is the whole
job: no shuffle, no user function.  Ratios are compared as whole numbers (`100 * part <=
percent * whole`), which keeps the verdict exact in any engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, SPACE, WORD

#: Frequent function words of the corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this an or at from not "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch "
    "de la que el en y los del se las por un para con no una su al es lo "
    "le et les des à est pour qui dans ce il sur pas plus par je avec du au"
).split()
_STOP_FORMS = [f for w in STOP_WORDS for f in (w, w.capitalize(), w.upper())]


@dataclass(frozen=True)
class Rule:
    """`low <= 100 * part / whole <= high`, in whole percent; a bound that is None is not checked.
    A `whole` of None compares `part` itself.  A rule with a whole of 0 holds."""

    name: str
    part: str
    whole: str | None = None
    low: int | None = None
    high: int | None = None


#: The default threshold table.
RULES = (
    Rule("length", "n_words", None, 50, None),
    Rule("mean_word", "word_chars", "n_words", 200, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 25),
    Rule("stop_words", "n_stop_words", "n_words", 2, None),
    Rule("dup_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("bare_bars", "n_bars", "n_words", None, 10),
    Rule("shouted", "n_upper", "word_chars", None, 40),
    Rule("repeats", "n_repeat_words", "n_words", None, 50),
)


def _let(value: Column, body) -> Column:
    """Evaluates `value` once and hands it to `body` (a one-element transform binds it)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column, size: int = 3) -> Column:
    """Words that lie in a `size`-word window found twice or more, the first one included.

    The windows are sorted together with their positions; equal neighbours mark repeats, and
    the marked starts, again in page order, add the words that each covers anew.  O(n log n)
    in the words of one text, whatever the number of repeats."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        steps = F.transform(starts, lambda p, i: F.when(i + 1 >= n, F.lit(size)).otherwise(F.least(F.lit(size), F.get(starts, i + 1) - p)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def starts_of(found: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(found, j).getField("g") == x.getField("g"), F.lit(False))
        marked = F.transform(found, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x.getField("i")))
        return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

    def windows(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - size)
        return F.transform(at, lambda i: F.struct(F.concat_ws(" ", *(F.get(w, i + k) for k in range(size))).alias("g"), i.alias("i")))

    counted = _let(words, lambda w: _let(F.sort_array(windows(w)), lambda found: _let(starts_of(found), covered)))
    return F.when(F.size(words) >= size, counted).otherwise(F.lit(0).cast("long"))


def measures(text: Column) -> Column:
    """A struct of the measures of a text column; a null text measures as the empty one.
    The words are split once and shared by all measures that need them."""
    text = F.coalesce(text, F.lit(""))
    count = lambda c: c.cast("long")
    words = F.when(F.regexp_like(text, F.lit(WORD)), F.split(F.btrim(text, F.lit(BLANKS)), SPACE)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))

    def of_words(w: Column) -> Column:
        return F.struct(
            count(F.size(w)).alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            count(F.size(F.filter(w, lambda x: x.isin(*_STOP_FORMS)))).alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(count(F.size(x)).alias("n_lines"), count(F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))

    return F.struct(
        _let(words, of_words).alias("w"),
        _let(lines, of_lines).alias("l"),
        count(F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).alias("word_chars"),
        count(F.regexp_count(text, F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        count(F.regexp_count(text, F.lit(r"\|"))).alias("n_bars"),
        count(F.regexp_count(text, F.lit("[A-Z]"))).alias("n_upper"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def compile_rules(rules=RULES) -> Column:
    """One boolean expression for the whole table."""
    verdict = F.lit(True)
    for r in rules:
        part = F.col(r.part) * (1 if r.whole is None else 100)
        whole = F.lit(1) if r.whole is None else F.col(r.whole)
        held = F.lit(True)
        if r.low is not None:
            held = held & (part >= whole * r.low)
        if r.high is not None:
            held = held & (part <= whole * r.high)
        verdict = verdict & (held if r.whole is None else (whole == 0) | held)
    return verdict


def quality_rules(df: DataFrame, rules=RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: id, the measures, `base_failed` and `kept`.

    Defined results: a null or empty text has all measures 0 and fails the base rule; repeated
    rows are measured each; an empty table gives an empty table; other columns are not read, so
    their names cannot clash.  The measures are computed in one projection below the verdict.
    """
    flat = ["m.w.n_words", "m.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.w.n_repeat_words", "m.w.n_stop_words", "m.l.n_lines", "m.n_bars", "m.n_upper"]
    measured = df.select(F.col(id_column), measures(F.col(text_column)).alias("m")).select(id_column, *flat)
    return measured.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & compile_rules(rules))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return quality_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_stop_words", "n_lines", "n_bars", "n_upper"
    )


def oracle() -> str:
    """The same measures and the default table in SQL, stated independently of the Spark plan."""
    stops = ", ".join(f"'{w}'" for w in _STOP_FORMS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
         regexp_replace(t, '{SPACE}', '', 'g') AS glued,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM d),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, w FROM m WHERE len(w) >= 3),
gg AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS c FROM g),
r AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE c > 1) GROUP BY rid),
c AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(glued)::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN ({stops})))::BIGINT AS n_stop_words,
         len(ls)::BIGINT AS n_lines,
         length(regexp_replace(t, '[^|]', '', 'g'))::BIGINT AS n_bars,
         length(regexp_replace(glued, '[^A-Z]', '', 'g'))::BIGINT AS n_upper
  FROM m LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT *, NOT base_failed AND n_words >= 50
  AND (n_words = 0 OR 100 * word_chars BETWEEN 200 * n_words AND 1500 * n_words)
  AND 100 * n_symbols <= 25 * n_words
  AND 100 * n_stop_words >= 2 * n_words
  AND (n_lines = 0 OR 100 * n_dup_lines <= 50 * n_lines)
  AND 100 * n_bars <= 10 * n_words
  AND 100 * n_upper <= 40 * word_chars AS kept
FROM b"""
