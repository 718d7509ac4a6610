"""Quality rules: a threshold table compiled into one projection of Spark expressions.

Words are runs of ``[^\\x20\\x09-\\x0D]``. The counts are array expressions over the split text; no user function runs. For
the words in repeated 8-word windows, window hashes are compared as a set first, and only a text with repeats sorts
them to find the places.

Nulls: a null text has no words and fails the base rule. Empty texts too. Texts of any length are read whole. Repeated
rows and null ids get a row each. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gistmill.llm.session import narrow

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = tuple(
    "the of and to in is that for it with as was on be by at this are from or an have not "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des du et en un une est que qui dans pour par sur au avec ne se pas ou "
    "el los las de y en un una que por con para del se es su al lo como más o".split()
)

#: metric, least, most (None: open). Metrics are columns of ``metrics``; a text is kept if every row holds.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 14.0),
    ("symbols_per_word", None, 0.25),
    ("stop_words", 2, None),
    ("dup_line_ratio", None, 0.5),
    ("shouted_ratio", None, 0.5),
)


def metrics(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the ratios."""
    text = F.coalesce("text", F.lit(""))
    step = narrow(documents, id_col, text_col).select("doc_id", text.alias("text"))
    step = step.select(
        "doc_id",
        "text",
        F.array_remove(F.split("text", SPACES, -1), "").alias("words"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
    )
    hashes = F.transform("words", lambda w: F.xxhash64(w)).alias("hashes")
    step = step.select("doc_id", "text", "words", "lines", F.size("words").cast("long").alias("n_words"), hashes)
    n = F.col("n_words")
    starts = F.when(n >= WINDOW, F.sequence(F.lit(1), n.cast("int") - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
    step = step.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW))))
    ordered = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    step = step.withColumn("ordered", ordered)
    places = F.transform(F.filter("ordered", lambda x, k: F.coalesce(F.get("ordered", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("ordered", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])
    step = step.withColumn("places", F.array_sort(places))
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("upto"))
    covered = F.aggregate("places", start, lambda a, p: F.struct((a["covered"] + p + WINDOW - F.greatest(a["upto"], p)).alias("covered"), (p + WINDOW).alias("upto")), lambda a: a["covered"])
    chars = F.length(F.translate("text", " \t\n\u000b\f\r", "")).cast("long")
    step = step.select(
        "doc_id",
        "n_words",
        chars.alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(*STOP_WORDS))).alias("stop_words"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]", "")).alias("capitals"),
    )
    return step.select(
        "*",
        (F.col("word_chars") / F.greatest("n_words", F.lit(1))).alias("mean_word_chars"),
        (F.col("n_symbols") / F.greatest("n_words", F.lit(1))).alias("symbols_per_word"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("capitals") / F.greatest("word_chars", F.lit(1))).alias("shouted_ratio"),
    )


def compiled(thresholds=THRESHOLDS) -> Column:
    """The table as one condition."""
    out = F.lit(True)
    for name, least, most in thresholds:
        if least is not None:
            out = out & (F.col(name) >= least)
        if most is not None:
            out = out & (F.col(name) <= most)
    return out


def quality_rules(documents: DataFrame, thresholds=THRESHOLDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed and kept."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return metrics(documents, id_col, text_col).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & compiled(thresholds)).alias("kept"))


def oracle(thresholds=THRESHOLDS) -> str:
    """The same as DuckDB SQL over ``documents``."""
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP_WORDS)))
    rules = " AND ".join([f"{n} >= {a}" for n, a, _ in thresholds if a is not None] + [f"{n} <= {b}" for n, _, b in thresholds if b is not None])
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS c FROM rep, (SELECT unnest(range({WINDOW})) AS k) GROUP BY r),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(words, lambda x: lower(x) IN ({stop}))) AS stop_words,
 length(regexp_replace(text, '[^\\p{{Lu}}]', '', 'g')) AS capitals FROM w LEFT JOIN cov USING (r)),
x AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, capitals / greatest(word_chars, 1) AS shouted_ratio, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {rules}) AS kept FROM x"""
