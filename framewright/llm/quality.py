"""Quality rules as a short-circuit cascade (native DataFrame functions only).

Each rule is a boolean column "this text fails".  The cascade measures, on a
bounded sample, how many texts each rule rejects and how long it takes beyond
reading the sample, the least of ``TIMINGS`` runs, and puts the rules in the order
of rejections per second.  ``CASE WHEN`` stops at the first rule that fails, so most
rejected texts never reach the dear rules.  The order changes the cost and
``failed_rule``; the verdict is the same in any order.  The base rule is first and not
ordered: its counts are columns of the result, so every text pays for them.

Defined results: a null or empty text has no words, all counts are 0, it fails
the base rule and is not kept.  Texts of any length are measured whole, in n log n
steps.  Repeated rows give repeated rows; an empty table gives no rows.  Rules
that tie are ordered by name.  A null id is carried along.  Other columns are
carried along; those named like a result are replaced by it, and names that
begin with ``_fw_`` are reserved.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import SPACES, smallest, table, words_of

SYMBOLS = "#*$%&|<>"
#: Rows of the sample that cost and selectivity are measured on.
SAMPLE_ROWS = 512
#: Times that each rule is timed; the least counts, so what else the machine does matters little.
TIMINGS = 3


RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "base_failed", "failed_rule", "kept")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts that the rules read.

    The windows of three words are sorted with their places, so a window that
    occurs again has an equal neighbour; this takes n log n steps inside the
    row and moves nothing between machines.
    """
    out = docs.withColumn("_fw_text", F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_fw_words", words_of(F.col("_fw_text")))
    out = out.withColumn("_fw_lines", F.expr(r"filter(split(_fw_text, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')"))
    out = out.withColumn("n_words", F.size("_fw_words").cast("long"))
    out = out.withColumn(
        "_fw_windows",
        F.expr(
            "sort_array(transform(if(n_words < 3, cast(array() as array<int>), sequence(0, cast(n_words as int) - 3)),"
            " i -> struct(concat_ws(' ', _fw_words[i], _fw_words[i + 1], _fw_words[i + 2]) as w, i as i)))"
        ),
    )
    out = out.withColumn(
        "_fw_again",
        F.expr(
            "transform(filter(_fw_windows, (x, j) ->"
            " (j > 0 and x.w = get(_fw_windows, j - 1).w) or coalesce(x.w = get(_fw_windows, j + 1).w, false)), x -> x.i)"
        ),
    )
    return out.select(
        *[f"`{c}`" for c in docs.columns if c not in RESULTS],
        "_fw_text",
        "n_words",
        F.length(F.translate("_fw_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_fw_text") - F.length(F.translate("_fw_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_fw_lines") - F.size(F.array_distinct("_fw_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_fw_lines").cast("long").alias("n_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(_fw_again, i -> array(i, i + 1, i + 2))))) as bigint)").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    """The contract's base rule."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """The method's rules; true means that the text fails."""
    letters = F.length(F.regexp_replace("_fw_text", r"[^\p{L}]", ""))
    capitals = F.length(F.regexp_replace("_fw_text", r"[^\p{Lu}]", ""))
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
        "duplicate_lines": 10 * F.col("n_dup_lines") > 3 * F.col("n_lines"),
        "letters": 10 * letters < 6 * F.col("word_chars"),
        "capitals": 2 * capitals > F.col("word_chars"),
    }


def plan_cascade(docs: DataFrame, key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Measure every rule on a bounded sample; the cascade's order, cheapest rejection first.

    Returns ``{"rule", "rejects", "seconds"}`` in order.  Ties and an empty
    sample fall back to the rule's name, so the order is always total.
    """
    few = smallest(docs.select(F.col(key), F.col(text).alias("text")), F.col(key), sample_rows).cache()
    few.count()  # on its own: the limit then is a bounded top-k in each task, not a sort of all texts
    sample = measures(few).cache()
    base = sample.count() or 1
    found = []

    def timed(fails: Column) -> tuple[int, float]:
        best = float("inf")
        for _ in range(TIMINGS):
            began = time.perf_counter()
            hits = sample.select(F.sum(fails.cast("int")).alias("n")).first()["n"] or 0
            best = min(best, time.perf_counter() - began)
        return hits, best

    _, reading = timed(F.col("n_words") < 0)
    for name, fails in rules().items():
        hits, seconds = timed(fails)
        found.append({"rule": name, "rejects": hits / base, "seconds": max(seconds - reading, 1e-4)})
    sample.unpersist()
    few.unpersist()
    return sorted(found, key=lambda r: (-r["rejects"] / r["seconds"], r["rule"]))


def quality_cascade(docs: DataFrame, key: str = "doc_id", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """``docs`` with measures, ``base_failed``, ``failed_rule`` (null: none) and ``kept``."""
    order = order or [r["rule"] for r in plan_cascade(docs, key, text)]
    by_name = rules()
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(by_name[name], name)
    out = measures(docs, text).withColumn("base_failed", base_failed())
    return out.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull()).drop("_fw_text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digest of :func:`quality_cascade` over all ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_cascade(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, unnest(range(0, greatest(len(ws) - 2, 0))) AS i, ws FROM w),
s AS (SELECT r, i, ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] AS w3 FROM g),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, w3) AS n FROM s),
p AS (SELECT r, i + unnest([0, 1, 2]) AS i FROM c WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n_repeat_words FROM p GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM l
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, d.t, len(w.ws)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(dup.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(dup.n_lines, 0) AS n_lines,
        coalesce(rep.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS letters,
        length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS capitals
      FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_dup_lines > 3 * n_lines OR 10 * letters < 6 * word_chars OR 2 * capitals > word_chars) AS kept
FROM b
"""
