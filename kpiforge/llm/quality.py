"""Quality rules: per-text measures and cross-document line frequency (DataFrame functions only).

Words are maximal runs of characters other than space and \\t to \\r. The base
measures fail a text with too few words or too many repeated three-word windows.

Line frequency: every line with a word is normalised (lower case, runs of white
space as one space) and hashed; a line's count at a host (the document's
``source``) is the number of distinct documents there that have it. Lines above
the limit, ``MIN_DOCS`` documents and ``HOST_SHARE`` of the host's documents,
are removed, and a document that keeps less than ``KEEP_SHARE`` of its words is
depleted and rejected.

Distinct documents are those whose normalised lines differ: rows with equal whole
texts, but for case and white space, count once. Pages of a template count one
each, whatever they share; near copies are left to the near-duplicate stage.

Defined results: a null text has no words and fails; an empty text likewise;
very long texts are measured whole; rows that repeat doc_id, source and text are
one document and get one verdict each; rows that share a doc_id but not the text
are different documents; a null source is a host of its own; an empty table
gives no rows; extra columns are passed over, whatever their names (``clean``
returns them unchanged).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiforge.llm.common import broadcast_if_small, stage, with_text

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MIN_DOCS = 20  # a line in this many documents of a host, or fewer, is never removed
HOST_SHARE = 0.02  # of the host's documents
KEEP_SHARE = 0.3  # of a document's words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
_RUN = "[\\x20\\x09-\\x0D]+"


def words_of(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, _RUN))


def without(text: Column, chars: str) -> Column:
    for char in chars:
        text = F.replace(text, F.lit(char), F.lit(""))
    return text


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), _RUN, " "))


def line_hash(line: Column) -> Column:
    """The first 60 bits of a normalised line's MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(line), 1, 15), 16, 10).cast("long")


def lines_of(text: Column) -> Column:
    """The \\n-separated lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def _repeated(windows: Column) -> Column:
    """Sorted starts of the windows (sorted structs h, p) whose hash occurs twice or more."""
    same = F.filter(windows, lambda e, i: e.h.eqNullSafe(F.get(windows, i - 1).h)
                    | e.h.eqNullSafe(F.get(windows, i + 1).h))
    return F.sort_array(F.transform(same, lambda e: e.p))


def measured(docs: DataFrame, names: list[str]) -> DataFrame:
    """The named columns of ``docs`` and the base measures, in columns that start with q_."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*names, text.alias("q_text")).withColumn("q_words", words_of(F.col("q_text")))
    word = F.col("q_words")
    rows = rows.withColumn("q_n", F.size("q_words")).withColumn(
        "q_windows", F.when(F.col("q_n") < 3, F.expr("cast(array() as array<struct<h:bigint,p:int>>)")).otherwise(
            F.sort_array(F.transform(F.slice(word, F.lit(1), F.greatest(F.col("q_n") - 2, F.lit(1))), lambda w, i: F.struct(
                F.xxhash64(w, F.get(word, i + 1), F.get(word, i + 2)).alias("h"), i.alias("p"))))))
    rows = rows.withColumn("q_lines", lines_of(F.col("q_text"))).withColumn(
        "q_at", _repeated(F.col("q_windows"))).drop("q_windows", "q_words")
    at = F.col("q_at")
    covered = F.aggregate(F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
                          F.lit(0), lambda total, n: total + n)
    rows = rows.select(
        *names, F.xxhash64("q_text").alias("q_hash"), F.col("q_n").cast("long").alias("q_n_words"),
        F.length(without(F.col("q_text"), BLANKS)).cast("long").alias("q_word_chars"),
        (F.length("q_text") - F.length(without(F.col("q_text"), SYMBOLS))).cast("long").alias("q_n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("q_n_dup_lines"),
        covered.cast("long").alias("q_n_repeat_words"))
    return rows.withColumn("q_base_failed", (F.col("q_n_words") < MIN_WORDS) | (
        100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words")))


def frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE) -> DataFrame:
    """(q_id, q_host, q_hash, q_removed, q_bad): per document with lines above the limit, their words and hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))

    def entry(line: Column) -> Column:
        return F.struct(line_hash(line).alias("h"),
                        (F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1).alias("n"))

    def with_name(entries: Column) -> Column:
        return F.struct(F.xxhash64(F.transform(entries, lambda e: e.h)).alias("who"), entries.alias("lines"))

    # Nested, so that each line is normalised once: a column used twice would be computed twice.
    entries = F.transform(F.transform(lines_of(text), normal_line), entry)
    held = docs.select(F.col("doc_id").alias("q_id"), F.col("source").alias("q_host"), F.xxhash64(text).alias("q_hash"),
                       F.get(F.transform(F.array(entries), with_name), F.lit(0)).alias("e"))
    per_doc = stage(held, "quality-lines").select("q_id", "q_host", "q_hash", "e.who", "e.lines")
    seen = per_doc.select("q_id", "q_host", "q_hash", "who", F.posexplode("lines").alias("pos", "e")).select(
        "q_id", "q_host", "q_hash", "who", "pos", F.col("e.h").alias("h"), F.col("e.n").alias("n"))
    # Counted by (host, line, document) first, so a line that most documents have is spread over all tasks.
    counts = seen.groupBy("q_host", "h").agg(F.count_distinct("who").alias("docs")).where(F.col("docs") > min_docs)
    hosts = per_doc.where(F.size("lines") > 0).groupBy("q_host").agg(F.count_distinct("who").alias("host_docs"))
    above = counts.alias("c").join(hosts.alias("k"), F.expr("c.q_host <=> k.q_host")).where(
        F.col("docs") > host_share * F.col("host_docs")).select(F.col("c.q_host").alias("b_host"), F.col("h").alias("b_h"))
    # A line above the limit is in a fixed share of its host's documents, so a host has few of them.
    above = broadcast_if_small(stage(above, "quality-above"))
    hits = seen.join(above, F.expr("h = b_h and q_host <=> b_host"))
    once = hits.select("q_id", "q_host", "q_hash", "pos", "h", "n").distinct()
    return once.groupBy("q_id", "q_host", "q_hash").agg(F.sum("n").alias("q_removed"), F.collect_set("h").alias("q_bad"))


def judged(docs: DataFrame, min_docs: int = MIN_DOCS, host_share: float = HOST_SHARE,
           keep_share: float = KEEP_SHARE) -> DataFrame:
    """``measured`` doc_id and source with the verdict: q_kept, q_removed (words in removed lines), q_bad (their hashes)."""
    rows = measured(docs, ["doc_id", "source"])
    bad = frequent_lines(docs, min_docs, host_share)
    rows = rows.alias("m").join(bad.alias("b"), F.expr(
        "m.doc_id <=> b.q_id and m.q_hash = b.q_hash and m.source <=> b.q_host"), "left").select(
        "m.*", F.coalesce("q_removed", F.lit(0)).cast("long").alias("q_removed"), "q_bad")
    left = F.col("q_n_words") - F.col("q_removed")
    return rows.withColumn("q_kept", ~F.col("q_base_failed") & (left >= keep_share * F.col("q_n_words")))


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """One row per document: the base measures, base_failed, kept and the words in removed lines."""
    return judged(docs, **limits).select(
        "doc_id", *[F.col(f"q_{c}").alias(c) for c in (
            "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")],
        F.col("q_removed").alias("n_removed_words"))


def clean(docs: DataFrame, **limits) -> DataFrame:
    """The kept documents, all columns, without their lines above the limit (n_chars follows the text).

    The verdicts are written first: a filter on them would otherwise be pushed
    into the measures and compute these again and again.
    """
    found = judged(docs, **limits).select("doc_id", "source", "q_hash", "q_kept", "q_bad")
    found = stage(found.dropDuplicates(["doc_id", "source", "q_hash"]), "quality-verdicts").where("q_kept")
    rows = docs.select(F.struct(*docs.columns).alias("row"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("hash"))
    rows = rows.alias("d").join(found.alias("v"), F.expr(
        "d.row.doc_id <=> v.doc_id and d.hash = v.q_hash and d.row.source <=> v.source")).select("d.row", "v.q_bad")
    text = F.col("row.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~F.array_contains(
        "q_bad", line_hash(normal_line(line)))), "\n")
    return with_text(rows, docs.columns, F.when(F.col("q_bad").isNull(), text).otherwise(kept))


#: DuckDB SQL for ``verdicts`` over documents.
VERDICTS_SQL = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS body FROM documents),
words AS (
    SELECT rid, unnest(found) AS word, generate_subscripts(found, 1) AS p
    FROM (SELECT rid, regexp_extract_all(body, '[^\x20\x09-\x0D]+') AS found FROM docs)),
windows AS (
    SELECT rid, p, word AS a, lead(word) OVER w AS b, lead(word, 2) OVER w AS c
    FROM words WINDOW w AS (PARTITION BY rid ORDER BY p)),
twice AS (
    SELECT rid, p FROM windows WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (
    SELECT rid, count(DISTINCT p + step) AS n FROM twice, (VALUES (0), (1), (2)) s(step) GROUP BY rid),
lines AS (
    SELECT rid, p, line, trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS bare
    FROM (SELECT rid, unnest(cut) AS line, generate_subscripts(cut, 1) AS p
          FROM (SELECT rid, string_split(body, chr(10)) AS cut FROM docs))
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
again AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
held AS (
    SELECT rid, p, host, left(md5(lower(bare)), 15) AS h, length(bare) - length(replace(bare, ' ', '')) + 1 AS n
    FROM lines JOIN docs USING (rid)),
named AS (SELECT rid, host, string_agg(h, ' ' ORDER BY p) AS who FROM held GROUP BY rid, host),
hosts AS (SELECT host, count(DISTINCT who) AS n FROM named GROUP BY host),
above AS (
    SELECT held.host, h FROM held JOIN named USING (rid)
    JOIN hosts ON held.host IS NOT DISTINCT FROM hosts.host
    GROUP BY held.host, h, hosts.n
    HAVING count(DISTINCT who) > {MIN_DOCS} AND count(DISTINCT who) > {HOST_SHARE}::DOUBLE * hosts.n),
cut AS (
    SELECT rid, sum(held.n) AS n FROM held
    JOIN above ON held.h = above.h AND held.host IS NOT DISTINCT FROM above.host GROUP BY rid),
base AS (
    SELECT d.rid, d.doc_id, d.body, len(regexp_extract_all(d.body, '[^\x20\x09-\x0D]+')) AS n_words,
        length(regexp_replace(d.body, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(d.body) - length(regexp_replace(d.body, '[{SYMBOLS}]', '', 'g')) AS n_symbols,
        coalesce(a.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM docs d LEFT JOIN again a USING (rid) LEFT JOIN covered c USING (rid)),
judged AS (
    SELECT base.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
        coalesce(cut.n, 0) AS n_removed_words
    FROM base LEFT JOIN cut USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
    NOT base_failed AND n_words - n_removed_words >= {KEEP_SHARE}::DOUBLE * n_words AS kept,
    n_removed_words::BIGINT AS n_removed_words
FROM judged
"""
