"""Quality rules with cross-document line frequency.  DataFrame functions only.

The lines of a text (cut at \\n) are normalised: lower case, runs of digits as 0, runs of separators as one space,
trimmed.  A line without a word is left aside.  The 64-bit hash of (host, normalised line) stands for the line; for every
hash the distinct documents of the host that hold it are counted (within a document a line counts once; every row is a
document).  A line is above the limit, boilerplate, if more than ``LEAST`` documents of its host hold it and these are more than one in
``SHARE`` of the host's documents; both limits depend on the host alone, so they mean the same at every size.  Boilerplate
lines are removed.  A document is depleted, and rejected, if more than half of its words went with them or fewer than ``LEAST_WORDS``
words are left.  Two plain rules stand before: at least ``LEAST_WORDS`` words, and at most half of the words in repeated 3-word windows.

``quality_rules`` reads the texts once and writes one narrow row per document (counts, line hashes with their words; the row number is
made in that write, so it is fixed).  Texts are never shuffled.  Line counts are combined before their shuffle and keyed by the line, so
neither a hot host nor a hot line is one task's work; the lines above the limit meet the documents by broadcast while counted small, else by a salted join.
``clean`` returns the documents themselves without their boilerplate lines.

Cases: a null text is empty, has no line and fails the base rules; null hosts are one host; rows that repeat an id are documents of their own
(equal rows get equal verdicts); two lines whose hashes collide would count as one (2^-64 a pair); an empty table gives an empty one.  Long texts are
handled in time near their length (one sort of their windows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import BROADCAST_ROWS, looked_up
from .store import Scratch

#: a boilerplate line stands in more documents of its host than this
LEAST = 10
#: and in more than one in so many of them
SHARE = 100
LEAST_WORDS = 50
#: in per cent of the words: most that repeated windows, or removed lines, may hold
MOST_REPEATED = MOST_REMOVED = 50
SYMBOLS = "#*$%&|<>"
_SEP = "\x20\x09\x0a\x0b\x0c\x0d"
_SEP_RUN = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` as an array."""
    inner = F.btrim(text, F.lit(_SEP))
    return F.when(F.length(inner) > 0, F.split(inner, _SEP_RUN)).otherwise(F.expr("cast(array() as array<string>)"))


def normalised(line: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), _SEP_RUN, " "), F.lit(" "))


def _repeated_words(grams: Column, placed: Column) -> Column:
    """Words covered by windows of three that are found twice or more; ``placed``: (hash, position), sorted."""
    before = lambda i: F.get(placed, i - 1)["g"].eqNullSafe(F.get(placed, i)["g"])
    after = lambda i: F.get(placed, i + 1)["g"].eqNullSafe(F.get(placed, i)["g"])
    at = F.transform(F.sequence(F.lit(0), F.size(placed) - 1), lambda i: F.when(before(i) | after(i), F.get(placed, i)["i"]))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.sort_array(F.filter(at, lambda p: p.isNotNull())), start,
        lambda acc, p: F.struct((p + 3).alias("end"), (acc["n"] + (p + 3 - F.greatest(p, acc["end"]))).cast("long").alias("n")),
        lambda acc: acc["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered)


def measured(docs: DataFrame, host: str, keep: list[Column]) -> DataFrame:
    """``keep`` and, per row, the word and line counts and ``_lines``: (line hash with its host, number, words) of every line with a word."""
    df = docs.select(*keep, F.col(host).cast("string").alias("_host"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_words", _words(F.col("_text"))).withColumn("_split", F.split("_text", "\n"))
    df = df.withColumn("n_words", F.size("_words").cast("long"))
    w = F.col("_words")
    none = F.expr("cast(array() as array<bigint>)")
    grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    df = df.withColumn("_grams", F.when(F.size(w) >= 3, grams).otherwise(none))
    df = df.withColumn("_placed", F.sort_array(F.transform("_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    full = F.filter("_split", lambda x: F.length(F.btrim(x, F.lit(_SEP))) > 0)
    df = df.withColumn("_full", full)
    numbered = F.transform("_split", lambda x, i: F.struct(
        F.when(F.length(F.btrim(x, F.lit(_SEP))) > 0, F.xxhash64(F.col("_host"), normalised(x))).alias("key"), i.alias("line"), F.size(_words(x)).alias("words")))
    return df.select(
        *(c for c in df.columns if not c.startswith("_") or c in ("_row", "_id")), "_host",
        F.length(F.translate("_text", _SEP, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_grams"), F.col("_placed")).alias("n_repeat_words"),
        F.filter(numbered, lambda x: x["key"].isNotNull()).alias("_lines"),
    )


def boilerplate(rows: DataFrame, scratch: Scratch, least: int = LEAST, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(key, line_docs): line hashes above the limit of their host, a written table."""
    counts = rows.select("_host", F.explode(F.array_distinct("_lines.key")).alias("key")).groupBy("key", "_host").agg(F.count(F.lit(1)).alias("line_docs"))
    counts = scratch.write(counts.filter(F.col("line_docs") > least), "counts")
    hosts = scratch.write(rows.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs")), "hosts")
    both = looked_up(counts, hosts, "_host", spread=F.col("key"), broadcast_rows=broadcast_rows)
    return scratch.write(both.filter(F.col("line_docs") * share > F.col("host_docs")).select("key", "line_docs"), "boilerplate")


def _verdicts(rows: DataFrame, scratch: Scratch, least: int, share: int, broadcast_rows: int, *more: Column) -> DataFrame:
    """Adds removed_lines, removed_words, base_failed and kept to written rows with ``_id``, and aggregates ``more`` of the removed lines."""
    frequent = boilerplate(rows, scratch, least, share, broadcast_rows)
    lines = rows.select("_id", F.explode("_lines").alias("x")).select("_id", F.col("x.key").alias("key"), F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    gone = looked_up(lines, frequent, "key", spread=F.col("_id"), broadcast_rows=broadcast_rows)
    gone = gone.groupBy("_id").agg(F.count(F.lit(1)).alias("removed_lines"), F.sum("words").cast("long").alias("removed_words"), *more)
    df = rows.drop("_lines").join(gone.withColumnRenamed("_id", "_gone"), F.col("_id") == F.col("_gone"), "left").drop("_gone")
    df = df.fillna(0, ["removed_lines", "removed_words"])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    depleted = (100 * F.col("removed_words") > MOST_REMOVED * F.col("n_words")) | (F.col("n_words") - F.col("removed_words") < LEAST_WORDS)
    return df.withColumn("base_failed", failed).withColumn("kept", ~(failed | depleted))


def quality_rules(docs: DataFrame, host: str = "source", least: int = LEAST, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """documents -> doc_id, counts, base_failed, kept, removed_lines and removed_words; one row per row."""
    scratch = Scratch(docs.sparkSession, "linefreq")
    keep = [F.col("doc_id").cast("long").alias("doc_id")]
    rows = scratch.write(measured(docs, host, keep).withColumn("_id", F.monotonically_increasing_id()), "rows")
    out = _verdicts(rows, scratch, least, share, broadcast_rows)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_lines", "removed_words")


def clean(docs: DataFrame, host: str = "source", least: int = LEAST, share: int = SHARE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The kept documents, with all their columns, without their boilerplate lines; n_chars, if there, is recounted where lines went."""
    scratch = Scratch(docs.sparkSession, "linefreq")
    whole = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("_row"), F.col("text"), F.col(host).alias("_of"))
    whole = scratch.write(whole.withColumn("_id", F.monotonically_increasing_id()), "texts")
    rows = scratch.write(measured(whole, "_of", [F.col("_id")]), "rows")
    judged = _verdicts(rows, scratch, least, share, broadcast_rows, F.collect_list("line").alias("_removed"))
    df = whole.join(judged.filter("kept").select(F.col("_id").alias("_kept"), "_removed"), F.col("_id") == F.col("_kept"))
    df = df.withColumn("_split", F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "_removed")
    df = df.withColumn("_left", left)
    text = F.array_join(F.transform("_left", lambda i: F.get(F.col("_split"), i)), "\n")
    df = df.withColumn("_new", F.when(F.size("_left") < F.size("_split"), text))
    out = []
    for c, t in docs.dtypes:
        old = F.col("_row")[c]
        new = {"text": F.col("_new"), "n_chars": F.length("_new").cast(t)}.get(c)
        out.append(F.when(F.col("_new").isNotNull(), new).otherwise(old).alias(c) if new is not None else old.alias(c))
    return df.select(*out)
