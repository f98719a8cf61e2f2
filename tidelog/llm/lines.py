"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

Lines that occur more than once get integer IDs in the order of their digests. Doubling ranks the runs of two lines by the ranks of their
lines, those of four by those of two, and so on, as deep as the shortest run to be removed: suffixes of equal rank are an interval of the suffix
array with a common prefix of that many lines. Of such an interval the first member, by (doc_id, place), stays, and the others are
later copies; the runs that overlap are one maximal repeated run, and its lines are deleted.

Runs that nothing repeats are left out at each step, so a step handles only what may still be a copy. DataFrame functions only.

Null texts stay null, empty ones empty; a text that loses all its lines becomes empty. Lines are compared without white space around them. Rows
with equal id and text are one document stored again: both keep or lose the same lines. Null ids sort last. Other columns are kept; a column
named `removed` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import saved

MIN_LINES = 3


def suffixes(df: DataFrame) -> DataFrame:
    """One row per line of each different document (doc_id, _text_hash, text), numbered so that neighbours in a document have adjacent numbers:
    place, left (lines from here to the document's end), digest, and the document's columns."""
    lines = df.select("doc_id", "_text_hash", F.split("text", "\n", -1).alias("_lines")).select(
        "doc_id", "_text_hash", F.size("_lines").alias("_n"), F.posexplode(F.transform("_lines", lambda x: F.unhex(F.md5(F.btrim(x, F.lit(" \t\r\x0b\x0c")))))).alias("pos", "digest")
    )
    narrow = saved(lines, "lines")
    # Whole documents stay in one part of the range; repeated rows fall together there.
    ranged = narrow.withColumn("_none", F.col("doc_id").isNull()).repartitionByRange("_none", "doc_id", "_text_hash")
    once = ranged.groupBy("_none", "doc_id", "_text_hash", "pos").agg(F.first("digest").alias("digest"), F.first("_n").alias("_n"))
    ordered = once.sortWithinPartitions("_none", "doc_id", "_text_hash", "pos")
    return saved(ordered.select(F.monotonically_increasing_id().alias("place"), (F.col("_n") - F.col("pos")).alias("left"), "digest", "doc_id", "_text_hash", "pos"), "suffixes")


def ranked(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Replace the keys by their rank in sorted order, and add `first`, the first place with these keys. Keys met once are left out."""
    counted = runs.groupBy(*keys).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    order = counted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id())
    # Read back: the ranks are fixed, and a hot key's runs can be split between tasks of the join.
    return saved(runs.join(saved(order, "ranks"), keys).drop(*keys), "ranked")


def doubled(runs: DataFrame, step: int) -> DataFrame:
    """Each run with the run that starts `step` lines later in the same document: place, left, head, next."""
    later = runs.select((F.col("place") - step).alias("place"), F.col("rank").alias("next"))
    # The document must reach beyond the step; the later run's own length is part of its rank.
    return runs.where(F.col("left") > step).select("place", "left", F.col("rank").alias("head")).join(later, "place")


def later_copies(lines: DataFrame, min_lines: int) -> DataFrame:
    """Places where a run of `min_lines` lines starts that also starts at an earlier place."""
    runs, length = ranked(lines.select("place", "left", "digest"), ["digest"]), 1
    while length < min_lines:
        step = min(length, min_lines - length)  # the last step overlaps, so that any length can be reached
        runs, length = ranked(doubled(runs, step), ["head", "next"]), length + step
    return runs.where(F.col("place") > F.col("first")).select("place", "first")


def without(lines: Column, removed: Column) -> Column:
    """An array without the elements at the given sorted positions, in time linear in both."""
    bounds = F.concat(F.array(F.lit(-1)), removed, F.array(F.size(lines)))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(removed)), lambda j: F.slice(lines, F.element_at(bounds, j + 1) + 2, F.element_at(bounds, j + 2) - F.element_at(bounds, j + 1) - 1)))


def removed_lines(df: DataFrame, min_lines: int) -> DataFrame:
    """Sorted positions of the lines to be deleted, per document that loses any: doc_id, _text_hash, positions."""
    lines = suffixes(df)
    gone = later_copies(lines, min_lines).select(F.explode(F.sequence(F.lit(0), F.lit(min_lines - 1))).alias("_k"), "place").select((F.col("place") + F.col("_k")).alias("place")).distinct()
    return lines.join(gone, "place", "left_semi").groupBy("doc_id", "_text_hash").agg(F.sort_array(F.collect_list("pos")).alias("_positions"))  # one document's lines


def deduplicate(df: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """`df` (doc_id, text, ...) with the later copies of runs of at least `min_lines` lines deleted from `text`; adds `removed`, the positions
    of the deleted lines in the original text."""
    kept = [c for c in df.columns if c not in ("removed", "_text_hash")]
    docs = df.select(*[F.col(f"`{c}`") for c in kept], F.xxhash64("text").alias("_text_hash"))
    gone = removed_lines(docs.where("text is not null").select("doc_id", "_text_hash", "text"), min_lines)
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("_text_hash").alias("_hash"), "_positions")
    joined = docs.join(gone.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    text = F.when(F.col("_positions").isNull(), F.col("text")).otherwise(F.array_join(without(F.split("text", "\n", -1), F.col("_positions")), "\n"))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept], F.coalesce("_positions", F.array().cast("array<int>")).alias("removed"))
