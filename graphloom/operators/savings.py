"""What an answer saves against the files it comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reduction(baseline: Column, sent: Column) -> Column:
    """Hundredths of the baseline that aren't sent, to one decimal; 0 without a baseline."""
    return F.when(baseline > 0, F.round(F.lit(100.0) * F.greatest(baseline - sent, F.lit(0)) / baseline, 1)).otherwise(0.0)


def savings(selected: DataFrame, files: DataFrame, sent: DataFrame, group: list[str] | None = None) -> DataFrame:
    """(group, sent, baseline, files_counted, saved, reduction_pct) for answers.

    selected: (group, file) of what an answer shows; files: (file, tokens), whole
    files, those missing aren't counted; sent: (group, sent) tokens of the answers.
    """
    group = group or []
    named = selected.select(*group, "file").distinct().join(files.select("file", "tokens").where("tokens IS NOT NULL"), "file")
    whole = named.groupBy(*group).agg(F.sum("tokens").alias("baseline"), F.count("*").alias("files_counted"))
    both = sent.join(whole, group, "left") if group else sent.crossJoin(F.broadcast(whole))
    base = F.coalesce("baseline", F.lit(0).cast("long"))
    return both.select(*group, "sent", base.alias("baseline"), F.coalesce("files_counted", F.lit(0).cast("long")).alias("files_counted"), F.greatest(base - F.col("sent"), F.lit(0)).alias("saved"), reduction(base, F.col("sent")).alias("reduction_pct"))


def summary(baseline: Column, sent: Column, files: Column, percent: Column) -> Column:
    """One line on a saving, which is one only if nobody reads the files again."""
    told = F.format_string("Up to ~%.1f%% smaller than the %d relevant file(s) in full (~%d → %d tokens), if they aren't read again.", percent, files, baseline, sent)
    return F.when(baseline > 0, told).otherwise("No files to compare with.")


def footer(baseline: Column, sent: Column, percent: Column) -> Column:
    """A line under an answer; empty without a baseline."""
    return F.when(baseline > 0, F.format_string("\n\n---\nup to %.1f%% smaller (~%d → %d tokens)\n", percent, baseline, sent)).otherwise("")
