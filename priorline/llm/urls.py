"""URL lists joined as of each capture's fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from priorline.llm.common import without

ALLOW, BLOCK, REMOVED = "allow", "block", "removed"


def host(url: Column) -> Column:
    """Lower-case host without user or port; null where the text is no absolute URL."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.when(found != "", F.rtrim(found, F.lit(".")))


def path(url: Column) -> Column:
    """Path without query and fragment, starting with a slash; empty for a bare host."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def _suffixes(name: Column, least: int) -> Column:
    """The host and its parent domains of at least ``least`` labels, longest first."""
    labels = F.split(name, r"\.")
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - least + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _prefixes(name: Column, path_: Column) -> Column:
    """host/first, host/first/second ... for every whole leading part of the path."""
    parts = F.filter(F.split(path_, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))).otherwise(
        F.array().cast("array<string>")
    )


def validity(entries: DataFrame, pattern: str = "pattern", action: str = "action", dated: str = "listed_at") -> DataFrame:
    """Intervals [since, until) in which a list entry says ``allow`` or ``block``.

    An entry is a dated statement about a pattern (a domain, which covers its subdomains, or host/path,
    which covers what lies below) and holds until the pattern's next statement; ``removed`` ends it.  Of
    statements with the same date the least action by name counts (allow, then block, then removed).
    Rows with a null pattern, action or date say nothing; repeated rows are one statement.
    """
    name = F.substring_index(F.col(pattern), "/", 1)  # domains have no case, paths have
    whole = F.concat(F.lower(name), F.substring(F.col(pattern), F.length(name) + 1, F.length(F.col(pattern))))
    clean = entries.select(whole.alias("pattern"), F.lower(F.col(action)).alias("action"), F.col(dated).cast("timestamp").alias("since")).dropna()
    daily = clean.groupBy("pattern", "since").agg(F.min("action").alias("action"))
    after = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    return daily.withColumn("until", after).filter(F.col("action").isin(ALLOW, BLOCK))


def evaluate(
    captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at", pattern: str = "pattern", action: str = "action", dated: str = "listed_at"
) -> DataFrame:
    """Add ``matched`` (the pattern that decides) and ``blocked`` to every capture, as of its fetch time.

    The longest active pattern decides; an allow entry can so except part of a blocked domain.  Each
    distinct (url, fetch time) is looked up once by equality on its own domain and path patterns and by
    its time's place in their intervals, so the work is captures x depth of the URL.  Captures with a null
    url or time, or no absolute URL, match nothing and are not blocked.  Columns of the two names are
    replaced; repeated captures are repeated.
    """
    spans = validity(entries, pattern, action, dated)
    asked = captures.select(F.col(url).alias("__u"), F.col(fetched).cast("timestamp").alias("__f")).dropna().distinct()
    # the fewest labels any listed domain has: shorter parents are in no list
    fewest = spans.agg(F.min(F.size(F.split(F.substring_index("pattern", "/", 1), r"\.")))).first()[0] or 1
    named = asked.withColumn("__h", host(F.col("__u"))).filter("__h IS NOT NULL")
    keys = F.concat(_suffixes(F.col("__h"), fewest), _prefixes(F.col("__h"), path(F.col("__u"))))
    probes = named.select("__u", "__f", F.explode(F.array_distinct(keys)).alias("pattern"))
    hits = probes.join(spans, "pattern").filter((F.col("since") <= F.col("__f")) & (F.col("until").isNull() | (F.col("__f") < F.col("until"))))
    decided = hits.groupBy("__u", "__f").agg(F.max(F.struct(F.length("pattern").alias("n"), "pattern", "action")).alias("__d"))
    rows = without(captures, "matched", "blocked")
    out = rows.join(decided, (F.col(url) == F.col("__u")) & (F.col(fetched).cast("timestamp") == F.col("__f")), "left")
    return out.select(*rows.columns, F.col("__d.pattern").alias("matched"), F.coalesce(F.col("__d.action") == BLOCK, F.lit(False)).alias("blocked"))
