"""URL filters: host-suffix and path-prefix expressions, matched by short hash and confirmed by full digest."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hexadecimal digits of a digest that the join compares: four bytes.
SHORT = 8
#: Repeats of a row are written out in runs of so many.
RUN = 100_000
ALLOW, BLOCK = "allow", "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What is between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; then up to ``?`` or ``#``.

    Both are empty for a null url and one without ``://``. Ports and user names stay parts of the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*+", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*+([^?#]*+)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(action, host, path) of a few rules given as tuples. Long lists are read from a table of these columns."""
    quoted = ", ".join("({})".format(", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r)) for r in rules)
    return spark.sql(f"select * from values {quoted} as rules(action, host, path)")


def _digest(host: Column, path: Column) -> Column:
    """Digest of an expression. A path is empty or starts with a slash, and no host has one, so the text is unambiguous."""
    return F.sha2(F.concat(host, path), 256)


def _suffixes(host: Column, labels: list[int]) -> Column:
    """The last 1, 2, ... labels of a host, for the numbers of labels that rules have."""
    return F.array_distinct(F.array(*(F.substring_index(host, ".", -n) for n in labels)))


def _prefixes(path: Column, slashed: int, lengths: list[int]) -> Column:
    """The prefixes of a path that a rule can have: those that end in a slash, up to the longest such rule, and those of the
    lengths of the other rules. The empty prefix counts if a rule has it."""
    short = F.substring(path, 1, slashed)
    at = F.filter(F.sequence(F.lit(1), F.length(short)), lambda i: F.substring(short, i, F.lit(1)) == "/")
    found = F.when(F.length(short) > 0, F.transform(at, lambda i: F.substring(short, F.lit(1), i)))
    whole = [F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(found, F.array().cast("array<string>")), F.array(*whole).cast("array<string>"))))


def filter_urls(
    pages: DataFrame, rules: DataFrame, *, default: str = ALLOW, page_id: str = "page_id", url: str = "url"
) -> DataFrame:
    """(page_id, host, path, rule, verdict): the rule that decides each url, and what it says.

    ``rules`` has ``action`` (``allow`` or ``block``), ``host`` and ``path``. A rule fits its host and all subdomains
    where the path starts with the rule's; of several the longest text ``host + path`` wins, then the longest host,
    then ``block``. Urls that no rule fits get ``default`` and a null rule.

    1. Each url is expanded into the suffixes of its host and the prefixes of its path, by whole labels, and at slashes.
       Expressions longer than any rule, in labels or in characters, are left out, since nothing can equal them: a very long url
       gives no more of them than a short one. Rules whose path ends inside a segment add their lengths to the prefixes.
    2. Digests of the expressions are joined with those of the rules on their first four bytes.
    3. Candidates with the same full digest are confirmed, and the one that takes precedence is kept.

    Urls that repeat with their id are one row until the end, so a page that holds a third of all rows is added up in the
    map tasks. Rules are never broadcast by force: Spark does it where their size is below its threshold, and the
    urls are then moved once; otherwise both sides are sorted by the short hash, and Spark splits those of a
    hot host. Only built-in functions are used.

    A row is returned for each row of ``pages``, with null ids and repeated rows. Null urls and those without
    ``://`` have empty host and path and fit no rule. Rules with a null or an empty host, with a null path, or whose path
    does not start with a slash fit nothing; repeated rules count once. Other columns, whatever their names, are not read.
    An empty table gives no rows; without rules every url gets ``default``.
    """
    usable = (F.col("host") != "") & ((F.col("path") == "") | F.col("path").startswith("/")) & F.col("action").isin(ALLOW, BLOCK)
    known = (
        rules.select(F.lower("action").alias("action"), F.translate("host", UPPER, LOWER).alias("host"), "path")
        .where(usable)
        .groupBy("host", "path")
        .agg(F.max("action").alias("action"))
    )
    ends = F.col("path").endswith("/")
    shape = known.agg(
        F.collect_set(F.size(F.split("host", r"\."))).alias("labels"),
        F.coalesce(F.max(F.when(ends, F.length("path"))), F.lit(0)).alias("slashed"),
        F.collect_set(F.when(~ends, F.length("path"))).alias("lengths"),
    ).first()
    host, path = host_and_path(F.col(url))
    each = ["id", "host", "path"]
    base = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path")).groupBy(*each).agg(F.count(F.lit(1)).alias("copies"))
    if shape["labels"]:
        hosts = _suffixes(F.col("host"), sorted(shape["labels"]))
        paths = _prefixes(F.col("path"), shape["slashed"], sorted(shape["lengths"]))
        spread = base.withColumn("of_host", F.explode_outer(hosts)).withColumn("of_path", F.explode_outer(paths))
        digests = spread.withColumn("digest", _digest(F.col("of_host"), F.col("of_path"))).withColumn("short", F.substring("digest", 1, SHORT))
        listed = known.select(
            F.concat("host", "path").alias("rule"), "action", F.length("host").alias("host_length"),
            _digest(F.col("host"), F.col("path")).alias("rule_digest"),
        ).withColumn("rule_short", F.substring("rule_digest", 1, SHORT))
        matched = digests.join(listed, F.col("short") == F.col("rule_short"), "left")
        fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), "host_length", "action", "rule"))
        base = matched.groupBy(*each, "copies").agg(F.max(fits).alias("best"))
    else:
        base = base.withColumn("best", F.lit(None).cast("struct<n int, host_length int, action string, rule string>"))
    runs = base.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(RUN).cast("long"))))
    last = F.least(F.col("first") + RUN, F.col("copies")) - 1
    rows = runs.withColumn("copy", F.explode(F.sequence(F.col("first"), last)))
    return rows.select(
        F.col("id").alias("page_id"), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(default)).alias("verdict"),
    )
