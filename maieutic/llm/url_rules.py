"""op1: URL rules by a sort-merge range join.

A host becomes the key of its labels in reverse, each closed by U+0001
(``tionsh.example.net`` -> ``net.example.tionsh.`` with that mark).  All
subdomains of a rule's host then lie in one interval that starts at the rule's
key, and the intervals of two rules are nested or apart.  Rules and URLs are
sorted together; a sweep keeps the stack of rule hosts whose interval is still
open, and judges each URL by the open hosts only.

The range partitioning sorts by host key, then by path, so one hot host
spreads over many partitions.  A host interval that runs on across a partition
border is carried over: every partition leaves the hosts that are open at its
end, and a second pass over those few rows tells each partition what was open
at its start.  Neither rules nor URLs are broadcast or collected; the carried
stacks are bounded by partitions times open rules, and a URL reads its own partition's only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maieutic.llm.common import written

MARK = "\u0001"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) of a URL: host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, path
    up to ``?``, ``#`` or the end; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"\A([^/?#]*)", 1)), F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """Labels in reverse, each closed by the mark (empty host: empty key)."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(labels), MARK), F.lit(MARK)))


def key_prefixes(key: Column) -> Column:
    """Keys of the host itself and of its parent domains (empty host: the empty key alone)."""
    labels = F.split(F.rtrim(key, F.lit(MARK)), MARK)
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), MARK), F.lit(MARK))
    )
    return F.when(key == "", F.array(F.lit(""))).otherwise(parents)


class _Open:
    """The open rule hosts of a sweep, outermost first: (key, {path: (rule, verdict)})."""

    def __init__(self):
        self.stack: list[tuple[str, dict[str, tuple[str, str]]]] = []

    def close_for(self, key: str) -> None:
        # The empty host has no subdomains: its key is open for itself alone.
        while self.stack and not (key.startswith(self.stack[-1][0]) and (self.stack[-1][0] or not key)):
            self.stack.pop()

    def add(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}))
        paths = self.stack[-1][1]
        paths[path] = max(paths.get(path, (rule, verdict)), (rule, verdict))

    def best(self, path: str) -> tuple[str | None, str | None, int | None]:
        """(rule, verdict, key length) of the longest open rule that fits the path."""
        found: tuple[int, int, str, str] | None = None
        for key, paths in self.stack:
            tried = paths if len(paths) <= len(path) + 1 else (path[:n] for n in range(len(path) + 1))
            for p in tried:
                if p in paths and path.startswith(p):
                    rule, verdict = paths[p]
                    found = max(found or (-1, -1, "", ""), (len(rule), len(key), rule, verdict))
        return (found[2], found[3], found[1]) if found else (None, None, None)


_COLUMNS = ["kind", "part", "key", "path", "id", "host", "rule", "verdict", "depth"]
_SWEPT = "kind int, part int, key string, path string, id {id}, host string, rule string, verdict string, depth int"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rules (kind 0) and URLs (kind 1) in; judged URLs out, then the hosts left open (kind 2) and
    the partition's first key (kind 3)."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    open_hosts, first, id_type = _Open(), None, None
    for batch in batches:
        kinds, keys, paths, rules, verdicts = (batch.column(c).to_pylist() for c in ("kind", "key", "path", "rule", "verdict"))
        id_type = batch.column("id").type
        judged = []
        for kind, key, path, rule, verdict in zip(kinds, keys, paths, rules, verdicts):
            first = key if first is None else first
            open_hosts.close_for(key)
            if kind == 0:
                open_hosts.add(key, path, rule, verdict)
            else:
                judged.append(open_hosts.best(path))
        urls = batch.filter(pa.array([k == 1 for k in kinds]))
        rule, verdict, depth = zip(*judged) if judged else ((), (), ())
        yield pa.record_batch(
            [urls.column("kind"), pa.array([part] * len(judged), pa.int32()), urls.column("key"), urls.column("path"),
             urls.column("id"), urls.column("host"), pa.array(rule, pa.string()), pa.array(verdict, pa.string()),
             pa.array(depth, pa.int32())],
            names=_COLUMNS,
        )
    if first is None:
        return
    left = [(2, key, path, *rv) for key, paths in open_hosts.stack for path, rv in paths.items()] + [(3, first, "", None, None)]
    kind, key, path, rule, verdict = zip(*left)
    n = len(left)
    yield pa.record_batch(
        [pa.array(kind, pa.int32()), pa.array([part] * n, pa.int32()), pa.array(key, pa.string()), pa.array(path, pa.string()),
         pa.nulls(n, id_type), pa.nulls(n, pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string()),
         pa.array([len(k) for k in key], pa.int32())],
        names=_COLUMNS,
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(<id_col>, host, path, rule, verdict)``, one row per input row.

    ``rules`` is ``(host, path, verdict)``.  A rule fits its host and all
    subdomains if the URL's path starts with the rule's path; the longest rule
    string (host + path) wins, then the longer host, then the later string.  No
    rule: null and ``default``.  A null URL, or one without ``://``, has empty
    host and path and fits only a rule with both empty.  Rules with a null host or
    path count as empty there; rules with a null verdict are no rules.
    Repeated ids and rows keep their rows.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    id_type = urls.schema["id"].dataType.simpleString()
    urls = urls.select("id", host.alias("host"), path.alias("path")).select(
        F.lit(1).alias("kind"), host_key(F.col("host")).alias("key"), "path", "id", "host",
        F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    stated = rules.where("verdict IS NOT NULL").select(
        ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    )
    stated = stated.select(
        F.lit(0).alias("kind"), host_key(F.col("host")).alias("key"), "path", F.lit(None).cast(id_type).alias("id"),
        "host", F.concat("host", "path").alias("rule"), "verdict",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = urls.unionByName(stated)
    # Rules of a host sort before its URLs, whatever their path.
    place = [F.col("key"), F.col("kind"), F.col("path"), F.xxhash64("id")]
    ranged = both.repartitionByRange(n, *place).sortWithinPartitions("key", "kind", "path")
    swept = written(ranged.mapInArrow(_sweep, _SWEPT.format(id=id_type)), "url-sweep")

    # What was open at each partition's start: hosts left open by an earlier partition that are the host or
    # a parent domain of the partition's first key (sorted keys: then they hold in between as well).
    starts = swept.where("kind = 3").select(F.col("part").alias("p"), F.explode(key_prefixes(F.col("key"))).alias("key"))
    left = swept.where("kind = 2").select(
        F.col("part").alias("from"), F.col("key").alias("k"),
        F.struct("key", "path", "rule", "verdict", "depth").alias("held"),
    )
    carried = (
        starts.join(left, (F.col("key") == F.col("k")) & (F.col("p") > F.col("from")))
        .groupBy("p").agg(F.collect_set("held").alias("open"))
    )
    judged = swept.where("kind = 1").join(carried, F.col("part") == F.col("p"), "left")
    fits = F.filter(F.col("open"), lambda r: F.col("key").startswith(r["key"]) & F.col("path").startswith(r["path"]))

    def ranked(rule: Column, depth: Column, verdict: Column) -> Column:
        return F.struct(F.length(rule).alias("n"), depth.alias("depth"), rule.alias("rule"), verdict.alias("verdict"))

    known = F.when(F.col("rule").isNotNull(), ranked(F.col("rule"), F.col("depth"), F.col("verdict")))
    best = F.greatest(known, F.array_max(F.transform(fits, lambda r: ranked(r["rule"], r["depth"], r["verdict"]))))
    return judged.select("id", "host", "path", best.alias("best")).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
