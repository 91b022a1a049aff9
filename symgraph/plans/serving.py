"""What a published state may serve: signals, reasons, staleness ladders, repair by one at a time, the cached face."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import iso_epoch

#: Signals of an evaluation: null is unknown.
SIGNALS = "graph_lags boolean, identity_algo_upgrade boolean, identity_drift boolean, doc_set_drift boolean, corpus_policy_drift boolean, source_newer boolean, head_drift boolean"


def needs_rebuild() -> Column:
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return on("graph_lags") | on("identity_algo_upgrade") | on("identity_drift") | on("doc_set_drift") | on("corpus_policy_drift") | (F.col("identity_drift").isNull() & on("source_newer"))


def serves() -> Column:
    """current-tree, committed-baseline or legacy-signals. A moved head never makes an answer stale."""
    return (
        F.when(F.coalesce("identity_algo_upgrade", F.lit(False)), "committed-baseline").when(F.col("identity_drift").isNull(), "legacy-signals")
        .when(~F.col("identity_drift") & ~needs_rebuild(), "current-tree").otherwise("committed-baseline")
    )


def stale_reasons() -> Column:
    """Reasons in fixed order; the head's drift is none."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.array_compact(F.array(
        F.when(on("graph_lags"), "torn-plane"), F.when(on("identity_algo_upgrade"), "identity-algo-upgrade"), F.when(on("identity_drift"), "content-drift"),
        F.when(on("doc_set_drift"), "doc-set-drift"), F.when(on("corpus_policy_drift"), "policy-drift"), F.when(F.col("identity_drift").isNull() & on("source_newer"), "legacy-signals"),
    ))


def evaluated(signals: DataFrame) -> DataFrame:
    """signals with fresh, serves and reasons."""
    return signals.withColumns({"fresh": ~needs_rebuild(), "serves": serves(), "reasons": stale_reasons()})


def snapshot_stale(graph_sha: Column, updated: Column, mtime: Column, head_sha: Column, head_epoch: Column) -> Column:
    """sha, last_updated, mtime or null: the first of the three that is known decides whether a graph is older than the head."""
    known = lambda c: c.isNotNull() & (c != "")
    # A list of one names the parsed time, so that it is parsed once.
    later = F.transform(F.array(iso_epoch(F.nullif(updated, F.lit("")))), lambda at: F.when(at.isNotNull(), F.when(at < head_epoch, "last_updated")).when(mtime < head_epoch, "mtime"))
    return F.when(known(graph_sha), F.when(~graph_sha.eqNullSafe(head_sha), "sha")).otherwise(F.get(later, F.lit(0)))


def cache_stale(cache_mtime: Column, index_mtime: Column, readable: Column, schema: Column, expected: str, head_drift: Column) -> Column:
    """The first of five signals against a cache, or null: stat, older, corrupt, schema, head."""
    return (
        F.when(cache_mtime.isNull() | index_mtime.isNull(), "stat").when(cache_mtime < index_mtime, "older").when(~readable, "corrupt")
        .when(~schema.eqNullSafe(F.lit(expected)), "schema").when(F.coalesce(head_drift, F.lit(False)), "head")
    )


def eval_scope(stamped: Column, detected: Column) -> Column:
    """Languages to evaluate: the stamped ones and what was detected; what was detected if nothing was stamped."""
    return F.when(stamped.isNull(), detected).otherwise(F.array_union(stamped, F.coalesce(detected, F.array().cast("array<string>"))))


def two_faces(spark: SparkSession, cache: str, index_key: str, rebuild: Callable[[], DataFrame]) -> tuple[DataFrame, str, str | None]:
    """(rows, face, warning): the Parquet cache if it was built from this content; else it is built anew, under a new name and switched by its key; the rows themselves if that fails.

    A cache is a folder named by the key of the index's content, so readers of an older one are never disturbed.
    """
    path = f"{cache.rstrip('/')}/{index_key}"
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(cache).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if done():
        return spark.read.parquet(path), "cache", None
    rows = rebuild()
    try:
        rows.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path), "rebuilt", None
    except Exception as e:  # the answer doesn't depend on the cache
        return rows, "index", f"the cache could not be built: {type(e).__name__}"


class Heal:
    """Repairs a stale state once, however many ask: a lock file, stolen when it is older than `most_age`; others wait up to `wait` and then serve what is there. After a repair that left the state stale, `cooldown` seconds pass before the next, unless the head has moved."""

    def __init__(self, folder: str, most_age: float = 600, wait: float = 120, cooldown: float = 600, poll: float = 0.2, clock: Callable[[], float] = time.time):
        self.lock, self.mark = os.path.join(folder, ".heal.lock"), os.path.join(folder, ".heal.churn")
        self.most_age, self.wait, self.cooldown, self.poll, self.clock = most_age, wait, cooldown, poll, clock

    def _acquire(self) -> bool:
        for _ in range(2):
            try:
                os.close(os.open(self.lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY))
                os.utime(self.lock, (self.clock(), self.clock()))
                return True
            except FileExistsError:
                try:
                    if self.clock() - os.stat(self.lock).st_mtime <= self.most_age:
                        return False
                    os.unlink(self.lock)
                except FileNotFoundError:
                    pass
        return False

    def ensure(self, is_stale: Callable[[], bool], repair: Callable[[], None], head_moved: bool = False) -> str:
        """fresh, healed, cooling, served-stale or peer-healed."""
        if not head_moved and os.path.exists(self.mark) and self.clock() - os.stat(self.mark).st_mtime < self.cooldown:
            return "cooling"
        if not is_stale():
            return "fresh"
        if self._acquire():
            try:
                repair()
                if is_stale():
                    with open(self.mark, "w"):
                        pass
                    os.utime(self.mark, (self.clock(), self.clock()))
                    return "served-stale"
                if os.path.exists(self.mark):
                    os.unlink(self.mark)
                return "healed"
            finally:
                if os.path.exists(self.lock):
                    os.unlink(self.lock)
        until = self.clock() + self.wait
        while self.clock() < until and os.path.exists(self.lock):
            time.sleep(self.poll)
        return "served-stale" if is_stale() else "peer-healed"


def writer_lock(path: str, budget: float = 5.0):
    """A context that holds an exclusive lock on a file, or raises TimeoutError after `budget` seconds."""
    import contextlib
    import fcntl

    @contextlib.contextmanager
    def held():
        with open(path, "a") as f:
            until = time.monotonic() + budget
            while True:
                try:
                    fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if time.monotonic() >= until:
                        raise TimeoutError(f"{path} is held by another writer") from None
                    time.sleep(0.05)
            try:
                yield
            finally:
                fcntl.flock(f, fcntl.LOCK_UN)

    return held()


def pick_sidecar(catalog: DataFrame, head: str | None) -> tuple[Mapping | None, str | None]:
    """The entry (path, commit, mtime) of the head's commit, else the newest with a warning; None without any."""
    exact = F.col("commit").eqNullSafe(F.lit(head))
    best = catalog.orderBy(F.desc(exact), F.desc("mtime"), F.desc("path")).limit(1).collect()
    if not best:
        return None, "no sidecar"
    row = best[0].asDict()
    return row, None if head is not None and row["commit"] == head else f"no sidecar of {head}; the newest is of {row['commit']}"
