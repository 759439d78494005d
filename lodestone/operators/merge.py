"""Idempotent merges: each takes the rows that exist and the rows that arrive and returns the new table.

Incoming rows are reduced by key first, in arrival order, so that duplicates inside a batch obey the
same rule as duplicates against the table; merging the same batch again changes nothing. Keys may be
null: null equals null, as in a unique index that treats nulls alike.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _same(keys: Sequence[str], left: str = "", right: str = "_r_") -> Column:
    on = F.lit(True)
    for key in keys:
        on = on & F.col(f"{left}{key}").eqNullSafe(F.col(f"{right}{key}"))
    return on


def _keys_of(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_r_{k}") for k in keys])


def reduce_batch(incoming: DataFrame, keys: Sequence[str], best: Column) -> DataFrame:
    """The row of each key for which best is smallest."""
    others = [c for c in incoming.columns if c not in keys]
    if not others:
        return incoming.distinct()
    return incoming.groupBy(*keys).agg(F.min_by(F.struct(*others), best).alias("_row")).select(*keys, "_row.*").select(*incoming.columns)


def new_rows(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """The first incoming row of each key that the table does not have."""
    return reduce_batch(incoming, keys, F.col(arrival)).join(_keys_of(existing, keys), _same(keys), "left_anti")


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Keep what exists; of each new key the first row to arrive."""
    return existing.unionByName(new_rows(existing, incoming, keys, arrival))


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], arrival: str) -> DataFrame:
    """Last write wins: the last row to arrive replaces what exists."""
    latest = reduce_batch(incoming, keys, -F.col(arrival))
    return existing.join(_keys_of(latest, keys), _same(keys), "left_anti").unionByName(latest)


def keep_least(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], by: str, arrival: str) -> DataFrame:
    """Conditional update: of all rows of a key the least by a column stays, the stored one on a tie."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return reduce_batch(both, keys, F.struct(F.col(by), "_new", arrival)).drop("_new")


def insert_two_keys(existing: DataFrame, incoming: DataFrame, first: str, second: str, group: str, arrival: str) -> DataFrame:
    """Insert rows that clash on neither of two unique keys inside a group.

    In this order: repeats of the first key inside the batch go, then rows with either key in the
    table, then repeats of the second key. Another order would drop rows that should stay.
    """
    one = reduce_batch(incoming, [group, first], F.col(arrival))
    fresh = one.join(_keys_of(existing, [group, first]), _same([group, first]), "left_anti")
    fresh = fresh.join(_keys_of(existing, [group, second]), _same([group, second]), "left_anti")
    return existing.unionByName(reduce_batch(fresh, [group, second], F.col(arrival)).select(*existing.columns))


def strike_states(outcomes: DataFrame, key: str, outcome: str, ceiling: int = 3) -> DataFrame:
    """State of each key from its outcomes: fetched for good once fetched, no_file after ceiling misses, else missing."""
    found = outcomes.groupBy(key).agg(F.bool_or(F.col(outcome) == "fetched").alias("_ok"), F.count_if(F.col(outcome) == "missing").alias("strikes"))
    status = F.when(F.col("_ok"), "fetched").when(F.col("strikes") >= ceiling, "no_file").otherwise("missing")
    return found.select(key, status.alias("status"), F.least("strikes", F.lit(ceiling)).cast("long").alias("strikes"))


def replace_children(existing: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Delete-then-insert: all rows of a parent that comes again are replaced."""
    parents = incoming.select(F.col(parent).alias("_parent")).distinct()
    return existing.join(parents, F.col(parent).eqNullSafe(F.col("_parent")), "left_anti").unionByName(incoming)


def replace_version(existing: DataFrame, incoming: DataFrame, parent: str, version: str) -> DataFrame:
    """Rows of the incoming version replace those of their parents that another version derived; other parents keep theirs."""
    done = incoming.select(F.col(parent).alias("_p"), F.col(version).alias("_v")).distinct()
    stale = F.col(parent).eqNullSafe(F.col("_p")) & ~F.col(version).eqNullSafe(F.col("_v"))
    return existing.join(done, stale, "left_anti").unionByName(incoming)


def current_version(rows: DataFrame, version: Column) -> DataFrame:
    """The derived rows of the given version alone, as readers see them before the others are replaced."""
    return rows.where(version)


def documents_and_jobs(incoming: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """One document for each content (the smallest key of equal ones) and one pending job for it, both from one input."""
    documents = incoming.groupBy(F.sha2(content, 256).alias("sha256")).agg(F.min(key).alias(key))
    jobs = documents.select(key, F.concat(F.lit("ingest:"), F.col(key).cast("string")).alias("dedupe_key"), F.lit("pending").alias("status"))
    return documents, jobs


def add_exchange(turns: DataFrame, threads: DataFrame, exchanges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Append each exchange (conv_id, question, answer, at) as two turns after the thread's last one, and touch its thread."""
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    placed = exchanges.join(last, "conv_id", "left").withColumn("_last", F.coalesce("_last", F.lit(-1)))
    made = F.array(*[F.struct((F.col("_last") + i).cast("long").alias("turn"), F.lit(role).alias("role"), F.col(text).alias("text")) for i, role, text in ((1, "user", "question"), (2, "assistant", "answer"))])
    added = placed.select("conv_id", F.explode(made).alias("_t")).select("conv_id", "_t.turn", "_t.role", "_t.text")
    touched = exchanges.groupBy("conv_id").agg(F.max("at").alias("touched"))
    kept = threads.join(touched.select(F.col("conv_id").alias("_c")), F.col("conv_id") == F.col("_c"), "left_anti")
    return turns.unionByName(added), kept.unionByName(touched)


def enqueue(jobs: DataFrame, wanted: DataFrame, now: str, cooldown_hours: int = 24) -> DataFrame:
    """New jobs for keys without a live job and without one made inside the cooldown: an anti join with a time condition.

    jobs: dedupe_key, status, created_at; wanted: dedupe_key and more. One job for each key.
    """
    moment = F.to_timestamp(F.lit(now))
    recent = jobs.where(F.col("status").isin("pending", "processing") | (F.col("created_at") > moment - F.make_dt_interval(hours=F.lit(cooldown_hours))))
    return wanted.dropDuplicates(["dedupe_key"]).join(recent.select(F.col("dedupe_key").alias("_k")), F.col("dedupe_key") == F.col("_k"), "left_anti")


def cascade_delete(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias("_p")), F.col(child_key) == F.col("_p"), "left_semi")


def set_null(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """References to parents that are gone become null."""
    found = children.join(parents.select(F.col(parent_key).alias("_p")).distinct(), F.col(child_key) == F.col("_p"), "left")
    return found.withColumn(child_key, F.col("_p")).drop("_p")


def delete_ids(rows: DataFrame, failing: DataFrame, key: str) -> DataFrame:
    return rows.join(failing.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")


def kept_presses(presses: DataFrame, group: str, at: str, minutes: int = 60) -> DataFrame:
    """Presses that count: each at least minutes after the last one that counted.

    A fold over each group's ordered presses: whether a press counts depends on the last that did, not on
    its neighbour. Groups are one user's presses, so the folded array is small.
    """
    ordered = presses.groupBy(group).agg(F.sort_array(F.collect_list(F.unix_seconds(F.col(at).cast("timestamp")))).alias("_t"))
    start = F.array().cast("array<bigint>")
    kept = F.aggregate("_t", start, lambda acc, t: F.when((F.size(acc) == 0) | (t - F.element_at(acc, -1) >= minutes * 60), F.array_append(acc, t)).otherwise(acc))
    # element_at on an empty array is guarded by the first condition
    return ordered.select(group, F.explode(kept).alias("_s")).select(group, F.timestamp_seconds("_s").alias(at))


def document_statuses(attempts: DataFrame) -> DataFrame:
    """Status of each document from its latest attempt: completed, failed, or pending again while tries are left.

    attempts: document_id, attempt, outcome (ok, rejected, error), max_attempts. A rejected document is
    failed at once; an error is retried until the last attempt. Ties of attempts go to the later outcome by name.
    """
    last = attempts.groupBy("document_id").agg(F.max(F.struct("attempt", "outcome", "max_attempts")).alias("_l")).select("document_id", "_l.*")
    status = F.when(F.col("outcome") == "ok", "completed").when((F.col("outcome") == "rejected") | (F.col("attempt") >= F.col("max_attempts")), "failed").otherwise("pending")
    return last.select("document_id", "attempt", status.alias("status"))


def unique_window(keys: Sequence[str], order: Sequence[Column]) -> Column:
    """Place of a row among those that share its keys."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
