"""Tables of records as they are kept: changes in sets, versions, deletions, states and logs.

Tables are not changed in place: every operator gives the table as it is after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def current(versions: DataFrame, key: list[str], at: str) -> DataFrame:
    """The newest version of each key, of appended ones; keys whose newest version is deleted are gone."""
    w = Window.partitionBy(*key).orderBy(F.col(at).desc())
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1 and not deleted").drop("_n")


def merged(old: DataFrame, new: DataFrame, key: list[str], now: str) -> DataFrame:
    """Old rows (key, ..., deleted_at) with the columns of new ones of their key: a row that was deleted is restored; keys that are new are appended."""
    columns = [c for c in old.columns if c not in (*key, "deleted_at")]
    n = new.select(*key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_new"))
    both = old.withColumn("_old", F.lit(True)).join(n, key, "full")
    picked = [F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    action = F.when(F.col("_old").isNull(), "created").when(F.col("_new") & F.col("deleted_at").isNotNull(), "restored").when(F.col("_new"), "updated")
    return both.select(*key, *picked, F.when(F.col("_new"), None).otherwise(F.col("deleted_at")).alias("deleted_at"), action.alias("action")).withColumn("changed_at", F.when(F.col("action").isNotNull(), F.lit(now).cast("timestamp")))


def soft_deleted(rows: DataFrame, when: Column, now: str) -> DataFrame:
    """Rows of which those that meet a condition, and are not deleted yet, are marked as deleted."""
    return rows.withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & when, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))


def cascaded(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the rows of keys that go."""
    return {name: t.join(gone.select(key), key, "left_anti") for name, t in tables.items()}


def updated_where(rows: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Rows with new values where a condition holds."""
    return rows.withColumns({c: F.when(when, v).otherwise(F.col(c)) for c, v in values.items()})


def usage(uses: DataFrame, key: str) -> DataFrame:
    """(key, times_used): a counter made from the log of uses, which many writers can append to."""
    return uses.groupBy(key).agg(F.count("*").alias("times_used"))


def transitions(models: DataFrame, profile: str, version: str, status: str, approve: Column) -> DataFrame:
    """Models after candidates are approved: of a profile the newest approved stays, older approved ones retire, failed and retired ones stay as they are."""
    next_status = F.when((F.col(status) == "candidate") & approve, "approved").otherwise(F.col(status))
    moved = models.withColumn("_next", next_status)
    newest = F.max(F.when(F.col("_next") == "approved", F.col(version))).over(Window.partitionBy(profile))
    return moved.withColumn(status, F.when((F.col("_next") == "approved") & (F.col(version) < newest), "retired").otherwise(F.col("_next"))).drop("_next")


def saved_attempt(attempts: DataFrame, key: str, order: str, ok: Column) -> DataFrame:
    """(key, status, attempts): the last attempt of each key, failed_validation unless it passed."""
    return attempts.groupBy(key).agg(F.when(F.max_by(ok, order), "saved").otherwise("failed_validation").alias("status"), F.count("*").alias("attempts"))


def kept_approved(old: DataFrame, new: DataFrame, key: list[str], status: str) -> DataFrame:
    """The upsert of models: new rows replace old ones of their key unless the old one is approved."""
    approved = old.where(F.col(status) == "approved").select(*key)
    taken = new.join(approved, key, "left_anti")
    return old.join(taken.select(*key), key, "left_anti").unionByName(taken)


def imported_if_absent(there: DataFrame, seed: DataFrame, key: list[str]) -> DataFrame:
    """A registry with the seed rows whose keys it lacks."""
    return there.unionByName(seed.join(there.select(*key), key, "left_anti"))


def in_use(catalog: DataFrame, uses: DataFrame, key: str, protected: tuple[str, ...] = ()) -> DataFrame:
    """Catalog rows with deletable: not protected and used nowhere."""
    n = uses.groupBy(key).agg(F.count("*").alias("uses"))
    return catalog.join(n, key, "left").withColumn("uses", F.coalesce("uses", F.lit(0))).withColumn("deletable", (F.col("uses") == 0) & ~F.col(key).cast("string").isin(*protected))


def audited(changes: DataFrame, entity: str, key: str, actor: str, at: str) -> DataFrame:
    """(entity, entity_id, action, actor, at) of changes that did something."""
    return changes.where("action is not null").select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("entity_id"), "action", F.col(actor).alias("actor"), F.col(at).alias("at"))


def with_settings(defaults: DataFrame, stored: DataFrame, key: str = "name", value: str = "value") -> DataFrame:
    """Settings by name: stored values go before defaults, stored names without a default are ignored."""
    s = stored.select(key, F.col(value).alias("_stored"))
    return defaults.join(s, key, "left").select(key, F.coalesce("_stored", value).alias(value))


def listed(rows: DataFrame, *, status: list[str] | None = None, name: tuple[str, str] | None = None, between: tuple[str, str, str] | None = None, not_source: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a listing: statuses, a part of a name in any case, a half-open range of times, all but one source (rows without one stay)."""
    out = rows if status is None else rows.where(F.col("status").isin(status))
    if name is not None:
        out = out.where(F.lower(F.col(name[0])).contains(name[1].lower()))
    if between is not None:
        out = out.where((F.col(between[0]) >= F.lit(between[1]).cast("timestamp")) & (F.col(between[0]) < F.lit(between[2]).cast("timestamp")))
    return out if not_source is None else out.where(F.col(not_source[0]).isNull() | (F.col(not_source[0]) != not_source[1]))


def folded(updates: DataFrame, key: str, name: str, value: str, order: str) -> DataFrame:
    """(key, progress): the newest value of each name of a key, as a JSON object with names in order."""
    newest = updates.groupBy(key, name).agg(F.max_by(value, order).alias("v"))
    return newest.groupBy(key).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, "v"))))).alias("progress"))


def stage_times(events: DataFrame, key: str, stage: str, at: str) -> DataFrame:
    """(key, stage, seconds): from a stage's first event to the next one's start, or to the key's last event."""
    first = events.groupBy(key, stage).agg(F.min(at).alias("begin"), F.max(at).alias("_end"))
    w = Window.partitionBy(key).orderBy("begin", stage)
    last = F.max("_end").over(Window.partitionBy(key))
    seconds = (F.unix_micros(F.coalesce(F.lead("begin").over(w), last)) - F.unix_micros("begin")) / 1e6
    return first.select(key, stage, F.round(seconds, 3).alias("seconds"))


def replayed(history: DataFrame, live: DataFrame, key: str, at: str, event_id: str, terminal: Column) -> DataFrame:
    """Events of history and of the live table, each once and in place, up to a key's first terminal one."""
    rows = history.unionByName(live).dropDuplicates([key, event_id])
    w = Window.partitionBy(key).orderBy(at, event_id)
    ended = F.coalesce(F.max(terminal.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"place": F.row_number().over(w).cast("long"), "_ended": ended}).where("_ended = 0").drop("_ended")


def serial_queue(tasks: DataFrame, session: str, order: list[str], seconds: Column) -> DataFrame:
    """Tasks with wait, the seconds that those before them in their session take: one runs at a time, first come first served."""
    w = Window.partitionBy(session).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return tasks.withColumn("wait", F.coalesce(F.sum(seconds).over(w), F.lit(0)))


def retried(attempts: DataFrame, key: str, at: str, failed: Column, *, most: int = 2, delay: int = 30) -> DataFrame:
    """(key, tries, state, next_at): done, waiting for a retry `delay` seconds after the last failure, or given up after `most` retries."""
    out = attempts.groupBy(key).agg(F.count("*").alias("tries"), F.max_by(failed, at).alias("_failed"), F.max(at).alias("_at"))
    state = F.when(~F.col("_failed"), "done").when(F.col("tries") <= most, "retry").otherwise("given up")
    return out.select(key, "tries", state.alias("state"), F.when(state == "retry", F.col("_at") + F.make_dt_interval(secs=F.lit(delay))).alias("next_at"))


def cancelled(rows: DataFrame, flags: DataFrame, key: str, at: str, *, ttl: int = 86400) -> DataFrame:
    """Rows whose key has no cancel flag that was set before them and not longer than `ttl` seconds ago."""
    f = flags.groupBy(key).agg(F.max("set_at").alias("_set"))
    hit = (F.col("_set") <= F.col(at)) & (F.unix_timestamp(at) - F.unix_timestamp("_set") <= ttl)
    return rows.join(f, key, "left").where(~F.coalesce(hit, F.lit(False))).drop("_set")


def watched(desired: DataFrame, scheduled: DataFrame, folder: str, order: str) -> DataFrame:
    """(folder, change): start, stop or keep, for folders to watch against those that are watched; of several wishes for a folder the first counts."""
    first = desired.groupBy(folder).agg(F.min(order).alias("_first"))
    both = first.join(scheduled.select(folder, F.lit(True).alias("_there")).distinct(), folder, "full")
    return both.select(folder, F.when(F.col("_there").isNull(), "start").when(F.col("_first").isNull(), "stop").otherwise("keep").alias("change"))
