"""Keyed and versioned tables: latest rows, upserts, purges, listings.

Each operator returns the new state of a table; publishing it is one write to a
new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftframe.operators.indexing import with_group_index
from weftframe.operators.querying import Page, page_rows


def latest_per_key(df: DataFrame, keys: Sequence[str], version: Sequence[str | Column]) -> DataFrame:
    """The row with the highest version of every key.

    Spark keeps one candidate per key and map task (WindowGroupLimit), so a hot
    key sends one row per task through the shuffle.
    """
    order = [(F.col(v) if isinstance(v, str) else v).desc_nulls_last() for v in version]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def first_steps(df: DataFrame, run: Sequence[str], order_by: Sequence[str], step: int) -> DataFrame:
    """The rows of every run up to a zero-based step; the step is clamped to
    the run. Spark keeps so many rows per run and task before the shuffle
    (WindowGroupLimit), so a long run sends little through it."""
    place = F.row_number().over(Window.partitionBy(*run).orderBy(*order_by))
    return df.withColumn("step", place).where(F.col("step") <= max(step, 0) + 1).withColumn("step", F.col("step") - 1)


def next_versions(
    history: DataFrame, incoming: DataFrame, keys: Sequence[str], order_by: Sequence[str], version: str = "version"
) -> DataFrame:
    """Number new rows per key, continuing after the highest version so far; null is a key like others."""
    numbered = with_group_index(incoming, keys, order_by, "_n")
    highest = history.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(version).alias("_max"))
    return (
        numbered.join(highest, _same_keys(keys), "left")
        .withColumn(version, F.coalesce(F.col("_max"), F.lit(0)) + F.col("_n") + 1)
        .drop("_max", "_n", *[f"_k{i}" for i in range(len(keys))])
    )


def _same_keys(keys: Sequence[str]) -> Column:
    """The keys against columns ``_k0``, ``_k1``, ...; null is a key like others."""
    same = F.lit(True)
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"_k{i}"))
    return same


def list_rows(
    df: DataFrame,
    states: Sequence[str] | None = None,
    started_from=None,
    started_to=None,
    page: int = 1,
    page_size: int = 50,
    state: str = "state",
    started: str = "started_at",
    tiebreak: str | None = None,
) -> Page:
    """Filtered, newest first, paged."""
    kept = df
    if states:
        kept = kept.where(F.col(state).isin(list(states)))
    if started_from is not None:
        kept = kept.where(F.col(started) >= F.lit(started_from))
    if started_to is not None:
        kept = kept.where(F.col(started) <= F.lit(started_to))
    order = [F.col(started).desc(), *([F.col(tiebreak)] if tiebreak else [])]
    return page_rows(kept, order, page, page_size)


def upsert(
    target: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Insert new keys; on known keys overwrite only the ``update`` columns.

    Incoming rows are applied in ``sequence`` order: the first row of a new key
    is inserted, later rows of the key only change the update columns. Null is
    a key like others.
    """
    order = F.struct(*sequence)
    kept = [c for c in target.columns if c not in keys and c not in update]
    folded = incoming.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(
        F.max_by(F.struct(*update), order).alias("_last"),
        F.min_by(F.struct(*kept), order).alias("_first") if kept else F.lit(None).alias("_first"),
    )
    existing = target.withColumn("_known", F.lit(True))
    merged = existing.join(folded, _same_keys(keys), "full")
    columns: list[Column] = []
    for name in target.columns:
        if name in keys:
            incoming_key = F.col(f"_k{list(keys).index(name)}")
            columns.append(F.when(F.col("_known"), F.col(name)).otherwise(incoming_key).alias(name))
        elif name in update:
            columns.append(
                F.when(F.col("_last").isNotNull(), F.col(f"_last.{name}")).otherwise(F.col(name)).alias(name)
            )
        else:
            columns.append(F.when(F.col("_known"), F.col(name)).otherwise(F.col(f"_first.{name}")).alias(name))
    return merged.select(*columns)


def ordered_children(df: DataFrame, parent: Sequence[str], order_by: Sequence[str], name: str = "position") -> DataFrame:
    """Children of every parent with their zero-based position by the order."""
    return with_group_index(df, parent, order_by, name)


def update_by_key(target: DataFrame, changes: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Set the update columns where the key occurs in ``changes``; keys that
    match nothing change nothing, null matches null. Several changes of a key are an
    error; ``apply_parameter_sets`` takes them in an order."""
    again = F.raise_error(F.lit("several changes of one key")).cast(changes.select(F.struct(*update).alias("s")).schema["s"].dataType)
    picked = changes.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.any_value(F.struct(*update)).alias("_one"), F.count("*").alias("_n"))
    picked = picked.withColumn("_new", F.when(F.col("_n") > 1, again).otherwise(F.col("_one"))).drop("_one", "_n")
    merged = target.join(picked, _same_keys(keys), "left")
    return merged.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
            if c in update
            else F.col(c)
            for c in target.columns
        ]
    )


def affected_rows(target: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many target rows the change set touches."""
    hit = target.join(changes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct(), _same_keys(keys), "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("affected"))


def apply_parameter_sets(
    target: DataFrame, sets: DataFrame, keys: Sequence[str], update: Sequence[str], sequence: Sequence[str]
) -> DataFrame:
    """Many parameterised updates at once; of several sets for a row the last
    one stays."""
    last = sets.groupBy(*keys).agg(F.max_by(F.struct(*update), F.struct(*sequence)).alias("_v"))
    return update_by_key(target, last.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in update]), keys, update)


def version_of(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    version: str = "version",
    wanted: int | None = None,
    default=None,
    requested: DataFrame | None = None,
    required: bool = False,
) -> DataFrame:
    """Values at the latest or a pinned version.

    With ``requested`` keys every request gets a row: ``found`` tells a stored
    null from an absent key, absent ones take the default or fail.
    """
    rows = latest_per_key(df, keys, [version]) if wanted is None else df.where(F.col(version) == wanted)
    rows = rows.select(*keys, value, version)
    if requested is None:
        return rows
    marked = rows.withColumn("found", F.lit(True))
    joined = requested.join(marked, list(keys), "left").withColumn("found", F.coalesce("found", F.lit(False)))
    fallback = F.lit(default)
    if required:
        fallback = F.raise_error(F.concat_ws(".", F.lit("variable not found"), *[F.col(k) for k in keys])).cast(
            rows.schema[value].dataType
        )
    return joined.withColumn(value, F.when(F.col("found"), F.col(value)).otherwise(fallback))


def delete_by_key(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """All rows, of whatever version, except those of the given keys."""
    return df.join(keys.select(*on).distinct(), list(on), "left_anti")


def set_active(
    df: DataFrame, ids: DataFrame, on: str, active: bool, now: Column, flag: str = "is_active", touched: str = "updated_at"
) -> DataFrame:
    """Soft delete or restore: flips the flag where it is in the other state."""
    named = ids.select(F.col(on)).distinct().withColumn("_hit", F.lit(True))
    merged = df.join(named, on, "left")
    flips = F.coalesce(F.col("_hit"), F.lit(False)) & (F.col(flag) != F.lit(active))
    return merged.select(
        *[
            F.when(flips, F.lit(active)).otherwise(F.col(c)).alias(c)
            if c == flag
            else F.when(flips, now).otherwise(F.col(c)).alias(c)
            if c == touched
            else F.col(c)
            for c in df.columns
        ]
    )


def purge_cascade(
    doomed: DataFrame, chain: Sequence[tuple[DataFrame, str, str]], key: str
) -> list[DataFrame]:
    """Remove keys from a table and everything below it.

    ``chain`` lists (table, own key, parent key) from the top down; the first
    entry's own key is compared with ``doomed.key``. Returns the kept tables.
    """
    gone = doomed.select(F.col(key).alias("_gone")).distinct()
    kept = []
    for level, (table, own, parent) in enumerate(chain):
        by = own if level == 0 else parent
        kept.append(table.join(gone, F.col(by) == F.col("_gone"), "left_anti"))
        if level < len(chain) - 1:
            gone = table.join(gone, F.col(by) == F.col("_gone"), "left_semi").select(F.col(own).alias("_gone")).distinct()
    return kept


def text_search(df: DataFrame, needle: str, columns: Sequence[str], active: str | None = None) -> DataFrame:
    """Rows whose text holds the needle, ignoring case."""
    wanted = F.lit(needle.lower())
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(wanted), F.lit(False))
    return df.where(hit & F.col(active)) if active else df.where(hit)


def has_all_tags(df: DataFrame, tags: str, wanted: Sequence[str]) -> DataFrame:
    """Rows whose tag array holds every wanted tag."""
    condition = F.lit(True)
    for tag in wanted:
        condition = condition & F.array_contains(F.col(tags), tag)
    return df.where(condition)


def version_key(text: Column) -> Column:
    """``1.10.2`` as an array of numbers, so that 1.10 is above 1.9."""
    return F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))


def newest_version(df: DataFrame, name: str, version: str, pinned: str | None = None) -> DataFrame:
    """Per name (ignoring case) the newest or the pinned version."""
    rows = df.withColumn("_name", F.lower(F.col(name))).withColumn("_version", version_key(F.col(version)))
    if pinned is not None:
        rows = rows.where(F.col("_version") == version_key(F.lit(pinned)))
    return latest_per_key(rows, ["_name"], ["_version"]).drop("_name", "_version")
