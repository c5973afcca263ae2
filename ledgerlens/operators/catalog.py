"""Catalog jobs: mapping rules over many datasets, saved and suggested
mappings, latest dataset per user, and the view catalog.

The application keeps this metadata in a small transactional store and
checks one request at a time; here the same rules run as Spark jobs over
whole catalogs (one row per dataset, mapping entry, save or view access).

Skew: many datasets share one header signature and one view (the initial
view) is opened by everyone, so group keys can be very hot.  Every
aggregation below is partially aggregated before its exchange (min_by /
max_by / count / collect_set are all map-side combinable), so a hot key
costs one row per task in the shuffle, and per-group collections are
bounded by a mapping's size (a few dozen entries), never by the data.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions.registry import FieldRegistry, registry as default_registry
from ledgerlens.operators.mapping import (
    AMOUNT_INDICATOR_GROUP, DEBIT_CREDIT_GROUP, MSG_DUPLICATES, MSG_MIXED_GROUPS, MSG_NO_AMOUNT_GROUP,
)
from ledgerlens.plans.spec import ViewSpec, canonical_json
from ledgerlens.session import checkpointed, scratch_path

MSG_REPEATED_RAW = "Raw columns unnamed or mapped more than once"


def _py_list(arr: Column) -> Column:
    """Render a non-empty ``array<string>`` like a Python list: ['a', 'b']."""
    return F.concat(F.lit("['"), F.array_join(arr, "', '"), F.lit("']"))


def _registry_lookup(spark, registry: FieldRegistry) -> DataFrame:
    """(field_id, bit): one bit per registry field."""
    rows = [{"field_id": f.id, "bit": 1 << i} for i, f in enumerate(registry.all())]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<field_id:string,bit:bigint>>")))


def _checked(mappings: DataFrame, registry: FieldRegistry, keys: tuple[str, ...]) -> DataFrame:
    """One row per mapping with ``found``: its violations in rule order.

    Known fields are one bit each, so a mapping is aggregated into a count and
    a bit mask (fixed-size state, partial before the exchange).  Only the few
    entries with an unknown id are collected, in a branch of their own; the
    lists hold one mapping's entries (bounded by a file's column count).
    """
    # The registry has a fixed, tiny size: broadcasting it is always safe.
    m = mappings.join(F.broadcast(_registry_lookup(mappings.sparkSession, registry)), "field_id", "left")
    per_map = m.groupBy(*keys).agg(F.count("bit").alias("n_known"), F.coalesce(F.bit_or("bit"), F.lit(0)).alias("bits"))
    ids = F.collect_set(F.coalesce("field_id", F.lit("None")))          # a null id is an unknown one
    unknown = (m.where(F.col("bit").isNull()).groupBy(*keys)
               .agg(F.array_sort(ids).alias("unknown_ids"), F.count(F.lit(1)).alias("n_unknown")))
    u = unknown.select(*[F.col(k).alias(f"_u_{k}") for k in keys], "unknown_ids", "n_unknown")
    same = [F.col(k).eqNullSafe(F.col(f"_u_{k}")) for k in keys]
    per_map = per_map.join(u, reduce(lambda a, b: a & b, same), "left").drop(*[f"_u_{k}" for k in keys])
    return per_map.select(*keys, F.concat(*_violations(registry)).alias("found"))


def _violation(rule: int, cond: Column, message: Column) -> Column:
    empty = F.array().cast("array<struct<rule:int,message:string>>")
    return F.when(cond, F.array(F.struct(F.lit(rule).alias("rule"), message.alias("message")))).otherwise(empty)


def _violations(registry: FieldRegistry) -> list[Column]:
    """Rules 1-5 over ``n_known``, ``bits``, ``n_unknown`` and ``unknown_ids`` (null if none)."""
    bit = {f.canonical_name: 1 << i for i, f in enumerate(registry.all())}
    v = _violation

    def has(name):
        return F.col("bits").bitwiseAND(bit[name]) != 0

    missing = F.array_compact(F.array(*[F.when(~has(f.canonical_name), F.lit(f.canonical_name)) for f in registry.mandatory()]))
    dc, ai = (has(a) & has(b) for a, b in (DEBIT_CREDIT_GROUP, AMOUNT_INDICATOR_GROUP))
    repeated = ((F.col("n_known") != F.bit_count("bits"))
                | (F.coalesce("n_unknown", F.lit(0)) != F.coalesce(F.size("unknown_ids"), F.lit(0))))
    return [
        v(1, F.col("unknown_ids").isNotNull(), F.concat(F.lit("Invalid field ids: "), _py_list(F.col("unknown_ids")))),
        v(2, repeated, F.lit(MSG_DUPLICATES)),
        v(3, F.size(missing) > 0, F.concat(F.lit("Mandatory fields not mapped: "), _py_list(missing))),
        v(4, ~(dc | ai), F.lit(MSG_NO_AMOUNT_GROUP)),
        v(5, dc & ai, F.lit(MSG_MIXED_GROUPS)),
    ]


_ODD = "!"              # marks an entry written out in full
_CODE = ord("A")        # others start with a character for their field


def _packed(mappings: DataFrame, registry: FieldRegistry, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, entries, n_known, bits, n_odd): every entry as a short text,
    neighbours of one mapping in one row.

    An entry of a known field is a character for the field and the raw column's
    name; one with an unknown id or without a name is written out.  A mapping's
    entries mostly lie next to each other, so they travel as one row rather
    than one each; where they do not, a mapping has several rows.
    """
    lookup = F.broadcast(_registry_lookup(mappings.sparkSession, registry).withColumn(
        "_code", F.char(F.lit(_CODE) + F.bit_count(F.col("bit") - 1))))
    short = F.concat("_code", "raw_column")
    coded = mappings.join(lookup, "field_id", "left").select(
        *keys, F.coalesce("bit", F.lit(0).cast("bigint")).alias("bit"),
        F.coalesce(short, F.concat(F.lit(_ODD), F.to_json(F.struct("raw_column", "field_id")))).alias("entry"), short.isNull().alias("odd"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows == 0:
                continue
            starts = np.ones(b.num_rows, dtype=bool)
            starts[1:] = False
            for k in range(len(keys)):
                c = b.column(k)
                changed = pc.not_equal(c[1:], c[:-1]).fill_null(True)           # null keys: a row each
                starts[1:] |= changed.to_numpy(zero_copy_only=False)
            at, n = np.flatnonzero(starts), len(keys)
            bit, odd = b.column(n).to_numpy(), b.column(n + 2).to_numpy(zero_copy_only=False)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, b.num_rows), pa.int32()), b.column(n + 1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(k).take(pa.array(at)) for k in range(n)], lists, pa.array(np.add.reduceat((bit != 0).astype(np.int64), at)),
                 pa.array(np.bitwise_or.reduceat(bit, at)), pa.array(np.add.reduceat(odd.astype(np.int64), at))],
                names=[*keys, "entries", "n_known", "bits", "n_odd"])

    schema = T.StructType([*[coded.schema[k] for k in keys], T.StructField("entries", T.ArrayType(T.StringType())),
                           *[T.StructField(c, T.LongType()) for c in ("n_known", "bits", "n_odd")]])
    return coded.mapInArrow(runs, schema)


def _pairs(registry: FieldRegistry) -> tuple[Column, Column]:
    """The (raw_column, field_id) pairs of packed ``entries``, and whether they form a map."""
    ids = F.from_json(F.lit(json.dumps([f.id for f in registry.all()])), "array<string>")
    kind = "struct<raw_column:string,field_id:string>"

    def rest(e: Column) -> Column:
        return F.substring(e, 2, 1 << 30)

    def short(e: Column) -> Column:
        return F.struct(rest(e).alias("raw_column"), ids[F.ascii(e) - _CODE].alias("field_id")).cast(kind)

    full = F.transform("entries", lambda e: F.when(F.startswith(e, F.lit(_ODD)), F.from_json(rest(e), kind)).otherwise(short(e)))
    plain = F.col("n_odd") == 0
    distinct = F.size(F.array_distinct(F.transform("entries", rest))) == F.size("entries")
    return (F.when(plain, F.transform("entries", short)).otherwise(full),
            F.when(plain, distinct).otherwise(_distinct_raw(full)))


def _distinct_raw(entries: Column) -> Column:
    """Whether every raw column is named, and only once, so that the entries form a map."""
    raw = F.transform(entries, lambda e: e["raw_column"])
    return (F.size(F.array_distinct(raw)) == F.size(raw)) & ~F.exists(raw, lambda x: x.isNull())


def mapping_violations(mappings: DataFrame, registry: FieldRegistry = default_registry,
                       keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """All rule violations per mapping: (*keys, rule, message).

    ``mappings``: (*keys, raw_column, field_id), one row per entry; ``keys``
    identify one mapping (a dataset, or a dataset and a save number).
    Rules: 1 unknown field ids, 2 a field id mapped twice, 3 mandatory field
    not mapped, 4 no complete amount group, 5 both amount groups complete.
    """
    return (_checked(mappings, registry, keys)
            .select(*keys, F.explode("found").alias("v"))
            .select(*keys, "v.rule", "v.message"))


def mapping_status(mappings: DataFrame, registry: FieldRegistry = default_registry,
                   keys: tuple[str, ...] = ("dataset_id",)) -> DataFrame:
    """One row per mapping: the first failing rule (the one a single request
    would report) or rule 0 / message 'ok'.  Violations are already in rule
    order, so this is the first array element: no second aggregation."""
    ok = F.struct(F.lit(0).alias("rule"), F.lit("ok").alias("message"))
    first = F.when(F.size("found") > 0, F.col("found")[0]).otherwise(ok)
    return (_checked(mappings, registry, keys)
            .select(*keys, first.alias("s"))
            .select(*keys, "s.rule", "s.message"))


def checked_saves(mappings: DataFrame, saved_at: DataFrame, registry: FieldRegistry = default_registry,
                  keys: tuple[str, ...] = ("dataset_id", "save_no")) -> DataFrame:
    """One row per save: its ``mapping``, first failing ``rule`` / ``message``
    (0 / 'ok' when it passes) and ``saved_at``.

    ``saved_at``: (*keys, saved_at); the first key alone (the dataset) decides
    where a row goes, so what is later grouped or joined by it stays in place.
    Entries and times meet in one aggregation: the entries are shuffled once,
    packed.  A list holds one mapping's entries.
    """
    at = F.struct("saved_at")
    time = T.StructType([saved_at.schema["saved_at"]])
    packed = _packed(mappings, registry, keys).withColumn("at", F.lit(None).cast(time))
    times = saved_at.select(*keys, F.lit(None).cast("array<string>").alias("entries"), at.alias("at"))
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    figures = [F.sum("n_known").alias("n_known"), F.bit_or("bits").alias("bits"), F.sum("n_odd").alias("n_odd")]
    saves = (packed.unionByName(times, allowMissingColumns=True).where(known).repartition(keys[0]).groupBy(*keys)
             .agg(F.flatten(F.collect_list("entries")).alias("entries"), F.collect_list("at").alias("at"), *figures)
             .where(F.size("entries") > 0).select(*keys, "entries", "n_known", "bits", "n_odd", F.explode("at").alias("at")))
    pairs, distinct = _pairs(registry)
    ids = F.array(*[F.lit(f.id) for f in registry.all()])
    unknown = F.filter(F.transform(pairs, lambda p: F.coalesce(p["field_id"], F.lit("None"))), lambda i: ~F.array_contains(ids, i))
    n_unknown = F.size("entries") - F.col("n_known")
    saves = saves.withColumns({"n_unknown": n_unknown, "unknown_ids": F.when(n_unknown > 0, F.array_sort(F.array_distinct(unknown)))})
    found = F.concat(*_violations(registry), _violation(6, ~distinct, F.lit(MSG_REPEATED_RAW)))
    ok = F.struct(F.lit(0).alias("rule"), F.lit("ok").alias("message"))
    return (saves.select(*keys, F.when(distinct, F.map_from_entries(pairs)).alias("mapping"),
                         F.coalesce(F.get(found, F.lit(0)), ok).alias("s"), "at.saved_at")
            .select(*keys, "mapping", "s.rule", "s.message", "saved_at"))


def mapping_saves(mappings: DataFrame, saved_at: DataFrame,
                  keys: tuple[str, ...] = ("dataset_id", "save_no")) -> DataFrame:
    """Entries + save time -> one row per save with a ``mapping`` map column.

    The collected list is one mapping (bounded by a file's column count); if
    its raw columns do not form a map, ``mapping`` is null.
    """
    entries = F.col("entries")
    return (mappings.groupBy(*keys)
            .agg(F.collect_list(F.struct("raw_column", "field_id")).alias("entries"))
            .withColumn("mapping", F.when(_distinct_raw(entries), F.map_from_entries(entries))).drop("entries")
            .join(saved_at, list(keys)))


def valid_saves(saves: DataFrame, status: DataFrame, keys: tuple[str, ...] = ("dataset_id", "save_no")) -> DataFrame:
    """Saves whose mapping passes every rule (refused saves never reach the store)."""
    return saves.join(status.where(F.col("rule") == 0).select(*keys), list(keys), "left_semi")


def mapping_text(mapping: Column) -> Column:
    """A mapping rendered as sorted ``raw=field_id`` pairs joined by ';'."""
    pairs = F.transform(F.map_entries(mapping), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.array_join(F.array_sort(pairs), ";")


def current_mappings(saves: DataFrame) -> DataFrame:
    """Latest saved mapping per dataset (a new save replaces the old one).

    ``saves``: (dataset_id, mapping, saved_at).  Ties on time go to the
    larger mapping text so the answer is deterministic.
    """
    key = F.struct("saved_at", F.col("mapping").cast("string"))
    return saves.groupBy("dataset_id").agg(F.max_by("mapping", key).alias("mapping"),
                                           F.max("saved_at").alias("saved_at"))


def signature_mappings(saves: DataFrame, datasets: DataFrame) -> DataFrame:
    """First mapping ever saved for each header signature (later saves never replace it).

    ``datasets``: (dataset_id, signature, ...).  Only valid saves reach the
    store, so callers pass saves that passed ``mapping_status``.
    """
    key = F.struct("saved_at", F.col("dataset_id"))
    return (saves.join(datasets.select("dataset_id", "signature"), "dataset_id")
            .groupBy("signature")
            .agg(F.min_by("mapping", key).alias("mapping"), F.min("saved_at").alias("saved_at")))


SIGNATURE_BROADCAST_ROWS = 20_000       # of about 2 KB each
SIGNATURE_SALTS = 64


def suggested_mappings(datasets: DataFrame, sig_mappings: DataFrame,
                       broadcast_rows: int = SIGNATURE_BROADCAST_ROWS) -> DataFrame:
    """Per dataset, the signature's mapping if it was saved before the upload, else empty.

    Because the first save of a signature is never replaced, comparing it
    with the upload time answers "what did the store hold at upload".

    The signatures' mappings (one row per header layout) are stored and
    counted.  Up to ``broadcast_rows`` they are broadcast, so the datasets are
    not shuffled; more are joined on (signature, salt), which parts the
    datasets of a common header among tasks.  The result is the same.
    """
    s = checkpointed(sig_mappings.select("signature", F.col("mapping").alias("_m"), F.col("saved_at").alias("_t")))
    d, on = datasets.select("dataset_id", "signature", "uploaded_at"), ["signature"]
    if s.count() <= broadcast_rows:
        s = F.broadcast(s)
    else:
        d = d.withColumn("_salt", F.pmod(F.xxhash64("dataset_id"), F.lit(SIGNATURE_SALTS)).cast("int"))
        s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SIGNATURE_SALTS - 1))))
        on = ["signature", "_salt"]
    empty = F.create_map().cast("map<string,string>")
    return (d.join(s, on, "left")
            .select("dataset_id",
                    F.when(F.col("_t") < F.col("uploaded_at"), F.col("_m")).otherwise(empty)
                    .alias("suggested_mapping")))


def latest_dataset_per_user(datasets: DataFrame) -> DataFrame:
    """Most recently accessed dataset per uploader (ties: larger dataset id)."""
    key = F.struct("last_accessed_at", "dataset_id")
    return (datasets.groupBy("uploaded_by_id")
            .agg(F.max_by("dataset_id", key).alias("dataset_id"),
                 F.max("last_accessed_at").alias("last_accessed_at")))


# --------------------------------------------------------------- view catalog
_PLACEHOLDER = "@@dataset_id@@"


def view_signature_col(spec: ViewSpec, dataset_id: Column) -> Column:
    """``spec.signature(dataset_id)`` as a Spark expression over a column of ids.

    The canonical JSON contains the dataset id exactly once, so it is
    rendered once on the driver with a placeholder and hashed per row as
    ``sha2(prefix || id || suffix)``.  Ids must not need JSON escaping.
    """
    prefix, suffix = canonical_json(spec, _PLACEHOLDER).split(_PLACEHOLDER)
    return F.sha2(F.concat(F.lit(prefix), dataset_id, F.lit(suffix)), 256)


def view_catalog(accesses: DataFrame) -> DataFrame:
    """One record per (dataset, view signature): first and last access.

    ``accesses``: (dataset_id, signature, user_id, accessed_at).  Opening an
    existing view only moves its last-access time.
    """
    return (accesses.groupBy("dataset_id", "signature")
            .agg(F.min("accessed_at").alias("created_at"),
                 F.max("accessed_at").alias("last_accessed_at"),
                 F.min_by("user_id", F.struct("accessed_at", "user_id")).alias("created_by"),
                 F.count(F.lit(1)).alias("accesses")))


def view_records(accesses: DataFrame) -> DataFrame:
    """Openings as view records of one opening each, to be merged."""
    return accesses.select("dataset_id", "signature", F.col("accessed_at").alias("created_at"),
                           F.col("accessed_at").alias("last_accessed_at"), F.col("user_id").alias("created_by"),
                           F.lit(1).cast("bigint").alias("accesses"), "spec", "parent_view_id")


def merge_view_records(records: DataFrame) -> DataFrame:
    """At most one record per (dataset, signature).

    Made by the first opening, with its parent; ``spec`` is that of the last
    one (sorting and page are not part of the signature).  Merging merged
    records gives the same as merging all openings at once.
    """
    first, last = F.struct("created_at", "created_by", "parent_view_id"), F.struct("last_accessed_at", "spec")
    return (records.groupBy("dataset_id", "signature")
            .agg(F.min("created_at").alias("created_at"), F.max("last_accessed_at").alias("last_accessed_at"),
                 F.min_by("created_by", first).alias("created_by"), F.sum("accesses").alias("accesses"),
                 F.max_by("spec", last).alias("spec"), F.min_by("parent_view_id", first).alias("parent_view_id")))


def least_recently_used(records: DataFrame, keep: int) -> DataFrame:
    """The records of each dataset beyond its ``keep`` last used ones, which a
    cache would drop first; ties by signature."""
    order = Window.partitionBy("dataset_id").orderBy(F.col("last_accessed_at").desc(), "signature")
    return records.withColumn("_nr", F.row_number().over(order)).where(F.col("_nr") > keep).drop("_nr")


def view_lineage(views: DataFrame) -> DataFrame:
    """(dataset_id, view_id, parent_view_id, root_view_id, depth, cyclic) of every view.

    ``views``: (dataset_id, view_id, parent_view_id), a view once.  A parent
    that is not a view of the dataset (deleted, or never stored) counts as
    none.  Views above each other in a circle, and those below them, have no
    root; they are marked instead.

    Every view points to an ancestor; each round it takes over its ancestor's
    pointer, so the distance covered doubles, and the longest chain of n
    views takes log2(n) rounds.  Views that have arrived at a root leave the
    rounds, so a root of most views is no hot key of the joins.

    Round r brings the views of depth 2^(r-1) to 2^r - 1 to their root.  Views
    further down have ancestors of every depth above them, so when a round
    brings none, all that are left are in circles or below them.

    Each round is written and read again as files: the size estimate of a
    checkpoint is that of the joins it came from, here the square of the one
    before, a number of 2^r digits on the driver.
    """
    spark, work = views.sparkSession, scratch_path(views.sparkSession, "lineage")

    def stored(df: DataFrame, name: str) -> str:
        df.write.parquet(f"{work}/{name}")
        return f"{work}/{name}"

    known = spark.read.parquet(stored(views.select("dataset_id", "view_id", F.col("parent_view_id").alias("_named")), "known"))
    # Merged, not broadcast: files of a few MB may hold millions of ids.
    ids = known.select(F.col("dataset_id").alias("_d"), F.col("view_id").alias("parent_view_id")).hint("merge")
    linked = (known.join(ids, (F.col("dataset_id") == F.col("_d")) & (F.col("_named") == F.col("parent_view_id")), "left")
              .select("dataset_id", "view_id", "parent_view_id"))
    at_root = F.col("parent_view_id").isNull()
    rounds = [stored(linked.select(
        "dataset_id", "view_id", "parent_view_id", F.coalesce("parent_view_id", "view_id").alias("_up"),
        F.when(at_root, 0).otherwise(1).cast("bigint").alias("depth"), at_root.alias("_done")), "0")]
    while True:
        done, last = spark.read.parquet(*rounds).where("_done"), spark.read.parquet(rounds[-1])
        open_ = last.where(~F.col("_done"))
        if open_.isEmpty() or last.where("_done").isEmpty():
            break
        # What each open view's ancestor points to, be it done or open.
        above = (done.unionByName(open_).select(F.col("dataset_id").alias("_d"), F.col("view_id").alias("_v"),
                                                F.col("_up").alias("_next"), F.col("depth").alias("_more"), F.col("_done").alias("_end")))
        moved = open_.join(above.hint("merge"), (F.col("dataset_id") == F.col("_d")) & (F.col("_up") == F.col("_v"))).select(
            "dataset_id", "view_id", "parent_view_id", F.col("_next").alias("_up"),
            (F.col("depth") + F.col("_more")).alias("depth"), F.col("_end").alias("_done"))
        rounds.append(stored(moved, str(len(rounds))))
    none = F.lit(None)
    return (done.select("dataset_id", "view_id", "parent_view_id", F.col("_up").alias("root_view_id"), "depth", F.lit(False).alias("cyclic"))
            .unionByName(open_.select("dataset_id", "view_id", "parent_view_id", none.cast("string").alias("root_view_id"),
                                      none.cast("bigint").alias("depth"), F.lit(True).alias("cyclic"))))
