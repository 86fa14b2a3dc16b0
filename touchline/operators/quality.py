"""Record comparison, identity and schema checks, counts that must agree."""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from touchline.functions import scalars as sc


def identity_form_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    items = [F.struct(F.lit(c).alias("scope"), F.col(c).alias("v")) for c in columns]
    long = df.select(F.inline(F.array(*items)))
    return long.groupBy("scope", sc.identity_form(F.col("v")).alias("form")).agg(
        F.count(F.lit(1)).alias("n")
    )


def surplus_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count(*) - count(distinct) per column, each aggregated on its own key."""
    whole = None
    for c in columns:
        part = (
            df.where(F.col(c).isNotNull()).groupBy(c).agg((F.count(F.lit(1)) - 1).alias("extra"))
            .groupBy().agg(F.lit(c).alias("scope"), F.coalesce(F.sum("extra"), F.lit(0)).alias("surplus"))
        )
        whole = part if whole is None else whole.unionByName(part)
    return whole


def recovered(records: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """found / missing / repeated when looking up the wanted keys in ``records``."""
    keys = list(keys)
    asked = wanted.select(*keys).distinct().withColumn("asked", F.lit(1))
    hits = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return asked.join(hits, keys, "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("found"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


def resolve_links(rows: DataFrame, targets: DataFrame, link: str, target: str) -> DataFrame:
    """One match resolves, none gives null, several are reported as ambiguous."""
    counted = targets.groupBy(link).agg(F.count(F.lit(1)).alias("_n"), F.min(target).alias("_t"))
    status = (
        F.when(F.col("_n") > 1, "ambiguous_link").when(F.col("_n").isNull(), "unresolved").otherwise("resolved")
    )
    return rows.join(counted, link, "left").select(
        *rows.columns, F.when(F.col("_n") == 1, F.col("_t")).alias(target), status.alias("status")
    )


def nonfinite_counts(df: DataFrame) -> DataFrame:
    """Non-finite values per double column."""
    bad = lambda c: F.count_if(F.isnan(c) | (F.abs(F.col(c)) == float("inf")))
    doubles = [f.name for f in df.schema.fields if f.dataType.simpleString() == "double"]
    return df.agg(F.count(F.lit(1)).alias("records"), *[bad(c).alias(c) for c in doubles])


def component_record(expected: Column, actual: Column) -> Column:
    gap = F.abs(actual - expected)
    finite = sc.is_finite(expected) & sc.is_finite(actual)
    return F.struct(
        expected.alias("expected"),
        actual.alias("actual"),
        F.when(finite, gap).alias("absolute_difference"),
        F.when(finite & (expected != 0), gap / F.abs(expected)).alias("relative_difference"),
        sc.ulp_distance(expected, actual).alias("ulp_distance"),
        (sc.float_bits(expected) == sc.float_bits(actual)).alias("bitwise_equal"),
        finite.alias("finite"),
    )


def _parsed(text: str):
    """A JSON document with key order and number text kept: (kind, value) nodes."""
    number = lambda kind: lambda raw: (kind, raw)
    tree = json.loads(
        text, parse_float=number("float"), parse_int=number("integer"), parse_constant=number("float"),
        object_pairs_hook=lambda pairs: ("object", dict(pairs)),
    )
    return _node(tree)


def _node(value):
    if isinstance(value, tuple):
        return ("object", {k: _node(v) for k, v in value[1].items()}) if value[0] == "object" else value
    if isinstance(value, list):
        return ("array", [_node(v) for v in value])
    if value is None or isinstance(value, bool):
        return ("null" if value is None else "boolean", value)
    return ("string", value)


def _shape(node) -> str:
    kind, value = node
    if kind == "object":
        return "{" + ",".join(f"{json.dumps(k)}:{_shape(v)}" for k, v in value.items()) + "}"
    return f"[{len(value)}:" + ",".join(map(_shape, value)) + "]" if kind == "array" else kind


def schema_fingerprint(df: DataFrame, json_column: str, name: str = "fingerprint") -> DataFrame:
    """``df`` with a hash of the names in their order, containers, lengths and scalar types of a document."""

    def hashed(batches):
        for batch in batches:
            found = [None if t is None else hashlib.sha256(_shape(_parsed(t)).encode()).hexdigest() for t in batch.column(json_column).to_pylist()]
            yield batch.append_column(name, pa.array(found, pa.string()))

    return df.mapInArrow(hashed, StructType([*df.schema.fields, StructField(name, StringType())]))


def compare_records(
    left: DataFrame, right: DataFrame, keys: Sequence[str], groups: dict[str, Sequence[str]]
) -> DataFrame:
    """Full-outer keyed comparison: one flag per column group, null-safe and exact."""
    keys = list(keys)
    fields = [f for fs in groups.values() for f in fs]
    tag = lambda df, t: df.select(*keys, *[F.col(f).alias(f"{t}_{f}") for f in fields], F.lit(1).alias(f"{t}_in"))
    joined = tag(left, "l").join(tag(right, "r"), keys, "full_outer")
    floats = {f.name for f in left.schema.fields if f.dataType.simpleString() in ("double", "float")}
    # The shortest text of a double names its bits, the sign of zero included.
    bits = lambda c, f: F.col(c).cast("string") if f in floats else F.col(c)
    same = lambda fs: _all([bits(f"l_{f}", f).eqNullSafe(bits(f"r_{f}", f)) for f in fs])
    flags = joined.select("l_in", "r_in", *[same(fs).alias(f"{name}_equal") for name, fs in groups.items()])
    return flags.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("l_in").isNull() | F.col("r_in").isNull()).alias("one_sided"),
        *[F.bool_and(f"{name}_equal").alias(f"{name}_equal") for name in groups],
    )


def _all(conditions: Sequence[Column]) -> Column:
    whole = conditions[0]
    for c in conditions[1:]:
        whole = whole & c
    return whole


def _differences(left, right, path: str = "$"):
    """(path, category, left kind, right kind, absolute difference, bits equal) of two nodes."""
    (a, x), (b, y) = left, right
    containers = ("object", "array")
    if a != b and (a in containers or b in containers):
        yield path, "container_type", a, b, None, None
    elif a == "object":
        for key in [*x, *(k for k in y if k not in x)]:
            if key in x and key in y:
                yield from _differences(x[key], y[key], f"{path}.{key}")
            else:
                yield f"{path}.{key}", "mapping_keys", x[key][0] if key in x else None, y[key][0] if key in y else None, None, None
    elif a == "array":
        if len(x) != len(y):
            yield path, "sequence_length", a, b, float(abs(len(x) - len(y))), None
        for at, pair in enumerate(zip(x, y)):
            yield from _differences(*pair, f"{path}[{at}]")
    else:
        numeric = {a, b} <= {"float", "integer"}
        if a != b:
            yield path, "scalar_type", a, b, None, None
        if numeric:
            exact = [int(v) if k == "integer" else float(v) for k, v in (left, right)]
            bits = [struct.pack(">d", v) if isinstance(v, float) else v for v in exact]
            if exact[0] != exact[1] or a == b and bits[0] != bits[1]:
                gap = abs(exact[0] - exact[1])
                yield path, "numeric_value", a, b, float(gap), a == b and bits[0] == bits[1]
        elif a == b and x != y:
            yield path, "scalar_value", a, b, None, None


def exact_differences(left: DataFrame, right: DataFrame, key: str, json_column: str) -> DataFrame:
    """Paths at which two JSON documents of the same key differ, with category, kinds and float facts.

    Containers of different kinds and arrays of different lengths are differences of their own;
    integers are compared as integers of any size, floats by their bits. A key on one side only is
    category ``record``; a null document counts as missing.
    """
    both = left.select(key, F.col(json_column).alias("l")).join(right.select(key, F.col(json_column).alias("r")), key, "full_outer")
    names = ("path", "category", "left_type", "right_type", "absolute_difference", "bits_equal")

    def compared(batches):
        for batch in batches:
            at, rows = [], []
            for i, (l, r) in enumerate(zip(batch.column("l").to_pylist(), batch.column("r").to_pylist())):
                if l is not None and r is not None:
                    found = [] if l == r else list(_differences(_parsed(l), _parsed(r)))
                else:
                    found = [] if l is r else [("$", "record", None if l is None else "document", None if r is None else "document", None, None)]
                at += [i] * len(found)
                rows += found
            columns = list(zip(*rows)) or [()] * len(names)
            kinds = (pa.string(),) * 4 + (pa.float64(), pa.bool_())
            keys = batch.column(key).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns, kinds)], names=[key, *names])

    form = ", ".join(f"{n} {k}" for n, k in zip(names, ("string",) * 4 + ("double", "boolean")))
    return both.mapInArrow(compared, f"`{key}` {left.schema[key].dataType.simpleString()}, {form}")


def difference_summary(differences: DataFrame) -> DataFrame:
    return differences.groupBy(
        sc.generalised_path(F.col("path")).alias("path"), "category", "left_type", "right_type"
    ).agg(
        F.count(F.lit(1)).alias("count"),
        F.coalesce(F.bool_and("bits_equal"), F.lit(True)).alias("all_bits_equal"),
        F.coalesce(F.max("absolute_difference"), F.lit(0.0)).alias("maximum_difference"),
    )


def same_multiset(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows only on one side, counted with multiplicity."""
    only = lambda a, b, name: a.exceptAll(b).groupBy().agg(
        F.lit(name).alias("side"), F.count(F.lit(1)).alias("rows")
    )
    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))


def key_set_gaps(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    keys = list(keys)
    gap = lambda a, b, name: a.select(*keys).join(b.select(*keys), keys, "left_anti").distinct().groupBy().agg(
        F.lit(name).alias("side"), F.count(F.lit(1)).alias("missing")
    )
    return gap(left, right, "right").unionByName(gap(right, left, "left"))


def count_gate(df: DataFrame, group: str, expected: DataFrame) -> DataFrame:
    """Groups whose row count differs from ``expected`` (group, n)."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("actual"))
    return counts.join(expected, group, "full_outer").where(
        ~F.coalesce("actual", F.lit(0)).eqNullSafe(F.coalesce("n", F.lit(0)))
    )


def chain_violations(journal: DataFrame) -> DataFrame:
    """Records whose ``previous`` is not the hash of the line before, or with a gap.

    The line before is found by sequence number, an equality join on (run, sequence).
    """
    before = journal.select("run", (F.col("sequence") + 1).alias("sequence"), F.sha2("line", 256).alias("expected"))
    joined = journal.join(before, ["run", "sequence"], "left")
    first = F.col("sequence") == 0
    broken = (
        F.when(first & F.col("previous").isNotNull(), "unexpected_previous")
        .when(~first & F.col("expected").isNull(), "sequence_gap")
        .when(~first & ~F.col("expected").eqNullSafe(F.col("previous")), "hash_mismatch")
    )
    return joined.select("run", "sequence", broken.alias("violation")).where(F.col("violation").isNotNull())


DIGEST_FANOUT = 4096


def ordered_digest(df: DataFrame, group: str, order: str, line: Column, levels: int = 4) -> DataFrame:
    """One SHA-256 per group over its lines in order, built as a tree.

    A flat hash over a whole group would need one task per group. Here blocks of 4096
    lines are hashed, then blocks of block hashes, up to ``levels`` times; a block is
    complete in itself, so no list exceeds 4096 entries (4 levels reach 2.8e14 lines).
    """
    rows = df.select(group, F.col(order).cast("long").alias("_o"), line.alias("_h"))
    for _ in range(levels):
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_h"))), lambda x: x["_h"])
        rows = rows.groupBy(group, F.floor(F.col("_o") / DIGEST_FANOUT).alias("_b")).agg(
            F.sha2(F.array_join(ordered, "\n"), 256).alias("_h")
        ).select(group, F.col("_b").alias("_o"), "_h")
    # Groups whose numbers exceed the tree are caught here instead of hashed apart.
    return rows.groupBy(group).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("_h"))
        .otherwise(F.raise_error(F.lit("digest needs another level")))
        .alias("digest")
    )


def lifecycle_accounts(journal: DataFrame) -> DataFrame:
    """Counters per run from (run, state, edge, action) records.

    Aggregated edge first, then state, then run, each step with map-side partials.
    """
    did = lambda a: F.coalesce(F.bool_or(F.col("action") == a), F.lit(False))
    edges = journal.groupBy("run", "state", "edge").agg(
        did("discovered").alias("discovered"), did("started").alias("started"),
        did("completed").alias("completed"), did("failed").alias("failed"),
    )
    n = lambda c: F.count_if(F.col(c))
    states = edges.groupBy("run", "state").agg(
        n("discovered").alias("edges_discovered"), n("started").alias("edges_evaluation_started"),
        n("completed").alias("edges_completed"), n("failed").alias("edge_failures"),
    )
    total = lambda c: F.sum(c).alias(c)
    return states.groupBy("run").agg(
        F.count(F.lit(1)).alias("states_discovered"),
        F.count_if(F.col("edges_evaluation_started") > 0).alias("states_evaluation_started"),
        F.count_if(F.col("edges_completed") == F.col("edges_discovered")).alias("states_completed"),
        total("edges_discovered"), total("edges_evaluation_started"), total("edges_completed"), total("edge_failures"),
    )


def lifecycle_violations(accounts: DataFrame) -> DataFrame:
    """Broken orderings of the counters per run."""
    c = F.col
    rules = F.array(
        F.when(~(c("states_completed") <= c("states_evaluation_started")), "state_lifecycle_order"),
        F.when(~(c("states_evaluation_started") <= c("states_discovered")), "state_lifecycle_order"),
        F.when(
            ~((c("edges_completed") <= c("edges_evaluation_started")) & (c("edges_evaluation_started") <= c("edges_discovered"))),
            "edge_lifecycle_order",
        ),
        F.when(c("edges_completed") + c("edge_failures") > c("edges_discovered"), "edge_terminal_count"),
    )
    return accounts.select("run", F.explode(F.array_compact(rules)).alias("violation"))


def distribution_violations(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary rows whose quantiles are unordered or whose mean leaves [minimum, maximum]."""
    steps = ["minimum", "q05", "q25", "q50", "q75", "q95", "maximum"]
    ordered = _all([F.col(a) <= F.col(b) for a, b in zip(steps, steps[1:])])
    slack = 1e-9 * F.greatest(F.lit(1.0), F.abs("minimum"), F.abs("maximum"))
    inside = (F.col("mean") >= F.col("minimum") - slack) & (F.col("mean") <= F.col("maximum") + slack)
    return stats.where(~(ordered & inside & (F.col("count") > 0))).select(*keys)
