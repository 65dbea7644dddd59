"""Names, load plans and schema gates over metadata frames.

Metadata is one row per table column; the work is joins over those rows. What a schema only claims
(no NULLs, unique keys) is verified on the data in one aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def fold(name: str) -> str:
    """An all-capitals name is an unquoted one and matches in lower case; others match as spelled."""
    return name.lower() if name.isupper() else name


def fold_col(c: Column) -> Column:
    return F.when((F.upper(c) == c) & (F.lower(c) != c), F.lower(c)).otherwise(c)


def match_names(source: list[str], target: list[str], explicit: dict[str, str] | None = None) -> dict[str, str]:
    """target name -> source name. An explicit entry wins but must exist; no match or several
    matches raise."""
    explicit, out = explicit or {}, {}
    for t in target:
        if t in explicit:
            if explicit[t] not in source:
                raise ValueError(f"mapping names source {explicit[t]!r} which is not in the snapshot")
            out[t] = explicit[t]
            continue
        found = [s for s in source if t in (s, fold(s))]
        if len(found) != 1:
            raise ValueError(f"target {t!r} matches sources {sorted(found)!r}")
        out[t] = found[0]
    return out


def _named(source: DataFrame, target: DataFrame, on: list[str]) -> Column:
    """Exact spelling or the folded source spelling."""
    return F.col("t.name").isin(F.col("s.name"), fold_col(F.col("s.name")))


def load_plan(source: DataFrame, target: DataFrame, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Plan and blockers for loading source tables into target tables.

    source: (table, name, type, is_udt) · target: (table, name, kind, type, generated, identity,
    has_default) with kind scalar, composite or array · mapping: (table, name, source_name) of the
    target, with a NULL name mapping the table itself.

    The plan has one row per target column: insert (with its source), generated or auto_filled.
    Tables with any blocker leave the plan.
    """
    spark = source.sparkSession
    if mapping is None:
        mapping = spark.createDataFrame([], "table string, name string, source_name string")
    s_tab = source.select(F.col("table").alias("name")).distinct().alias("s")
    t_tab = target.select(F.col("table").alias("name")).distinct().alias("t")
    named = mapping.filter(F.col("name").isNull()).select(F.col("table").alias("tt"), F.col("source_name").alias("st"))
    auto = s_tab.join(t_tab, _named(s_tab, t_tab, []), "left").select(F.col("s.name").alias("st"), F.col("t.name").alias("tt"))
    auto = auto.join(named.select("st"), "st", "left_anti")
    known = named.join(t_tab.select(F.col("t.name").alias("tt"), F.lit(True).alias("_ok")), "tt", "left").select(
        "st", F.when(F.col("_ok"), F.col("tt")).alias("tt"))
    matched = auto.unionByName(known).groupBy("st").agg(F.count("tt").alias("n"), F.min("tt").alias("tt"))
    table_blockers = matched.filter(F.col("n") != 1).select(
        F.lit("table_match").alias("kind"), F.col("st").alias("table"), F.lit(None).cast("string").alias("name"),
        F.when(F.col("n") == 0, "no target table").otherwise("several target tables").alias("detail"))
    pairs = matched.filter(F.col("n") == 1).select("st", "tt")

    tc = target.join(pairs, F.col("table") == F.col("tt")).alias("t")
    sc = source.select(F.col("table").alias("st"), "name", F.col("type").alias("source_type"), "is_udt")
    cm = mapping.filter(F.col("name").isNotNull()).select(F.col("table").alias("mt"), F.col("name").alias("mn"), F.col("source_name").alias("want"))
    with_map = tc.join(cm, (F.col("t.tt") == F.col("mt")) & (F.col("t.name") == F.col("mn")), "left").select(
        F.col("t.st").alias("st"), F.col("t.tt").alias("tt"), F.col("t.name").alias("name"), "kind", F.col("t.type").alias("target_type"),
        "generated", "identity", "has_default", "want").alias("t")
    s = sc.alias("s")
    hit = (F.col("s.st") == F.col("t.st")) & F.when(F.col("t.want").isNotNull(), F.col("s.name") == F.col("t.want")).otherwise(_named(s, with_map, []))
    found = with_map.join(s, hit, "left").groupBy(
        F.col("t.st").alias("st"), F.col("t.tt").alias("tt"), F.col("t.name").alias("name"), "kind", "target_type", "generated", "identity", "has_default", "want"
    ).agg(F.count("s.name").alias("n"), F.min("s.name").alias("source_name"), F.max("source_type").alias("source_type"), F.max("is_udt").alias("is_udt"))
    found = found.withColumn("source_name", F.when(F.col("n") == 1, F.col("source_name")))

    gen, one = F.col("generated"), F.col("n") == 1
    filled = F.col("identity") | F.col("has_default")
    nested = F.col("kind").isin("composite", "array")
    takes_text = F.col("target_type").isin("json", "jsonb", "xml")
    mismatch = one & ((nested & ~F.col("is_udt")) | (~nested & ~takes_text & F.col("is_udt")))
    kind = (
        F.when(gen & F.col("want").isNotNull() & ~one, "invalid_generated_mapping").when(gen & (F.col("n") > 1), "ambiguous_generated_source")
        .when(gen, None).when(~one & ~filled, "missing_source_column").when(mismatch, "type_mismatch"))
    judged = found.withColumns({"blocker": kind, "role": F.when(gen, "generated").when(one, "insert").otherwise("auto_filled")})
    col_blockers = judged.filter(F.col("blocker").isNotNull()).select(
        F.col("blocker").alias("kind"), F.col("tt").alias("table"), "name",
        F.when(F.col("n") > 1, "several source columns").when(F.col("n") == 0, "no source column").otherwise("type family differs").alias("detail"))
    used = judged.filter(F.col("source_name").isNotNull()).select("st", F.col("source_name").alias("name"))
    dropped = sc.join(pairs, "st", "left_semi").join(used, ["st", "name"], "left_anti").select(
        F.lit("dropped_source_column").alias("kind"), F.col("st").alias("table"), "name", F.lit("source column maps to no target column").alias("detail"))
    blockers = table_blockers.unionByName(col_blockers).unionByName(dropped)
    stopped = judged.filter(F.col("blocker").isNotNull()).select("tt").unionByName(
        dropped.join(pairs, F.col("table") == F.col("st")).select("tt")).distinct()
    plan = judged.join(stopped, "tt", "left_anti").select(
        F.col("st").alias("source_table"), F.col("tt").alias("target_table"), "name", "role",
        F.when(F.col("role") == "insert", F.col("source_name")).alias("source_name"), "target_type")
    return plan, blockers


def apply_plan(snapshot: DataFrame, plan: list[tuple[str, str, str]], path: str) -> None:
    """Write (target, source, type) columns of a snapshot to a new location; one that already
    holds data is refused. Booleans follow the flag rule of zero and non-zero."""
    def cast(source: str, kind: str) -> Column:
        c = F.col(f"`{source}`")
        is_number = dict(snapshot.dtypes)[source].split("(")[0] in ("decimal", "bigint", "int", "double")
        return (c != 0) if kind == "boolean" and is_number else c.cast(kind)

    snapshot.select(*[cast(s, k).alias(t) for t, s, k in plan]).write.mode("errorifexists").parquet(path)


# Target types each rule accepts.
TYPE_FAMILY = {
    "numeric": ("numeric", "integer", "bigint", "smallint", "real", "double precision"),
    "char": ("character",),
    "varchar": ("character varying", "text"),
    "lob_text": ("text",),
    "date": ("timestamp without time zone", "timestamp with time zone", "date"),
    "timestamp": ("timestamp without time zone", "timestamp with time zone"),
    "timestamp_ltz": ("timestamp with time zone", "timestamp without time zone"),
    "binary": ("bytea",),
    "xml": ("xml",),
    "interval_ym": ("interval",),
    "interval_ds": ("interval",),
    "object": ("USER-DEFINED", "jsonb"),
    "collection_varray": ("ARRAY", "USER-DEFINED", "jsonb"),
    "collection_nested": ("ARRAY", "USER-DEFINED", "jsonb"),
}


def schema_gate(expected: DataFrame, actual: DataFrame, expected_keys: DataFrame, actual_keys: DataFrame) -> DataFrame:
    """One row per expected table with each check and the overall verdict.

    expected: (table, name, rule, nullable, generated, precision, scale, length) · actual: (table,
    name, data_type, nullable, generated, precision, scale, length) · keys: (table, kind, columns)
    with kind primary or unique and an ordered column array. NULL expectations are not checked.
    """
    families = F.create_map(*[x for k, v in TYPE_FAMILY.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in v]))])
    e, a = expected.alias("e"), actual.alias("a")
    both = e.join(a, (F.col("e.table") == F.col("a.table")) & (F.col("e.name") == F.col("a.name")), "full_outer")
    present = F.col("a.name").isNotNull() & F.col("e.name").isNotNull()
    differs = lambda c: F.coalesce(F.col(f"e.{c}").isNotNull() & ~F.col(f"e.{c}").eqNullSafe(F.col(f"a.{c}")), F.lit(False))
    family = F.coalesce(F.array_contains(families[F.col("e.rule")], F.col("a.data_type")), F.lit(False))
    rows = both.select(
        F.coalesce("e.table", "a.table").alias("table"), F.col("a.name").isNotNull().alias("_has"), (~present).alias("bad_name"), (present & ~family).alias("bad_type"),
        (present & ~F.col("e.nullable") & F.col("a.nullable")).alias("bad_null"), (present & F.col("e.generated") & ~F.col("a.generated")).alias("bad_gen"),
        (present & (differs("precision") | differs("scale") | differs("length"))).alias("bad_size"))
    flags = rows.groupBy("table").agg(
        F.max("_has").alias("present"), *[(F.count_if(F.col(f"bad_{c}")) == 0).alias(n) for c, n in (
            ("name", "columns_match"), ("type", "type_family_ok"), ("null", "not_null_ok"), ("gen", "generated_ok"), ("size", "quantitative_ok"))])
    pk = lambda df, n: df.filter(F.col("kind") == "primary").select("table", F.col("columns").alias(n))
    sets = lambda df, n: df.groupBy("table").agg(F.collect_set(F.array_sort("columns")).alias(n))
    out = flags.join(expected.select("table").distinct(), "table", "left_semi")
    out = out.join(pk(expected_keys, "_epk"), "table", "left").join(pk(actual_keys, "_apk"), "table", "left")
    out = out.join(sets(expected_keys.filter(F.col("kind") == "unique"), "_eu"), "table", "left").join(sets(actual_keys, "_au"), "table", "left")
    none = F.array().cast("array<array<string>>")
    out = out.withColumns({
        "primary_key_ok": F.when(F.col("_epk").isNull(), F.col("_apk").isNotNull()).otherwise(F.coalesce(F.col("_epk") == F.col("_apk"), F.lit(False))),
        "unique_ok": F.size(F.array_except(F.coalesce("_eu", none), F.coalesce("_au", none))) == 0})
    checks = ("columns_match", "type_family_ok", "not_null_ok", "generated_ok", "quantitative_ok", "primary_key_ok", "unique_ok")
    ok = reduce(lambda x, y: x & y, [F.col(c) for c in checks])
    return out.select("table", "present", *checks, F.when(~F.col("present"), "missing").when(~ok, "mismatch").otherwise("ok").alias("verdict"))


def profile_schema(df: DataFrame, table: str) -> DataFrame:
    """Metadata a table's data supports: type, whether any NULL occurs and the longest text."""
    kinds = {"bigint": "bigint", "int": "integer", "string": "text", "double": "double precision", "timestamp_ntz": "timestamp without time zone",
             "timestamp": "timestamp with time zone", "date": "date", "binary": "bytea", "boolean": "boolean"}
    facts = df.agg(*[x for n, t in df.dtypes for x in (
        F.count_if(F.col(n).isNull()).alias(f"{n}__nulls"), (F.max(F.length(n)) if t == "string" else F.lit(None).cast("int")).alias(f"{n}__len"))])
    rows = [F.struct(
        F.lit(table).alias("table"), F.lit(n).alias("name"), F.lit("numeric" if t.startswith("decimal") else kinds.get(t, t)).alias("data_type"),
        (F.col(f"{n}__nulls") > 0).alias("nullable"), F.lit(False).alias("generated"), F.lit(None).cast("int").alias("precision"),
        F.lit(None).cast("int").alias("scale"), F.col(f"{n}__len").cast("int").alias("length")) for n, t in df.dtypes]
    return facts.select(F.inline(F.array(*rows)))


def key_holds(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row: repeated and incomplete keys of a claimed key; both zero means it holds."""
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    return df.groupBy(*cols).agg(F.count("*").alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("repeated"), F.coalesce(F.sum(F.when(missing, F.col("n"))), F.lit(0)).alias("incomplete"))


def choose_key(columns: list[dict], constraints: list[dict]) -> list[str] | None:
    """The primary key if its columns are NOT NULL and not generated, else the first such unique key."""
    meta = {c["name"]: c for c in columns}
    fit = lambda k: all(meta.get(c, {}).get("nullable") == "N" and not meta[c].get("generated") for c in k["columns"])
    for kind in ("primary", "unique"):
        for k in (x for x in constraints if x["kind"] == kind):
            if fit(k):
                return list(k["columns"])
    return None


def metadata(spark: SparkSession, rows: list[tuple], expected: bool) -> DataFrame:
    """Metadata rows as a frame with the gate's column names."""
    kind = "rule" if expected else "data_type"
    return spark.createDataFrame(rows, f"table string, name string, {kind} string, nullable boolean, generated boolean, precision int, scale int, length int")
