"""Form fields from a table of form objects, one row per dictionary.

form_objects: doc_id, obj_id, parent_id, page_number, page_height, ft, t, v, dv,
ff, rect array<double>, opt array<struct<value, display>>, is_widget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from quire.plans.durable import settled

# Flag bits and types.
READ_ONLY, REQUIRED, MULTILINE_BIT, RADIO_BIT = 1, 2, 12, 15
TYPES = {"Tx": "text", "Ch": "choice", "Sig": "signature"}
CHECKED = ("true", "yes", "1", "on")

# 2 ** ROUNDS ancestors are covered; only circular chains are still open then
ROUNDS = 32


def inherit(objects: DataFrame, cols: tuple[str, ...] = ("t", "v")) -> DataFrame:
    """Values of the nearest ancestor that has them, along the whole parent chain.

    Pointers are doubled: after r rounds every object has looked at 2^r
    ancestors, so a chain costs the logarithm of its length in joins. Only
    objects still without a value take part in a round, and every round's
    result is written out, so the plan does not grow. The write counts what is
    still open, so a round is one job.
    """
    attrs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(c).alias("val")) for c in cols])
    keys = ["doc_id", "attr", "obj_id"]
    is_open = F.col("next").isNotNull()

    def written(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        seen = Observation()
        kept = settled(rows.observe(seen, F.count_if(is_open).alias("open")))
        return kept.where(~is_open), kept.where(is_open), seen.get["open"]

    known, pending, n = written(
        objects.select("doc_id", "obj_id", "parent_id", F.inline(attrs)).select(
            *keys, "val", F.when(F.col("val").isNull(), F.col("parent_id")).alias("next")))
    for _ in range(ROUNDS):
        if not n:
            break
        up = known.unionByName(pending).select(
            "doc_id", "attr", F.col("obj_id").alias("next"), F.col("val").alias("up_val"),
            F.col("next").alias("up_next"))
        further = F.col("up_val").isNull() & (F.col("up_next") != F.col("obj_id"))
        # a pointer to a missing object finds nothing and drops out
        closed, pending, n = written(pending.join(up, ["doc_id", "attr", "next"]).select(
            *keys, F.col("up_val").alias("val"), F.when(further, F.col("up_next")).alias("next")))
        known = known.unionByName(closed)
    values = known.groupBy("doc_id", "obj_id").agg(
        *[F.max(F.when(F.col("attr") == c, F.col("val"))).alias(f"inherited_{c}") for c in cols])
    return objects.join(values, ["doc_id", "obj_id"], "left")


def _rounded(c: Column) -> Column:
    return F.round(c, 2)


def fields(objects: DataFrame) -> DataFrame:
    """Form fields of the widgets: name, type, geometry, value, flags, options."""
    objects = settled(objects)
    parents = objects.select(
        "doc_id", F.col("obj_id").alias("parent_id"), F.col("ft").alias("_parent_ft"),
        F.col("ff").alias("_parent_ff"))
    named = inherit(objects).where(
        F.col("is_widget") & (F.size("rect") >= 4)
        & ~F.exists(F.slice("rect", 1, 4), lambda e: e.isNull()))
    # type and flags look one level up only
    rows = named.join(parents, ["doc_id", "parent_id"], "left").withColumns({
        "_ft": F.coalesce("ft", "_parent_ft"),
        "_ff": F.coalesce("ff", "_parent_ff", F.lit(0)).cast("bigint"),
    })
    r = [F.get("rect", F.lit(i)) for i in range(4)]
    bit = lambda n: F.getbit(F.col("_ff"), F.lit(n)) == 1
    kind = F.when(F.col("_ft") == "Btn", F.when(bit(RADIO_BIT), "radio").otherwise("checkbox"))
    for name, value in TYPES.items():
        kind = kind.when(F.col("_ft") == name, value)
    x = _rounded(F.least(r[0], r[2]))
    y = _rounded(F.col("page_height") - F.greatest(r[1], r[3]))
    fallback = F.format_string("field_p%d_%d_%d", "page_number",
                               F.greatest(x, F.lit(0.0)).cast("bigint"),
                               F.greatest(y, F.lit(0.0)).cast("bigint"))
    name = F.coalesce("inherited_t", fallback)
    options = F.array_compact(F.transform("opt", lambda o: F.coalesce(o["display"], o["value"])))
    return rows.select(
        "doc_id", "obj_id", "page_number",
        F.concat(F.lit("fld_"), "page_number", F.lit("_"), name).alias("field_id"),
        name.alias("name"), F.col("inherited_t").isNotNull().alias("has_name"),
        kind.otherwise("text").alias("field_type"), x.alias("x"), y.alias("y"),
        _rounded(F.abs(r[2] - r[0])).alias("width"), _rounded(F.abs(r[3] - r[1])).alias("height"),
        F.coalesce("inherited_v", F.lit("")).alias("value"), F.col("dv").alias("default_value"),
        ((F.col("_ff").bitwiseAND(READ_ONLY)) != 0).alias("read_only"),
        ((F.col("_ff").bitwiseAND(REQUIRED)) != 0).alias("required"),
        bit(MULTILINE_BIT).alias("multiline"),
        F.when(F.size(options) > 0, options).alias("options"),
    )


def summary(field_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Number of fields per document, also for documents without any."""
    n = field_rows.groupBy("doc_id").agg(F.count("*").alias("fields_count"))
    return docs.select("doc_id").join(n, "doc_id", "left").fillna(0, ["fields_count"]).withColumn(
        "has_forms", F.col("fields_count") > 0)


def given_values(requests: DataFrame) -> DataFrame:
    """Rows (doc_id, name, new_value) of requests holding a map of values."""
    return requests.select("doc_id", F.explode("values").alias("name", "new_value"))


def fill(field_rows: DataFrame, given: DataFrame) -> DataFrame:
    """Fill fields by name from (doc_id, name, new_value); marks the updated ones.

    Of several values for one name the largest is taken, so no field is doubled.
    """
    given = given.groupBy("doc_id", "name").agg(F.max("new_value").alias("new_value"))
    truthy = F.lower("new_value").isin(*CHECKED)
    filled = F.when(F.col("field_type") == "checkbox",
                    F.when(truthy, "Yes").otherwise("Off")).otherwise(F.col("new_value"))
    updated = F.col("new_value").isNotNull() & F.col("has_name")
    return (
        field_rows.join(given, ["doc_id", "name"], "left")
        .withColumn("updated", updated)
        .withColumn("value", F.when(F.col("updated"), filled).otherwise(F.col("value")))
        .drop("new_value")
    )


def updated_counts(filled: DataFrame) -> DataFrame:
    return filled.groupBy("doc_id").agg(F.count_if("updated").alias("updated"))
