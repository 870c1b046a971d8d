"""Tables of paths and values: range scans, rows put together from them, and JSON taken apart and rebuilt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import paths as P
from quillspark.storage import written

#: What stands at the path of an object.
OBJECT = "object-type-placeholder"
MOST_LEVELS = 1000


def range_scan(table: DataFrame, prefix: str, path_col: str = "path", strict: bool = False) -> DataFrame:
    """The rows whose path lies in the prefix's range; the filter reaches the scan."""
    return table.where(P.in_range(F.col(path_col), prefix, strict))


def assembled_tuples(table: DataFrame, top: str, columns: list[str] | None = None, path_col: str = "path", value_col: str = "value") -> DataFrame:
    """(row_key, cells): a map of columns for each first name below top; nested columns keep their slashes.

    With columns, only those, and no rows without any of them. Paths that end
    at the row key have no column and are left out.
    """
    if not top.endswith("/"):
        raise ValueError("top ends with a slash")
    rest = F.regexp_replace(F.substr(F.col(path_col), F.lit(len(top) + 1)), "/$", "")
    rows = table.where(F.col(path_col).startswith(top)).select(F.substring_index(rest, "/", 1).alias("row_key"), rest.alias("_rest"), F.col(value_col).alias("_value"))
    named = rows.where(F.contains("_rest", F.lit("/"))).withColumn("_column", F.expr("substr(_rest, length(row_key) + 2)"))
    if columns is not None:
        named = named.where(F.col("_column").isin(*columns)) if columns else named.limit(0)
    cells = named.groupBy("row_key", "_column").agg(F.max("_value").alias("_value"))
    return cells.groupBy("row_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_column", "_value")))).alias("cells"))


def tuple_table(table: DataFrame, top: str, columns: list[str], path_col: str = "path", value_col: str = "value") -> DataFrame:
    """assembled_tuples() with a column for each one named."""
    found = assembled_tuples(table, top, columns, path_col, value_col)
    return found.select("row_key", *[F.col("cells")[c].alias(c) for c in columns])


def flattened_json(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, path, kind, s, n) for every value in a JSON document, and for every object and array itself.

    kind is 'string', 'number' or 'boolean'; s has strings, booleans as words
    and null as the word, n has numbers. An object has the row OBJECT at its
    own path; an array has a child for each index and one named length. Null and
    unreadable documents have no rows. Levels are taken apart one after another,
    each from a table that holds only what is still nested; one that is nested
    more than MOST_LEVELS deep is an error.
    """
    level = docs.select(F.col(id_col).alias("_id"), F.lit("").alias("path"), F.try_parse_json(F.col(json_col)).alias("v")).where("v IS NOT NULL")
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    for depth in range(MOST_LEVELS):
        typed = level.withColumn("_type", F.substring_index(F.schema_of_variant("v"), "<", 1))
        if depth:
            typed = written(typed.select("_id", "path", "v", "_type"), "json-level")
        plain = typed.where(~F.col("_type").isin("OBJECT", "ARRAY"))
        word = F.col("_type").isin("VOID", "STRING", "BOOLEAN")
        scalars = plain.select(
            "_id",
            F.concat("path", F.lit("/")).alias("path"),
            F.when(F.col("_type") == "BOOLEAN", "boolean").when(word, "string").otherwise("number").alias("kind"),
            F.when(F.col("_type") == "VOID", "null").when(word, F.expr("try_variant_get(v, '$', 'string')")).alias("s"),
            F.when(~word, F.expr("try_variant_get(v, '$', 'double')")).alias("n"),
        )
        nested = typed.where(F.col("_type").isin("OBJECT", "ARRAY"))
        if depth >= 1 and not nested.take(1):
            out = scalars if out is None else out.unionByName(scalars)
            break
        objects = nested.where("_type = 'OBJECT'").select("_id", F.concat("path", F.lit("/")).alias("path"), F.lit("string").alias("kind"), F.lit(OBJECT).alias("s"), F.lit(None).cast("double").alias("n"))
        arrays = nested.where("_type = 'ARRAY'").select("_id", F.concat("path", F.lit("/length/")).alias("path"), F.lit("number").alias("kind"), F.lit(None).cast("string").alias("s"), F.size(F.expr("try_variant_get(v, '$', 'array<variant>')")).cast("double").alias("n"))
        here = scalars.unionByName(objects).unionByName(arrays)
        out = here if out is None else out.unionByName(here)
        level = docs.sparkSession.sql("SELECT _id, concat(path, '/', coalesce(c.key, cast(c.pos AS string))) AS path, c.value AS v FROM {nested}, LATERAL variant_explode(v) AS c(pos, key, value)", nested=nested)
    else:
        raise ValueError("nested too deeply")
    return out.select(F.col("_id").cast(kind).alias(id_col), "path", "kind", "s", "n")


def as_text(kind: Column, s: Column, n: Column) -> Column:
    """A value's text: whole numbers without a point."""
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    return F.when(kind == "number", F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))).otherwise(s)


def _quoted(value: Column) -> Column:
    pair = F.to_json(F.create_map(F.lit("k"), value))
    return F.substr(pair, F.lit(6), F.length(pair) - 6)


def rebuilt_json(table: DataFrame, id_col: str, path_col: str = "path", value_col: str = "value") -> DataFrame:
    """(id, json) of the objects that tables of paths came from: all leaves are strings, names are sorted.

    Arrays stay objects of indexes and a length. The row of an object gives way
    to its children; without any it stays a string. One step a level, from the
    deepest up.
    """
    names = P.parts(F.col(path_col))
    rows = table.where(F.length(path_col) > 1).select(F.col(id_col).alias("_id"), names.alias("_names"), _quoted(F.col(value_col)).alias("_json")).withColumn("_depth", F.size("_names"))
    rows = written(rows, "json-paths")
    deepest = rows.agg(F.max("_depth")).first()[0] or 0
    if deepest > MOST_LEVELS:
        raise ValueError("nested too deeply")
    leaves = rows.withColumn("_made", F.lit(0))
    above = None
    for depth in range(deepest, 0, -1):
        here = leaves.where(F.col("_depth") == depth).select("_id", "_names", "_json", "_made")
        here = here if above is None else here.unionByName(above)
        one = here.groupBy("_id", "_names").agg(F.max_by("_json", "_made").alias("_json"))
        key = F.element_at("_names", -1)
        cell = F.struct(key.alias("k"), F.concat(_quoted(key), F.lit(":"), F.col("_json")).alias("t"))
        cells = one.groupBy("_id", F.slice("_names", F.lit(1), F.size("_names") - 1).alias("_names")).agg(F.array_sort(F.collect_list(cell)).alias("c"))
        above = cells.select("_id", "_names", F.concat(F.lit("{"), F.array_join("c.t", ","), F.lit("}")).alias("_json"), F.lit(1).alias("_made"))
    if above is None:
        return rows.select(F.col("_id").alias(id_col), F.col("_json").alias("json")).limit(0)
    return above.select(F.col("_id").alias(id_col), F.col("_json").alias("json"))


def is_valid_json(table: DataFrame, id_col: str) -> DataFrame:
    """(id, valid) over flattened_json() rows: whether no object, reached through objects only, is empty."""
    arrays = table.where(F.col("path").endswith("/length/") & (F.col("kind") == "number")).select(F.col(id_col), F.regexp_replace("path", "length/$", "").alias("_array"))
    empty = table.where(F.col("s") == OBJECT).select(F.col(id_col), F.col("path").alias("_object"))
    children = table.where("path <> '/'").select(F.col(id_col), F.regexp_replace("path", "[^/]*/$", "").alias("_object")).distinct()
    bare = empty.join(children, [id_col, "_object"], "left_anti")
    inside = bare.join(arrays, id_col).where(F.col("_object").startswith(F.col("_array"))).select(id_col, "_object").distinct()
    bad = bare.join(inside, [id_col, "_object"], "left_anti").select(id_col).distinct().withColumn("_bad", F.lit(True))
    return table.select(id_col).distinct().join(bad, id_col, "left").select(id_col, F.col("_bad").isNull().alias("valid"))


def under(table: DataFrame, prefix: str) -> DataFrame:
    """Paths of flattened_json() moved below a prefix, with values as text: what writing a document at a path stores."""
    base = prefix.rstrip("/")
    return table.withColumn("path", F.concat(F.lit(base), F.col("path"))).withColumn("value", as_text(F.col("kind"), F.col("s"), F.col("n"))).drop("kind", "s", "n")


def read_json(table: DataFrame, uri: str, id_col: str, value_col: str = "value") -> DataFrame:
    """(id, json) of what lies at a path of each store: rebuilt, then looked up; null if nothing does."""
    names = [x for x in uri.split("/") if x]
    prefix = "/" + "".join(f"{x}/" for x in names)
    found = range_scan(table, prefix, strict=True)
    whole = rebuilt_json(found, id_col, value_col=value_col)
    pointer = "$" + "".join(f"['{x}']" for x in names)
    got = F.get_json_object("json", pointer) if names else F.col("json")
    return table.select(id_col).distinct().join(whole, id_col, "left").select(id_col, got.alias("json"))


def values_named(docs: DataFrame, id_col: str, json_col: str, name: str = "uri") -> DataFrame:
    """(id, value) of every value under a key, however deep it lies."""
    rows = flattened_json(docs, id_col, json_col)
    return rows.where(F.col("path").endswith(f"/{name}/") & (~F.col("s").eqNullSafe(F.lit(OBJECT)))).select(id_col, as_text(F.col("kind"), F.col("s"), F.col("n")).alias("value"))
