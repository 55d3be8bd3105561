"""Catalog jobs: names, hashes, configurations, parameters and tool definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.functions.text import (
    ALLOWED_APIS, MAX_DESCRIPTION, MAX_RENDERED, full_name, parse_full_name, standardize,
)
from calltrail.operators.cuts import chosen

PARAM = "struct<name:string,type:string,description:string>"

# Parameter type texts, the Python type each stands for, and its comment.
UPPER_TYPES = [
    ("STRING", "str"), ("BOOLEAN", "bool"), ("NUMBER", "Union[float, int]"), ("FLOAT", "float"),
    ("ARRAY", "List[Any]"), ("LIST", "List[Any]"),
    ("OBJECT", "Dict[str, Any]"), ("DICT", "Dict[str, Any]"), ("JSON", "Dict[str, Any]"), ("MAP", "Dict[str, Any]"),
    ("CREDENTIALS", "str"), ("SELECT", "str"), ("ENUM", "str"), ("DATEPICKER", "str"),
    ("DATE", "str"), ("DATETIME", "str"), ("FILE", "Any"), ("BINARY", "Any"),
]
EXACT_COMMENTS = [
    ("DATE (YYYY-MM-DD)", "date in the format of 'YYYY-MM-DD'"),
    ("GEOPOINT (latitude, longitude)", "geopoint in the format of 'latitude, longitude'"),
    ("TIME (24-hour HH:MM)", "time in the format of '24-hour HH:MM'"),
]
DESCRIPTION_TEMPLATE = """
This is an api, {api_name}, from tool, {tool_name}, in category, {category}.

The api description:
{api_description}
The tool description:
{tool_description}
"""


def python_type(type_text: Column) -> Column:
    out = None
    for text, name in UPPER_TYPES:
        hit = F.upper(type_text) == text
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(F.lit("str"))


def type_comment(type_text: Column) -> Column:
    out = None
    for text, comment in EXACT_COMMENTS:
        hit = type_text == text
        out = F.when(hit, F.lit(comment)) if out is None else out.when(hit, F.lit(comment))
    return out.otherwise(F.lit(""))


def hash_to_name(df: DataFrame, hashes: DataFrame, column: str) -> DataFrame:
    """Add `name`: the mapped name, the value itself when it is a name already, else null.

    hashes(hash, name). Both sides are joined on the value, so nothing is broadcast blindly.
    """
    by_hash = hashes.select(F.col("hash").alias(column), F.col("name").alias("_mapped"))
    names = hashes.select(F.col("name").alias(column)).distinct().withColumn("_known", F.lit(True))
    return (
        df.join(by_hash, column, "left")
        .join(names, column, "left")
        .withColumn("name", F.coalesce("_mapped", F.when(F.col("_known"), F.col(column))))
        .drop("_mapped", "_known")
    )


def name_to_hash(df: DataFrame, hashes: DataFrame, column: str):
    """Add `hash`. Returns (resolved rows, rows whose name the catalog lacks)."""
    by_name = hashes.select(F.col("name").alias(column), "hash")
    return df.join(by_name, column), df.join(by_name, column, "left_anti")


def parse_names(df: DataFrame, column: str) -> DataFrame:
    """Add category, tool, api, all empty when the name has not exactly three parts."""
    return df.withColumn("_p", parse_full_name(F.coalesce(F.col(column), F.lit("")))).select(
        *df.columns, "_p.category", "_p.tool", "_p.api"
    )


def tool_category(catalog: DataFrame, position: str) -> DataFrame:
    """catalog(category, tool, api, position) -> category per (tool, api); the last row wins."""
    return catalog.groupBy("tool", "api").agg(F.max_by("category", position).alias("category"))


def valid_queries(queries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Rows whose `tool_name` is the full name of a catalog row."""
    names = catalog.select(full_name(F.col("category"), F.col("tool"), F.col("api")).alias("tool_name"))
    return queries.join(names, "tool_name", "left_semi")


def resolve_apis(configs: DataFrame) -> DataFrame:
    """configs(category, tool, api_pos, name, ...) -> one row per standardised api name.

    Where several entries of one tool standardise to the same name the first one counts.
    """
    named = configs.withColumn("api", standardize(F.col("name")))
    return first_per_key(named, ["category", "tool", "api"], "api_pos").drop("api_pos")


def api_args(references: DataFrame, configs: DataFrame, limit: int = MAX_DESCRIPTION) -> DataFrame:
    """Description and parameters per (category, tool, api); empty when nothing matches.

    configs needs description and the `required`, `optional` parameter arrays.
    """
    def short(params: str) -> Column:
        empty = F.array().cast(f"array<{PARAM}>")
        return F.coalesce(
            F.transform(
                params,
                lambda p: F.struct(
                    p["name"].alias("name"), p["type"].alias("type"),
                    F.substring(p["description"], 1, limit).alias("description"),
                ),
            ),
            empty,
        )

    found = references.join(resolve_apis(configs), ["category", "tool", "api"], "left")
    return found.select(
        *references.columns,
        *[c for c in ("tool_description",) if c in configs.columns],
        F.substring(F.coalesce("description", F.lit("")), 1, limit).alias("description"),
        short("required").alias("required"),
        short("optional").alias("optional"),
    )


def known_apis(proposals: DataFrame, hashes: DataFrame, keys: list[str]) -> DataFrame:
    """proposals(keys..., position, hash) -> the apis of each proposal that the catalog knows.

    Adds `name`; proposals left without any api keep one row with a null name.
    """
    named = proposals.join(hashes, "hash", "left")
    kept = named.filter(F.col("name").isNotNull())
    counts = named.groupBy(*keys).agg(F.count("name").alias("_n")).filter(F.col("_n") == 0)
    return kept.unionByName(counts.select(*keys), allowMissingColumns=True)


def first_per_key(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The first row of every key by `position`."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), position).alias("_r")).select(*keys, "_r.*")


def without_fields(record: Column, *fields: str) -> Column:
    """A struct without the listed fields."""
    return record.dropFields(*fields)


def buildable(references: DataFrame, configs: DataFrame) -> DataFrame:
    """Counts of references with and without a configuration."""
    known = resolve_apis(configs).select("category", "tool", "api", F.lit(True).alias("_known"))
    return references.join(known, ["category", "tool", "api"], "left").agg(
        F.count_if(F.col("_known").isNotNull()).alias("n_built"),
        F.count_if(F.col("_known").isNull()).alias("n_dropped"),
    )


def split_api_for_tool(texts: DataFrame, catalog: DataFrame, column: str = "api_for_tool") -> DataFrame:
    """Resolve texts 'api_for_tool' to (api, tool): the first cut where both are known.

    Works on distinct texts; fewer than two or ten and more parts resolve to nothing.
    """
    marker = "_for_"
    distinct = texts.select(column).distinct().withColumn("_parts", F.split(column, marker))
    n = F.size("_parts")
    cuts = distinct.filter((n >= 2) & (n < 10)).withColumn("_cut", F.explode(F.sequence(F.lit(1), n - 1)))
    named = cuts.select(
        column, "_cut",
        F.array_join(F.slice("_parts", 1, F.col("_cut")), marker).alias("api"),
        F.array_join(F.slice("_parts", F.col("_cut") + 1, n), marker).alias("tool"),
    )
    known = named.join(catalog.select("api").distinct(), "api", "left_semi").join(
        catalog.select("tool").distinct(), "tool", "left_semi"
    )
    best = known.groupBy(column).agg(F.min_by(F.struct("api", "tool"), "_cut").alias("_b"))
    return distinct.select(column).join(best, column, "left").select(column, "_b.api", "_b.tool")


def distinct_names(catalog: DataFrame) -> DataFrame:
    """Every tool name and every api name once."""
    return catalog.select(F.lit("tool").alias("kind"), F.col("tool").alias("name")).unionByName(
        catalog.select(F.lit("api").alias("kind"), F.col("api").alias("name"))
    ).distinct()


def allowed_only(catalog: DataFrame, name: str, allowed: list[str] = ALLOWED_APIS) -> DataFrame:
    return catalog.filter(F.col(name).isin(allowed))


def sample_catalog(catalog: DataFrame, key: str, num_apis: int, seed: int, step: int = 0,
                   max_iter: int = 10, strict: bool = False) -> DataFrame:
    """`num_apis` rows without replacement; out of range means all rows, or an error if `strict`."""
    if strict and not 0 < num_apis <= catalog.count():
        raise ValueError("num_apis is out of range")
    return catalog.filter(chosen(catalog, key, seed * max_iter + step, count=num_apis))


def argument_schema(required: Column, optional: Column) -> Column:
    """Ordered (name, type, description) entries; a later parameter of the same name wins.

    Both kinds are mandatory in the schema, as a model must fill every argument.
    """
    both = F.concat(required, optional)
    names = F.array_distinct(F.transform(both, lambda p: p["name"]))

    def entry(name):
        p = F.element_at(F.filter(both, lambda q: q["name"] == name), -1)
        return F.struct(
            name.alias("name"),
            python_type(p["type"]).alias("type"),
            F.concat(F.coalesce(p["description"], F.lit("")), F.lit("\n"), type_comment(p["type"])).alias("description"),
        )

    return F.transform(names, entry)


def function_definition(name: Column, description: Column, required: Column, optional: Column) -> Column:
    """Tool definition as JSON text: properties in first-seen order, `required` as listed."""
    named = lambda params: F.filter(params, lambda p: F.coalesce(p["name"], F.lit("")) != "")
    both = named(F.concat(required, optional))
    keys = F.array_distinct(F.transform(both, lambda p: p["name"]))

    def prop(key):
        p = F.element_at(F.filter(both, lambda q: q["name"] == key), -1)
        return F.struct(
            F.coalesce(p["type"], F.lit("string")).alias("type"),
            F.coalesce(p["description"], F.lit("")).alias("description"),
        )

    return F.to_json(
        F.struct(
            name.alias("name"),
            description.alias("description"),
            F.struct(
                F.lit("object").alias("type"),
                F.map_from_arrays(keys, F.transform(keys, prop)).alias("properties"),
                F.transform(named(required), lambda p: p["name"]).alias("required"),
            ).alias("parameters"),
        )
    )


def rendered_description(api: Column, tool: Column, category: Column, api_text: Column, tool_text: Column) -> Column:
    pattern = DESCRIPTION_TEMPLATE.replace("%", "%%")
    for field in ("api_name", "tool_name", "category", "api_description", "tool_description"):
        pattern = pattern.replace("{" + field + "}", "%s")
    return F.substring(F.format_string(pattern, api, tool, category, api_text, tool_text), 1, MAX_RENDERED)


def annotations(args: DataFrame) -> DataFrame:
    """args(category, tool, api, required, optional, description, tool_description) ->
    name, description, args_schema per tool."""
    return args.select(
        full_name(F.col("category"), F.col("tool"), F.col("api")).alias("name"),
        rendered_description(
            F.col("api"), F.col("tool"), F.col("category"), F.col("description"), F.col("tool_description")
        ).alias("description"),
        argument_schema(F.col("required"), F.col("optional")).alias("args_schema"),
    )
