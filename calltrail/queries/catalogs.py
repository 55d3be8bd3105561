"""Names, hashes, configurations, parameters and definitions over the part table."""

from pyspark.sql import functions as F

from calltrail.functions import text
from calltrail.plans import catalog as cat
from calltrail.plans import workflows as wf
from calltrail.queries.base import query, table

PARAMS = f"array<{cat.PARAM}>"


def entries(spark, sf_dir):
    """Parts as api entries of tools: category p_type, tool p_brand, api name p_name."""
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("tool"), F.col("p_name").alias("name"),
        F.col("p_partkey").alias("api_pos"), "p_size", "p_retailprice",
    )


def full_names(spark, sf_dir):
    """hash and name of every part; the api of a name is the part key, so names are unique."""
    part = table(spark, sf_dir, "part")
    name = text.full_name(F.col("p_type"), F.col("p_brand"), F.col("p_partkey").cast("string"))
    return part.select(F.substring(F.md5(name), 1, 12).alias("hash"), name.alias("name"))


NAMES_SQL = """names AS (
  SELECT substr(md5(n), 1, 12) AS hash, n AS name
  FROM (SELECT p_type || '-' || p_brand || '-' || CAST(p_partkey AS VARCHAR) AS n FROM part))"""
STD_API_SQL = r"""trim(regexp_replace(regexp_replace({0}, '[^\x{{4e00}}-\x{{9fa5}}^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"""


def std_api_sql(column: str) -> str:
    bare = f"lower({STD_API_SQL.format(column)})"
    return f"CASE WHEN regexp_matches({bare}, '^[0-9]') THEN 'get_' || {bare} ELSE {bare} END"


ENTRIES_SQL = f"""entries AS (
  SELECT p_type AS category, p_brand AS tool, p_name AS name, p_partkey AS api_pos, p_size, p_retailprice,
         {std_api_sql('p_name')} AS api
  FROM part)"""


@query("api_names", """
SELECT p_partkey, p_type || '-' || p_brand || '-' || p_name AS full_name, p_type AS category, p_brand AS tool, p_name AS api
FROM part""")
def api_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = part.select("p_partkey", text.full_name(F.col("p_type"), F.col("p_brand"), F.col("p_name")).alias("full_name"))
    return cat.parse_names(named, "full_name")


RAW_NAME = "concat('2 ', p_name, '  (', p_brand, ')/', p_type, ' ')"


@query("standardized_names", f"""
SELECT p_partkey, {std_api_sql("('2 ' || p_name || '  (' || p_brand || ')/' || p_type || ' ')")} AS api,
       {std_api_sql("(p_brand || '__' || p_name)")} AS second,
       replace(replace(replace(replace(p_type || ' , ' || p_brand || '/x', ' ', '_'), ',', '_'), '/', '_'), '__', '_') AS category
FROM part""")
def standardized_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.standardize(F.expr(RAW_NAME)).alias("api"),
        text.standardize(F.concat("p_brand", F.lit("__"), "p_name")).alias("second"),
        text.standardize_category(F.concat("p_type", F.lit(" , "), "p_brand", F.lit("/x"))).alias("category"),
    )


@query("tool_category", """
SELECT p_brand AS tool, p_name AS api, max_by(p_type, p_partkey) AS category FROM part GROUP BY p_brand, p_name""")
def tool_category(spark, sf_dir):
    rows = entries(spark, sf_dir).withColumnRenamed("name", "api")
    return cat.tool_category(rows, "api_pos")


@query("distinct_names", """
SELECT DISTINCT 'tool' AS kind, p_brand AS name FROM part UNION ALL SELECT DISTINCT 'api', p_name FROM part""")
def distinct_names(spark, sf_dir):
    return cat.distinct_names(entries(spark, sf_dir).withColumnRenamed("name", "api"))


VALUE_SQL = """values_ AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_returnflag = 'A' THEN substr(md5(p_type || '-' || p_brand || '-' || CAST(p_partkey AS VARCHAR)), 1, 12)
              WHEN l_returnflag = 'N' THEN p_type || '-' || p_brand || '-' || CAST(p_partkey AS VARCHAR)
              ELSE 'lost-' || CAST(p_partkey AS VARCHAR) END AS value
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _values(spark, sf_dir):
    """Tool references of three spellings: hash, name and neither."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand")
    both = lines.join(part, F.col("p_partkey") == F.col("l_partkey"))
    name = text.full_name(F.col("p_type"), F.col("p_brand"), F.col("p_partkey").cast("string"))
    value = (
        F.when(F.col("l_returnflag") == "A", F.substring(F.md5(name), 1, 12))
        .when(F.col("l_returnflag") == "N", name)
        .otherwise(F.concat(F.lit("lost-"), F.col("p_partkey").cast("string")))
    )
    return both.select("l_orderkey", "l_linenumber", value.alias("value"))


@query("hash_lookup", f"""WITH {NAMES_SQL}, {VALUE_SQL}
SELECT l_orderkey, l_linenumber, value, coalesce(h.name, n.name) AS name,
       coalesce(split_part(h.name, '-', 1), '') AS category, coalesce(split_part(h.name, '-', 3), '') AS api
FROM values_ LEFT JOIN names h ON h.hash = value LEFT JOIN names n ON n.name = value""")
def hash_lookup(spark, sf_dir):
    hashes = full_names(spark, sf_dir)
    values = _values(spark, sf_dir)
    # references are resolved once per distinct value
    resolved = cat.hash_to_name(values.select("value").distinct(), hashes, "value")
    mapped = F.when(F.col("name") != F.col("value"), F.col("name"))
    parsed = cat.parse_names(resolved.withColumn("_mapped", mapped), "_mapped")
    return values.join(parsed, "value").select("l_orderkey", "l_linenumber", "value", "name", "category", "api")


@query("name_to_hash", f"""WITH {NAMES_SQL}, {VALUE_SQL}
SELECT value, count(*) AS n, max(hash) AS hash FROM values_ LEFT JOIN names ON name = value GROUP BY value""")
def name_to_hash(spark, sf_dir):
    counted = _values(spark, sf_dir).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    found, missing = cat.name_to_hash(counted, full_names(spark, sf_dir), "value")
    return found.select("value", "n", "hash").unionByName(
        missing.select("value", "n", F.lit(None).cast("string").alias("hash"))
    )


@query("valid_queries", f"""WITH {NAMES_SQL}, {VALUE_SQL}
SELECT l_orderkey, l_linenumber, value AS tool_name FROM values_ WHERE value IN (SELECT name FROM names)""")
def valid_queries(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("tool"), F.col("p_partkey").cast("string").alias("api")
    )
    return cat.valid_queries(_values(spark, sf_dir).withColumnRenamed("value", "tool_name"), part)


@query("proposal_apis", f"""WITH {NAMES_SQL}, {VALUE_SQL}
SELECT l_orderkey, value AS hash, l_linenumber, name FROM values_ JOIN names ON hash = value
UNION ALL SELECT l_orderkey, NULL, NULL, NULL FROM values_ LEFT JOIN names ON hash = value
GROUP BY l_orderkey HAVING count(name) = 0""")
def proposal_apis(spark, sf_dir):
    """Orders as proposals: apis with an unknown hash go, proposals left with none stay."""
    proposals = _values(spark, sf_dir).withColumnRenamed("value", "hash")
    return cat.known_apis(proposals, full_names(spark, sf_dir), ["l_orderkey"])


@query("named_steps", f"""WITH {NAMES_SQL}, {VALUE_SQL}
SELECT l_orderkey, l_linenumber, coalesce(h.name, n.name) AS tool, 'call ' || coalesce(h.name, n.name) AS log,
       '{{"' || coalesce(h.name, n.name) || '":1}}' AS result
FROM values_ LEFT JOIN names h ON h.hash = value LEFT JOIN names n ON n.name = value
WHERE coalesce(h.name, n.name) IS NOT NULL""")
def named_steps(spark, sf_dir):
    raw = _values(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.col("value").alias("tool"), F.concat(F.lit("call "), "value").alias("log"),
        F.concat(F.lit('{"'), "value", F.lit('":1}')).alias("result"),
    )
    return wf.name_steps(raw, full_names(spark, sf_dir))


@query("first_apis", """
SELECT p_type AS category, p_brand AS tool, p_name AS name, min(p_partkey) AS api_pos FROM part GROUP BY ALL""")
def first_apis(spark, sf_dir):
    rows = entries(spark, sf_dir).select("category", "tool", "name", "api_pos")
    return cat.first_per_key(rows, ["category", "tool", "name"], "api_pos")


def _configs(spark, sf_dir):
    """Entries with the parameters of a tool configuration."""
    size = F.struct(
        F.lit("size").alias("name"), F.lit("NUMBER").alias("type"),
        F.concat(F.lit("Size, such as "), F.col("p_size").cast("string")).alias("description"),
    )
    nameless = F.struct(F.lit("").alias("name"), F.lit("STRING").alias("type"), F.lit("never shown").alias("description"))
    day = F.struct(
        F.lit("day").alias("name"), F.lit("DATE (YYYY-MM-DD)").alias("type"), F.lit("Day of use").alias("description")
    )
    again = F.struct(
        F.lit("size").alias("name"), F.lit("Enum").alias("type"), F.lit("Size by name").alias("description")
    )
    return entries(spark, sf_dir).select(
        "category", "tool", "api_pos", "name",
        F.concat(F.lit("Finds a "), "name", F.lit(" "), F.repeat(F.lit("ab "), F.col("p_size") * 2)).alias("description"),
        F.array(size, nameless).cast(PARAMS).alias("required"),
        F.when(F.col("p_size") % 2 == 0, F.array(day, again)).otherwise(F.array(day)).cast(PARAMS).alias("optional"),
        F.concat(F.lit("Tools of "), "tool").alias("tool_description"),
    )


FIRST_SQL = f"""{ENTRIES_SQL},
firsts AS (
  SELECT category, tool, api, min(api_pos) AS api_pos FROM entries GROUP BY category, tool, api),
configs AS (
  SELECT e.*, substr('Finds a ' || name || ' ' || repeat('ab ', p_size * 2), 1, 256) AS description,
         p_size % 2 = 0 AS is_even
  FROM entries e JOIN firsts USING (category, tool, api, api_pos))"""


@query("api_config_lookup", f"""WITH {FIRST_SQL}
SELECT r.category, r.tool, r.api, coalesce(description, '') AS description,
       CAST(CASE WHEN name IS NULL THEN 0 ELSE 2 END AS INTEGER) AS n_required,
       CAST(CASE WHEN name IS NULL THEN 0 WHEN is_even THEN 2 ELSE 1 END AS INTEGER) AS n_optional
FROM (SELECT DISTINCT category, p_brand AS tool, api FROM part
      JOIN (SELECT DISTINCT category, api FROM entries) ON p_type = category) r
LEFT JOIN configs USING (category, tool, api)""")
def api_config_lookup(spark, sf_dir):
    """Each tool asks for every api of its category, most of which are those of other tools."""
    configs = _configs(spark, sf_dir)
    names = configs.select("category", text.standardize(F.col("name")).alias("api")).distinct()
    tools = configs.select("category", "tool").distinct()
    references = tools.join(names, "category")
    found = cat.api_args(references, configs)
    return found.select(
        "category", "tool", "api", "description", F.size("required").alias("n_required"), F.size("optional").alias("n_optional")
    )


@query("buildable_tools", f"""WITH {FIRST_SQL}
SELECT count(c.name) AS n_built, count(*) - count(c.name) AS n_dropped
FROM (SELECT p_type AS category, p_brand AS tool, {std_api_sql("CASE WHEN p_size > 40 THEN p_name || ' x' ELSE p_name END")} AS api
      FROM part) r LEFT JOIN configs c USING (category, tool, api)""")
def buildable_tools(spark, sf_dir):
    asked = entries(spark, sf_dir).select(
        "category", "tool",
        text.standardize(F.when(F.col("p_size") > 40, F.concat("name", F.lit(" x"))).otherwise(F.col("name"))).alias("api"),
    )
    return cat.buildable(asked, _configs(spark, sf_dir))


@query("api_for_tool", f"""WITH {ENTRIES_SQL},
texts AS (SELECT DISTINCT api || CASE WHEN p_size % 3 = 0 THEN '_for_' ELSE '_for_all_for_' END || tool AS api_for_tool FROM entries),
known AS (SELECT DISTINCT api FROM entries), tools AS (SELECT DISTINCT tool FROM entries UNION SELECT DISTINCT 'all_for_' || tool FROM entries)
SELECT api_for_tool, split_part(api_for_tool, '_for_', 1) AS api,
       substr(api_for_tool, length(split_part(api_for_tool, '_for_', 1)) + 6) AS tool
FROM texts""")
def api_for_tool(spark, sf_dir):
    named = entries(spark, sf_dir).withColumn("api", text.standardize(F.col("name")))
    texts = named.select(
        F.concat(
            "api", F.when(F.col("p_size") % 3 == 0, "_for_").otherwise("_for_all_for_"), "tool"
        ).alias("api_for_tool")
    )
    known = named.select("api", "tool").unionByName(
        named.select("api", F.concat(F.lit("all_for_"), "tool").alias("tool"))
    )
    return cat.split_api_for_tool(texts, known)


TYPE_TEXTS = ["String", "BOOLEAN", "number", "Float", "list", "Json", "select", "DATE (YYYY-MM-DD)", "datetime",
              "File", "unheard of", "TIME (24-hour HH:MM)", "date (yyyy-mm-dd)"]
TYPE_RESULTS = ["str", "bool", "Union[float, int]", "float", "List[Any]", "Dict[str, Any]", "str", "str", "str",
                "Any", "str", "str", "str"]
TYPE_COMMENTS = ["", "", "", "", "", "", "", "date in the format of ''YYYY-MM-DD''", "", "", "",
                 "time in the format of ''24-hour HH:MM''", ""]


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query("param_types", f"""
SELECT p_partkey, {_sql_list(TYPE_RESULTS)}[1 + p_size % 13] AS python_type,
       {_sql_list(TYPE_COMMENTS)}[1 + p_size % 13] AS comment FROM part""")
def param_types(spark, sf_dir):
    kind = F.element_at(F.array(*[F.lit(t) for t in TYPE_TEXTS]), F.col("p_size") % 13 + 1)
    return table(spark, sf_dir, "part").withColumn("kind", kind).select(
        "p_partkey", cat.python_type(F.col("kind")).alias("python_type"), cat.type_comment(F.col("kind")).alias("comment")
    )


def _resolved(spark, sf_dir):
    configs = _configs(spark, sf_dir)
    references = configs.select("category", "tool", text.standardize(F.col("name")).alias("api")).distinct()
    return cat.api_args(references, configs)


SIZE_SQL = """CASE WHEN is_even THEN '{"type":"Enum","description":"Size by name"}'
              ELSE '{"type":"NUMBER","description":"Size, such as ' || CAST(p_size AS VARCHAR) || '"}' END"""


@query("function_defs", f"""WITH {FIRST_SQL}
SELECT category || '-' || tool || '-' || api AS name,
       '{{"name":"' || category || '-' || tool || '-' || api || '","description":"' || description
       || '","parameters":{{"type":"object","properties":{{"size":' || {SIZE_SQL}
       || ',"day":{{"type":"DATE (YYYY-MM-DD)","description":"Day of use"}}}},"required":["size"]}}}}' AS definition
FROM configs""")
def function_defs(spark, sf_dir):
    name = text.full_name(F.col("category"), F.col("tool"), F.col("api"))
    return _resolved(spark, sf_dir).select(
        name.alias("name"),
        cat.function_definition(name, F.col("description"), F.col("required"), F.col("optional")).alias("definition"),
    )


@query("api_descriptions", f"""WITH {FIRST_SQL}
SELECT category || '-' || tool || '-' || api AS name,
       substr(chr(10) || 'This is an api, ' || api || ', from tool, ' || tool || ', in category, ' || category || '.' || chr(10)
         || chr(10) || 'The api description:' || chr(10) || description || chr(10) || 'The tool description:' || chr(10)
         || 'Tools of ' || tool || chr(10), 1, 1024) AS description,
       CASE WHEN is_even THEN 'size:str:Size by name' ELSE 'size:Union[float, int]:Size, such as ' || CAST(p_size AS VARCHAR) END
         || chr(10) || '|:str:never shown' || chr(10) || '|day:str:Day of use' || chr(10) || 'date in the format of ''YYYY-MM-DD'''
         AS args
FROM configs""")
def api_descriptions(spark, sf_dir):
    noted = cat.annotations(_resolved(spark, sf_dir))
    shown = F.transform("args_schema", lambda a: F.concat_ws(":", a["name"], a["type"], a["description"]))
    return noted.select("name", "description", F.array_join(shown, "|").alias("args"))
