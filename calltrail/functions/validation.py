"""Does an API response carry data? One reason column, null when the response is valid.

Text rules come first and settle most rows. Rows that start like an object or array and
pass them are read as VARIANT; only those that are not JSON go through Python, as the
other common spelling is a Python literal. Stages are separate projections so that no rule
parses a text twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calltrail.functions.pyliteral import to_json_text
from calltrail.functions.text import strip

# The word lists, prefixes, key lists and reasons of the validation rules.
TAG_PREFIXES = ["<!DOCTYPE", "<html", "<head", "<body", "<?xml", "<QUOTE", "<ERROR"]
LOWER_TAG_PREFIXES = ["<html>", "<!doctype html>", "<?xml"]
BINARY_PREFIXES = ["\x89PNG", "PNG", "�PNG", "\xff\xd8\xff", "%PDF"]
EXPLICIT_ERRORS = [
    "Payment required",
    "DEPLOYMENT_DISABLED",
    "API request missing api_key or valid OAuth parameters",
    "Internal Server Error",
    "404 Not Found",
    "403 Forbidden",
    "The endpoint has been disabled",
    "API rate limit exceeded",
    "Invalid Stock Ticker",
    "could not parse location:",
    "Value ETHBTC for symbol is not valid",
    "You have reached maximum request limit.",
    "An API key is required to",
    "API has been moved",
    "Wrong value passed",
    "This file is no longer",
    "No Any Results",
    "Missing coordinates",
    "could not be found",
    "No data found",
    "abbreviation: CDT",
]
ERROR_KEYWORDS = [
    ("not valid", "Validation error"),
    ("invalid", "Invalid input"),
    ("must be a", "Validation error"),
    ("must be an", "Validation error"),
    ("could not parse", "Parsing error"),
    ("failed to parse", "Parsing error"),
    ("cannot parse", "Parsing error"),
    ("rate limit", "Rate limit exceeded"),
    ("maximum request limit", "Rate limit exceeded"),
    ("too many requests", "Rate limit exceeded"),
    ("authentication failed", "Authentication failed"),
    ("authentication required", "Authentication required"),
    ("unauthorized", "Unauthorized access"),
    ("access denied", "Access denied"),
    ("forbidden", "Access forbidden"),
    ("404 page not found", "404 error - page not found"),
    ("404 not found", "404 error - not found"),
    ("404 error", "404 error"),
    ("not found", "Resource not found"),
    ("does not exist", "Resource not found"),
    ("doesn't exist", "Resource not found"),
    ("can't find", "Resource not found"),
    ("cannot find", "Resource not found"),
    ("api doesn't exist", "API endpoint not found"),
    ("api does not exist", "API endpoint not found"),
    ("invalid api", "Invalid API endpoint"),
    ("endpoint does not exist", "API endpoint not found"),
    ("endpoint doesn't exist", "API endpoint not found"),
    ("endpoint is disabled", "Endpoint disabled"),
    ("blocked host:", "Blocked host error"),
    ("service unavailable", "Service unavailable"),
    ("internal server error", "Internal server error"),
    ("deployment not found", "Deployment not found"),
    ("deployment could not be found", "Deployment not found"),
    ("timed out", "API timeout"),
    ("disabled for your subscription", "Subscription required"),
    ("subscription required", "Subscription required"),
    ("upgrade your plan", "Plan upgrade required"),
    ("error", "API error"),
    ("failed", "API request failed"),
]
# Every explicit error and keyword contains one of these in lower case; a text without any
# of them needs no search for the longer lists.
STEMS = [
    "valid", "must be a", " parse", "limit", "requests", "required", "failed", "unauthorized", "denied",
    "forbidden", "not found", "error", "t exist", "t find", "disabled", "host:", "unavailable", "be found",
    "timed out", "upgrade", "missing ", "been moved", "wrong value", "no longer", "any results", "data found", "cdt",
]
METADATA_KEYS = [
    "status", "code", "statuscode", "status_code", "cod", "t-status", "success", "ok",
    "request_id", "requestid", "message", "msg", "at", "method", "hostname",
    "last_page", "total", "count", "offset", "limit", "page",
]
ERROR_FIELDS = ["error", "message", "messages", "detail", "notice"]
STATUS_FIELDS = ["status", "code", "statusCode", "status_code", "cod", "t-status"]
EMPTY = "Empty response from API"
NONE_TEXT = "Response is Python 'None' string"
BINARY = "Binary data is not supported in API response"
MARKUP = "HTML/XML error page returned instead of JSON"
PLAN = "Subscription or plan upgrade required"


def first_reason(*rules: tuple[Column, object]) -> Column:
    """The reason of the first rule whose condition holds, else null."""
    out = None
    for condition, reason in rules:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _sql_text(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _first_hit(column: str, pairs: list[tuple[str, str]]) -> str:
    """SQL for the reason of the first pair whose text is inside `column`."""
    cases = " ".join(f"WHEN contains({column}, {_sql_text(t)}) THEN {_sql_text(r)}" for t, r in pairs)
    return f"CASE {cases} END"


def error_keyword(column: str) -> Column:
    """Reason of the first keyword, in list order, inside a lower-cased text column."""
    return F.expr(_first_hit(column, ERROR_KEYWORDS))


def text_rules(error: Column, response: Column) -> Column:
    """Rules on the text alone; needs its stripped form `_bare`, the lower case of that, `_low`,
    and `_suspect`: does it hold any of the stems?"""
    bare, lowered = F.col("_bare"), F.col("_low")
    control = F.length(
        F.regexp_replace(F.substring(response, 1, 100), r"[^\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    )
    explicit = [(e, f"Explicit error message found: '{e}'") for e in EXPLICIT_ERRORS]
    return F.coalesce(
        first_reason(
            (error != "", error),
            (response.isNull() | bare.isin("", "{}", "[]"), EMPTY),
            (bare == "None", NONE_TEXT),
            (any_of([response.startswith(p) for p in BINARY_PREFIXES]), BINARY),
            ((F.length(response) > 50) & (control > 20), BINARY),
            (any_of([bare.startswith(p) for p in TAG_PREFIXES]), MARKUP),
            (any_of([lowered.startswith(p) for p in LOWER_TAG_PREFIXES]), MARKUP),
        ),
        F.when(F.col("_suspect"), F.expr(_first_hit("_bare", explicit))),
    )


def kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BOOLEAN, VOID or a number type of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def text_of(v: Column) -> Column:
    return F.variant_get(v, "$", "string")


def py_text(v: Column, k: Column) -> Column:
    """A value as it prints in a message."""
    return (
        F.when(k == "VOID", F.lit("None"))
        .when(k == "BOOLEAN", F.initcap(text_of(v)))
        .when(k.isin("OBJECT", "ARRAY"), F.to_json(v))
        .otherwise(text_of(v))
    )


def whole_number(v: Column, k: Column) -> Column:
    """The value as an integer: numbers truncated, Booleans 0 or 1, texts only if integral."""
    text = text_of(v)
    digits = F.regexp_replace(strip(text), "_", "")
    return (
        F.when(k == "STRING", F.when(digits.rlike(r"^[+-]?[0-9]+$"), digits.try_cast("decimal(38,0)")))
        .when(k == "BOOLEAN", F.when(text == "true", 1).otherwise(0))
        .when(k.isin("VOID", "OBJECT", "ARRAY"), F.lit(None))
        .when(k.isin("DOUBLE", "FLOAT"), F.variant_get(v, "$", "double").try_cast("decimal(38,0)"))
        .otherwise(F.regexp_replace(text, r"\..*$", "").try_cast("decimal(38,0)"))
    )


def hollow(json_text: Column) -> Column:
    """Nothing but nulls, empty texts and empty containers at any depth.

    Escapes go first, so quotes only delimit; each text then shrinks to its first character
    between two marks, keys and empties are dropped, and any rest is content.
    """
    no_escapes = F.regexp_replace(json_text, r"\\.", "x")
    marked = F.regexp_replace(no_escapes, '"([^"]?)[^"]*"', "\u0001$1\u0002")
    rest = F.regexp_replace(marked, "\u0001[^\u0002]*\u0002\\s*:|\u0001\u0002|null|[\\[\\]{},\\s]", "")
    return rest == ""


def empty_value(v: Column, k: Column) -> Column:
    """Null, empty text, empty list or empty object; not 0, not false."""
    return (k == "VOID") | ((k == "STRING") & (text_of(v) == "")) | F.to_json(v).isin("[]", "{}")


def _field(name: str) -> Column:
    """Value of a key in any case; of several spellings the last one in the text."""
    spelled = F.filter(F.col("_keys"), lambda k: F.lower(k) == name)
    return F.when(F.size(spelled) > 0, F.element_at(F.col("_map"), F.element_at(spelled, -1)))


def _field_texts() -> Column:
    """Lower-cased texts of the error fields, null where the field is no text or too long."""
    def text(name):
        limit = {"error": None, "detail": None, "notice": 200}.get(name, 100)
        is_text = F.col(f"_k_{name}") == "STRING"
        value = text_of(F.col(f"_f_{name}"))
        fits = is_text if limit is None else is_text & (F.length(value) <= limit)
        return F.when(fits, F.lower(value))

    return F.array(*[text(name) for name in ERROR_FIELDS])


def _error_field_rules() -> Column:
    hit = F.expr(f"transform(_field_texts, t -> {_first_hit('t', ERROR_KEYWORDS)})")
    error, message, messages, detail, notice = [hit[i] for i in range(len(ERROR_FIELDS))]
    detail_text = text_of(F.col("_f_detail"))
    first_msg = F.try_variant_get(F.col("_f_detail"), "$[0].msg", "variant")
    notice_low = F.when(F.col("_k_notice") == "STRING", F.lower(text_of(F.col("_f_notice"))))
    upgrade = (notice_low.contains("available") & notice_low.contains("plan")) | (
        notice_low.contains("upgrade") & (notice_low.contains("plan") | notice_low.contains("subscription"))
    )
    failed = F.concat(
        F.lit("API failed: "),
        F.coalesce(py_text(F.col("_f_message"), F.col("_k_message")), F.lit("Unknown error")),
    )
    success, status = F.col("_f_success"), F.col("_f_status")
    return F.coalesce(
        error,
        message,
        messages,
        F.when(detail.isNotNull(), F.concat(F.lit("API error: "), detail_text)),
        F.when(
            (F.col("_k_detail") == "ARRAY") & first_msg.isNotNull(),
            F.concat(F.lit("Validation error: "), py_text(first_msg, kind(first_msg))),
        ),
        F.when((F.length(notice_low) < 200) & upgrade, F.lit(PLAN)),
        notice,
        F.when((F.col("_k_success") == "BOOLEAN") & (text_of(success) == "false"), failed),
        F.when((F.col("_k_status") == "STRING") & (text_of(status) == "error"), failed),
    )


def _exact(name: str) -> Column:
    return F.try_element_at(F.col("_map"), F.lit(name))


def _status_rules() -> Column:
    rules = []
    for name in ("success", "ok"):
        v = _exact(name)
        says_no = F.lower(text_of(v)) == "false"
        rules.append(F.when(kind(v).isin("BOOLEAN", "STRING") & says_no, F.lit(f"JSON '{name}' field is false")))
    data = _exact("data")
    no_result = (kind(data) == "STRING") & text_of(data).contains("No result")
    for name in STATUS_FIELDS:
        v = _exact(name)
        k = kind(v)
        number = whole_number(v, k)
        rules.append(
            F.when(
                (k == "STRING") & F.lower(text_of(v)).isin("error", "failed", "failure"),
                F.concat(F.lit(f"JSON '{name}' indicates error: "), text_of(v)),
            )
        )
        rules.append(
            F.when(number >= 400, F.concat(F.lit(f"JSON '{name}' is error code: "), number.cast("string")))
        )
        rules.append(F.when((number == 0) & no_result, F.lit(f"JSON '{name}' is 0 with no result")))
    nested = F.try_variant_get(_exact("meta"), "$.status", "variant")
    k = kind(nested)
    rules.append(
        F.when(
            whole_number(nested, k) >= 400,
            F.concat(F.lit("JSON 'meta.status' is error code: "), py_text(nested, k)),
        )
    )
    return F.coalesce(*rules)


def _empty_structure_rules() -> Column:
    values = F.map_values("_map")
    texts = F.transform(values, lambda v: F.to_json(v))
    lists = F.filter(texts, lambda t: t.startswith("["))
    blank = F.forall(
        texts,
        lambda t: t.isin("[]", "{}", "null", '""', "false") | t.rlike(r"^-?0+(\.0+)?([eE][+-]?[0-9]+)?$"),
    )
    # all values are looked at only in objects of one or two keys
    only_empty = (F.size("_keys") <= 2) & (F.size(lists) > 0) & blank
    succeeded = ((kind(_exact("status")) == "STRING") & (text_of(_exact("status")) == "success")) | (
        (kind(_exact("success")) == "BOOLEAN") & (text_of(_exact("success")) == "true")
    )
    has_data = F.array_contains("_keys", "data")
    data = F.when(has_data, F.try_variant_get(_exact("data"), "$", "map<string,variant>")).otherwise(F.col("_map"))
    results = F.try_element_at(data, F.lit("results"))
    no_results = (F.to_json(results) == "[]") & (F.size(data) <= 3)
    return first_reason(
        (only_empty, "API returned object with only empty arrays"),
        (succeeded & no_results, "Empty results returned"),
    )


def _parsed_rules() -> Column:
    content = F.filter(F.col("_keys"), lambda k: ~F.lower(k).isin(METADATA_KEYS))
    one = F.element_at(content, 1)
    only = F.element_at(F.col("_map"), F.element_at(F.col("_keys"), 1))
    of_object = F.coalesce(
        first_reason(
            (F.size("_keys") == 0, "API returned empty object instead of structured response"),
            (
                (F.size("_keys") == 1) & empty_value(only, kind(only)),
                "API returned single-key object with empty value",
            ),
            (F.size(content) == 0, "API returned only metadata/status fields with no content"),
            (
                (F.size(content) == 1) & hollow(F.to_json(F.element_at(F.col("_map"), one))),
                F.concat(F.lit("API returned metadata and single empty key '"), one, F.lit("'")),
            ),
        ),
        _error_field_rules(),
        _status_rules(),
        _empty_structure_rules(),
    )
    return F.when(F.col("_map").isNotNull(), of_object).when(
        F.col("_empty_array"), F.lit("API returned empty array instead of structured response")
    )


def validate_responses(df: DataFrame, response: str = "response", error: str = "error") -> DataFrame:
    """Add `is_valid` and `reason` (empty when valid).

    The keyword list is the last rule for every text and, for texts that are no object or
    array, the only one after the text rules; so each text is searched for it once.
    """
    columns = df.columns
    r = F.col(response)
    a = df.withColumn("_bare", strip(r)).withColumn("_low", F.lower("_bare"))
    a = a.withColumn("_suspect", F.expr(" OR ".join(f"contains(_low, {_sql_text(t)})" for t in STEMS)))
    a = a.withColumn("_text_reason", text_rules(F.coalesce(F.col(error), F.lit("")), r))
    undecided = F.col("_text_reason").isNull()
    structured = F.col("_bare").startswith("{") | F.col("_bare").startswith("[")
    a = a.select(
        *columns, "_text_reason",
        F.when(undecided & F.col("_suspect"), error_keyword("_low")).alias("_keyword"),
        F.when(undecided & structured, r).alias("_json"),
    ).withColumn("_v", F.try_parse_json("_json"))
    # null for every row that parsed, so Python sees the rest only
    b = a.withColumn("_lenient", to_json_text(F.when(F.col("_v").isNull(), F.col("_json"))))
    b = b.withColumns(
        {"_v": F.coalesce("_v", F.try_parse_json("_lenient")), "_json": F.coalesce("_lenient", "_json")}
    )
    b = b.withColumns(
        {
            "_map": F.try_variant_get("_v", "$", "map<string,variant>"),
            "_empty_array": F.coalesce(F.size(F.try_variant_get("_v", "$", "array<variant>")) == 0, F.lit(False)),
        }
    )
    b = b.withColumn("_keys", F.when(F.col("_map").isNotNull(), F.array_distinct(F.json_object_keys("_json"))))
    named = [*ERROR_FIELDS, "success", "status"]
    b = b.withColumns({f"_f_{n}": _field(n) for n in named})
    b = b.withColumns({f"_k_{n}": kind(F.col(f"_f_{n}")) for n in named})
    b = b.withColumn("_field_texts", _field_texts())
    reason = F.coalesce(F.col("_text_reason"), _parsed_rules(), F.col("_keyword"), F.lit(""))
    return b.withColumn("reason", reason).select(*columns, (F.col("reason") == "").alias("is_valid"), "reason")
