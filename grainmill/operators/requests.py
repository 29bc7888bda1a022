"""Chat requests as they arrive: one JSON body each, read as VARIANT, with its first error or its filled-in values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .conversation import message_error

MOST_BYTES, MOST_TOKENS = 8 * 1024 * 1024, 16384

_DIGITS = r"[0-9]+(_[0-9]+)*"
_INTEGER = rf"^[+-]?{_DIGITS}$"
_REAL = rf"(?i)^[+-]?({_DIGITS}(\.({_DIGITS})?)?|\.{_DIGITS})(e[+-]?{_DIGITS})?$"
_ENDLESS = r"(?i)^[+-]?(nan|inf|infinity)$"
_FILLED = ("model", "messages", "temperature", "top_p", "max_tokens", "stream")


def _get(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column) -> Column:
    """The type of a value without its parameters: OBJECT, ARRAY, STRING, BOOLEAN, VOID, BIGINT, DECIMAL, DOUBLE; null if there is none."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def number(v: Column, whole: bool = False) -> Column:
    """A value as a double, null if it is none: numbers, true and false, and texts of a number between white space. ``whole`` takes
    texts of integers only and cuts fractions off; otherwise texts of infinity and NaN are numbers, too."""
    kind, text = _kind(v), strip(_get(v, "$", "string"))
    as_number = F.when(text.rlike(_INTEGER if whole else _REAL), F.regexp_replace(text, "_", "").try_cast("double"))
    if not whole:
        as_number = F.when(text.rlike(_ENDLESS), F.lit(float("nan"))).otherwise(as_number)
    plain = _get(v, "$", "double")
    if whole:
        plain = F.when(plain < 0, F.ceil(F.greatest(plain, F.lit(-1e15)))).otherwise(F.floor(F.least(plain, F.lit(1e15)))).cast("double")
    return F.when(kind == "STRING", as_number).when(kind == "BOOLEAN", F.when(_get(v, "$", "boolean"), 1.0).otherwise(0.0)).when(~kind.isin("OBJECT", "ARRAY", "VOID"), plain)


def holds(v: Column) -> Column:
    """Whether a value counts as true: false, null, zero and what is empty don't, nor does one that isn't there."""
    kind = _kind(v)
    empty = F.to_json(v).isin('""', "[]", "{}")
    return F.coalesce(F.when(kind == "VOID", False).when(kind == "BOOLEAN", _get(v, "$", "boolean")).when(kind.isin("STRING", "ARRAY", "OBJECT"), ~empty).otherwise(_get(v, "$", "double") != 0), F.lit(False))


def parse_requests(requests: DataFrame, default_model: str, body: str = "body", temperature: float = 0.3, top_p: float = 0.9, max_tokens: int = 4096) -> DataFrame:
    """Adds ``error``, the first thing that is wrong with a request's JSON body, or null, and what a right one asks for, with
    defaults where it is silent: model, messages (array of role and content; developers count as users), temperature, top_p,
    max_tokens (cut to 16384) and stream. Of a wrong request all of them are null; columns of these names are replaced.

    Checked in this order: body there, its size, its JSON, an object, messages a list that isn't empty, each message in turn (an
    object, its role, its content), the three numbers' types, then the range of each. A null ``max_tokens`` gives way to
    ``max_completion_tokens``, a null temperature is an error. Numbers may come as texts. Bodies with a key twice in one object, and
    numbers written as NaN or Infinity outside of texts, are no valid JSON here. A model that is no text is named by its JSON.

    All is expressions on one row: nothing is shuffled, however the requests are spread.
    """
    raw = F.col(body)
    size = F.octet_length(raw)
    parsed = requests.withColumn("_v", F.when((size > 0) & (size <= MOST_BYTES), F.try_parse_json(raw)))
    v = F.col("_v")
    parsed = parsed.withColumn("_list", F.when(_kind(_get(v, "$.messages")) == "ARRAY", _get(v, "$.messages", "array<variant>")))
    text = lambda x, path: F.when(_kind(_get(x, path)) == "STRING", _get(x, path, "string"))

    def wrong(item: Column, index: Column) -> Column:
        no_object = F.concat(F.lit("messages["), index.cast("string"), F.lit("] must be an object"))
        return F.when(F.coalesce(_kind(item), F.lit("")) != "OBJECT", no_object).otherwise(message_error(index, text(item, "$.role"), text(item, "$.content")))

    given = lambda name, default: F.when(_get(v, name).isNull(), F.lit(float(default))).otherwise(number(_get(v, name)))
    there = lambda name: F.coalesce(_kind(_get(v, name)), F.lit("VOID")) != "VOID"
    tokens = F.when(there("$.max_tokens"), number(_get(v, "$.max_tokens"), True)).when(there("$.max_completion_tokens"), number(_get(v, "$.max_completion_tokens"), True)).otherwise(F.lit(float(max_tokens)))
    parsed = parsed.withColumns({"_bad": F.get(F.filter(F.transform("_list", wrong), lambda e: e.isNotNull()), F.lit(0)), "_t": given("$.temperature", temperature), "_p": given("$.top_p", top_p), "_m": tokens})
    t, p, m = F.col("_t"), F.col("_p"), F.col("_m")
    error = (F.when(F.coalesce(size, F.lit(0)) == 0, "empty request body").when(size > MOST_BYTES, "request body too large").when(v.isNull(), "request body must be valid JSON")
             .when(_kind(v) != "OBJECT", "request body must be a JSON object").when(F.coalesce(F.size("_list"), F.lit(0)) < 1, "messages must be a non-empty list").when(F.col("_bad").isNotNull(), F.col("_bad"))
             .when(t.isNull() | p.isNull() | m.isNull(), "temperature, top_p and max_tokens must be numbers")
             .when(~t.between(0, 2), "temperature must be between 0 and 2").when(~((p > 0) & (p <= 1)), "top_p must be between 0 and 1").when(m < 1, "max_tokens must be at least 1"))
    name = _get(v, "$.model")
    model = F.when(~holds(name), F.lit(default_model)).when(_kind(name) == "STRING", _get(name, "$", "string")).when(_kind(name) == "BOOLEAN", "True").otherwise(F.to_json(name))
    role = lambda x: F.when(text(x, "$.role") == "developer", "user").otherwise(text(x, "$.role"))
    messages = F.transform("_list", lambda x: F.struct(role(x).alias("role"), text(x, "$.content").alias("content")))
    found = parsed.withColumn("_error", error)
    right = lambda x: F.when(F.col("_error").isNull(), x)
    values = (model, messages, t, p, F.least(m, F.lit(float(MOST_TOKENS))).cast("int"), holds(_get(v, "$.stream")))
    found = found.withColumn("_filled", right(F.struct(*[x.alias(c) for c, x in zip(_FILLED, values)])))
    own = [c for c in requests.columns if c not in ("error", *_FILLED)]
    return found.select(*own, F.col("_error").alias("error"), *[F.col(f"_filled.{c}").alias(c) for c in _FILLED])


def with_system_prompt(messages: Column, prompt: str) -> Column:
    """Messages with a system prompt before them, unless one of them is a system message."""
    head = F.struct(F.lit("system").alias("role"), F.lit(prompt).alias("content"))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages).otherwise(F.concat(F.array(head), messages))
