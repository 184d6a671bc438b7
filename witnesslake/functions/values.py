"""Typed attribute values: a tagged struct of a kind, a number, and `same`, a text that is equal for equal values and no others.

Kinds are null, bool, int, num, text, list and object. Booleans equal the numbers
1 and 0 and whole numbers their decimals, as in the rule documents' own language;
an order exists between numbers alone, never for booleans. Whole numbers of up to
38 digits are compared exactly, also with doubles; all others as doubles. Lists
are equal item by item, also those in lists; below that and in objects they are
compared as JSON texts. `key` and `items` are for reading, not for comparing.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMERIC = ("bool", "int", "num")
NESTED = 1
#: 2^0 to 2^64, exactly.
_POWERS = json.dumps([1 << k for k in range(65)])


def _whole(n: Column) -> Column:
    """A double as an exact whole number of up to 38 digits; null if it is none."""
    # from 2^63 on a double ends in zero bits, which go before it becomes a long
    k = F.greatest(F.lit(0), F.ceil(F.log2(F.abs(n))).cast("int") - 62)
    large = lambda k: ((n / F.pow(F.lit(2.0), k)).cast("long").cast("decimal(19,0)") * F.get(F.from_json(F.lit(_POWERS), "array<decimal(20,0)>"), k)).cast("decimal(38,0)")
    # from 2^53 on all are whole
    return F.when(F.abs(n) < float(1 << 53), F.when(n == F.floor(n), n.cast("long").cast("decimal(38,0)"))).when(F.abs(n) < 1e38, let(k, large))


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, which is made once however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _key(kind: Column, n: Column, s: Column) -> Column:
    return F.when(kind.isin(*NUMERIC), F.concat(F.lit("n:"), n.cast("string"))).when(kind == "null", "null").otherwise(F.concat(F.substring(kind, 1, 1), F.lit(":"), s))


def _kind(v: Column) -> Column:
    return let(
        F.schema_of_variant(v),
        lambda t: F.when(t == "VOID", "null").when(t == "BOOLEAN", "bool").when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT") | t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "int").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "num").when(t == "STRING", "text").when(t.startswith("ARRAY"), "list").otherwise("object"),
    )


def _scalar(v: Column) -> Column:
    """struct(v, kind, n, s, whole): a variant as what it is."""
    def read(p: Column) -> Column:
        n = F.when(p["kind"] == "bool", F.try_variant_get(p["v"], "$", "boolean").cast("double")).when(p["kind"].isin("int", "num"), F.try_variant_get(p["v"], "$", "double"))
        return F.struct(p["v"].alias("v"), p["kind"].alias("kind"), n.alias("n"), F.try_variant_get(p["v"], "$", "string").alias("s"))

    def counted(p: Column) -> Column:
        whole = F.coalesce(F.when(p["kind"] == "int", F.try_variant_get(p["v"], "$", "decimal(38,0)")), _whole(p["n"]))
        return F.struct(*(p[c].alias(c) for c in ("v", "kind", "n", "s")), whole.alias("whole"))

    return let(let(F.struct(v.alias("v"), _kind(v).alias("kind")), read), counted)


def _listed(p: Column) -> Column:
    return F.when(p["kind"] == "list", F.try_variant_get(p["v"], "$", "array<variant>"))


def _same(p: Column, depth: int = NESTED) -> Column:
    """The text that equal values share, of a struct that _scalar made."""
    said = F.when(p["kind"].isin(*NUMERIC), F.concat(F.lit("n:"), F.coalesce(p["whole"].cast("string"), p["n"].cast("string")))).when(p["kind"] == "null", "null")
    if depth:
        parts = F.transform(_listed(p), lambda x: F.coalesce(let(_scalar(x), lambda q: _same(q, depth - 1)), F.lit("null")))
        # each item after its length, so no item can look like two
        said = said.when(p["kind"] == "list", F.concat(F.lit("l:"), F.array_join(F.transform(parts, lambda x: F.concat(F.length(x).cast("string"), F.lit(":"), x)), ",")))
    return said.otherwise(F.concat(F.substring(p["kind"], 1, 1), F.lit(":"), p["s"]))


def strict(text: Column) -> Column:
    """A JSON text as a variant; null for what is no JSON, and for JSON that anything but white space follows.

    A name that is used twice in one object makes it no JSON unless the session
    allows that (spark.sql.variant.allowDuplicateKeys).
    """

    def parsed(p: Column) -> Column:
        # the parser stops behind the first value: so a name must follow that the text can't hold
        wrapped = F.concat(F.lit('{"v":'), p["text"], F.lit(',"'), p["end"], F.lit('":0}'))
        good = lambda parts: F.when((F.size(parts) == 2) & F.map_contains_key(parts, p["end"]), F.coalesce(F.element_at(parts, F.lit("v")), F.parse_json(F.lit("null"))))
        return let(F.try_variant_get(F.try_parse_json(wrapped), "$", "map<string,variant>"), good)

    return let(F.struct(text.alias("text"), F.sha2(text, 256).alias("end")), parsed)


def of_variant(v: Column) -> Column:
    """The typed value of a variant; a null variant is of kind null."""

    def typed(p: Column) -> Column:
        items = F.transform(_listed(p), lambda x: F.coalesce(let(_scalar(x), lambda q: _key(q["kind"], q["n"], q["s"])), F.lit("null")))
        within = F.transform(_listed(p), lambda x: F.coalesce(let(_scalar(x), lambda q: _same(q)), F.lit("null")))
        key = F.when(p["kind"] == "list", F.concat(F.lit("l:"), F.array_join(items, ","))).otherwise(_key(p["kind"], p["n"], p["s"]))
        return F.when(p["v"].isNull(), _none()).otherwise(F.struct(p["kind"].alias("kind"), p["n"].alias("n"), key.alias("key"), items.alias("items"), p["whole"].alias("whole"), _same(p).alias("same"), within.alias("within")))

    return let(_scalar(v), typed)


def _none() -> Column:
    null = F.lit(None)
    return F.struct(F.lit("null").alias("kind"), null.cast("double").alias("n"), F.lit("null").alias("key"), null.cast("array<string>").alias("items"), null.cast("decimal(38,0)").alias("whole"), F.lit("null").alias("same"), null.cast("array<string>").alias("within"))


def of_json(text: Column) -> Column:
    """The typed value of a JSON text; what is no JSON is of kind null."""
    return of_variant(strict(text))


def of_text(s: Column) -> Column:
    """A string column as values of kind text, null ones of kind null."""
    null, key = F.lit(None), F.concat(F.lit("t:"), s)
    text = F.struct(F.lit("text").alias("kind"), null.cast("double").alias("n"), key.alias("key"), null.cast("array<string>").alias("items"), null.cast("decimal(38,0)").alias("whole"), key.alias("same"), null.cast("array<string>").alias("within"))
    return F.when(s.isNull(), _none()).otherwise(text)


def of_python(value: object) -> Column:
    """A literal of None, a bool, a number, a string or a list or tuple of them, read as its JSON is."""
    return of_json(F.lit(json.dumps(value)))


def compare(operator: Column | str, held: Column, expected: Column) -> Column:
    """True, false or, where the two have no order, null; `present` is true of whatever is held."""

    def judged(p: Column) -> Column:
        op, a, b = p["op"], p["held"], p["expected"]
        same, inside = a["same"] == b["same"], F.coalesce(F.array_contains(b["within"], a["same"]), F.lit(False))
        return F.struct(op.alias("op"), same.alias("same"), inside.alias("inside"), F.when(a["kind"].isin("int", "num") & b["kind"].isin("int", "num"), F.coalesce(_sign(a["whole"], b["whole"]), _sign(a["n"], b["n"]))).alias("sign"))

    def said(p: Column) -> Column:
        op, sign = p["op"], p["sign"]
        return (
            F.when(op == "eq", p["same"]).when(op == "ne", ~p["same"]).when(op == "in", p["inside"]).when(op == "not_in", ~p["inside"]).when(op == "gt", sign > 0)
            .when(op == "gte", sign >= 0).when(op == "lt", sign < 0).when(op == "lte", sign <= 0).when(op == "present", F.lit(True))
        )

    operator = F.lit(operator) if isinstance(operator, str) else operator
    return let(let(F.struct(operator.alias("op"), held.alias("held"), expected.alias("expected")), judged), said)


def _sign(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null where one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), F.when(a < b, -1).when(a > b, 1).otherwise(0))


def bare(token: Column) -> Column:
    """An unquoted token as JSON text: true, false, null and numbers as such, all else a string."""
    said, trimmed = F.lower(token), F.trim(token)
    number = trimmed.rlike(r"^[+-]?\d+$") | trimmed.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    plain = F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.cast("decimal(38,0)").cast("string")).otherwise(trimmed.try_cast("double").cast("string"))
    return F.when(said.isin("true", "false"), said).when(said.isin("null", "none", ""), "null").when(number, plain).otherwise(F.to_json(F.struct(token.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(token.alias("v")))) - 6))
