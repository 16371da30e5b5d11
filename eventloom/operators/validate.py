"""Contract rules (VAL-01 to VAL-17). A rule is an expression that is null or a violation; all rules of a table run in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas

VIOLATION = "struct<path:string,rule:string,actual:string>"


def _hit(bad: Column, path: str, rule: str, actual: Column | None = None) -> Column:
    shown = F.lit(None).cast("string") if actual is None else actual.cast("string")
    return F.when(bad, F.struct(F.lit(path).alias("path"), F.lit(rule).alias("rule"), shown.alias("actual")))


def rule_required(*paths: str) -> list[Column]:
    """VAL-01. Missing required value, top level or nested."""
    return [_hit(F.col(p).isNull(), p, "required") for p in paths]


def rule_type(raw: Column, types: dict[str, str]) -> list[Column]:
    """VAL-02. JSON value of the wrong type. types: path to string, number, boolean, object or array."""
    fits = {"string": "STRING", "number": "BIGINT|DECIMAL.*|DOUBLE", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}
    out = []
    for path, kind in types.items():
        value = F.try_variant_get(F.try_parse_json(raw), f"$.{path}", "variant")
        name = F.schema_of_variant(value)
        out.append(_hit(value.isNotNull() & (name != "VOID") & ~name.rlike(f"^({fits[kind]})$"), path, "type", name))
    return out


def rule_min_length(rules: dict[str, int]) -> list[Column]:
    """VAL-03. String shorter than its least length."""
    return [_hit(F.length(p) < n, p, "minLength", F.col(p)) for p, n in rules.items()]


def rule_enum(rules: dict[str, list[str]]) -> list[Column]:
    """VAL-04. Value outside an enum; null is not judged."""
    return [_hit(~F.col(p).isin(*v), p, "enum", F.col(p)) for p, v in rules.items()]


def rule_range(rules: dict[str, tuple[float | None, float | None]]) -> list[Column]:
    """VAL-05. Number outside its bounds; a bound of None is open."""
    out = []
    for p, (lo, hi) in rules.items():
        bad = F.lit(False) if lo is None else F.col(p) < lo
        out.append(_hit(bad if hi is None else bad | (F.col(p) > hi), p, "range", F.col(p)))
    return out


def rule_min_items(rules: dict[str, int], maps: bool = False) -> list[Column]:
    """VAL-06. Array with fewer items (maps: map with fewer properties) than allowed."""
    return [_hit(F.col(p).isNotNull() & (F.size(F.map_keys(p) if maps else F.col(p)) < n), p, "minProperties" if maps else "minItems", F.size(p)) for p, n in rules.items()]


def rule_closed(raw: Column, known: list[str], path: str | None = None, mode: str = "producer") -> list[Column]:
    """VAL-07. Unknown key in a closed object; consumers ignore unknown keys, producers may not send them."""
    if mode == "consumer":
        return []
    obj = raw if path is None else F.get_json_object(raw, f"$.{path}")
    extra = F.array_except(F.json_object_keys(obj), F.array(*[F.lit(k) for k in known]))
    return [_hit(F.size(extra) > 0, path or "$", "additionalProperties", F.array_join(F.sort_array(extra), ","))]


def rule_datetime(raw: Column, paths: list[str]) -> list[Column]:
    """VAL-08. Text that is no date-time."""
    value = lambda p: F.get_json_object(raw, f"$.{p}")
    good = lambda p: value(p).rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$") & F.try_to_timestamp(value(p)).isNotNull()
    return [_hit(value(p).isNotNull() & ~good(p), p, "date-time", value(p)) for p in paths]


def rule_pattern(rules: dict[str, str]) -> list[Column]:
    """VAL-09. Value that does not match its pattern."""
    return [_hit(~F.col(p).rlike(r), p, "pattern", F.col(p)) for p, r in rules.items()]


def rule_const(rules: dict[str, str]) -> list[Column]:
    """VAL-10. Value other than the constant; null too."""
    return [_hit(~F.col(p).eqNullSafe(F.lit(v)), p, "const", F.col(p)) for p, v in rules.items()]


def rule_typed_map(raw: Column, paths: list[str]) -> list[Column]:
    """VAL-11. Map with values that are no strings."""
    out = []
    for p in paths:
        m = F.try_variant_get(F.try_parse_json(raw), f"$.{p}", "map<string,variant>")
        bad = F.map_filter(m, lambda k, v: F.schema_of_variant(v) != "STRING")
        out.append(_hit(F.size(F.map_keys(bad)) > 0, p, "valueType", F.array_join(F.array_sort(F.map_keys(bad)), ",")))
    return out


def rule_elements(path: str, name: str, bad) -> list[Column]:
    """VAL-12. A rule inside the elements of an array: bad takes an element and says whether it fails."""
    return [_hit(F.exists(path, bad), f"{path}[]", name, F.size(F.filter(path, bad)))]


def violations(df: DataFrame, topic: str, id_col: str, rules: list[Column]) -> DataFrame:
    """(topic, record_id, path, rule, actual): every rule in one projection, then one explode."""
    found = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return df.select(F.lit(topic).alias("topic"), F.col(id_col).cast("string").alias("record_id"), F.explode(found).alias("v")).select("topic", "record_id", "v.*")


def topic_rules(topic: str) -> list[Column]:
    """The rules that a typed record of a topic must hold."""
    out = rule_required(*schemas.REQUIRED[topic]) + rule_min_length({schemas.KEYS[topic][0]: 1})
    names = schemas.columns(topic)
    if "severity" in names:
        out += rule_enum({"severity": schemas.SEVERITIES})
    if "entities" in names:
        out += rule_elements("entities", "required", lambda e: e["kind"].isNull() | e["id"].isNull())
    out += rule_min_items(dict.fromkeys(schemas.MIN_ITEMS.get(topic, []), 1)) + rule_range(dict.fromkeys(schemas.UNIT_RANGES.get(topic, []), (0.0, 1.0)))
    if topic == "similar.incidents.v1":
        out += rule_elements("neighbors", "range", lambda n: ~n["score"].between(0, 1))
    return out


def validate(df: DataFrame, topic: str, rules: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """VAL-13. (valid rows, quarantined rows with their violations). One projection; no join, so a record without an id is judged like others."""
    marked = df.withColumn("violations", F.filter(F.array(*(rules or topic_rules(topic))), lambda x: x.isNotNull()))
    return marked.where("size(violations) = 0").drop("violations"), marked.where("size(violations) > 0")


def violation_summary(found: DataFrame) -> DataFrame:
    """VAL-14. Violations by topic, rule and path."""
    return found.groupBy("topic", "rule", "path").agg(F.count("*").alias("n"))


def catalog_coverage(catalog: DataFrame, registry: DataFrame) -> DataFrame:
    """VAL-15. (name, problem) of catalog(name, schema) against registry(schema, body): no schema field, schema not there, or not JSON."""
    met = catalog.join(registry.select("schema", "body", F.lit(True).alias("there")), "schema", "left")
    problem = F.when(F.col("schema").isNull() | (F.trim("schema") == ""), "no schema").when(F.col("there").isNull(), "schema missing").when(F.try_parse_json("body").isNull(), "not JSON")
    return met.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def compat_drift(df: DataFrame, required: list[str], known: list[str]) -> DataFrame:
    """VAL-16. Of (producer, day, raw): share of records that lack a required key or bear unknown ones, and the change from the producer's day before."""
    keys = F.coalesce(F.json_object_keys("raw"), F.array().cast("array<string>"))
    bad = (F.size(F.array_except(F.array(*[F.lit(k) for k in required]), keys)) > 0) | (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0)
    by = df.groupBy("producer", "day").agg(F.avg(bad.cast("double")).alias("share"), F.count("*").alias("n"))
    return by.withColumn("change", F.col("share") - F.lag("share").over(Window.partitionBy("producer").orderBy("day")))


DEFAULTS = {"mode": "merge", "min_plan": "free", "trust": "mixed", "search_mode": "blended", "page": 1, "role": "component"}


def apply_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """VAL-17. Declared defaults in place of nulls, for the columns that df has."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType)) for c, v in (defaults or DEFAULTS).items() if c in df.columns})
