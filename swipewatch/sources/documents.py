"""Policy and weight documents: many at once, as rows, with every broken rule by name.

A document is JSON text, or YAML of the plain kind that configuration files are written in (``yaml_to_json``). It is parsed into a VARIANT, so a
field that is missing or of another type is a broken rule and not a failed job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.policy import GRAPH_FIELDS, METHODS, PolicyConfig

# Rule names, as reports show them.
ONE_OBJECT = "the text is one object"
HAS_VERSION = "the policy has a version"
NUMBERS = "thresholds are numbers"
ORDERED = "0 <= review threshold < block threshold <= 1"
SHARE = "0 <= capacity <= 1"
METHOD = "the method is known"
NO_OVERRIDE = "graph flags block nothing by themselves"
SOME_WEIGHTS = "there are review priorities"
KNOWN_FIELDS = "review priorities are of known flags"
DECLARED = "each flag declares enabled and weight"
POSITIVE = "weights are above 0"

#: Policies that a driver takes in as objects.
MOST_POLICIES = 10_000


# --- YAML ------------------------------------------------------------------------------------------


def _scalar(text: str):
    if text[:1] in ("'", '"'):
        inner = text[1:-1].replace("''", "") if text[0] == "'" else text[1:-1]
        if len(text) < 2 or text[-1] != text[0] or text[0] in inner or (text[0] == '"' and "\\" in inner):
            raise ValueError(f"not plainly quoted: {text!r}")
        return text[1:-1].replace("''", "'") if text[0] == "'" else text[1:-1]
    fixed = {"": None, "null": None, "~": None, "true": True, "false": False, "{}": {}, "[]": []}
    if text.lower() in fixed:
        return fixed[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def plain_yaml(text: str):
    """Mappings and lists by indentation, scalars, comments and quotes; anything else raises ``ValueError``."""
    lines = []
    for raw in text.splitlines():
        bare = re.match(r"""(?:(?<!\S)'[^']*'|(?<!\S)"[^"]*"|(?<=\S)#|[^#])*""", raw)[0].rstrip()  # up to a comment
        if bare.strip() and bare.strip() != "---":
            if "\t" in bare[: len(bare) - len(bare.lstrip())]:
                raise ValueError("indented by a tab")
            lines.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def block(at: int, depth: int):
        is_list = lines[at][1].startswith("- ") or lines[at][1] == "-"
        out: list | dict = [] if is_list else {}
        while at < len(lines) and lines[at][0] == depth and (lines[at][1].startswith("- ") or lines[at][1] == "-") == is_list:
            body = lines[at][1]
            if is_list:
                item = body[1:].strip()
                if re.match(r"[^'\"\s][^:]*:(\s|$)", item):
                    raise ValueError("a mapping inside a list item")
                key, rest = None, item
            else:
                m = re.match(r"""('[^']*'|"[^"]*"|[^'"\s][^:]*?)\s*:(?:\s+(.*))?$""", body)
                if m is None:
                    raise ValueError(f"no key in {body!r}")
                key, rest = str(_scalar(m[1])) if m[1][0] in "'\"" else m[1], m[2] or ""
                if key in out:
                    raise ValueError(f"{key} is there twice")
            if rest[:1] in ("&", "*", "|", ">", "!") or (rest[:1] in ("{", "[") and rest not in ("{}", "[]")):
                raise ValueError(f"not plain: {rest!r}")
            if rest[:1] not in ("'", '"') and re.search(r":(\s|$)", rest):
                raise ValueError(f"a mapping inside a value: {rest!r}")
            at += 1
            value = _scalar(rest)
            if not rest and at < len(lines) and (lines[at][0] > depth or (not is_list and lines[at][0] == depth and lines[at][1].startswith("-"))):
                value, at = block(at, lines[at][0])
            if is_list:
                out.append(value)
            else:
                out[key] = value
        return out, at

    if not lines:
        return None
    value, end = block(0, lines[0][0])
    if end < len(lines):
        raise ValueError(f"out of line: {lines[end][1]!r}")
    return value


def yaml_to_json(docs: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """(document, text) with YAML as JSON; a text that is not plain YAML becomes null, so that it breaks the first rule."""
    kind = docs.schema[document].dataType.simpleString()

    def one(value: str | None) -> str | None:
        try:
            return None if value is None else json.dumps(plain_yaml(value))
        except ValueError:
            return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(v) for v in batch.column(1).to_pylist()], pa.string())], ["document", "text"])

    return docs.select(document, text).mapInArrow(work, f"document {kind}, text string")


# --- rules -----------------------------------------------------------------------------------------


def _parsed(docs: DataFrame, document: str, text: str) -> DataFrame:
    v = F.try_parse_json(F.col(text))
    return docs.select(F.col(document).alias("document"), F.when(F.schema_of_variant(v).startswith("OBJECT"), v).alias("v"))


def _get(path: str, kind: str, of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _number(path: str) -> Column:
    x = _get(path, "double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _broken(rules: dict[str, Column]) -> Column:
    """Names of the rules that are not met; unknown is not met. Without an object nothing else is asked."""
    rest = F.array_compact(F.array(*[F.when(~F.coalesce(met, F.lit(False)), F.lit(name)) for name, met in rules.items()]))
    return F.when(F.col("v").isNull(), F.array(F.lit(ONE_OBJECT))).otherwise(rest).alias("broken")


def policy_documents(docs: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """(document, policy_version, review_threshold, block_threshold, review_capacity, priority_method, broken) of each policy document."""
    low, high, share = _number("$.review_threshold"), _number("$.block_threshold"), _number("$.review_capacity")
    version, method = _get("$.policy_version", "string"), F.coalesce(_get("$.priority_method", "string"), F.lit("SCORE_ONLY"))
    numbers = low.isNotNull() & high.isNotNull()
    rules = {HAS_VERSION: F.length(version) > 0, NUMBERS: numbers, ORDERED: ~numbers | ((low >= 0) & (low < high) & (high <= 1)), SHARE: share.between(0, 1), METHOD: method.isin(*METHODS)}
    typed = {"policy_version": version, "review_threshold": low, "block_threshold": high, "review_capacity": share, "priority_method": method}
    return _parsed(docs, document, text).select("document", *[c.alias(n) for n, c in typed.items()], _broken(rules))


def weight_documents(docs: DataFrame, document: str = "document", text: str = "text") -> DataFrame:
    """(document, weights, broken): the enabled weights of each graph document, a map by flag."""
    parsed = _parsed(docs, document, text).withColumn("m", _get("$.review_priority", "map<string,variant>"))
    field = lambda spec, name, kind: F.try_variant_get(spec, f"$.{name}", kind)
    specs, each = F.map_values("m"), lambda test: F.forall(F.map_values("m"), lambda s: F.coalesce(test(s), F.lit(False)))
    some = F.coalesce(F.size(specs) > 0, F.lit(False))
    weight = lambda s: field(s, "weight", "double")
    declared = each(lambda s: field(s, "enabled", "boolean").isNotNull() & weight(s).isNotNull())
    rules = {
        NO_OVERRIDE: ~F.coalesce(_get("$.automatic_block_override.enabled", "boolean"), F.lit(False)), SOME_WEIGHTS: some,
        KNOWN_FIELDS: ~some | (F.size(F.array_except(F.map_keys("m"), F.array(*[F.lit(g) for g in GRAPH_FIELDS]))) == 0), DECLARED: ~some | declared,
        POSITIVE: ~some | each(lambda s: weight(s).isNull() | (weight(s) > 0) & (weight(s) < float("inf")))}
    enabled = F.transform_values(F.map_filter("m", lambda _, s: F.coalesce(field(s, "enabled", "boolean"), F.lit(False))), lambda _, s: weight(s))
    return parsed.select("document", enabled.alias("weights"), _broken(rules))


def broken_rules(checked: DataFrame) -> DataFrame:
    """(document, rule): a row for each broken rule."""
    return checked.select("document", F.explode("broken").alias("rule"))


def policy_configs(checked: DataFrame) -> dict:
    """document -> typed policy, of the documents without a broken rule. Policies are plans of one job each, so their number is limited."""
    fine = checked.where(F.size("broken") == 0).drop("broken")
    rows = fine.limit(MOST_POLICIES + 1).collect()
    if len(rows) > MOST_POLICIES:
        raise ValueError(f"more than {MOST_POLICIES} policies")
    return {r["document"]: PolicyConfig(r["policy_version"], r["review_threshold"], r["block_threshold"], r["review_capacity"], r["priority_method"]) for r in rows}
