"""Rule 002 on packet documents: the whole schema, at every depth.

`schema()` states the packet schema as plain data (a JSON Schema subset: type, const,
enum, pattern, format, lengths, limits, items, required, properties, closed objects and
one condition). `document_findings` turns it into columns over VARIANT values: the
objects at the top in one projection, and the elements of all lists, written once by
list, in one projection per list, so that no generated method grows with the schema.
Every failing keyword is a finding of its own, at the pointer of the value.

Cases: a document that is no JSON object has one finding of the engine; a field that is
missing is only reported where it is required; JSON null is a value of type null; a list
may have any number of elements, and none meet in one row again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.text import let
from sessionloom.session import allow_repeated_keys, materialize
from sessionloom.sources import packets
from sessionloom.sources.packets import json_type

Schema = dict


def _string(low: int | None = None, high: int | None = None, null: bool = False, **more) -> Schema:
    limits = {k: v for k, v in (("minLength", low), ("maxLength", high)) if v is not None}
    return {"type": ["string", "null"] if null else ["string"], **limits, **more}


def _object(required: list[str], properties: dict[str, Schema], optional: dict[str, Schema] | None = None, **more) -> Schema:
    return {"type": ["object"], "required": required, "properties": {**properties, **(optional or {})}, **more}


def _list(items: Schema, **more) -> Schema:
    return {"type": ["array"], "items": items, **more}


def _all_of(properties: dict[str, Schema], optional: dict[str, Schema] | None = None, **more) -> Schema:
    return _object(list(properties), properties, optional, **more)


def schema() -> Schema:
    """The packet schema. Field names, limits and patterns are fixed values."""
    ident = _string(pattern=_shown(K.ID_PATTERN))
    stamp, flag = _string(format="date-time"), {"type": ["boolean"]}
    commit = _string(null=True, pattern=_shown(K.COMMIT_PATTERN))
    refs, share = _list(ident), {"type": ["number"], "minimum": 0, "maximum": 1}
    place = {"type": ["integer", "null"], "minimum": 0}
    return _all_of({
        "schema_version": _string(const=K.SCHEMA_VERSION), "id": ident, "title": _string(3, 200),
        "status": _string(enum=K.STATUSES), "validation_level": _string(enum=K.LEVELS), "task_type": _string(enum=K.TASK_TYPES),
        "objective": _string(1, 4000), "current_state": _string(1, 8000), "next_action": _string(1, 4000),
        "open_questions": _list(_all_of({
            "id": ident, "text": _string(1, 2000), "blocking": flag, "status": _string(enum=K.QUESTION_STATUSES)})),
        "confidence_score": share,
        "repo_context": _all_of({
            "attached": flag, "root": _string(1, null=True), "vcs": _string(enum=["git", "none"]), "branch": _string(1, 255, True),
            "base_branch": _string(1, 255, True), "commit": commit, "base_commit": commit, "dirty": flag,
        }, condition=({"attached": {"const": True}}, {"root": _string(1), "vcs": {"const": "git"}})),
        "context_items": _list(_all_of({
            "kind": _string(enum=K.CONTEXT_KINDS), "ref": _string(1, 4096), "reason": _string(1, 2000),
            "priority": {"type": ["integer"], "minimum": 1, "maximum": 5}, "freshness_score": share, "provenance_refs": refs,
        }, {"exists": {"type": ["boolean", "null"]}})),
        "constraints": _list(_all_of({
            "id": ident, "type": _string(enum=K.CONSTRAINT_TYPES), "text": _string(1, 4000), "severity": _string(enum=K.SEVERITIES),
            "source": _string(enum=K.CONSTRAINT_SOURCES), "provenance_refs": _list(ident, minItems=1)})),
        "attempts": _list(_all_of({
            "id": ident, "tool": _string(1, 128), "summary": _string(1, 4000), "result": _string(enum=K.ATTEMPT_RESULTS),
            "failure_reason": _string(None, 4000, True), "artifact_refs": refs, "created_at": stamp})),
        "acceptance_criteria": _list(_all_of({
            "id": ident, "text": _string(1, 4000), "status": _string(enum=K.CRITERION_STATUSES), "required": flag,
            "source": _string(enum=K.CRITERION_SOURCES), "provenance_refs": refs})),
        "warnings": _list(_all_of({
            "code": _string(pattern=_shown(K.WARNING_CODE_PATTERN)), "severity": _string(enum=K.SEVERITIES), "message": _string(1, 4000),
            "blocking": flag, "source": _string(enum=K.WARNING_SOURCES)})),
        "provenance_links": _list(_all_of({
            "id": ident, "field_name": _string(1, 255), "artifact_id": ident, "source_type": _string(enum=K.ARTIFACT_KINDS),
            "ref": _string(1, 4096),
        }, {"span_start": place, "span_end": place, "excerpt": _string(None, 1000, True)})),
        "source_artifacts": _list(_all_of({
            "id": ident, "type": _string(enum=K.ARTIFACT_KINDS), "source_tool": _string(1, 128), "uri": _string(1, 4096),
            "digest": _string(pattern=_shown(K.DIGEST_PATTERN)), "created_at": stamp})),
        "created_at": stamp, "updated_at": stamp,
    }, {
        "policy": _all_of({"approval_required": flag, "dispatch_allowed": flag, "stale_context": flag, "reasons": _list(_string(1, 2000))}),
        "render_hints": _object([], {
            "default_target": _string(enum=K.TARGETS), "context_budget": {"type": ["integer"], "minimum": 256, "maximum": 200000},
            "include_provenance": flag}),
        "extensions": {"type": ["object"], "open": True},
    })


def _shown(pattern: str) -> str:
    return pattern.replace(r"\A", "^").replace(r"\z", "$")


def _exact(pattern: str) -> str:
    return pattern.replace("^", r"\A", 1).removesuffix("$") + r"\z"


def _finding(bad: Column, path: Column, message: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(path.alias("path"), F.lit(message).alias("message")))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


def _own(v: Column, s: Schema, path: Column, given: bool = False) -> list[Column]:
    """Findings of the keywords that look at one value, null where there are none; `given`:
    the value is there, though it may be NULL for JSON null."""
    kind = F.coalesce(json_type(v), F.lit("null")) if given else json_type(v)
    text, number, out = _as(v, "string"), _as(v, "double"), []
    is_text, is_number = kind == "string", kind == "number"
    if types := s.get("type"):
        fits = [is_number & (number == F.floor(number)) if t == "integer" else kind == t for t in types]
        out.append(_finding(~reduce(Column.__or__, [F.coalesce(f, F.lit(False)) for f in fits]) & kind.isNotNull(), path, f"must be {','.join(types)}"))
    if "const" in s:
        const = s["const"]
        same = (kind == "boolean") & (_as(v, "boolean") == const) if isinstance(const, bool) else is_text & (text == const)
        out.append(_finding(kind.isNotNull() & ~same, path, "must be equal to constant"))
    if "enum" in s:
        out.append(_finding(kind.isNotNull() & ~(is_text & text.isin(s["enum"])), path, "must be equal to one of the allowed values"))
    if "minLength" in s:
        out.append(_finding(is_text & (F.char_length(text) < s["minLength"]), path, f"must NOT have fewer than {s['minLength']} characters"))
    if "maxLength" in s:
        out.append(_finding(is_text & (F.char_length(text) > s["maxLength"]), path, f"must NOT have more than {s['maxLength']} characters"))
    if "pattern" in s:
        out.append(_finding(is_text & ~text.rlike(_exact(s["pattern"])), path, f'must match pattern "{s["pattern"]}"'))
    if "format" in s:
        out.append(_finding(is_text & ~text.rlike(K.DATE_TIME_PATTERN), path, f'must match format "{s["format"]}"'))
    if "minimum" in s:
        out.append(_finding(is_number & (number < s["minimum"]), path, f"must be >= {s['minimum']}"))
    if "maximum" in s:
        out.append(_finding(is_number & (number > s["maximum"]), path, f"must be <= {s['maximum']}"))
    if "minItems" in s:
        out.append(_finding((kind == "array") & (F.size(_as(v, "array<variant>")) < s["minItems"]), path,
                            f"must NOT have fewer than {s['minItems']} items"))
    return out


def _is_table(s: Schema) -> bool:
    """Whether a list holds objects: its elements become rows."""
    return "object" in s.get("items", {}).get("type", [])


def _inside(v: Column, s: Schema, path: Column) -> list[Column]:
    """Arrays of findings of an object's fields (not of elements of lists of objects)."""
    is_object = json_type(v) == "object"
    keys = F.map_keys(_as(v, "map<string,variant>"))
    here = F.when(path == "", "/").otherwise(path)
    out = [F.when(is_object, F.filter(F.array(*[
        _finding(~F.array_contains(keys, name), here, f"must have required property '{name}'") for name in s.get("required", [])
    ], F.lit(None).cast("struct<path:string,message:string>")), lambda x: x.isNotNull()))]
    if not s.get("open"):
        known = F.array(*[F.lit(n) for n in s["properties"]])
        out.append(F.when(is_object, F.transform(F.array_except(keys, known), lambda _: F.struct(
            here.alias("path"), F.lit("must NOT have additional properties").alias("message")))))
    for name, field in s.get("properties", {}).items():
        out += _field(v, name, field, path)
    if "condition" in s:
        out.append(_condition(v, s["condition"], path))
    return out


def _field(v: Column, name: str, s: Schema, path: Column) -> list[Column]:
    at = F.concat(path, F.lit(f"/{name}"))
    value = F.try_variant_get(v, f"$.{name}", "variant")
    out = [let(value, lambda x: F.filter(F.array(*_own(x, s, at)), lambda f: f.isNotNull()))]
    if "object" in s["type"]:
        out += _inside(value, s, at) if "properties" in s else []
    elif "items" in s and not _is_table(s):
        each = F.transform(_as(value, "array<variant>"), lambda x, i: F.array(
            *_own(x, s["items"], F.concat(at, F.lit("/"), i.cast("string")), given=True)))
        out.append(F.filter(F.flatten(each), lambda f: f.isNotNull()))
    return out


def _condition(v: Column, condition: tuple[dict[str, Schema], dict[str, Schema]], path: Column) -> Column:
    """Where the first fields fit (a missing one does), the second ones must fit, too."""
    when, then = condition
    get = lambda n: F.try_variant_get(v, f"$.{n}", "variant")
    fits = reduce(Column.__and__, [F.coalesce(*_own(get(n), s, path)).isNull() for n, s in when.items()])
    found = F.filter(F.array(*[c for n, s in then.items() for c in _own(get(n), s, F.concat(path, F.lit(f"/{n}")))]), lambda f: f.isNotNull())
    whole = F.array(F.struct(path.alias("path"), F.lit('must match "then" schema').alias("message")))
    return F.when((json_type(v) == "object") & fits & (F.size(found) > 0), F.concat(found, whole))


def _flat(arrays: list[Column]) -> Column:
    none = F.array().cast("array<struct<path:string,message:string>>")
    return F.flatten(F.array(*[F.coalesce(a, none) for a in arrays]))


def list_elements(docs: DataFrame, key: str, doc: str) -> DataFrame:
    """One row per element of every list of objects: key, list, pos, v; written once,
    in a folder per list."""
    lists = [n for n, s in schema()["properties"].items() if _is_table(s)]
    parsed = docs.select(key, F.try_parse_json(doc).alias("d"))
    rows = parsed.select(key, F.inline(packets.list_elements(F.col("d"), lists)))
    return materialize(rows, "list-elements", ["list"])


def document_findings(docs: DataFrame, key: str = "uri", doc: str = "doc") -> DataFrame:
    """key, code, severity, path and message for every limit that a document breaks."""
    allow_repeated_keys(docs.sparkSession)
    whole = schema()
    parsed = docs.select(key, F.try_parse_json(doc).alias("v"))
    top = parsed.where(F.coalesce(json_type(F.col("v")) == "object", F.lit(False)))
    odd = parsed.where(~F.coalesce(json_type(F.col("v")) == "object", F.lit(False))).select(
        key, F.lit(f"{K.RULE_PREFIX}-engine").alias("code"), F.lit("/").alias("path"), F.lit("packet is not an object").alias("message"))
    code = F.lit(f"{K.RULE_PREFIX}002").alias("code")
    parts = [top.select(key, code, F.inline(_flat(_inside(F.col("v"), whole, F.lit("")))))]
    elements = list_elements(docs, key, doc)
    for name, field in whole["properties"].items():
        if _is_table(field):
            at = F.concat(F.lit(f"/{name}/"), F.col("pos").cast("string"))
            item = F.filter(F.array(*_own(F.col("v"), field["items"], at, given=True)), lambda f: f.isNotNull())
            inside = _flat([item, *_inside(F.col("v"), field["items"], at)])
            parts.append(elements.where(F.col("list") == name).select(key, code, F.inline(inside)))
    found = reduce(DataFrame.unionByName, [*parts, odd])
    return found.select(key, "code", F.lit("critical").alias("severity"), "path", "message")
