"""Column functions of the catalogue; all but the compatibility forms stay in the JVM."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal form of a tag, and bounds of the catalogue.
TAG = r"^[a-z0-9][a-z0-9_-]{0,63}\z"
MOST_TAGS = 32
REASON_BYTES = 2048
CUT_MARK = "…[truncated]"
MOST_NAME = 255
META_BYTES = 8192
META_DEPTH = 4
ADDRESS_CHARACTERS = 512


def dot(a: Column, b: Column) -> Column:
    """The dot product, summed in double from the first element on."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """One less the cosine; null where a vector is zero or missing."""
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _python(change: Callable, kind: str, raw: Column) -> Column:
    """``change`` of each value that is not null; in Python, since Spark has no NFKC."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else change(v))

    return F.pandas_udf(run, kind)(raw)


def _tag_form(raw: Column) -> Column:
    normalize = unicodedata.normalize
    return _python(lambda v: normalize("NFKC", v).strip().lower(), "string", raw)


def _tag_forms(raw: Column) -> Column:
    normalize = unicodedata.normalize
    return _python(lambda v: [None if t is None else normalize("NFKC", t).strip().lower() for t in v if t is None or t.strip()], "array<string>", raw)


def normalise_tag(raw: Column) -> Column:
    """In compatibility form, trimmed and lower-case; null where that is not a tag."""
    tag = _tag_form(raw)
    return F.when(tag.rlike(TAG), tag)


def normalise_tags(raw: Column) -> Column:
    """Tags of an array: blanks dropped, the first of equals kept; null where one is no tag or too many are left."""
    named = F.array_distinct(_tag_forms(raw))
    return F.when(~F.exists(named, lambda t: t.isNull() | ~t.rlike(TAG)) & (F.size(named) <= MOST_TAGS), named)


def tags_all(tags: Column, wanted: list[str]) -> Column:
    return F.size(F.array_except(F.array(*map(F.lit, wanted)), tags)) == 0


def tags_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def meta_equals(meta: Column, key: str, value: str) -> Column:
    """Whether a top-level member is the JSON string ``value``; the number of the same digits is not."""
    found = F.try_parse_json(meta)
    member = F.try_variant_get(found, f"$.{key}", "variant")
    return F.coalesce((F.schema_of_variant(member) == "STRING") & (F.try_variant_get(found, f"$.{key}", "string") == value), F.lit(False))


def backoff_seconds(attempts: Column) -> Column:
    return F.lit(10) * F.pow(F.lit(2), F.greatest(attempts, F.lit(1))).cast("long")


def file_name(raw: Column) -> Column:
    """In compatibility form the last segment, without control characters, outer white space and dots, at most 255 characters; null if nothing is left."""
    normalize, category = unicodedata.normalize, unicodedata.category

    def change(value: str) -> str | None:
        name = "".join(c for c in normalize("NFKC", value) if category(c) != "Cc")
        return name.replace("\\", "/").rsplit("/", 1)[-1].strip().strip(".")[:MOST_NAME].strip() or None

    return _python(change, "string", raw)


def split_tags(raw: Column) -> Column:
    """Tags of an array of fields, each one tag or a comma-separated list of tags."""
    return normalise_tags(F.flatten(F.transform(raw, lambda v: F.split(v, ","))))


def label_tag(raw: Column) -> Column:
    """A label as a tag, runs of white space as one hyphen; null where that is no tag."""
    normalize = unicodedata.normalize
    named = _python(lambda v: normalize("NFKC", "-".join(v.split())).strip().lower(), "string", raw)
    return F.when(named.rlike(TAG), named)


def label_tags(raw: Column) -> Column:
    """The labels of an array that can be tags, in order, the first of equals kept, at most ``MOST_TAGS``."""
    normalize = unicodedata.normalize
    named = _python(lambda v: [normalize("NFKC", "-".join(t.split())).strip().lower() for t in v if t is not None], "array<string>", raw)
    return F.slice(F.array_distinct(F.filter(named, lambda t: t.rlike(TAG))), 1, MOST_TAGS)


def tag_union(first: Column, second: Column) -> Column:
    """The tags of both arrays in the order first seen; null where they are too many."""
    both = F.array_distinct(F.concat(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))
    return F.when(F.size(both) <= MOST_TAGS, both)


def _levels() -> Callable:
    def depth(value) -> int:
        """Levels of nesting, the value itself the first; level by level, so that no text is too deep for it."""
        found, level = 0, [value]
        while level:
            found += 1
            level = [inner for v in level for inner in (v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())]
        return found

    return depth


def json_depth(raw: Column) -> Column:
    """How deep a JSON text nests, an object or a value alone being 1; null where it is no JSON."""
    depth, loads = _levels(), json.loads

    def change(value: str) -> int | None:
        try:
            return depth(loads(value))
        except (ValueError, RecursionError):
            return None

    return _python(change, "int", raw)


def metadata_problem(raw: Column) -> Column:
    """Why a text is no metadata: not JSON, no object, too many bytes or too deep; null where nothing is wrong, as with blanks."""
    depth, loads, dumps, most, deepest = _levels(), json.loads, json.dumps, META_BYTES, META_DEPTH

    def change(value: str) -> str | None:
        if not value.strip():
            return None
        if len(value.encode()) > most:
            return "too many bytes"
        try:
            found = loads(value)
        except (ValueError, RecursionError):
            return "not JSON"
        if not isinstance(found, dict):
            return "not an object"
        if len(dumps(found, separators=(",", ":"))) > most:
            return "too many bytes"
        return "too deep" if depth(found) > deepest else None

    return _python(change, "string", raw)


def metadata(raw: Column) -> Column:
    """A text as metadata: blank and null are an empty object; null where :func:`metadata_problem` has something to say."""
    empty = raw.isNull() | (F.trim(raw) == "")
    return F.when(empty, "{}").when(metadata_problem(raw).isNull(), raw)


def patched(current: Column, patch: Column, given: Column) -> Column:
    """Metadata after an edit: left alone where not ``given``, cleared by null, else replaced."""
    return F.when(given, F.coalesce(patch, F.lit("{}"))).otherwise(current)


def metadata_merge(*layers: Column) -> Column:
    """Objects merged at the top level, each over those before it; nulls and blanks are empty, values keep their types."""
    loads, dumps = json.loads, json.dumps

    def change(parts) -> str:
        whole: dict = {}
        for part in parts:
            if part is not None and part.strip():
                whole |= loads(part)
        return dumps(whole, separators=(",", ":"), ensure_ascii=False)

    return _python(change, "string", F.array(*layers))


def bounded_reason(raw: Column) -> Column:
    """A text of at most ``REASON_BYTES`` bytes, cut between characters and marked where it was longer."""
    most, mark = REASON_BYTES, CUT_MARK

    def change(value: str) -> str:
        whole = value.encode()
        return value if len(whole) <= most else whole[: most - len(mark.encode())].decode(errors="ignore") + mark

    return F.when(F.octet_length(raw) <= most, raw).otherwise(_python(change, "string", raw))


def reason_for(kind: Column, message: Column, ours: Column) -> Column:
    """What is kept of an error: its class, and its message where the error is the catalogue's own."""
    return bounded_reason(F.when(ours, F.concat_ws(": ", kind, message)).otherwise(kind))


def address(declared: Column, fallback: Column) -> Column:
    """A declared web address that is one and not too long, else the fallback."""
    fits = (F.char_length(declared) <= ADDRESS_CHARACTERS) & declared.rlike("^https?://")
    return F.when(fits, declared).otherwise(fallback)


def picture_name(identifier: Column) -> Column:
    return F.concat(F.lpad(identifier.cast("string"), 12, "0"), F.lit(".jpg"))


def provenance(dataset: str, identifier: Column, licence: Column, source_url: Column) -> Column:
    """Where a picture comes from, as metadata."""
    return F.to_json(F.struct(F.lit(dataset).alias("dataset"), identifier.cast("string").alias("dataset_id"), licence.alias("licence"), source_url.alias("source_url")))


def links(asset_id: Column, prefix: str) -> Column:
    """Where an asset's files are served."""
    at = F.concat(F.lit(prefix + "/"), asset_id.cast("string"))
    return F.struct(F.concat(at, F.lit("/file")).alias("file"), F.concat(at, F.lit("/thumbnail")).alias("thumbnail"))


def score(distance: Column) -> Column:
    return 1 - distance


def unit(vector: Column) -> Column:
    """A vector at length one; a zero vector is an error, not a row of nulls."""
    norm = F.sqrt(dot(vector, vector))
    return F.when(norm > 0, F.transform(vector, lambda x: (x.cast("double") / norm).cast("float"))).when(vector.isNotNull(), F.raise_error(F.lit("a zero vector has no direction")))
