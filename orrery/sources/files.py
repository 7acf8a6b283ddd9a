"""Files beside the tables: pictures of a folder with their JSON sidecars, the dataset's manifest, and the media store."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from io import BytesIO
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions import columns as C
from orrery.operators import assets as A
from orrery.scratch import ship

#: Suffixes of pictures, the most bytes of a sidecar, the key of a file's origin, and why an entry is passed over.
SUFFIXES = ("jpg", "jpeg", "png", "webp")
SIDECAR_BYTES = 16 * 1024
ORIGIN = "source_path"
NO_PICTURE = "not named like a picture"
TOO_LARGE = f"larger than the {SIDECAR_BYTES} bytes a sidecar may have"
#: The dataset, the manifest's place in its archive, its most bytes, and the licences that permit reuse.
DATASET, MEMBER, MEMBER_BYTES = "coco-val2017", "annotations/instances_val2017.json", 128 * 1024 * 1024
LICENCES = (
    "http://creativecommons.org/licenses/by/2.0/",
    "http://creativecommons.org/licenses/by-sa/2.0/",
    "http://flickr.com/commons/usage/",
    "http://www.usa.gov/copyright.shtml",
)
MANIFEST = """images array<struct<id:bigint, license:bigint, flickr_url:string>>, licenses array<struct<id:bigint, url:string>>,
    categories array<struct<id:bigint, name:string>>, annotations array<struct<image_id:bigint, category_id:bigint>>"""
_SUFFIX = r"\.([^./]*)\z"


def _files(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)


def _is_picture(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, _SUFFIX, 1)).isin(*SUFFIXES)


def entries(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """The entries of a folder (path, size_bytes, modified, reason): pictures, and other files with the reason they are passed over.

    A sidecar belongs to its picture and is no entry. Contents are not read.
    """
    listed = _files(spark, path, recursive).select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    named = listed.withColumns({"stem": F.regexp_replace("path", _SUFFIX, ""), "picture": _is_picture(F.col("path"))})
    stems = named.where("picture").select("stem").distinct().withColumn("beside", F.lit(True))
    joined = named.join(stems, "stem", "left").where(~(F.col("path").endswith(".json") & F.coalesce("beside", F.lit(False))))
    return joined.select("path", "size_bytes", "modified", F.when(~F.col("picture"), NO_PICTURE).alias("reason")).orderBy("path")


def count_entries(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    return entries(spark, path, recursive=recursive).agg(F.count("*").alias("n"))


def sidecar(raw: Column) -> Column:
    """What a sidecar's text says, as struct(tags, meta, refusal): its tags as written, its metadata, and why it cannot be used."""
    loads, dumps = json.loads, json.dumps

    def read(value: str | None) -> tuple:
        if value is None:
            return None, None, None
        try:
            found = loads(value)
        except (ValueError, RecursionError):
            return None, None, "not JSON"
        if not isinstance(found, dict):
            return None, None, "not an object"
        if set(found) - {"tags", "meta"}:
            return None, None, "unexpected keys: " + ", ".join(sorted(set(found) - {"tags", "meta"}))
        tags, meta = found.get("tags", []), found.get("meta", {})
        if not (isinstance(tags, list) and all(isinstance(t, str) for t in tags)):
            return None, None, "tags must be a list of strings"
        if not isinstance(meta, dict):
            return None, None, "meta must be an object"
        return tags, dumps(meta, separators=(",", ":"), ensure_ascii=False), None

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read(v) for v in values], columns=["tags", "meta", "refusal"], dtype=object)

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "tags array<string>, meta string, refusal string")(raw)


def pictures_of(files: DataFrame) -> DataFrame:
    """The pictures (path, size_bytes, sha256, stem) among binary files, of a batch or a stream."""
    return files.where(_is_picture(F.col("path"))).select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), F.regexp_replace("path", _SUFFIX, "").alias("stem"))


def sidecars_of(files: DataFrame) -> DataFrame:
    """What the JSON files among binary files say (stem, large, said), of a batch or a stream."""
    beside = files.where(F.col("path").endswith(".json"))
    small = F.when(F.col("length") <= SIDECAR_BYTES, F.decode("content", "UTF-8"))
    return beside.select(F.regexp_replace("path", _SUFFIX, "").alias("stem"), F.when(F.col("length") > SIDECAR_BYTES, TOO_LARGE).alias("large"), sidecar(small).alias("said"))


def described(joined: DataFrame) -> DataFrame:
    """Pictures joined with their sidecars (path, size_bytes, sha256, large, said) as path, size_bytes, sha256, tags, meta, refusal."""
    tags = C.normalise_tags(F.coalesce("said.tags", F.array().cast("array<string>")))
    refusal = F.coalesce("large", "said.refusal", F.when(tags.isNull(), "tags that are none, or too many"), C.metadata_problem(F.col("said.meta")))
    return joined.select("path", "size_bytes", "sha256", tags.alias("tags"), F.col("said.meta").alias("meta"), refusal.alias("refusal"))


def folder(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """Pictures (path, size_bytes, sha256) with what their sidecars say (tags, meta) and why one is refused (refusal)."""
    files = _files(spark, path, recursive)
    return described(pictures_of(files).join(sidecars_of(files), "stem", "left"))


def import_folder(
    spark: SparkSession, path: str, assets: DataFrame, *, now: Column, tags: tuple[str, ...] = (), meta: str = "{}", recursive: bool = False
) -> tuple[DataFrame, DataFrame]:
    """What becomes of every entry (path, outcome, reason, asset_id), and the new assets.

    A run's tags are joined by the picture's own, its metadata is overlaid by
    them, and the file's origin is written last. Nothing is stored here, so the
    first frame alone is a rehearsal. Of equal contents the first path is
    created and the others are duplicates, as are contents already stored.
    """
    decided, made = imported(folder(spark, path, recursive=recursive), assets, now=now, tags=tags, meta=meta)
    skipped = entries(spark, path, recursive=recursive).where("reason is not null")
    return decided.unionAll(skipped.select("path", F.lit("skipped").alias("outcome"), "reason", F.lit(None).cast("string").alias("asset_id"))), made


def imported(pictures: DataFrame, assets: DataFrame, *, now: Column, tags: tuple[str, ...] = (), meta: str = "{}") -> tuple[DataFrame, DataFrame]:
    """What becomes of ``pictures`` as :func:`described` gives them (path, outcome, reason, asset_id), and the new assets; the rest as in :func:`import_folder`."""
    own = F.array(*map(F.lit, tags)).cast("array<string>")
    joined = C.tag_union(own, F.coalesce("tags", F.array().cast("array<string>")))
    origin = F.to_json(F.struct(F.col("path").alias(ORIGIN)))
    whole = C.metadata_merge(F.lit(meta), F.col("meta"), origin)
    checked = pictures.withColumns({"all_tags": joined, "whole": F.when(F.col("refusal").isNull(), whole)})
    refused = F.coalesce(F.concat(F.lit("its sidecar: "), "refusal"), F.when(F.col("all_tags").isNull(), "its sidecar: too many tags"), C.metadata_problem(F.col("whole")))
    checked = checked.withColumn("reason", refused)
    name, extension = C.file_name(F.col("path")), F.lower(F.regexp_extract("path", _SUFFIX, 1))
    good = checked.where("reason is null").select(
        F.col("path").alias("id"), "sha256", F.col("all_tags").alias("tags"), F.col("whole").alias("meta"), "size_bytes",
        name.alias("original_filename"), F.when(extension == "jpeg", "jpg").otherwise(extension).alias("file_ext"), F.lit("folder").alias("source"),
    )
    found = A.outcomes(good.select("id", "sha256"), assets, "id")
    new = good.join(found.where("outcome = 'created'").select("id"), "id", "left_semi").drop("id")
    made = A.inserted(new, now)
    ids = made.select("sha256", F.col("id").alias("made_id"))
    stored = found.join(assets.select(F.col("id").cast("string").alias("asset_id")), "asset_id", "left_semi").select("id", "asset_id")
    decided = found.select("id", "sha256", "outcome").join(ids, "sha256", "left").join(stored, "id", "left")
    decided = decided.select(F.col("id").alias("path"), "outcome", F.lit(None).cast("string").alias("reason"), F.coalesce("asset_id", "made_id").alias("asset_id"))
    none = F.lit(None).cast("string").alias("asset_id")
    bad = checked.where("reason is not null").select("path", F.lit("refused").alias("outcome"), "reason", none)
    return decided.unionAll(bad), made


def manifest(spark: SparkSession, path: str, *, member: str = MEMBER, most: int = MEMBER_BYTES) -> DataFrame:
    """The manifest, one row, of a JSON file or of the one named member of a zip archive.

    Refused where the member is missing or larger than ``most``; nothing is
    unpacked to disk, and a member under another name is not looked for.
    """
    if not path.endswith(".zip"):
        return spark.read.schema(MANIFEST).option("multiLine", True).json(path)

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for content in part["content"]:
                with zipfile.ZipFile(BytesIO(content)) as archive:
                    if member not in archive.namelist():
                        raise ValueError(f"the archive has no {member!r}")
                    if archive.getinfo(member).file_size > most:
                        raise ValueError(f"{member!r} has more than {most} bytes")
                    out.append(archive.read(member).decode())
            yield pd.DataFrame({"raw": out})

    raw = spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, "raw string")
    return raw.select(F.from_json("raw", MANIFEST, {"mode": "FAILFAST"}).alias("m")).select("m.*")


def offered(found: DataFrame, *, licences: tuple[str, ...] = LICENCES, base: str = "https://example.org/pictures") -> DataFrame:
    """The manifest's pictures in its order (place, identifier, licence, tags, source_url, refused).

    A picture without a positive id, or whose licence the manifest's table does
    not define or ``licences`` does not accept, is refused.
    """
    part = lambda name: found.select(F.explode(name).alias("r")).select("r.*")
    images = found.select(F.posexplode("images").alias("place", "r")).select("place", F.col("r.id").alias("identifier"), F.col("r.license").alias("license_id"), "r.flickr_url")
    terms = part("licenses").where("id is not null and url is not null").groupBy(F.col("id").alias("license_id")).agg(F.max("url").alias("licence"))
    names = part("categories").where("id is not null and name is not null").groupBy(F.col("id").alias("category_id")).agg(F.max("name").alias("name"))
    marks = found.select(F.posexplode("annotations").alias("nth", "r")).select("nth", F.col("r.image_id").alias("identifier"), F.col("r.category_id").alias("category_id"))
    first = marks.join(names, "category_id").groupBy("identifier", "name").agg(F.min("nth").alias("nth"))
    labels = first.groupBy("identifier").agg(F.array_sort(F.collect_list(F.struct("nth", "name"))).alias("labels"))  # a picture's few labels
    joined = images.join(terms, "license_id", "left").join(labels, "identifier", "left")
    refused = ~F.coalesce((F.col("identifier") > 0) & F.col("licence").isin(*licences), F.lit(False))
    own = F.concat(F.lit(base + "/"), C.picture_name(F.col("identifier")))
    tags = C.label_tags(F.transform(F.coalesce("labels", F.array().cast("array<struct<nth:int,name:string>>")), lambda r: r["name"]))
    return joined.select("place", "identifier", "licence", tags.alias("tags"), C.address(F.col("flickr_url"), own).alias("source_url"), refused.alias("refused"))


def store_media(files: DataFrame, root: str) -> DataFrame:
    """Write contents (id, file_ext, content) to ``root``, a mount that all executors share, as first two characters / id.ext; gives id and path.

    A file is staged beside its final name, flushed and renamed, so none is seen half written and a task that runs again writes the same.
    """
    ship(files.sparkSession)

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            paths = []
            for id_, extension, content in zip(part["id"], part["file_ext"], part["content"], strict=True):
                if extension not in SUFFIXES or "/" in id_:
                    raise ValueError(f"{id_!r}, {extension!r}: no name of the store")
                shard = os.path.join(root, id_[:2])
                os.makedirs(shard, exist_ok=True)
                final, staged = os.path.join(shard, f"{id_}.{extension}"), os.path.join(shard, f"{id_}.{uuid4().hex}.part")
                with open(staged, "wb") as handle:
                    handle.write(content)
                    handle.flush()
                    os.fsync(handle.fileno())
                os.replace(staged, final)
                paths.append(final)
            yield pd.DataFrame({"id": part["id"], "path": paths})

    return files.select("id", "file_ext", "content").mapInPandas(write, "id string, path string")


def media_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file of the store (path, modified), staged ones too."""
    return _files(spark, root, True).select("path", F.col("modificationTime").alias("modified"))
