"""Result documents, side tables and settings as JSON with explicit schemas; atomic writes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .transactions import Files

SEGMENT = "struct<segment_id:bigint,start_ms:bigint,end_ms:bigint,speaker_label:string,included_in_preview:boolean,raw_text:string>"
SPEAKER = "struct<speaker_label:string,speaker_profile_id:string,fingerprint_id:string>"
MERGED = "struct<merge_id:bigint,start_ms:bigint,end_ms:bigint,speaker_label:string,manual_speaker_label:string,raw_content:string,cleaned_content:string,was_llm_failure:boolean>"
RESULT = f"job_id string, audio_path string, finished_at string, cleaned_model string, segments array<{SEGMENT}>, speakers array<{SPEAKER}>, merged_results array<{MERGED}>"
SPEAKER_INPUT = "version bigint, audioPath string, sentences array<struct<text:string,startMs:bigint,endMs:bigint,tokens:array<struct<text:string,startMs:bigint,endMs:bigint>>>>"
SETTINGS = "apiKeys array<struct<id:string,tier:string,priority:bigint,enabled:boolean>>, glossary array<string>, cleanup struct<chunkChars:bigint>, queue struct<autoStart:boolean>"
KINDS = {"result": RESULT, "speaker_input": SPEAKER_INPUT, "settings": SETTINGS}


def schema_of(kind: str) -> StructType:
    return _parse_datatype_string(KINDS[kind])


def read_documents(spark: SparkSession, path: str, kind: str = "result") -> DataFrame:
    """One row per JSON file with its defaults filled in; broken fields read as null."""
    df = spark.read.schema(schema_of(kind)).option("multiLine", "true").option("mode", "PERMISSIVE").json(path)
    if kind != "result":
        return df
    segments = F.transform("segments", lambda s: s.withField("included_in_preview", F.coalesce(s["included_in_preview"], F.lit(True))))
    merged = F.transform("merged_results", lambda m: m.withField("cleaned_content", F.coalesce(m["cleaned_content"], F.lit(""))).withField("was_llm_failure", F.coalesce(m["was_llm_failure"], F.lit(False))))
    return df.withColumns({"segments": segments, "merged_results": merged})


def first_existing(candidates: DataFrame, existing: DataFrame, key: str, path: str, rank: str) -> DataFrame:
    """Of each key's candidate paths the first, by rank, that exists."""
    return candidates.join(existing.select(path).distinct(), path, "left_semi").groupBy(key).agg(F.min_by(path, rank).alias(path))


def write_atomic(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    """Write beside the target and put it in place by one rename; readers see the old or the new data, never half of it.

    A crash before the rename leaves the old data and a ``.staging`` folder, which the next write replaces.
    """
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, staging, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".staging", ".old"))
    fs = to.getFileSystem(conf)
    df.write.mode("overwrite").format(fmt).options(**options).save(str(staging))
    fs.delete(old, True)
    if fs.exists(to) and not fs.rename(to, old):
        raise OSError(f"can't move {path} away")
    if not fs.rename(staging, to):
        fs.rename(old, to)
        raise OSError(f"can't put {path} in place")
    fs.delete(old, True)


def recover(spark: SparkSession, path: str) -> str:
    """After a crash: put back what was moved away if nothing is in place. Returns what was found."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    to, old = (jvm.org.apache.hadoop.fs.Path(path + s) for s in ("", ".old"))
    fs = to.getFileSystem(conf)
    if fs.exists(to):
        fs.delete(old, True)
        return "complete"
    if fs.exists(old):
        fs.rename(old, to)
        return "restored"
    return "absent"


def affine_table(spark: SparkSession, path: str) -> DataFrame:
    """A feature normaliser's text file: the bracketed lists after <AddShift> and <Rescale> as two arrays."""
    text = spark.read.text(path, wholetext=True)
    numbers = lambda tag: F.transform(F.split(F.trim(F.regexp_extract("value", rf"(?s)<{tag}>.*?\[\s*(.*?)\s*\]", 1)), r"\s+"), lambda x: x.cast("double"))
    return text.select(numbers("AddShift").alias("shift"), numbers("Rescale").alias("scale"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of tokens -> token, id; of a token that comes twice the first id."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("id", "token"))
    return rows.groupBy("token").agg(F.min("id").alias("id"))


def save_settings(spark: SparkSession, path: str, settings: dict) -> None:
    """Settings as one JSON document that only its owner may read, in place by a rename; fields that KINDS doesn't know are refused."""
    known = {f.name for f in schema_of("settings").fields}
    if unknown := settings.keys() - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder)
    files.write(f"{name}.staging", json.dumps(settings, ensure_ascii=False).encode())
    owner = spark._jvm.org.apache.hadoop.fs.permission.FsPermission("600")
    files.fs.setPermission(files.path(f"{name}.staging"), owner)
    files.remove(name)
    files.move(f"{name}.staging", name)


def load_settings(spark: SparkSession, path: str) -> dict:
    """The settings, or those of a save that was stopped between its two steps; none saved: empty."""
    folder, _, name = path.rpartition("/")
    files = Files(spark, folder)
    files.move(f"{name}.staging", name) if not files.exists(name) else None
    return json.loads(files.read(name)) if files.exists(name) else {}
