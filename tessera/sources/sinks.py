"""Documents and files that are put in place all at once: the overlay, code concepts, promoted files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.document import read_document, write_lists
from tessera.sources.store import exists
from tessera.sources.versions import Conflict, Versions


def write_overlay(concepts: DataFrame, edges: DataFrame, path: str, graph_hash: str, model: str, generated_at: str, schema_version: str = "1") -> str:
    """The overlay as one document, in place all at once: its folder is written whole before a version names it."""
    spark = concepts.sparkSession
    log, folder = Versions(spark, path), f"data-{uuid.uuid4().hex}"
    lists = {"concepts": (concepts, ["id"]), "edges": (edges, ["from", "type", "to"])}
    write_lists(lists, f"{path.rstrip('/')}/{folder}", {"schema_version": schema_version, "graph_hash": graph_hash, "model": model, "generated_at": generated_at})
    now = log.manifest()
    if not log.put({**now, "number": now["number"] + 1, "folders": [folder]}):
        raise Conflict(f"version {now['number'] + 1} is there already")
    return folder


def load_overlay(spark: SparkSession, path: str, concepts: str, edges: str) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Concepts and edges with these schemas, and meta (name, value), of the newest overlay; None where there is none."""
    folders = Versions(spark, path).manifest()["folders"]
    if not folders:
        return None
    lists, meta = read_document(spark, f"{path.rstrip('/')}/{folders[0]}", {"concepts": concepts, "edges": edges})
    return lists["concepts"], lists["edges"], meta


#: What static analysis finds beyond symbols: routes, commands and the like, and the nodes they annotate.
CODE_CONCEPT = "name string, kind string, file string, line int, refs array<string>, meta map<string,string>"


def write_code_concepts(concepts: DataFrame, path: str, graph_hash: str, schema_version: str = "1") -> str:
    """Code concepts as one document; returns its hash."""
    return write_lists({"concepts": (concepts, ["kind", "name", "file"])}, path, {"schema_version": schema_version, "graph_hash": graph_hash})


def load_code_concepts(spark: SparkSession, path: str) -> DataFrame:
    """Code concepts; none where there is no document."""
    if not exists(spark, path):
        return spark.createDataFrame([], CODE_CONCEPT)
    return read_document(spark, path, {"concepts": CODE_CONCEPT})[0]["concepts"]


def promote(files: DataFrame, path: str) -> int:
    """Adds files (target, content) to a versioned folder, all or none; a target that is there or named twice raises.

    Returns how many there are.  The driver gets the first ten colliding targets for the message.
    """
    log = Versions(files.sparkSession, path)
    number = log.manifest()["number"]
    there = log.read("target string, content string", number)
    twice = files.groupBy("target").count().filter("count > 1").select("target")
    met = [r.target for r in files.select("target").join(there.select("target"), "target", "left_semi").unionAll(twice).distinct().orderBy("target").limit(10).collect()]
    if met:
        raise FileExistsError(", ".join(met))
    folder, now = log.stage(files), log.manifest(number) if number else log.manifest(0)
    if not log.put({**now, "number": number + 1, "folders": [*now["folders"], folder]}):
        raise Conflict(f"version {number + 1} is there already")
    return files.sparkSession.read.parquet(f"{path.rstrip('/')}/{folder}").count()
