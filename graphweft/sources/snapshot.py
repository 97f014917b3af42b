"""Snapshots: Parquet versions under one folder, and a manifest that names the current one.

A new version is written beside the old one; then the manifest is swapped by a rename, so that a failed save leaves
the last one whole. Everything goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from graphweft.errors import GraphError
from graphweft.graph import PropertyGraph

FORMAT = 1


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def save(graph: PropertyGraph, path: str, secure: bool = True) -> None:
    """Validate, write, swap."""
    graph.validate()
    spark = graph.spark
    version = uuid.uuid4().hex
    graph.nodes.write.parquet(f"{path}/{version}/nodes")
    graph.rels.write.parquet(f"{path}/{version}/rels")
    manifest = {
        "format": FORMAT, "version": version, "next_node": graph.next_node, "next_rel": graph.next_rel, "mixed": sorted(map(list, graph.mixed)),
        "constraints": [list(c) for c in graph.constraints], "indexes": [list(i) for i in graph.indexes],
        "nodes": graph.nodes.count(), "relationships": graph.rels.count(),
    }
    fs, temporary = _fs(spark, f"{path}/manifest.{version}.json")
    out = fs.create(temporary, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    old, target = read_manifest(spark, path, missing=None), _fs(spark, f"{path}/manifest.json")[1]
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(temporary, target):
        raise GraphError("IO_ERROR", f"cannot rename {temporary}")
    if secure:
        harden(spark, path)
    if old:
        fs.delete(_fs(spark, f"{path}/{old['version']}")[1], True)


def harden(spark: SparkSession, path: str) -> None:
    """Owner-only permissions, where the file system has them."""
    fs, p = _fs(spark, path)
    fs.setPermission(p, spark._jvm.org.apache.hadoop.fs.permission.FsPermission("700"))


def read_manifest(spark: SparkSession, path: str, missing: Any = ...) -> dict | None:
    fs, p = _fs(spark, f"{path}/manifest.json")
    if not fs.exists(p):
        if missing is None:
            return None
        raise GraphError("NOT_FOUND", path)
    text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())
    try:
        manifest = json.loads(text)
        if manifest["format"] != FORMAT or not isinstance(manifest["version"], str):
            raise ValueError(manifest)
    except (ValueError, KeyError, TypeError) as e:
        raise GraphError("CORRUPT", f"{path}: bad manifest") from e
    return manifest


def load(spark: SparkSession, path: str, check: bool = True) -> PropertyGraph:
    """The current version; check: counts, ids, ends and constraints hold."""
    m = read_manifest(spark, path)

    def read(part: str) -> DataFrame:
        where = f"{path}/{m['version']}/{part}"
        if not exists(spark, where):
            raise GraphError("CORRUPT", f"{where} is missing")
        return spark.read.parquet(where)

    graph = PropertyGraph(read("nodes"), read("rels"), m["next_node"], m["next_rel"], frozenset(map(tuple, m["mixed"])), tuple(map(tuple, m["constraints"])), tuple(map(tuple, m["indexes"])))
    if check:
        if (graph.node_count(), graph.rel_count()) != (m["nodes"], m["relationships"]):
            raise GraphError("CORRUPT", f"{path}: counts differ from the manifest")
        graph.validate()
    return graph


# password-protected copies: own envelope, AES-GCM of the session with a key from scrypt
def _key(password: str, salt: bytes) -> bytes:
    import hashlib

    if not password:
        raise GraphError("INVALID_ARGUMENT", "empty password")
    return hashlib.scrypt(password.encode(), salt=salt, n=2**14, r=8, p=1, dklen=32)


def encrypt(graph: PropertyGraph, path: str, password: str) -> None:
    """Each row as an encrypted JSON text, with the manifest as one more row of its own kind."""
    import os

    from pyspark.sql import functions as F

    salt = os.urandom(16)
    key = F.lit(_key(password, salt))
    meta = json.dumps({"next_node": graph.next_node, "next_rel": graph.next_rel, "mixed": sorted(map(list, graph.mixed)), "constraints": graph.constraints, "indexes": graph.indexes, "schemas": [graph.nodes.schema.json(), graph.rels.schema.json()], "counts": [graph.node_count(), graph.rel_count()]})
    spark = graph.spark
    rows = spark.createDataFrame([("meta", meta)], "kind string, text string")
    for kind, df in (("node", graph.nodes), ("rel", graph.rels)):
        rows = rows.union(df.select(F.lit(kind), F.to_json(F.struct("*"))))
    sealed = rows.select(F.aes_encrypt(F.to_json(F.struct("kind", "text")).cast("binary"), key, F.lit("GCM")).alias("sealed"), F.lit(salt).alias("salt"))
    sealed.write.parquet(path)


def decrypt(spark: SparkSession, path: str, password: str) -> PropertyGraph:
    """A wrong password or a changed byte is CORRUPT."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    sealed = spark.read.parquet(path)
    first = sealed.first()
    if first is None:
        raise GraphError("CORRUPT", path)
    key = F.lit(_key(password, bytes(first.salt)))
    opened = sealed.select(F.try_aes_decrypt("sealed", key, F.lit("GCM")).cast("string").alias("t")).select("t", F.from_json("t", "kind string, text string").alias("r"))
    if opened.where("t is null").limit(1).count():
        raise GraphError("CORRUPT", f"{path}: wrong password or changed data")
    metas = opened.where("r.kind = 'meta'").select("r.text").collect()
    if len(metas) != 1:
        raise GraphError("CORRUPT", path)
    m = json.loads(metas[0].text)
    frames = [opened.where(f"r.kind = '{k}'").select(F.from_json("r.text", T.StructType.fromJson(json.loads(s))).alias("x")).select("x.*") for k, s in zip(("node", "rel"), m["schemas"], strict=True)]
    graph = PropertyGraph(*frames, m["next_node"], m["next_rel"], frozenset(map(tuple, m["mixed"])), tuple(map(tuple, m["constraints"])), tuple(map(tuple, m["indexes"]))).materialised()
    if [graph.node_count(), graph.rel_count()] != m["counts"]:
        raise GraphError("CORRUPT", f"{path}: rows are missing")
    return graph
