"""Column and value contracts: a source that changed is refused, never guessed at."""

from __future__ import annotations

import hashlib
import json
import os
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A file doesn't have the columns or values it is declared to have."""


def expect_columns(found: list, expected: list[str], where: str) -> None:
    """Exactly these columns in this order, spaces around names aside."""
    names = [str(c).strip() if c is not None else "" for c in found]
    if names != list(expected):
        raise ContractError(f"{where}: missing {sorted(set(expected) - set(names))}, unexpected {sorted(set(names) - set(expected))}, order {names}")


def expect_not_html(content: bytes, where: str) -> None:
    """An error page that came with status 200 is not data."""
    head = content[:512].lstrip().lower()
    if head.startswith((b"<!doctype html", b"<html")):
        raise ContractError(f"{where}: got an HTML page")


def require(value: Column, ok: Column, message: str) -> Column:
    """value where ok holds, else the query fails with the message and the value."""
    told = F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(value.cast("string"), F.lit("null"))))
    return F.when(ok, value).otherwise(told.cast("string"))


def expect_rows(df: DataFrame, expected: int, where: str) -> DataFrame:
    n = df.count()
    if n != expected:
        raise ContractError(f"{where}: {n} rows, {expected} expected")
    return df


def profile(df: DataFrame, name: str) -> DataFrame:
    """(name, n_rows, n_columns, nulls): one pass; nulls is a map by column."""
    nulls = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.count("*") - F.count(c))]) if df.columns else F.create_map()
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("n_rows"), F.lit(len(df.columns)).alias("n_columns"), nulls.alias("nulls"))


# --- provenance --------------------------------------------------------------------------


def sha256_of(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def _manifest(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def record(path: str, source: str, url: str, manifest: str, **extra) -> dict:
    """Note a landed file's checksum, size, origin and time in the manifest."""
    entry = {"source": source, "url": url, "sha256": sha256_of(path), "bytes": os.path.getsize(path), "recorded_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **extra}
    book = _manifest(manifest) | {os.path.basename(path): entry}
    with open(manifest, "w", encoding="utf-8") as f:
        json.dump(book, f, indent=1, sort_keys=True)
    return entry


def verify(path: str, manifest: str) -> None:
    """The file is in the manifest and has not changed since."""
    entry = _manifest(manifest).get(os.path.basename(path))
    if entry is None:
        raise ContractError(f"{path}: not in the manifest")
    if sha256_of(path) != entry["sha256"]:
        raise ContractError(f"{path}: checksum differs from the manifest")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of every file below path, computed on the executors."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
