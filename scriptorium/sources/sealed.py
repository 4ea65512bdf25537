"""Create-only writes with a manifest, and strict JSON read as pointer leaves."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shapes import token


def content_digest(df: DataFrame) -> DataFrame:
    """One row (n, digest): the number of rows and an order-free digest of their whole content."""
    row = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))))
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_sealed(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write ``df`` as Parquet under path/data and its manifest, last, under path/manifest; an existing path fails."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/data")
    content_digest(df.sparkSession.read.parquet(f"{path}/data")).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


def read_sealed(spark: SparkSession, path: str) -> DataFrame:
    """The data of a sealed path, after its rows were counted and digested again; a difference raises."""
    df = spark.read.parquet(f"{path}/data")
    said = spark.read.schema("n long, digest string").json(f"{path}/manifest").first()
    seen = content_digest(df).first()
    if said is None or tuple(said) != tuple(seen):
        raise ValueError(f"{path} does not hold what its manifest says")
    return df


class _Number(str):
    """A JSON number kept as it was written."""


def _no_repeats(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("repeated key")
    return out


def _refuse(name: str):
    raise ValueError(f"{name} is no JSON number")


def strict_parse(text: str):
    """Parsed JSON with numbers as written; repeated keys and non-finite numbers raise ValueError."""
    return json.loads(text, object_pairs_hook=_no_repeats, parse_constant=_refuse, parse_int=_Number, parse_float=_Number)


def leaves(value) -> Iterator[tuple[str, str, str | None]]:
    """(pointer, type, lexeme) of all leaves, empty containers among them, in the order of the text."""
    stack = [("", value)]
    while stack:
        pointer, v = stack.pop()
        if isinstance(v, (dict, list)) and v:
            items = [(token(k), x) for k, x in v.items()] if isinstance(v, dict) else list(enumerate(v))
            stack.extend((f"{pointer}/{k}", x) for k, x in reversed(items))
        elif isinstance(v, dict):
            yield pointer, "object", None
        elif isinstance(v, list):
            yield pointer, "array", None
        elif v is None:
            yield pointer, "null", None
        elif isinstance(v, bool):
            yield pointer, "bool", "true" if v else "false"
        else:
            yield pointer, "number" if isinstance(v, _Number) else "string", str(v)


def json_leaves(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pointer, type, lexeme, problem) of strictly read JSON texts; a text that can't be read is one row with its problem."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    found = [(*x, None) for x in leaves(strict_parse(text))]
                except (ValueError, RecursionError) as e:
                    found = [(None, None, None, "repeated key" if "repeated" in str(e) else "not JSON")]
                at += [i] * len(found)
                out += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[j] for x in out], pa.string()) for j in range(4))], names=[key, "pointer", "type", "lexeme", "problem"])

    return rows.select(key, body).mapInArrow(run, f"{key} {kind}, pointer string, type string, lexeme string, problem string")


def pointer_get(value, pointer: str):
    """The value at a JSON pointer (RFC 6901) of a parsed JSON value; KeyError where it leads nowhere."""
    if pointer and pointer[0] != "/":
        raise ValueError("a pointer is empty or begins with a slash")
    for part in pointer.split("/")[1:]:
        key = part.replace("~1", "/").replace("~0", "~")
        if isinstance(value, dict) and key in value:
            value = value[key]
        elif isinstance(value, list) and key.isdigit() and (key == "0" or key[0] != "0") and int(key) < len(value):
            value = value[int(key)]
        else:
            raise KeyError(pointer)
    return value


def pointers(wanted: list[str]):
    """A function from a JSON text to one row of the values at the pointers: strings as they are, numbers as written, null if absent."""

    def read(body: str) -> list[tuple]:
        try:
            parsed = json.loads(body, parse_int=_Number, parse_float=_Number)
        except (ValueError, RecursionError):
            return []
        out = []
        for p in wanted:
            try:
                v = pointer_get(parsed, p)
            except KeyError:
                v = None
            out.append(v if v is None or isinstance(v, str) else ("true" if v else "false") if isinstance(v, bool) else json.dumps(v, ensure_ascii=False))
        return [tuple(out)]

    return read


def scalar_paths(rows: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place, pointer, value): stripped scalars of JSON texts with keys sorted; empty strings, nulls and unreadable texts are left out."""
    from ..operators.markup import per_value

    def read(text: str) -> list[tuple]:
        try:
            parsed = strict_parse(text)
        except (ValueError, RecursionError):
            return []
        out: list[tuple] = []
        stack = [("", parsed)]
        while stack:
            at, v = stack.pop()
            if isinstance(v, dict):
                stack.extend((f"{at}/{token(k)}", v[k]) for k in sorted(v, reverse=True))
            elif isinstance(v, list):
                stack.extend((f"{at}/{i}", v[i]) for i in range(len(v) - 1, -1, -1))
            elif v is not None:
                word = ("true" if v else "false") if isinstance(v, bool) else v.strip()
                if word:
                    out.append((len(out), at, word))
        return out

    return per_value(rows, key, body, read, "place int, pointer string, value string")


def read_run(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(file, state, content) of the files under ``path`` against a manifest (file, sha256, ok, status).

    States: good, missing, unlisted, digest differs, failed (not ok or no status 200). The content is given
    of good files only. Files are read by Spark's binary source and digested where they lie.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    seen = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("seen"), "content")
    j = manifest.select("file", "sha256", "ok", "status").withColumn("listed", F.lit(True)).join(seen, "file", "full")
    state = F.when(F.col("seen").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(~F.col("sha256").eqNullSafe(F.col("seen")), "digest differs").when(~F.coalesce(F.col("ok") & (F.col("status") == 200), F.lit(False)), "failed").otherwise("good")
    return j.select("file", state.alias("state"), F.when(state == "good", F.col("content")).alias("content"))


def read_accounted(spark: SparkSession, path: str, schema: str, rows: int, digest: str | None = None) -> DataFrame:
    """JSON lines (gzip or plain) after their number, and if given their content digest, were checked against what is stated."""
    df = spark.read.schema(schema).json(path)
    seen = content_digest(df).first()
    if seen["n"] != rows or digest is not None and seen["digest"] != digest:
        raise ValueError(f"{path} holds {seen['n']} rows with digest {seen['digest']}, not what is stated")
    return df


def file_bindings(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, sha256) of the files under ``path``: a receipt against which a later state can be compared."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed_bindings(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) between two receipts: added, removed or changed."""
    b = before.select("file", F.col("sha256").alias("b"))
    j = b.join(after.select("file", F.col("sha256").alias("a")), "file", "full")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return j.select("file", change.alias("change")).where("change is not null")
