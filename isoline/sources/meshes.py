"""Readers of mesh, calibration and record texts, and flat writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<id:string,review_status:string,candidate:struct<type:string,length_mm:double>,guardrails:struct<passed:boolean,warnings:array<struct<code:string,severity:string>>>>"
EXPORT = f"struct<schema_version:string,current:{RECORD},saved:array<{RECORD}>>"


def obj_parts(df: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of OBJ texts in their order: (key, line, kind, parts), without comments and blanks."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\r?\n")).alias("line", "raw"))
    parts = F.filter(F.split(F.trim(F.regexp_replace("raw", "#.*", "")), "\\s+"), lambda s: s != "")
    return lines.withColumn("p", parts).filter(F.size("p") > 0).select(key, "line", F.element_at("p", 1).alias("kind"), F.slice("p", 2, F.size("p")).alias("parts"))


def obj_vertices(parts: DataFrame, key: str) -> DataFrame:
    """(key, vid, x, y, z), counted from 0 in the order of the text."""
    from pyspark.sql import Window as W

    v = parts.filter("kind = 'v'").withColumn("vid", F.row_number().over(W.partitionBy(key).orderBy("line")) - 1)
    return v.select(key, "vid", *(F.get("parts", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")))


def obj_triangles(parts: DataFrame, vertices: DataFrame, key: str) -> DataFrame:
    """(key, i0, i1, i2): polygons fanned from their first vertex; negative indices count from the end. Faces with an index out of range go."""
    n = vertices.groupBy(key).agg(F.count("*").alias("n"))
    ids = F.transform("parts", lambda p: F.element_at(F.split(p, "/"), 1).try_cast("int"))
    f = parts.filter("kind = 'f'").withColumn("ids", ids).join(n, key)
    f = f.withColumn("ids", F.transform("ids", lambda i: F.when(i < 0, F.col("n") + i).otherwise(i - 1)))
    f = f.filter((F.size("ids") >= 3) & F.forall("ids", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("n"))))
    f = f.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)))
    return f.select(key, F.get("ids", F.lit(0)).alias("i0"), F.get("ids", F.col("k")).alias("i1"), F.get("ids", F.col("k") + 1).alias("i2"))


def _ply(df: DataFrame, key: str, text: str) -> DataFrame:
    """Of ASCII PLY texts: (key, body: lines after the header, n_v, n_f, names: of a vertex's numbers in order). Elements are vertices, then faces; others after these are left out, as are texts in another format."""
    lines = df.select(key, F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s)).alias("lines")).withColumn("end", F.array_position("lines", F.lit("end_header")))
    lines = lines.filter((F.col("end") > 0) & F.startswith(F.get("lines", F.lit(0)), F.lit("ply")) & F.exists("lines", lambda s: s.rlike("^format\\s+ascii")))
    head = F.slice("lines", F.lit(1), F.col("end"))
    n = lambda what: F.coalesce(F.try_element_at(F.filter(F.transform(F.col("head"), lambda s: F.regexp_extract(s, rf"^element\s+{what}\s+(\d+)$", 1)), lambda s: s != ""), F.lit(1)).cast("int"), F.lit(0))
    own = F.filter(F.transform("head", lambda s, i: F.when(s.rlike("^property") & (F.size(F.filter(F.slice(F.col("head"), F.lit(1), i), lambda e: e.rlike("^element"))) == 1), F.regexp_extract(s, r"(\S+)$", 1))), lambda s: s.isNotNull())
    return lines.withColumn("head", head).select(key, F.slice("lines", F.col("end").cast("int") + 1, F.size("lines")).alias("body"), n("vertex").alias("n_v"), n("face").alias("n_f"), own.alias("names"))


def ply_vertices(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, vid, x, y, z) of ASCII PLY texts, counted from 0."""
    rows = _ply(df, key, text).select(key, "names", F.posexplode(F.slice("body", F.lit(1), F.col("n_v"))).alias("vid", "line"))
    numbers = F.split("line", "\\s+")
    return rows.select(key, "vid", *(F.get(numbers, F.array_position("names", F.lit(n)).cast("int") - 1).try_cast("double").alias(n) for n in "xyz"))


def ply_triangles(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i0, i1, i2) of ASCII PLY texts: polygons fanned from their first vertex; faces with an index out of range go."""
    rows = _ply(df, key, text).select(key, "n_v", F.explode(F.slice("body", F.col("n_v") + 1, F.col("n_f"))).alias("line"))
    numbers = F.transform(F.split("line", "\\s+"), lambda s: s.try_cast("int"))
    rows = rows.withColumn("all", numbers).withColumn("ids", F.slice("all", F.lit(2), F.greatest(F.coalesce(F.get("all", F.lit(0)), F.lit(0)), F.lit(0))))
    rows = rows.filter((F.size("ids") >= 3) & F.forall("ids", lambda i: i.isNotNull() & (i >= 0) & (i < F.col("n_v"))))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 2)))
    return rows.select(key, F.get("ids", F.lit(0)).alias("i0"), F.get("ids", F.col("k")).alias("i1"), F.get("ids", F.col("k") + 1).alias("i2"))


#: The scalar types of PLY and how many bytes they have.
PLY_SCALARS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}
PLY_FACES = ("vertex_indices", "vertex_index", "vertices", "verts")
PLY_PARTS = "vid long, x double, y double, z double, i0 long, i1 long, i2 long, error string"


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files at a path, each read whole by one task."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _ply_header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, ...]]]], int]:
    """A PLY header's format, its elements as (name, count, properties), and where the data begin."""
    end = content.find(b"end_header")
    line = content.find(b"\n", end)
    if not content.startswith(b"ply") or end < 0 or line < 0:
        raise ValueError("no PLY header")
    kind, elements = "", []
    for words in (x.split() for x in content[:end].decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"]:
            kind = words[1]
        elif words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"] and elements:
            elements[-1][2].append(tuple(words[1:]))
    return kind, elements, line + 1


def _ply_element(data: memoryview, at: int, count: int, properties: list[tuple[str, ...]], order: str) -> tuple[dict[str, object], int]:
    """An element's columns by name, and where the next begins. Records of equal list lengths are decoded at once, others one by one."""
    kind = lambda t: np.dtype(order + PLY_SCALARS[t])
    sizes, here = {}, at
    for p in properties if count else ():  # lengths of the first record's lists
        if p[0] == "list":
            sizes[p[3]] = int(np.frombuffer(data, kind(p[1]), 1, here)[0])
            here += kind(p[1]).itemsize + sizes[p[3]] * kind(p[2]).itemsize
        else:
            here += kind(p[0]).itemsize
    record = np.dtype([f for p in properties for f in ([(f"#{p[3]}", kind(p[1])), (p[3], kind(p[2]), (sizes.get(p[3], 0),))] if p[0] == "list" else [(p[1], kind(p[0]))])])
    if at + record.itemsize * count <= len(data):
        rows = np.frombuffer(data, record, count, at)
        if all((rows[f"#{n}"] == size).all() for n, size in sizes.items()):
            return {n: rows[n] for n in record.names if n[0] != "#"}, at + record.itemsize * count
    out: dict[str, list] = {p[-1]: [] for p in properties}
    for _ in range(count):
        for p in properties:
            n, t = 1, kind(p[0]) if p[0] != "list" else kind(p[2])
            if p[0] == "list":
                n = int(np.frombuffer(data, kind(p[1]), 1, at)[0])
                at += kind(p[1]).itemsize
            value = np.frombuffer(data, t, n, at)
            at += t.itemsize * n
            out[p[-1]].append(value if p[0] == "list" else value[0])
    return out, at


def ply_mesh(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (n, 3) and triangles (m, 3) of a PLY file, binary of either byte order or ASCII. Polygons are fanned from their first vertex; those with an index out of range go. A file that is cut short, or is no PLY, is an error."""
    kind, elements, at = _ply_header(content)
    if kind == "ascii":
        order, numbers = "<", iter(content[at:].split())
        binary = bytearray()
        for _, count, properties in elements:
            for _ in range(count):
                for p in properties:
                    n, t = 1, p[0]
                    if p[0] == "list":
                        n, t = int(next(numbers, b"")), p[2]
                        binary += np.array([n], order + PLY_SCALARS[p[1]]).tobytes()
                    binary += np.array([float(next(numbers, b"")) for _ in range(n)]).astype(order + PLY_SCALARS[t]).tobytes()
        data, at = memoryview(bytes(binary)), 0
    elif kind in ("binary_little_endian", "binary_big_endian"):
        order, data = "<" if kind == "binary_little_endian" else ">", memoryview(content)
    else:
        raise ValueError(f"unknown PLY format {kind!r}")
    vertices, triangles = np.empty((0, 3)), []
    for name, count, properties in elements:
        found, at = _ply_element(data, at, count, properties, order)
        if name == "vertex":
            vertices = np.stack([np.asarray(found[n], dtype=float) for n in "xyz"], axis=1) if count else vertices
        elif name == "face" and count:
            lists = [p[3] for p in properties if p[0] == "list"]
            own = next((n for n in lists if n in PLY_FACES), lists[0] if lists else None)
            for ids in found[own] if own else ():
                ids = np.asarray(ids, dtype=np.int64)
                triangles.append(np.stack([np.full(max(0, len(ids) - 2), ids[0] if len(ids) else 0), ids[1:-1], ids[2:]], axis=1) if len(ids) > 2 else np.empty((0, 3), np.int64))
                if len(ids) and (ids.min() < 0 or ids.max() >= len(vertices)):
                    triangles.pop()
    return vertices, np.concatenate([np.empty((0, 3), np.int64), *triangles])


def ply_parts(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, vid, x, y, z, i0, i1, i2, error): a row for each vertex and each triangle of PLY contents; one with what is wrong where a file can't be read, or is null. Files are one row each, so one task's."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PLY_PARTS.split(", ")]
        for b in batches:
            for k, data in zip(b[key], b[content], strict=True):
                try:
                    v, t = ply_mesh(bytes(data) if data is not None else b"")
                except (ValueError, KeyError, IndexError, TypeError) as e:
                    yield pd.DataFrame([(k, *[None] * 7, str(e) or type(e).__name__)], columns=[key, *names]).astype({c: "Int64" for c in ("vid", "i0", "i1", "i2")})
                    continue
                corners = pd.DataFrame({"vid": range(len(v)), "x": v[:, 0], "y": v[:, 1], "z": v[:, 2]})
                whole = pd.concat([corners, pd.DataFrame(t, columns=["i0", "i1", "i2"])], ignore_index=True).reindex(columns=names).astype({c: "Int64" for c in ("vid", "i0", "i1", "i2")} | {"error": object})
                whole.insert(0, key, k)
                whole["error"] = None
                yield whole

    return df.select(key, content).mapInPandas(decode, f"{key} {dict(df.dtypes)[key]}, {PLY_PARTS}")


def ply_encoded(df: DataFrame, key: str, points: str, faces: str, big: str) -> DataFrame:
    """(key, content): meshes of points (arrays of three numbers) and faces (arrays of indices) as binary PLY, with the greatest byte first where big is true."""

    @F.pandas_udf("binary")
    def encode(p: pd.Series, f: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for ps, fs, is_big in zip(p, f, b, strict=True):
            order = ">" if is_big else "<"
            head = f"ply\nformat binary_{'big' if is_big else 'little'}_endian 1.0\nelement vertex {len(ps)}\nproperty float x\nproperty float y\nproperty float z\nelement face {len(fs)}\nproperty list int int vertex_indices\nend_header\n"
            body = [np.stack(ps).astype(order + "f4").tobytes()] if len(ps) else []
            body += [np.array([len(x), *x], dtype=order + "i4").tobytes() for x in fs]
            out.append(head.encode() + b"".join(body))
        return pd.Series(out)

    return df.select(key, encode(points, faces, big).alias("content"))


def calibration(text: Column) -> Column:
    """The numbers of a camera calibration text by name: lines of a percent sign, one letter, and a number. Of a letter that comes twice the last counts; lines that are no number are left out."""
    lines = F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s))
    pairs = F.transform(lines, lambda s: F.struct(F.regexp_extract(s, r"^%([A-Za-z])(?:[\s=:]|(?=[-+.0-9]))", 1).alias("k"), F.regexp_replace(s, r"^%[A-Za-z][\s=:]*", "").try_cast("double").alias("v")))
    pairs = F.filter(pairs, lambda p: (p["k"] != "") & p["v"].isNotNull())
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def records(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Review records of JSON payloads, whether one record, an export of a current and saved ones, or a list of records: (key, record)."""
    p = F.col(payload)
    whole, listed, one = F.from_json(p, EXPORT), F.from_json(p, f"array<{RECORD}>"), F.from_json(p, RECORD)
    export = F.concat(F.array(whole["current"]), F.coalesce(whole["saved"], F.array().cast(f"array<{RECORD}>")))
    found = F.when(F.startswith(F.trim(p), F.lit("[")), listed).when(F.startswith(F.coalesce(whole["schema_version"], F.lit("")), F.lit("incision-review-export")), export).otherwise(F.array(one))
    return df.select(key, F.explode(F.filter(found, lambda r: r["id"].isNotNull())).alias("record"))


def flat_rows(df: DataFrame, section: str, key: list[str]) -> DataFrame:
    """Numbers of a summary as rows of text for a CSV: section, name, metric, value."""
    named = F.concat_ws("/", *key) if key else F.lit("")
    numbers = [c for c in df.columns if c not in key]
    return df.select(F.lit(section).alias("section"), named.alias("name"), F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in numbers))).alias("m")).select("section", "name", "m.*")


def csv_field(c: Column) -> Column:
    """A field quoted where it holds a comma, quote or line end, quotes doubled."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
