"""Readers and writers for multi-label file formats.

Bodies are read and parsed by Spark (``spark.read.text`` + string functions),
so a large file is split across tasks.  Only the small metadata — the ARFF
header lines, the label XML — is read on the driver.  Writers produce the
header as its own small file next to the distributed body part files; readers
accept either a single file or such a directory.
"""

from __future__ import annotations

import re
import json
import os
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polytag.frame import MLFrame
from polytag.session import scratch_path


# ------------------------------------------------------------------ ARFF


def parse_arff_header(lines: list[str]) -> list[tuple[str, str, list[str] | None]]:
    """[(name, kind, nominal values)] from '@attribute' lines, in order; kind is 'numeric',
    'nominal' or 'string'."""
    out = []
    for ln in lines:
        s = ln.strip()
        if not s.lower().startswith("@attribute"):
            continue
        rest = s[len("@attribute"):].strip()
        if rest.startswith("'"):
            end = rest.index("'", 1)
            name, typ = rest[1:end], rest[end + 1:].strip()
        else:
            name, typ = rest.split(None, 1)
        if typ.startswith("{"):
            vals = [v.strip().strip("'\"") for v in re.findall(r"""'[^']*'|"[^"]*"|[^,]+""", typ.strip("{}").strip())]
            vals = [v for v in vals if v]
            out.append((name, "nominal", vals))
        elif typ.lower() in ("numeric", "real", "integer"):
            out.append((name, "numeric", None))
        else:
            out.append((name, "string", None))
    return out


def read_label_xml(spark: SparkSession, path: str) -> tuple[list[str], list[tuple[str, str | None]]]:
    """(label names in document order, (label, parent) edges) from a labels XML file; the small
    metadata file is read whole and parsed on the driver."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    root = ET.fromstring(text)
    names, edges = [], []

    def walk(node, parent):
        for ch in node:
            if ch.tag.split("}")[-1] == "label":
                nm = ch.attrib["name"]
                names.append(nm)
                edges.append((nm, parent))
                walk(ch, nm)

    walk(root, None)
    return names, edges


_QUOTED = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*\""""
#: a cell is quoted text or anything up to a comma; group 1 (dense) or index and value (sparse)
QUOTED_DENSE = rf"\s*({_QUOTED}|[^,]*)\s*(?:,|$)"
QUOTED_SPARSE = rf"\s*(\d+)\s+({_QUOTED}|[^,]*)\s*(?:,|$)"


def read_arff(spark: SparkSession, path: str, labels: list[str] | None = None, n_labels: int | None = None,
              labels_first: bool = False, id_col: str | None = None) -> MLFrame:
    """ARFF (dense 'a,b,c' or sparse '{i v,...}' rows) -> MLFrame.  Labels come from ``labels``
    (for example read from the XML) or are the last (first) ``n_labels`` attributes.  A nominal
    label is 1 when its value is the string '1' (a {1,0} declaration flips the index, not the value).
    A line that begins with % is a comment anywhere, as the format has it; one that begins with @ only before @data."""
    # a line's place: the split it lies in, then its order in the split; header lines are those up to the first @data of a file
    # with a @relation line, and every line of a file without one is data
    where = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    txt = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), where.alias("_at"))
    word = F.lower(F.trim("value"))
    marks = txt.groupBy("_file").agg(F.min(F.when(word.rlike(r"^@data\s*$"), F.col("_at"))).alias("_data"), F.max(word.startswith("@relation")).alias("_head")).filter("_head")
    lines = txt.join(F.broadcast(marks), "_file", "left")  # one row per header file
    header = [r["value"] for r in lines.filter("_head and (_data is null or _at <= _data)").filter(F.trim("value").startswith("@")).orderBy("_file", "_at").collect()]
    attrs = parse_arff_header(header)
    names = [a[0] for a in attrs]
    if labels is None:
        labels = names[:n_labels] if labels_first else names[-n_labels:]
    body = lines.filter(F.col("_head").isNull() | (F.col("_at") > F.col("_data"))).filter((F.trim("value") != "") & ~F.trim("value").rlike(r"^%"))
    if id_col is None:  # an id that does not depend on how the file is split: the row's content and its number among equal rows
        body = body.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).select("value", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k"))
        body = body.select("value", F.xxhash64("value", "_k").alias("_id"))
    else:
        body = body.select("value", F.lit(None).cast("long").alias("_id"))
    v = F.trim("value")
    sparse = v.startswith("{")
    inner = F.regexp_replace(v, r"^\{|\}$", "")
    # sparse: {i v, j w} -> map of index -> value; unspecified numeric/nominal cells are 0 / first value
    cell = F.lit(QUOTED_SPARSE)
    smap = F.map_from_arrays(F.transform(F.regexp_extract_all(inner, cell, F.lit(1)), lambda i: i.cast("int")), F.transform(F.regexp_extract_all(inner, cell, F.lit(2)), lambda c: F.trim(c)))
    dense = F.transform(F.regexp_extract_all(v, F.lit(QUOTED_DENSE), F.lit(1)), lambda c: F.trim(c))
    x = body.select("_id", F.when(sparse, smap).alias("_m"), F.when(~sparse, dense).alias("_d"))
    cols = []
    for i, (nm, kind, vals) in enumerate(attrs):
        default = "0" if kind != "nominal" else vals[0]
        raw = F.coalesce(F.get("_d", F.lit(i)), F.coalesce(F.element_at("_m", F.lit(i)), F.lit(default)))
        bare = raw == "?"
        raw = F.regexp_replace(raw, r"""^(['"])(.*)\1$""", "$2")
        if nm in labels:
            cols.append(F.when(bare, None).otherwise((raw == "1").cast("int")).alias(nm))
        elif kind == "numeric":
            cols.append(F.when(bare, None).otherwise(raw.try_cast("double")).alias(nm))  # text that is no number is missing
        else:
            cols.append(F.when(bare, None).otherwise(raw).alias(nm))
    df = x.select(*cols, *([F.col("_id").alias("id")] if id_col is None else []))
    feats = [n for n in names if n not in labels and n != id_col]
    id_col = id_col or "id"
    return MLFrame.from_wide(df, labels, feats, id_col)


def write_arff(mlf: MLFrame, path: str, relation: str = "data", id_col: str | None = "id") -> str:
    """Dense ARFF: a one-file header (attribute lines) plus body part files written by Spark."""
    spark = mlf.df.sparkSession
    schema = {f.name: f.dataType.simpleString() for f in mlf.df.schema.fields}
    feats = ([id_col] if id_col else []) + list(mlf.features)
    lines = [f"@relation {relation}"]
    nominal = {}
    for f in feats:
        if schema.get(f) == "string":
            vals = sorted(r[0] for r in mlf.df.select(f).distinct().collect() if r[0] is not None)  # feature-sized
            nominal[f] = vals
            lines.append("@attribute %s {%s}" % (f, ",".join(vals)))
        else:
            lines.append(f"@attribute {f} numeric")
    lines += [f"@attribute {lab} {{0,1}}" for lab in mlf.labels]
    lines.append("@data")
    spark.createDataFrame([(ln,) for ln in lines], "value string").coalesce(1).write.mode("overwrite").text(path + "/header")
    cell = [F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in feats]
    cell += [F.coalesce(F.col(mlf.y_col)[j].cast("string"), F.lit("?")) for j in range(mlf.L)]
    mlf.df.select(F.concat_ws(",", *cell).alias("value")).write.mode("overwrite").text(path + "/body")
    return path


def read_arff_dir(spark: SparkSession, path: str, labels: list[str], id_col: str = "id") -> MLFrame:
    """Read an ARFF written by ``write_arff`` (header file + body parts)."""
    return read_arff(spark, [path + "/header", path + "/body"], labels=labels, id_col=id_col)  # type: ignore[arg-type]


# ------------------------------------------------------------------ multi-label LibSVM


def write_libsvm(mlf: MLFrame, path: str, numeric_features: list[str]) -> str:
    """Lines 'l1,l2 1:v 2:w' (labels 0-based, features 1-based, zeros omitted)."""
    labs = F.array_join(F.transform(F.filter(F.transform(mlf.y_col, lambda t, i: F.when(t == 1, i)), lambda v: v.isNotNull()),
                                    lambda i: i.cast("string")), ",")
    feats = F.array(*[F.when(F.col(f).cast("double") != 0, F.concat(F.lit(f"{i + 1}:"), F.col(f).cast("double").cast("string")))
                      for i, f in enumerate(numeric_features)])
    line = F.concat_ws(" ", labs, F.array_join(F.filter(feats, lambda s: s.isNotNull()), " "))
    mlf.df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def read_libsvm_ml(spark: SparkSession, path: str, n_features: int | None = None) -> MLFrame:
    """Multi-label LibSVM -> MLFrame with dense features x1..xd and y (numLabels = max label + 1)."""
    txt = spark.read.text(path).filter(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    first = F.get(parts, F.lit(0))
    has_labels = ~first.contains(":")
    labs = F.when(has_labels, F.transform(F.split(first, ","), lambda s: s.cast("int"))).otherwise(F.array().cast("array<int>"))
    kv = F.filter(parts, lambda s: s.contains(":"))
    fmap = F.map_from_entries(F.transform(kv, lambda s: F.struct(F.split(s, ":")[0].cast("int").alias("k"),
                                                                  F.split(s, ":")[1].cast("double").alias("v"))))
    # an id that does not depend on how the files are split: the row's content and its number among equal rows
    once = txt.groupBy("value").agg(F.count(F.lit(1)).alias("_n")).select("value", F.explode(F.sequence(F.lit(1).cast("long"), "_n")).alias("_k"))
    x = once.select(labs.alias("_l"), fmap.alias("_f"), F.xxhash64("value", "_k").alias("id"))
    st = x.agg(F.max(F.array_max("_l")).alias("ml"), F.max(F.array_max(F.map_keys("_f"))).alias("mf")).first()
    L = int(st["ml"]) + 1
    d = n_features or int(st["mf"])
    feats = [f"x{i}" for i in range(1, d + 1)]
    df = x.select(*[F.coalesce(F.element_at("_f", F.lit(i)), F.lit(0.0)).alias(f"x{i}") for i in range(1, d + 1)],
                  F.transform(F.sequence(F.lit(0), F.lit(L - 1)), lambda j: F.array_contains("_l", j).cast("int")).alias("y"), "id")
    return MLFrame(df, tuple(f"L{j}" for j in range(L)), tuple(feats))


# ------------------------------------------------------------------ hierarchical class cells


def read_hier_csv(spark: SparkSession, path: str, class_col: str = "class", sep: str = ",") -> tuple[DataFrame, list[str]]:
    """CSV whose class cell lists paths 'a/b@c'; every listed path and all its ancestors are set.
    Returns (df with 'labels' ARRAY<STRING> of node paths, sorted distinct node paths)."""
    df = spark.read.option("header", True).option("sep", sep).csv(path)
    paths = F.split(F.col(class_col), "@")
    nodes = F.flatten(F.transform(paths, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(F.split(p, "/"))), lambda k: F.array_join(F.slice(F.split(p, "/"), 1, k), "/"))))
    out = df.withColumn("labels", F.array_distinct(nodes))
    names = sorted(r[0] for r in out.select(F.explode("labels")).distinct().collect())  # label-sized
    return out, names


# ------------------------------------------------------------------ text vectors


def read_text_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Space-separated doubles per line -> (vec ARRAY<DOUBLE>)."""
    return spark.read.text(path).filter(F.trim("value") != "").select(
        F.transform(F.split(F.trim("value"), r"\s+"), lambda s: s.cast("double")).alias("vec"))


# ------------------------------------------------------------------ parquet data sets and models


def write_ml_parquet(mlf: MLFrame, path: str) -> str:
    """Rows as Parquet plus a small JSON sidecar with label/feature names and the tree edges."""
    mlf.df.write.mode("overwrite").parquet(path + "/rows")
    meta = {"labels": list(mlf.labels), "features": list(mlf.features), "id": mlf.id_col, "y": mlf.y_col}
    if mlf.tree is not None:
        meta["tree"] = [r.asDict() for r in mlf.tree.collect()]  # label-sized
    mlf.df.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")
    return path


def read_ml_parquet(spark: SparkSession, path: str) -> MLFrame:
    meta = json.loads(spark.read.text(path + "/meta").first()["value"])
    df = spark.read.parquet(path + "/rows")
    tree = spark.createDataFrame(meta["tree"]) if meta.get("tree") else None
    return MLFrame(df, tuple(meta["labels"]), tuple(meta["features"]), meta["id"], meta["y"], tree)


def save_nb_model(model, path: str) -> str:
    """Persist a count-based model: weight table as Parquet, constants and attributes as JSON."""
    spark = model.weights.sparkSession
    model.weights.write.mode("overwrite").parquet(path + "/weights")
    meta = {"keys": model.keys, "features": model.features, "n_weights": model.n_weights, "const": model.const,
            "extra": {k: v for k, v in model.__dict__.items() if k in ("chain", "groups", "pruned")}}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(path + "/meta")
    return path


def load_nb_model(spark: SparkSession, path: str):
    from polytag.operators.nb import NBModel

    meta = json.loads(spark.read.text(path + "/meta").first()["value"])
    m = NBModel(meta["keys"], meta["features"], spark.read.parquet(path + "/weights"), meta["n_weights"], meta["const"])
    for k, v in meta.get("extra", {}).items():
        setattr(m, k, v)
    return m


def write_label_xml(spark: SparkSession, edges: list[tuple[str, str | None]], path: str) -> str:
    """Nested labels XML from (label, parent) edges (label-sized metadata, one small file)."""
    kids: dict[str | None, list[str]] = {}
    for lab, par in edges:
        kids.setdefault(par, []).append(lab)

    def emit(node, ind):
        out = []
        for ch in kids.get(node, []):
            if kids.get(ch):
                out.append(f'{ind}<label name="{ch}">')
                out += emit(ch, ind + "  ")
                out.append(f"{ind}</label>")
            else:
                out.append(f'{ind}<label name="{ch}"/>')
        return out

    lines = ['<?xml version="1.0" encoding="utf-8"?>', "<labels>"] + emit(None, "  ") + ["</labels>"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("os",)]
