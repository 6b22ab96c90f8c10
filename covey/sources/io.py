"""Readers and writers of the formats that the operators take."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from covey.operators.information import english
from covey.operators.text import normalised, parsed_times

EVENT = "commit struct<collection:string>, record struct<text:string,createdAt:string,embed:struct<`$type`:string>>"
#: Collection of the records that are posts, and the embeds that make one a quotation; fixed values of the record format.
POST, QUOTES = "app.bsky.feed.post", ("app.bsky.embed.record", "app.bsky.embed.recordWithMedia")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and place of the lines that are not blank: 0, 1, ... in the order of files (by path) and lines.

    Lines are counted for each block of a file (a row each); within a block the order is that of reading.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    lines = lines.where(F.col("value").rlike(r"(?U)\S")).withColumn("id", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "start").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("file", "start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(blocks.select("file", "start", "first", before.alias("before")), ["file", "start"]).select("value", (F.col("before") + F.col("id") - F.col("first")).alias("place"))


def _parsed(value: str = "value"):
    """A JSON line as a variant; bare NaN and Infinity count as null, anything else that is no JSON is an error."""
    mended = F.regexp_replace(value, r"([:\[,]\s*)(?:NaN|-?Infinity)(?=\s*[,}\]])", "$1null")
    return F.coalesce(F.try_parse_json(value), F.try_parse_json(mended), F.parse_json(value))


def _at(path: str) -> Column:
    return F.try_variant_get("v", f"$.{path}", "variant")


def _holds(v: Column) -> Column:
    """Whether a value counts as one: there, not null, not false, not 0, not empty."""
    kind, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    empty = (kind == "VOID") | ((kind == "STRING") & (text == "")) | ((kind == "BOOLEAN") & (text == "false")) | kind.isin("ARRAY<VOID>", "OBJECT<>")
    zero = F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False)) & (kind != "STRING") & (kind != "BOOLEAN")
    return v.isNotNull() & ~F.coalesce(empty | zero, F.lit(True))


def _first(*values: Column) -> Column:
    return F.coalesce(*[F.when(_holds(v), v) for v in values])


def _as_text(v: Column) -> Column:
    """A string without outer white space; anything else is empty."""
    text = F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    return F.coalesce(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), F.lit(""))


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """pack_id (place among the lines that are not blank), name, title, description, own_description, members (distinct).

    name is the first that is not empty of the pack's name, its record's and its uri. title (of the pack or its
    record) and description (of the record or the pack) are texts, empty where they are no strings.
    own_description is the pack's own, as it is.
    """
    rows = numbered_lines(spark, path).select(F.col("place").alias("pack_id"), _parsed().alias("v"))
    members = F.from_json(F.to_json(_at("members")), "array<struct<did:string>>")
    name = F.coalesce(F.try_variant_get(_first(_at("name"), _at("record.name")), "$", "string"), F.try_variant_get("v", "$.uri", "string"))
    return rows.select(
        "pack_id", name.alias("name"), _as_text(_first(_at("name"), _at("record.name"))).alias("title"), _as_text(_first(_at("record.description"), _at("description"))).alias("description"),
        F.try_variant_get("v", "$.description", "string").alias("own_description"), F.coalesce(F.array_compact(F.array_distinct(F.transform(members, lambda m: m["did"]))), F.expr("cast(array() AS array<string>)")).alias("members"),
    )


def pack_texts(packs: DataFrame, include_name: bool = True) -> DataFrame:
    """pack_id, text ("title. description", what is empty left out) and its MD5. packs: pack_id, title, description."""
    parts = [F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit("")) for c in (["title"] if include_name else []) + ["description"]]
    return packs.select("pack_id", F.concat_ws(". ", *parts).alias("text")).withColumn("text_hash", F.md5("text"))


def described_packs(packs: DataFrame, column: str = "own_description") -> DataFrame:
    """Packs whose own description is not empty; null is kept."""
    return packs.where(F.col(column).isNull() | (F.col(column) != ""))


def described_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of a pack file whose top-level description is not empty; null is kept, a line without the key is an error, and so is a blank one."""
    rows = spark.read.text(path).withColumn("v", F.parse_json("value"))
    there = F.when(F.try_variant_get("v", "$.description", "variant").isNull(), F.raise_error(F.lit("a pack without a description"))).otherwise(F.lit(True))
    return rows.where(there.cast("boolean") & F.coalesce(F.try_variant_get("v", "$.description", "string") != "", F.lit(True))).select("value")


def record_path(did: str = "did"):
    """Path of a user's records under the records folder: three levels of leading characters."""
    return F.concat_ws("/", F.substring(did, 1, 1), F.substring(did, 1, 2), F.substring(did, 1, 3), F.concat(F.col(did), F.lit(".jsonl.gz")))


#: Where a record file's path names its user: the file itself.
USER = r"([^/]+)\.jsonl(?:\.gz)?$"


def read_records(spark: SparkSession, paths: str | list[str], user: str = USER, holding: str | None = None) -> DataFrame:
    """user_id, e (the event) and malformed, for each line of record files that is not blank.

    Many small files share a task (Spark packs them by size). A line that is no JSON, or whose fields have other
    types, is malformed and has no event. user: pattern of the path, with the user in its first group. Of
    the lines only those that contain `holding`, if given, are parsed.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    raw = raw.where(F.col("value").contains(holding) if holding else F.col("value").rlike(r"(?U)\S"))
    event = F.from_json("value", f"{EVENT}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = raw.select(F.regexp_extract(F.input_file_name(), user, 1).alias("user_id"), event.alias("e"))
    bad = F.col("e").isNull() | F.col("e._bad").isNotNull()
    return rows.select("user_id", F.when(~bad, F.struct("e.commit", "e.record")).alias("e"), bad.alias("malformed"))


def posts_of(records: DataFrame, quotes: bool = True, english_only: bool = False) -> DataFrame:
    """user_id, created_at (null if it can't be read), text (one line), is_quote of the posts among read_records()'s rows; blank texts are left out."""
    text = normalised("e.record.text")
    posts = records.where(F.col("e.commit.collection") == POST).select("user_id", F.col("e.record.createdAt").alias("created"), text.alias("text"), F.coalesce(F.col("e.record.embed.`$type`").isin(*QUOTES), F.lit(False)).alias("is_quote"))
    posts = parsed_times(posts.where(F.col("text") != ""), "created").select("user_id", "created_at", "text", "is_quote")
    if english_only:
        posts = posts.where(english())
    return posts if quotes else posts.where(~F.col("is_quote"))


def read_posts(spark: SparkSession, paths: str | list[str], quotes: bool = True, english_only: bool = False, user: str = USER) -> DataFrame:
    """posts_of() the record files."""
    return posts_of(read_records(spark, paths, user, holding=POST), quotes, english_only)


def record_counts(records: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, lines, malformed and posts of each of users (user_id); a user without a file has none."""
    counts = records.groupBy("user_id").agg(F.count("*").alias("lines"), F.count_if("malformed").alias("malformed"))
    counts = counts.join(posts_of(records).groupBy("user_id").agg(F.count("*").alias("posts")), "user_id", "left")
    return users.select("user_id").distinct().join(counts, "user_id", "left").fillna(0, ["lines", "malformed", "posts"])


def read_edges(spark: SparkSession, path: str, columns: tuple[str, ...] = ("source", "target", "created_at"), header: bool = False, source: str = "source", target: str = "target") -> DataFrame:
    """Edges from Parquet, or from CSV with the columns in this order; only the two ends are read."""
    if path.rstrip("/").endswith(".parquet"):
        edges = spark.read.parquet(path)
    else:
        edges = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", header).csv(path)
    return edges.select(F.col(source).alias("source"), F.col(target).alias("target"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet or CSV, by the name."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def read_users(spark: SparkSession, path: str, column: str | None = None, ordered: bool = False) -> DataFrame:
    """Distinct user_id from a text file, a column, a column `did`, or both ends of pairs; ordered adds place, by which each comes first.

    Places are given by one sort of the distinct users: for query sets, which are small.
    """
    if path.endswith(".txt"):
        out = numbered_lines(spark, path).select(F.trim("value").alias("user_id"), F.lit(0).alias("part"), "place")
    else:
        table = read_table(spark, path)
        names = [column] if column else ["did"] if "did" in table.columns else ["user_a", "user_b"]
        table, out = table.withColumn("place", F.monotonically_increasing_id()), None
        for k, n in enumerate(names):
            one = table.select(F.col(n).alias("user_id"), F.lit(k).alias("part"), "place")
            out = one if out is None else out.union(one)
    out = out.where("user_id IS NOT NULL").groupBy("user_id").agg(F.min(F.struct("part", "place")).alias("at"))
    return out.select("user_id", (F.row_number().over(W.orderBy("at")) - 1).alias("place")) if ordered else out.select("user_id")


def read_nodes(spark: SparkSession, packs: str | None = None, nodes: str | None = None) -> DataFrame:
    """The universe of nodes (node): a file of one id a line, or the members of all packs."""
    if nodes:
        return read_users(spark, nodes).withColumnRenamed("user_id", "node")
    return read_packs(spark, packs).select(F.explode("members").alias("node")).distinct()


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table from its footers: no column is read."""
    return spark.read.parquet(path).select().count()


def cached_graph(spark: SparkSession, edges: str, cache: str, directed: bool = True, rebuild: bool = False) -> DataFrame:
    """The distinct edges of an edge file, written once to `cache`, sorted by source, and read from there on; rebuild writes it anew."""
    from covey.operators.graph import load

    done = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    fs = done.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if rebuild or not fs.exists(done):
        graph = load(read_edges(spark, edges), directed)
        graph.repartition("source").sortWithinPartitions("source", "target").write.mode("overwrite").parquet(cache)
    return spark.read.parquet(cache)


def read_embeddings(table: DataFrame) -> DataFrame:
    """pack_id and embedding, brought to length 1; rows of length 0 stay as they are."""
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return table.withColumn("embedding", F.when(norm > 0, F.transform("embedding", lambda x: x.cast("double") / norm)).otherwise(F.transform("embedding", lambda x: x.cast("double"))))


def write_table(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Parquet, or CSV by the name; an empty result is refused.

    The new table is written beside the old one, which is then renamed, replaced by the new one and only
    then deleted: whenever this stops, one of the two is there, whole, under path or path.old-*.
    """
    if df.isEmpty():
        raise ValueError("the result is empty; nothing is written")
    mark = uuid.uuid4().hex
    part, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    (df.write.option("header", True).csv if path.endswith(".csv") else df.write.option("compression", compression).parquet)(part)
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    replaced = fs.exists(at(path))
    if replaced and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} can't be moved aside; the new table is {part}")
    if not fs.rename(at(part), at(path)):
        if replaced:
            fs.rename(at(old), at(path))
        raise OSError(f"{part} can't be moved to {path}")
    if replaced:
        fs.delete(at(old), True)


def read_manifest(path: str) -> dict[str, str]:
    """`key : value` and `K=V K=V` lines of a run's manifest."""
    out: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        if " : " in line:
            key, _, value = line.partition(" : ")
            out[key.strip()] = value.strip()
        else:
            out |= dict(x.split("=", 1) for x in line.split() if "=" in x)
    return out


def interchange_degrees(spark: SparkSession, path: str) -> DataFrame:
    """node and degree from a hypergraph interchange file (`incidences` of node and edge)."""
    doc = spark.read.option("multiLine", True).schema("incidences array<struct<edge:string,node:string>>").json(path)
    return doc.select(F.explode("incidences").alias("i")).select("i.node", "i.edge").distinct().groupBy("node").agg(F.count("*").alias("degree"))


def write_posts(folder: str, did: str, events: list[dict]) -> str:
    """One user's records as gzipped JSON lines at their place under folder; for tests and small exports."""
    path = Path(folder, did[0], did[:2], did[:3], f"{did}.jsonl.gz")
    os.makedirs(path.parent, exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.writelines(json.dumps(e) + "\n" for e in events)
    return str(path)
