"""Queries that write files in the formats of the sources, read them back by the readers, and their SQL over the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.operators import edges as ed
from covey.operators import information as info
from covey.operators import text as tx
from covey.plans import structure as st
from covey.session import delete_at_end, shared_folder
from covey.sources import io
from covey.sources import roles as R

S = R.SQL
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def new_folder(spark: SparkSession) -> str:
    """A folder in the shared folder, which goes when the driver's JVM ends."""
    folder = f"{shared_folder(spark)}/covey-files-{uuid.uuid4().hex}"
    delete_at_end(spark, folder)
    return folder


def _new(spark: SparkSession, name: str) -> str:
    return f"{new_folder(spark)}/{name}"


_NAME = "CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END"
_INNER = "CASE WHEN p_partkey % 4 = 0 AND p_partkey % 8 > 0 THEN p_brand END"
_ABOUT = "CASE WHEN p_partkey % 3 > 0 THEN p_type ELSE '' END"


@query(f"""WITH x AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS pack_id, coalesce(nullif({_NAME}, ''), {_INNER}) AS title, 'at://' || p_partkey AS uri, {_ABOUT} AS about FROM part)
SELECT pack_id, coalesce(title, uri) AS name, coalesce(title, '') AS title, CASE WHEN coalesce(title, '') = '' THEN about WHEN about = '' THEN title ELSE title || '. ' || about END AS text, 2::BIGINT AS members FROM x""")
def read_packs(spark, d):
    """Parts as pack lines with blank lines between; some have an empty name, a name in their record or only a URI."""
    member = F.array(*[F.struct(F.concat(F.lit("u"), (F.col("p_partkey") % k).cast("string")).alias("did")) for k in (7, 7)], F.struct(F.lit("all").alias("did")))
    record = F.struct(F.expr(_INNER).alias("name"), F.expr(_ABOUT).alias("description"))
    line = F.to_json(F.struct(F.expr(_NAME).alias("name"), record.alias("record"), F.concat(F.lit("at://"), F.col("p_partkey").cast("string")).alias("uri"), member.alias("members")))
    path = _new(spark, "packs.jsonl")
    lines = R.table(spark, d, "part").select("p_partkey", F.explode(F.array(line, F.lit(" "))).alias("value"))
    lines.repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey").select("value").write.text(path)
    packs = io.read_packs(spark, path)
    return packs.join(io.pack_texts(packs), "pack_id").select("pack_id", "name", "title", "text", F.size("members").cast("long").alias("members"))


@query(f"WITH {S['e']} SELECT source::VARCHAR AS source, target::VARCHAR AS target FROM e")
def read_edges_csv(spark, d):
    path = _new(spark, "edges.csv")
    R.edges(spark, d).withColumn("created_at", F.lit("2024-01-01")).write.csv(path)
    return io.read_edges(spark, path)


@query(f"WITH {S['e']} SELECT source, target FROM e")
def read_edges_parquet(spark, d):
    path = _new(spark, "edges.parquet")
    R.edges(spark, d).withColumn("created_at", F.lit("2024-01-01")).write.parquet(path)
    return io.read_edges(spark, path)


@query("SELECT c_custkey::VARCHAR AS node, 'listed' AS how FROM customer UNION ALL SELECT DISTINCT 'u' || p_partkey % 7, 'members' FROM part")
def read_nodes(spark, d):
    """The universe from a file of ids, and from the members of packs."""
    ids, packs = _new(spark, "nodes.txt"), _new(spark, "packs.jsonl")
    R.table(spark, d, "customer").select(F.explode(F.array(F.col("c_custkey").cast("string"), F.concat(F.lit(" "), F.col("c_custkey").cast("string")))).alias("value")).write.text(ids)
    member = F.struct(F.concat(F.lit("u"), (F.col("p_partkey") % 7).cast("string")).alias("did"))
    R.table(spark, d, "part").select(F.to_json(F.struct(F.col("p_name").alias("name"), F.array(member, member).alias("members"))).alias("value")).write.text(packs)
    return io.read_nodes(spark, nodes=ids).withColumn("how", F.lit("listed")).union(io.read_nodes(spark, packs=packs).withColumn("how", F.lit("members")))


@query(f"WITH {S['p']} SELECT kind, hops, count(*) AS n, sum(shared_packs)::BIGINT AS shared, round(avg(cosine), 9) AS mean FROM p, (VALUES ('csv'), ('parquet')) k(kind) GROUP BY 1, 2")
def read_pair_tables(spark, d):
    """The pair table by its two formats."""
    out = None
    for kind in ("csv", "parquet"):
        path = _new(spark, f"pairs.{kind}")
        io.write_table(R.pair_table(spark, d), path)
        one = io.read_table(spark, path).groupBy("hops").agg(F.count("*").alias("n"), F.sum("shared_packs").alias("shared"), F.round(F.avg("cosine"), 9).alias("mean"))
        one = one.select(F.lit(kind).alias("kind"), F.col("hops").cast("long").alias("hops"), "n", F.col("shared").cast("long").alias("shared"), "mean")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {S['e']} SELECT count(*) AS n FROM e")
def edge_count(spark, d):
    """Rows of a written edge table, from its footers."""
    path = _new(spark, "edges.parquet")
    io.write_table(R.edges(spark, d), path)
    return spark.createDataFrame([(io.row_count(spark, path),)], "n long")


@query(f"WITH {S['e']}, {st._NODES} SELECT source, target FROM e WHERE source NOT IN (SELECT node FROM u) AND target NOT IN (SELECT node FROM u)")
def replaced_table(spark, d):
    """A table that is read, reduced and put in its own place."""
    path = _new(spark, "edges.parquet")
    io.write_table(R.edges(spark, d), path)
    io.write_table(ed.without(spark.read.parquet(path), st._nodes(spark, d)), path)
    return spark.read.parquet(path)


@query(f"WITH {S['e']} SELECT DISTINCT source::VARCHAR AS source, target::VARCHAR AS target FROM e WHERE source <> target")
def cached_graph(spark, d):
    edges, cache = _new(spark, "edges.csv"), _new(spark, "graph")
    R.edges(spark, d).withColumn("created_at", F.lit("")).write.csv(edges)
    io.cached_graph(spark, edges, cache, rebuild=True)
    return io.cached_graph(spark, edges, cache)


@query(f"WITH {S['p']} SELECT DISTINCT unnest([user_a, user_b]) AS user_id FROM p")
def read_pair_users(spark, d):
    path = _new(spark, "pairs.parquet")
    R.pair_table(spark, d).write.parquet(path)
    return io.read_users(spark, path)


@query("SELECT c_custkey::VARCHAR AS user_id, row_number() OVER (ORDER BY c_custkey DESC) - 1 AS place FROM customer")
def read_listed_users(spark, d):
    """A file of one id a line, each id twice: the order of first mention stays."""
    path = _new(spark, "users.txt")
    ids = R.table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.col("c_custkey").cast("string"), F.lit(""), F.col("c_custkey").cast("string"))).alias("value"))
    ids.repartitionByRange(3, F.desc("c_custkey")).sortWithinPartitions(F.desc("c_custkey")).select("value").write.text(path)
    return io.read_users(spark, path, ordered=True)


@query(f"WITH {S['dm']} SELECT pack_id::VARCHAR AS node, count(*) AS degree FROM dm GROUP BY 1")
def interchange_degrees(spark, d):
    path = _new(spark, "graph.json")
    link = F.struct(F.col("user_id").cast("string").alias("edge"), F.col("pack_id").cast("string").alias("node"))
    R.dense_membership(spark, d).agg(F.to_json(F.struct(F.collect_list(link).alias("incidences"))).alias("value")).write.text(path)
    return io.interchange_degrees(spark, path)


@query("SELECT o_orderkey AS user_id, o_orderdate - CASE WHEN o_orderkey % 7 = 2 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END AS created_at FROM orders WHERE o_orderkey % 7 <> 0")
def dated_posts(spark, d):
    """Times as text, some no times at all, some with an offset, the others in UTC."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    key = F.col("o_orderkey") % 7
    text = F.when(key == 0, "no time").when(key == 1, F.concat(at, F.lit("Z"))).when(key == 2, F.concat(at, F.lit("+02:00"))).otherwise(at)
    posts = R.table(spark, d, "orders").select(F.col("o_orderkey").alias("user_id"), text.alias("created"))
    return tx.dated(tx.parsed_times(posts, "created")).select("user_id", "created_at")


def _normal(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^{tx.SPACE}+|{tx.SPACE}+$', '', 'g'), '{tx.LINE_BREAKS}', ' ', 'g')"


def _broken(char) -> str:
    """Texts of every third turn with outer white space and line breaks of all kinds put in."""
    return f"CASE WHEN turn % 3 = 1 THEN {char(8195)} || {char(11)} || replace(text, ', ', CASE turn % 2 WHEN 0 THEN {char(8232)} ELSE {char(13)} || {char(10)} END) || {char(133)} || {char(28)} ELSE text END"


_BROKEN = _broken(lambda c: f"chr({c})")


@query(f"SELECT conv_id AS user_id, turn, {_normal(_BROKEN)} AS text FROM conversations")
def normalised_posts(spark, d):
    return R.posts(spark, d).withColumn("text", F.expr(_broken(lambda c: f"'{chr(c)}'"))).select("user_id", "turn", tx.normalised().alias("text"))


@query(f"""WITH w AS (SELECT conv_id, turn, {_normal(_BROKEN)} AS t, turn % 4 = 2 AS q FROM conversations WHERE turn % 5 <> 3),
po AS (SELECT conv_id, count(*) AS posts, count(*) FILTER (WHERE q) AS quotes, md5(string_agg(t, ' ' ORDER BY turn, t)) AS text_hash FROM w WHERE t <> '' GROUP BY 1),
li AS (SELECT conv_id, count(*) + CASE WHEN conv_id % 3 < 2 THEN 1 ELSE 0 END AS lines, CASE WHEN conv_id % 3 < 2 THEN 1 ELSE 0 END AS malformed FROM conversations GROUP BY 1)
SELECT c_custkey::VARCHAR AS user_id, coalesce(lines, 0) AS lines, coalesce(malformed, 0)::BIGINT AS malformed, coalesce(posts, 0) AS posts, coalesce(quotes, 0) AS quotes, text_hash
FROM customer LEFT JOIN li ON li.conv_id = c_custkey LEFT JOIN po ON po.conv_id = c_custkey""")
def read_posts(spark, d):
    """Conversations as gzipped record files, one for each user, with other collections, broken and blank lines; users without a file have nothing."""
    path = f"{new_folder(spark)}/records"
    rows = R.posts(spark, d).withColumn("text", F.expr(_broken(lambda c: f"'{chr(c)}'")))
    embed = F.struct(F.expr(f"CASE WHEN turn % 4 = 2 THEN '{io.QUOTES[0]}' END").alias("$type"))
    record = F.struct("text", F.concat(F.lit("2024-01-01T00:"), F.lpad(F.col("turn").cast("string"), 2, "0"), F.lit(":00Z")).alias("createdAt"), embed.alias("embed"))
    line = F.to_json(F.struct(F.struct(F.expr(f"CASE WHEN turn % 5 = 3 THEN 'app.bsky.feed.like' ELSE '{io.POST}' END").alias("collection")).alias("commit"), record.alias("record")))
    broken = F.when(F.col("user_id") % 3 == 0, F.lit('{"commit": {"collection": "app.bsky.feed.post"}, "record": ')).when(F.col("user_id") % 3 == 1, F.lit("no event")).otherwise(F.lit(" "))
    lines = rows.select("user_id", line.alias("value")).union(rows.select("user_id").distinct().select("user_id", broken))
    lines.withColumnRenamed("user_id", "user").repartition("user").write.partitionBy("user").option("compression", "gzip").text(path)
    records = io.read_records(spark, path, user=r"/user=([^/]+)/")
    users = R.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("created_at", "text"))), lambda p: p["text"]), " ")
    posts = io.posts_of(records).groupBy("user_id").agg(F.count_if("is_quote").alias("quotes"), F.md5(texts).alias("text_hash"))
    return io.record_counts(records, users).join(posts, "user_id", "left").fillna(0, ["quotes"])


_SOME = "CASE WHEN p_partkey % 10 = 4 THEN 'new ' || p_name ELSE p_name END"


@query("""SELECT 1 AS step, count(*) FILTER (WHERE p_partkey % 2 = 0) AS encoded, count(*) FILTER (WHERE p_partkey % 2 = 0) AS held FROM part UNION ALL SELECT 2, count(*) FILTER (WHERE p_partkey % 2 = 1), count(*) FROM part
UNION ALL SELECT 3, count(*) FILTER (WHERE p_partkey % 10 = 4), count(*) FROM part UNION ALL SELECT 4, count(*), count(*) FROM part UNION ALL SELECT 5, 0, count(*) FROM part""")
def embedding_cache(spark, d):
    """Half of the packs are encoded, then all, then some with another text, then all by another model, and then none: each time only what the cache lacks."""
    path = f"{new_folder(spark)}/cache"
    parts = R.table(spark, d, "part").select(F.col("p_partkey").alias("pack_id"), F.col("p_name").alias("text"), F.expr(_SOME).alias("other"))
    renamed = parts.select("pack_id", F.col("other").alias("text"))
    rows = []
    for step, (texts, model) in enumerate(((parts.where("pack_id % 2 = 0"), "a"), (parts, "a"), (renamed, "a"), (renamed, "b"), (parts, "a")), 1):
        found, encoded = info.update_embeddings(texts.select("pack_id", "text"), path, info.hashing_encoder, model)
        rows.append((step, encoded, found.select("pack_id").distinct().count()))
    return spark.createDataFrame(rows, "step int, encoded long, held long")


@query("SELECT conv_id AS user_id, md5(string_agg(text, ' ' ORDER BY turn, text)) AS text_hash FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def user_documents(spark, d):
    return tx.user_documents(R.posts(spark, d)).select("user_id", F.md5("text").alias("text_hash"))
