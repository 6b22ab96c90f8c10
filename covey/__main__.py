"""python -m covey COMMAND --help: the analyses over files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covey.operators import edges as ed
from covey.operators import graph as gr
from covey.operators import membership as mb
from covey.operators import pairs as pr
from covey.operators import text as tx
from covey.plans import analyses as an
from covey.plans import figures
from covey.session import session
from covey.sources import io


def _membership(spark: SparkSession, a) -> DataFrame:
    return mb.build(io.read_packs(spark, a.packs))


def _docs(spark: SparkSession, a) -> DataFrame:
    return tx.user_documents(tx.dated(io.read_posts(spark, a.records)), "created_at")


def _write(tables: dict[str, DataFrame], out: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out}/{name}")


def census(spark, a):
    _write({"curve": an.aggregate_only(io.read_table(spark, a.pairs), a.max_shared, a.n_boot, a.seed)} if a.pairs else an.census(_membership(spark, a), _docs(spark, a), a.per_level, a.baseline, a.max_shared, n_boot=a.n_boot, seed=a.seed), a.out)


def semantic(spark, a):
    m, pairs = _membership(spark, a), io.read_table(spark, a.pairs)
    _write(an.semantic_overlap(pairs, m, io.read_embeddings(io.read_table(spark, a.embeddings)), a.max_shared, a.n_boot, a.seed), a.out)


def network(spark, a):
    pairs = io.read_table(spark, a.pairs)
    if "hops" in pairs.columns:
        return _write(an.network(pairs, None, a.max_hops, n_boot=a.n_boot, seed=a.seed, known=pairs), a.out)
    with_hops = gr.hops(pairs, io.read_edges(spark, a.edges), a.max_hops, a.directed)
    with_hops.write.mode("overwrite").parquet(f"{a.out}/pairs_with_hops")
    stored = spark.read.parquet(f"{a.out}/pairs_with_hops")
    return None if a.hops_only else _write(an.network(stored, None, a.max_hops, n_boot=a.n_boot, seed=a.seed, known=stored), a.out)


def _embeddings(spark, a) -> DataFrame:
    return io.read_embeddings(io.read_table(spark, a.embeddings))


def null_model(spark, a):
    if a.reduce:  # the replicates of all tasks
        observed, replicates = (spark.read.parquet(f"{a.out}/task-*/{n}") for n in ("observed", "replicates"))
        return _write({"summary": an.null_reduce(observed.distinct(), replicates)}, a.out)
    if a.statistic == "cooccurrence":
        return cooccurrence(spark, a)
    tables = an.null_model(_membership(spark, a), io.read_table(spark, a.pairs), _embeddings(spark, a), a.statistic, a.ensemble, a.replicates, a.seed, a.method, a.trades or None, a.task, a.tasks)
    return _write(tables, f"{a.out}/task-{a.task}")


def null_curves(spark, a):
    tables = an.null_curves(_membership(spark, a), io.read_table(spark, a.pairs), _embeddings(spark, a), a.ensemble, a.replicates, a.max_shared, a.seed, a.method, a.trades or None, a.n_boot)
    _write(tables, a.out)
    figures.draw(spark.read.parquet(f"{a.out}/curves"), "curves", a.out)


def degree_diagnostic(spark, a):
    _write(an.degree_diagnostic(_membership(spark, a), io.read_table(spark, a.pairs), a.n, (a.seed,), a.seed), a.out)


def inspect_pairs(spark, a):
    tables = an.pair_inspection(_membership(spark, a), _embeddings(spark, a), io.read_table(spark, a.pairs) if a.pairs else None, seed=a.seed)
    _write(tables, a.out)


def report(spark, a):
    known = (_membership(spark, a), _embeddings(spark, a)) if a.packs and a.embeddings else (None, None)
    print(an.numbers_report(io.read_table(spark, a.pairs), a.out, a.max_hops, a.n_boot, a.seed, *known))


def max_df(spark, a):
    _write(an.vocabulary_report(io.read_table(spark, a.pairs), _docs(spark, a), min_df=a.min_df), a.out)


def fit_corpus(spark, a):
    _write(an.fit_corpus(io.read_table(spark, a.pairs), _docs(spark, a), a.min_df, a.max_df), a.out)


def described(spark, a):
    io.described_lines(spark, a.packs).write.mode("overwrite").text(a.out)


def cooccurrence(spark, a):
    _write(an.cooccurrence(_membership(spark, a), io.read_table(spark, a.pairs)), a.out)


def eval_pairs(spark, a):
    io.write_table(pr.uniform_pairs(pr.eligible(_membership(spark, a), a.min_packs), a.n, a.seed), a.out)


def filter_edges(spark, a):
    e, nodes = io.read_edges(spark, a.edges), io.read_nodes(spark, a.packs, a.nodes)
    e = ed.induced(e, nodes, a.either)
    e = ed.deduped(e) if a.dedupe else e
    e = ed.reciprocal(e) if a.reciprocal else e
    io.write_table(ed.core(e, a.min_degree) if a.min_degree else e, a.out)


def cap_degree(spark, a):
    io.write_table(ed.capped(io.read_edges(spark, a.edges), a.cap), a.out)


def drop_nodes(spark, a):
    edges, nodes = io.read_edges(spark, a.edges), io.read_users(spark, a.users).toDF("node")
    ed.dropped_counts(edges, nodes).show()
    io.write_table(ed.without(edges, nodes), a.out)


def degrees(spark, a):
    ed.degree_quantiles(io.read_edges(spark, a.edges)).show(truncate=False)
    ed.degree_report(io.read_edges(spark, a.edges), a.top).show(a.top, truncate=False)


def paths(spark, a):
    edges = io.cached_graph(spark, a.edges, a.cache, not a.undirected, a.rebuild) if a.cache else io.read_edges(spark, a.edges)
    out = gr.shortest_paths(io.read_users(spark, a.users).toDF("node"), edges, not a.undirected, True, a.reachable, held=gr.HELD)
    io.write_table(out, a.out)
    gr.path_summary(spark.read.parquet(a.out)).show()


def stats(spark, a):
    mb.corpus_counts(_membership(spark, a), io.read_edges(spark, a.edges), io.read_posts(spark, a.records)).show(truncate=False)


_NULL = {"packs": None, "pairs": None, "embeddings": None, "ensemble": "microcanonical", "method": "effrank", "replicates": 100, "trades": 0, "seed": 0, "out": "out"}
#: Command: function, and its options (name: default; False is a switch, None has to be given or may stay away).
COMMANDS = {
    "census": (census, {"packs": None, "records": None, "pairs": None, "per-level": 1000, "baseline": 1000, "max-shared": 5, "n-boot": 500, "seed": 42, "out": "out"}),
    "semantic": (semantic, {"packs": None, "pairs": None, "embeddings": None, "max-shared": 8, "n-boot": 500, "seed": 42, "out": "out"}),
    "network": (network, {"pairs": None, "edges": None, "max-hops": 3, "directed": False, "hops-only": False, "n-boot": 500, "seed": 42, "out": "out"}),
    "null-model": (null_model, _NULL | {"statistic": "slope", "task": 0, "tasks": 1, "reduce": False}),
    "null-curves": (null_curves, _NULL | {"max-shared": 8, "n-boot": 500}),
    "cooccurrence": (cooccurrence, {"packs": None, "pairs": None, "out": "out"}),
    "degree-diagnostic": (degree_diagnostic, {"packs": None, "pairs": None, "n": 10000, "seed": 42, "out": "out"}),
    "inspect-pairs": (inspect_pairs, {"packs": None, "embeddings": None, "pairs": None, "seed": 42, "out": "out"}),
    "report": (report, {"pairs": None, "packs": None, "embeddings": None, "max-hops": 3, "n-boot": 500, "seed": 42, "out": "out"}),
    "max-df": (max_df, {"pairs": None, "records": None, "min-df": 10, "out": "out"}),
    "fit-corpus": (fit_corpus, {"pairs": None, "records": None, "min-df": 10, "max-df": 0.4, "out": "out"}),
    "described": (described, {"packs": None, "out": "described"}),
    "eval-pairs": (eval_pairs, {"packs": None, "n": 10000, "min-packs": 2, "seed": 42, "out": "pairs.parquet"}),
    "filter-edges": (filter_edges, {"edges": None, "packs": None, "nodes": None, "either": False, "dedupe": False, "reciprocal": False, "min-degree": 0, "out": "edges.parquet"}),
    "cap-degree": (cap_degree, {"edges": None, "cap": 500_000, "out": "edges.parquet"}),
    "drop-nodes": (drop_nodes, {"edges": None, "users": None, "out": "edges.parquet"}),
    "degrees": (degrees, {"edges": None, "top": 20}),
    "paths": (paths, {"users": None, "edges": None, "cache": None, "rebuild": False, "undirected": False, "reachable": False, "out": "paths.parquet"}),
    "stats": (stats, {"packs": None, "edges": None, "records": None}),
}


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="covey", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, (_, options) in COMMANDS.items():
        p = sub.add_parser(name)
        for option, default in options.items():
            if default is False:
                p.add_argument(f"--{option}", action="store_true")
            else:
                p.add_argument(f"--{option}", default=default, type=type(default) if default is not None else str)
    a = parser.parse_args(argv)
    COMMANDS[a.command][0](session(), a)


if __name__ == "__main__":
    main()
