"""Tables that figures are drawn from, and a plain drawing of them where matplotlib is installed."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covey.operators import aggregates as ag
from covey.operators import inference as inf


def overlap_curve(pairs: DataFrame, max_shared: int, n_boot: int = 500, seed: int = 16) -> DataFrame:
    """s_raw, mean_cosine, std, count, err_low, err_high, ci_low, ci_high: cosine by packs shared, the top level open."""
    return _curve(pairs, F.least("shared_packs", F.lit(max_shared)), n_boot, seed).withColumnRenamed("level", "s_raw").withColumnRenamed("mean", "mean_cosine")


def renormalised_curve(pairs: DataFrame, max_shared: int, n_boot: int = 500, seed: int = 16) -> DataFrame:
    """shared_packs, mean, std, count, err_low, err_high, ci_low, ci_high: cosine by the rounded effective number."""
    return _curve(pairs, ag.rint_bin("n_eff", max_shared), n_boot, seed).withColumnRenamed("level", "shared_packs")


def _curve(pairs: DataFrame, level, n_boot: int, seed: int) -> DataFrame:
    plain = ag.by_level(pairs, level).select("level", "mean", "std", F.col("n").alias("count"))
    boots = inf.cluster_bootstrap(pairs, level, n_boot=n_boot, seed=seed).select("level", "err_low", "err_high", "ci_low", "ci_high")
    return plain.join(boots, "level").orderBy("level")


def null_points(pairs: DataFrame) -> DataFrame:
    """s_raw, n_obs, mean_cosine for each exact number of packs shared."""
    return pairs.groupBy(F.col("shared_packs").alias("s_raw")).agg(F.count("*").alias("n_obs"), F.avg("cosine").alias("mean_cosine")).orderBy("s_raw")


def null_overlay(curves: DataFrame) -> DataFrame:
    """overlap_kind, bin, observed_mean_cosine, observed_err_low, observed_err_high, null_mean_cosine, null_err_low, null_err_high from null_curves()."""
    far = lambda a, b: F.col(a) - F.col(b)
    return curves.select(
        F.col("x_kind").alias("overlap_kind"), "bin", F.col("observed_mean").alias("observed_mean_cosine"), far("observed_mean", "observed_ci_low").alias("observed_err_low"), far("observed_ci_high", "observed_mean").alias("observed_err_high"),
        F.col("null_mean").alias("null_mean_cosine"), far("null_mean", "null_low").alias("null_err_low"), far("null_high", "null_mean").alias("null_err_high"),
    ).orderBy("overlap_kind", "bin")


def regime_cells(pairs: DataFrame, n_boot: int = 500, seed: int = 16) -> DataFrame:
    """s_eff_regime, network_distance, n, mean_cosine, ci_low, ci_high, ci_width for each stratum and distance."""
    out = inf.cell_bootstrap(pairs.withColumn("stratum", ag.stratum()), ("stratum", "hops"), n_boot=n_boot, seed=seed)
    width = (F.col("ci_high") - F.col("ci_low")).alias("ci_width")
    return out.select(F.col("stratum").alias("s_eff_regime"), F.col("hops").alias("network_distance"), "n", F.col("mean").alias("mean_cosine"), "ci_low", "ci_high", width).orderBy("s_eff_regime", "network_distance")


def write(table: DataFrame, name: str, folder: str) -> Path:
    """A figure's table (a row for each mark, so it is small) as CSV."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path = Path(folder, f"{name}.csv")
    table.toPandas().to_csv(path, index=False)
    return path


def draw(table: DataFrame, name: str, folder: str, x: str = "bin", y: str = "observed_mean", low: str | None = "null_low", high: str | None = "null_high") -> Path | None:
    """Writes the table, and draws y over x, with a band between low and high, as PDF where matplotlib is installed."""
    write(table, name, folder)
    try:
        import matplotlib

        matplotlib.use("Agg")
        from matplotlib import pyplot as plt
    except ImportError:
        return None
    rows = table.toPandas().sort_values(x)
    figure, axes = plt.subplots()
    axes.plot(rows[x], rows[y], "o-")
    if low in rows and high in rows:
        axes.fill_between(rows[x], rows[low], rows[high], alpha=0.3)
    axes.set_xlabel(x)
    axes.set_ylabel(y)
    path = Path(folder, f"{name}.pdf")
    figure.savefig(path)
    plt.close(figure)
    return path
