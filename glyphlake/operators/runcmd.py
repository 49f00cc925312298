"""Command lines of run configurations (M7-M11, P15, P16, P20, J10, A4, S11): built, never started."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import arguments, basename, execution_mode, is_blank, wsl_executable_missing, wsl_path

# The settings' defaults.
DEFAULTS = {
    "execution_mode": "WSL",
    "executable": "",
    "wsl_distribution": "Ubuntu",
    "docker_image": "sagemath/sagemath",
    "docker_dir": "/mnt/sage",
    "docker_command": "sage",
    "parameters": "",
}


def with_defaults(settings: DataFrame) -> DataFrame:
    """Settings rows, missing columns and nulls filled."""
    return settings.select(*(c for c in settings.columns if c not in DEFAULTS), *((F.coalesce(F.col(k), F.lit(v)) if k in settings.columns else F.lit(v)).alias(k) for k, v in DEFAULTS.items()))


def command_lines(runs: DataFrame) -> DataFrame:
    """runs with the settings' columns to (name, mode, argv, error); argv is null where error is not."""
    mode = execution_mode(F.col("execution_mode"))
    before, after = arguments(F.col("parameters")), arguments(F.col("script_parameters"))
    script = F.col("script_path")
    folder = F.regexp_extract(script, r"^(.*)[/\\][^/\\]*$", 1)
    parent = F.when(folder != "", folder).when(script.rlike(r"^[/\\][^/\\]+$"), F.left(script, F.lit(1)))
    one = lambda *c: F.array(*(F.lit(x) if isinstance(x, str) else x for x in c))
    native = F.concat(one(F.col("executable")), before, one(script), after)
    wsl = F.concat(one("wsl.exe", "-d", F.col("wsl_distribution"), "--", F.col("executable")), before, one(wsl_path(script)), after)
    docker = F.concat(one("docker", "run", "--rm", "-v", F.concat(parent, F.lit(":"), F.col("docker_dir")), "-w", F.col("docker_dir"), F.col("docker_image"), F.col("docker_command")), before, one(basename(script)), after)
    error = (
        F.when(is_blank(script), "script path is empty")
        .when((mode == "WSL") & wsl_executable_missing(F.col("executable")), "executable is not configured")
        .when((mode == "DOCKER") & parent.isNull(), "no script directory")
    )
    argv = F.when(mode == "NATIVE", native).when(mode == "WSL", wsl).otherwise(docker)
    return runs.select("name", mode.alias("mode"), F.when(error.isNull(), argv).alias("argv"), error.alias("error"))


def configurations_for(scripts: DataFrame, runs: DataFrame) -> DataFrame:
    """(script_path, name, is_new): a script's first configuration, else a new one named after the file."""
    known = runs.groupBy("script_path").agg(F.min("name").alias("known"))
    rows = scripts.where("ext = 'sage'").select(F.col("path").alias("script_path")).join(known, "script_path", "left")
    return rows.select("script_path", F.coalesce("known", F.regexp_replace(basename(F.col("script_path")), r"\.sage$", "")).alias("name"), F.col("known").isNull().alias("is_new"))


def exactly_one(df: DataFrame, key: str) -> DataFrame:
    """A4: df, failing for a key that has more than one row."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    checked = counts.select(key, F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("more than one row for "), F.col(key).cast("string")))).alias("_one"))
    return df.join(checked, key).where("_one").drop("_one")
