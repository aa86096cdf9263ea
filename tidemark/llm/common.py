"""What the operators of this package share: columns, text units, hashes and the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
M64 = np.uint64


def col(name: str) -> Column:
    """The column of this very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind(df: DataFrame, name: str) -> str:
    """The type of a column, as schemas spell it."""
    return df.schema[name].dataType.simpleString()


def plain(df: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with columns c0, c1 and so on, and how to give those columns their names back."""
    names = df.columns
    own = [f"c{k}" for k in range(len(names))]
    return df.toDF(*own), lambda out: out.select(*(F.col(a).alias(b) for a, b in zip(own, names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names. Only a session whose executors are threads of this process (tests) gets
    one of its own where none is set; elsewhere that is an error, as executors couldn't read it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", sc.master):
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def checkpoint(df: DataFrame) -> DataFrame:
    """Written to the shared folder, so that lost executors cost nothing that was done before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores, in lower case."""
    return WORD.findall(text.lower()) if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> M64(30))) * M64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> M64(27))) * M64(0x94D049BB133111EB)
        return h ^ (h >> M64(31))
