"""Sessions for tests, the bench and local use. On a cluster, the session comes from outside."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def credential(service: str, name: str) -> str:
    """A secret from the environment (CITEGRAIN_<SERVICE>_<NAME>), else from the system's keyring if the
    keyring package is there; never from a file of this repository."""
    if found := os.environ.get(f"CITEGRAIN_{service}_{name}".upper()):
        return found
    try:
        import keyring
    except ImportError:
        keyring = None
    if keyring is not None and (found := keyring.get_password(service, name)):
        return found
    raise LookupError(f"no credential {name} for {service}")


def local_session(cpus: int | str = 8, partitions: int | None = None, memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("citegrain")
        .config("spark.sql.shuffle.partitions", str(partitions or 8))
        .config("spark.driver.memory", os.environ.get("CITEGRAIN_DRIVER_MEMORY", memory))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
