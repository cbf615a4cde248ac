"""What the jobs share: settings from a small JSON file, a log, and a session for the command line."""

from __future__ import annotations

import argparse
import json
import logging
from contextlib import contextmanager

from pyspark.sql import SparkSession

log = logging.getLogger("kbspark.jobs")


def settings(defaults: dict, path: str | None = None, **given) -> dict:
    """Defaults, then what the file says, then what was given; an unknown name is an error."""
    out = dict(defaults)
    if path:
        with open(path) as f:
            out |= json.load(f)
    out |= {k: v for k, v in given.items() if v is not None}
    if unknown := sorted(set(out) - set(defaults)):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    return out


def parser(about: str, **paths: str) -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description=about)
    for name, what in paths.items():
        out.add_argument(name, help=what)
    out.add_argument("--config", help="a JSON file of settings")
    return out


@contextmanager
def session(name: str):
    """The command line's own session."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        yield spark
    finally:
        spark.stop()


@contextmanager
def conf(spark: SparkSession, **values: str):
    """Settings of the session for a while; what they were before comes back. Names have ``__`` for dots."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
