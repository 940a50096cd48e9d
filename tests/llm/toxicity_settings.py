"""Compares settings of the toxicity model on the inner fold; with --held-out, gives the held-out figures of the defaults.

    python tests/llm/toxicity_settings.py [--held-out] /root/testdata/sf0.1 [/root/testdata/check_s ...]

The defaults have the lowest mean log loss on the inner folds of these two tables.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession

from tidemill.llm import toxicity as tox

ALL = 1 << 20  # all terms that are in three training rows
GRID = [
    tox.Settings(), tox.Settings(frequent=0), tox.Settings(frequent=512), tox.Settings(frequent=2_048), tox.Settings(frequent=ALL), tox.Settings(terms=1_024), tox.Settings(terms=16_384),
    tox.Settings(rate=0.1), tox.Settings(rate=0.6), tox.Settings(steps=250), tox.Settings(steps=1_000),
]


def told(figures: dict) -> str:
    return f"{figures['rows']} rows: right {figures['right']:.4f}, of toxic rows found {figures['found']:.4f}, of clean ones taken for toxic {figures['wrongly']:.4f}, log loss {figures['log_loss']:.4f}"


def main() -> None:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    held_out = "--held-out" in sys.argv
    for folder in (x for x in sys.argv[1:] if x != "--held-out"):
        docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
        for settings in GRID if not held_out else ():
            print(folder, "inner", settings, told(tox.validate(docs, labels, settings)), flush=True)
        if held_out:
            print(folder, "held out", tox.Settings(), told(tox.validate(docs, labels, on=tox.HELD_OUT)), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
