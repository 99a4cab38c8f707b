"""Commands: mine DUMP PATH, link-training PATH, shrink PATH, load-model MODEL PATH NAME. The language of a new
wiki and the number of workers come from the environment (config.Settings), that of a mined one from its tables; a master that spark-submit or Spark's defaults name stands."""

from __future__ import annotations

import sys

from pyspark import SparkConf
from pyspark.sql import SparkSession

from .config import Settings
from .mining import Mine
from .sources.tables import Tables, load_model, save_model, shrunk


def main(command: str, *args: str) -> None:
    settings = Settings.from_environment()
    builder = SparkSession.builder.appName(f"knotwork {command}")
    spark = (builder if SparkConf().contains("spark.master") else builder.master(settings.master)).getOrCreate()
    if command == "mine":
        dump, path = args
        print(Mine(spark, dump, path, settings.chosen).run())
    elif command == "link-training":
        (path,) = args
        print(Mine.opened(spark, path).link_training().count())
    elif command == "shrink":
        (path,) = args
        tables = Tables(spark, path)
        tables.write("small_markup", shrunk(tables.read("markup")))
    elif command == "load-model":
        model, path, name = args
        save_model(load_model(model), f"{path.rstrip('/')}/models/{name}")
    else:
        raise SystemExit(__doc__)


if __name__ == "__main__":
    main(*sys.argv[1:] or ("help",))
