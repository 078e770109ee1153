"""``python -m codemosaic COMMAND ...``"""

import sys

from pyspark.sql import SparkSession

from .api import Engine
from .cli import main

spark = SparkSession.builder.appName("codemosaic").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
sys.exit(main(sys.argv[1:], Engine(spark)))
