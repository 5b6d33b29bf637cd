"""``python -m quillgraph --input PATH --output PATH [options]``."""

import logging
import sys

from pyspark.sql import SparkSession

from quillgraph.config import parse_args
from quillgraph.pipeline import run

if __name__ == "__main__":
    source, target, cfg = parse_args(sys.argv[1:])
    logging.basicConfig(level=cfg.log_level.upper(), filename=cfg.log_file or None, format="%(asctime)s %(levelname)s %(message)s")
    logging.info("encoding %s to %s with %s", source, target, cfg)
    run(SparkSession.builder.appName("quillgraph").getOrCreate(), source, target, cfg)
    logging.info("done")
