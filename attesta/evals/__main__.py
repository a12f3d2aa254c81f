import sys

from pyspark.sql import SparkSession

from . import CASES, run_case, scorecard

scores = [run_case(SparkSession.builder.getOrCreate(), c) for c in CASES]
print(scorecard(scores))
sys.exit(not all(s.passed for s in scores))
