"""Launcher for spark-submit: ``spark-submit --py-files infosieve.zip run_job.py ARGS``."""

import sys

from infosieve.plans.job import run

if __name__ == "__main__":
    run(sys.argv[1:])
