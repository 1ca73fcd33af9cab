"""``python -m panelkit prices|features|compare|inspect``: the steps of the workflow."""

from __future__ import annotations

import argparse

from .operators.signals import METHODS
from .plans import workflow
from .session import session


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="panelkit")
    parser.add_argument("--master", help="where Spark runs, if its configuration doesn't say so")
    steps = parser.add_subparsers(dest="step", required=True)
    one = steps.add_parser("prices", help="raw CSV files to a clean panel")
    one.add_argument("raw"), one.add_argument("out")
    two = steps.add_parser("features", help="a clean panel to a feature table")
    two.add_argument("prices"), two.add_argument("out")
    two.add_argument("--min-tickers", type=int, default=100)
    three = steps.add_parser("compare", help="statistics of several signals")
    three.add_argument("features"), three.add_argument("columns", nargs="+")
    three.add_argument("--method", choices=METHODS, default="zscore_tanh"), three.add_argument("--alpha", type=float, default=0.05)
    four = steps.add_parser("inspect", help="one signal by date")
    four.add_argument("features"), four.add_argument("column")
    four.add_argument("--method", choices=METHODS, default="zscore_tanh")
    to = parser.parse_args(args)
    spark = session(master=to.master)
    if to.step == "prices":
        workflow.build_prices(spark, to.raw, to.out)
    elif to.step == "features":
        workflow.build_features(spark, to.prices, to.out, to.min_tickers)
    elif to.step == "compare":
        workflow.compare_signals(spark.read.parquet(to.features), to.columns, to.method, to.alpha).show(1000, False)
    else:
        workflow.inspect_signal(spark.read.parquet(to.features), to.column, to.method).show(1000, False)


if __name__ == "__main__":
    main()
