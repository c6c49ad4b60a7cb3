"""Training as a job for spark-submit.

    spark-submit -m clauseforge.plans.job TRAIN_PARQUET MODEL_PATH [POS_PARTS] [NEG_PARTS]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from clauseforge.operators.pairs import STRATEGIES
from clauseforge.plans.learner import fit_labelled
from clauseforge.plans.model import RuleModel
from clauseforge.sources.sequences import read_instances


def train_job(
    spark: SparkSession,
    train_path: str,
    model_path: str,
    pos_parts: int = 0,
    neg_parts: int = 0,
    strategy: str = "auto",
    fmt: str = "parquet",
    on_conflict: str = "error",
) -> RuleModel:
    """Read instances, learn, save. Partition numbers of 0 or less leave the default."""
    model = fit_labelled(
        read_instances(spark, train_path),
        strategy=strategy,
        on_conflict=on_conflict,
        partitions=(pos_parts if pos_parts > 0 else None, neg_parts if neg_parts > 0 else None),
    )
    model.save(spark, model_path, fmt)
    return model


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Learn a Boolean formula from labelled instances.")
    parser.add_argument("train_path")
    parser.add_argument("model_path")
    parser.add_argument("pos_parts", nargs="?", type=int, default=0)
    parser.add_argument("neg_parts", nargs="?", type=int, default=0)
    parser.add_argument("--strategy", choices=STRATEGIES, default="auto")
    parser.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    parser.add_argument("--on-conflict", choices=("error", "drop"), default="error")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("rule-training").getOrCreate()
    model = train_job(
        spark, args.train_path, args.model_path, args.pos_parts, args.neg_parts,
        args.strategy, args.format, args.on_conflict,
    )
    print(f"version: {model.version}")
    print(f"formula: {model.formula}")
    print(f"training time: {model.training_time}")


if __name__ == "__main__":
    main()
