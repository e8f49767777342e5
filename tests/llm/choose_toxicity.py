"""python tests/llm/choose_toxicity.py SF_DIR: the settings of the toxicity scorer by cross-validation inside the rows it may learn from.

Each setting is varied alone, the best value is kept, in the order of CHOICES; a value must be better than the one in place by more
than one document. Folds are thirds of the learn rows by hash; a fold's labels are never read by the model that scores it. Rows
that learn_rows() leaves out (the held-out third) are not scored at all here.
"""

import math
import os
import sys
from dataclasses import replace

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F

from ticketloom.llm import toxicity
from ticketloom.session import build_session

CHOICES = [
    ("prefix_bytes", [(), (5,), (4, 5, 6, 7)]), ("rates", [(), (0.004, 0.008, 0.012)]), ("min_lift", [1.5, 2.0, 3.0]), ("min_chi2", [2.0, 6.0]), ("max_df", [0.02, 0.05, 0.2]),
    ("min_df", [3, 5, 8]), ("k", [5, 10, 25]), ("prior", [0.25, 1.0]), ("folds", [4, 8]),
]
FOLDS = 3


def evaluate(spark, sf_dir: str, cfg: toxicity.ToxicityConfig) -> tuple[float, int, int, int]:
    """(log loss, documents right of the toxic ones, wrongly rejected, missed) over the folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(F.col("toxic").isNotNull() & toxicity.learn_rows(F.col("doc_id")))
    labels = labels.withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("choose")), F.lit(FOLDS))).persist()
    loss = right = wrong = missed = 0
    for fold in range(FOLDS):
        model = toxicity.learn(docs, labels.where(F.col("fold") != fold).drop("fold"), cfg)
        own = labels.where(F.col("fold") == fold)
        for r in toxicity.score_texts(docs.join(own.select("doc_id", "toxic"), "doc_id"), model, keep=("doc_id", "toxic")).collect():
            p = min(max(r._toxicity, 1e-6), 1 - 1e-6)
            loss -= math.log(p if r.toxic else 1 - p)
            hit = r._toxicity >= cfg.threshold
            right, wrong, missed = right + (hit and r.toxic == 1), wrong + (hit and r.toxic == 0), missed + (not hit and r.toxic == 1)
    return loss, right, wrong, missed


def main(sf_dir: str) -> None:
    spark = build_session("choose", "local[6]", **{"spark.sql.shuffle.partitions": "6", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    cfg = toxicity.ToxicityConfig()
    now = evaluate(spark, sf_dir, cfg)
    print("start", now, flush=True)
    for name, values in CHOICES:
        for v in values:
            if v == getattr(cfg, name):
                continue
            got = evaluate(spark, sf_dir, replace(cfg, **{name: v}))
            better = got[2] + got[3] < now[2] + now[3] - 1 or (abs(got[2] + got[3] - now[2] - now[3]) <= 1 and got[0] < 0.95 * now[0])
            print(name, v, got, "taken" if better else "", flush=True)
            if better:
                cfg, now = replace(cfg, **{name: v}), got
    print(cfg, now)


if __name__ == "__main__":
    main(sys.argv[1])
