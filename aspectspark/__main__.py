"""Command line: ``python -m aspectspark <job> ...`` (see plans/jobs.py)."""

from __future__ import annotations

import argparse
import json

from aspectspark.plans import jobs
from aspectspark.plans.cascade import STAGE_LABELS, named_scorers
from aspectspark.plans.scorers import SCORERS
from aspectspark.plans.sparse_heads import WIDTH
from aspectspark.session import get_session


def main(argv=None):
    ap = argparse.ArgumentParser(prog="aspectspark")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="job", required=True)
    d = sub.add_parser("datasets")
    d.add_argument("train"), d.add_argument("dev"), d.add_argument("legacy"), d.add_argument("out")
    d.add_argument("--compat", action="store_true")
    d.add_argument("--seed", default="42")
    d.add_argument("--on-invalid", default="fail", choices=("fail", "drop", "quarantine"))
    p = sub.add_parser("predict")
    p.add_argument("corpus"), p.add_argument("out")
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--scorer", choices=sorted(SCORERS))
    which.add_argument("--heads", help="folder of heads saved by fit, one per stage")
    f = sub.add_parser("fit")
    f.add_argument("stage", choices=sorted(STAGE_LABELS)), f.add_argument("csv"), f.add_argument("out")
    c = sub.add_parser("crossval")
    c.add_argument("stage", choices=sorted(STAGE_LABELS)), c.add_argument("csv")
    c.add_argument("--folds", type=int, default=5)
    for x in (f, c):
        x.add_argument("--dim", type=int, default=WIDTH)
        x.add_argument("--max-iter", type=int, default=50)
        x.add_argument("--reg", type=float, default=0.01)
    v = sub.add_parser("vote")
    v.add_argument("members"), v.add_argument("corpus"), v.add_argument("out")
    v.add_argument("--threshold", type=int, default=2)
    e = sub.add_parser("evaluate")
    e.add_argument("gold"), e.add_argument("pred")
    e.add_argument("--sticky", action="store_true")
    a = ap.parse_args(argv)
    spark = get_session(a.master)
    if a.job == "datasets":
        print(json.dumps(jobs.build_stage_sets(spark, a.train, a.dev, a.legacy, a.out,
                                            seed=a.seed, compat=a.compat,
                                            on_invalid=a.on_invalid)))
    elif a.job == "predict":
        scorers = jobs.load_heads(spark, a.heads) if a.heads else named_scorers(a.scorer)
        jobs.predict_file(spark, a.corpus, a.out, scorers)
    elif a.job == "fit":
        print(json.dumps(jobs.fit_stage(spark, a.csv, a.stage, a.out, a.dim, a.max_iter, a.reg)))
    elif a.job == "crossval":
        for r in jobs.cross_validate_stage(spark, a.csv, a.stage, a.folds, a.dim, a.max_iter, a.reg):
            print(json.dumps(r))
    elif a.job == "vote":
        jobs.vote_files(spark, a.members, a.corpus, a.out, a.threshold)
    else:
        modes = ("exact", "sticky") if a.sticky else ("exact",)
        for r in jobs.evaluate_files(spark, a.gold, a.pred, modes):
            print(json.dumps(r, ensure_ascii=False))


if __name__ == "__main__":
    main()
