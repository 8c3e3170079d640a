"""Run one report over an event table and write the result.

    python -m cohortwise.cli inapp-renewal --events PATH --line 健走 \
        --start 2024-01-01 --end 2024-06-30 --out PATH
    python -m cohortwise.cli training --events PATH --experiment PATH \
        --control PATH --start 2024-01-05 --end 2024-01-11 --out PATH

The event table is Parquet (ideally partitioned by ``date``); the cohort
lists are Parquet tables with a ``user_id`` column. The result is written
as Parquet (or printed with ``--show``, all rows, tab-separated). An existing
output folder is refused unless ``--overwrite`` is given. ``--by-user`` reads
an event table in the layout of ``sources.by_user``; ``--all-users`` makes the
training report aggregate all users before it joins the lists.
"""

from __future__ import annotations

import argparse

from .functions import rules as R
from .plans import reports
from .session import build_session
from .sources.by_user import read_by_user
from .sources.events import cohorts_from_lists, read_events

PURCHASE_REPORTS = {
    "inapp-renewal": reports.inapp_renewal_report,
    "web-renewal": reports.web_renewal_report,
    "web-arppu": reports.web_arppu_report,
    "web-new-sales": reports.web_new_sales_report,
}


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="cohortwise")
    ap.add_argument("report", choices=[*PURCHASE_REPORTS, "training"])
    ap.add_argument("--events", required=True)
    ap.add_argument("--start", required=True)
    ap.add_argument("--end", required=True)
    ap.add_argument("--line", default="健走", help="product line (purchase reports)")
    ap.add_argument("--experiment", help="experiment-arm user list (training report)")
    ap.add_argument("--control", help="control-arm user list (training report)")
    ap.add_argument("--out", help="output Parquet path")
    ap.add_argument("--overwrite", action="store_true", help="replace the folder given with --out")
    ap.add_argument("--by-user", action="store_true", help="--events is a layout by user")
    ap.add_argument("--all-users", action="store_true", help="training report: aggregate before joining the user lists")
    ap.add_argument("--show", action="store_true", help="print the report instead of writing it")
    ap.add_argument("--master")
    args = ap.parse_args(argv)

    spark = build_session(args.master)
    events = read_by_user(spark, args.events) if args.by_user else read_events(spark, args.events)
    if args.report == "training":
        if not (args.experiment and args.control):
            ap.error("training needs --experiment and --control")
        cohorts = cohorts_from_lists(
            {
                R.GROUP_EXPERIMENT: spark.read.parquet(args.experiment),
                R.GROUP_CONTROL: spark.read.parquet(args.control),
            }
        )
        df = reports.experiment_training_report(events, cohorts, args.start, args.end, cohort_first=not args.all_users)
    else:
        df = PURCHASE_REPORTS[args.report](events, args.line, args.start, args.end)
    if args.show:
        print("\t".join(df.columns))
        for row in df.toLocalIterator():  # every row, one partition at a time
            print("\t".join("" if v is None else str(v) for v in row))
    elif args.out:
        df.write.mode("overwrite" if args.overwrite else "errorifexists").parquet(args.out)
    else:
        ap.error("give --out or --show")


if __name__ == "__main__":
    main()
