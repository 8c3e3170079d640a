"""spark-submit entry point: ``spark-submit --py-files cohortwise.zip run_report.py <report> ...``."""

from cohortwise.cli import main

if __name__ == "__main__":
    main()
