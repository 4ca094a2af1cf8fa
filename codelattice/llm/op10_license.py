"""op10: licence notices in `documents`."""

from .common import table
from .license_scan import license_scan, sql

NAME = "op10_license_scan"
SQL = sql()


def query(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))
