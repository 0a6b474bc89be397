"""Privacy level of a settings row."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points.
FLAGS = {"fake_headers": 5, "fake_referer": 5, "remove_fingerprints": 10, "doh": 15}
AGENTS = {"fixed": 0, "realistic": 10, "random": 15, "custom": 20}
FINGERPRINTS = {"none": 0, "basic": 10, "advanced": 20, "full": 30}
BANDS = ((30, "low"), (60, "medium"), (85, "high"))


def points() -> Column:
    out = sum((F.when(F.col(c), n).otherwise(0) for c, n in FLAGS.items()), F.lit(0))
    out = out + F.when(F.col("verify_certificates"), 10).otherwise(5)
    for column, table in (("user_agent", AGENTS), ("fingerprint", FINGERPRINTS)):
        out = out + F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(column)]
    return out


def level(score: Column) -> Column:
    out = None
    for most, name in BANDS:
        out = F.when(score <= most, name) if out is None else out.when(score <= most, name)
    return out.otherwise("maximum")
