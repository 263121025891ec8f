"""Deterministic patient hashing: bucket number, bucket label and the train/test split."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

# Number of hash buckets and the first bucket of the held-out test share (20 %).
NUM_BUCKETS = 10_000
FIRST_TEST_BUCKET = 8_000
# Buckets per storage folder: 100 folders in all, and the train share is exactly folders 0-79.
BUCKETS_PER_FOLDER = 100
# Column names of the stored split.
FOLDER = "folder"
BUCKET = "bucket"


def bucket(pid: Column, buckets: int = NUM_BUCKETS) -> Column:
    """SHA-256 of the id, read as one 256-bit number, modulo ``buckets``.

    The 64 hex digits are taken in five runs of up to 52 bits and reduced run by run, which keeps
    every intermediate value inside a bigint.
    """
    digest = F.sha2(pid, 256)
    total, start = F.lit(0).cast("bigint"), 1
    for digits in (12, 13, 13, 13, 13):
        run = F.conv(F.substring(digest, start, digits), 16, 10).cast("bigint")
        total = (total * F.lit((1 << 4 * digits) % buckets) + run) % F.lit(buckets)
        start += digits
    return total.cast("int")


def bucket_of(pid: str, buckets: int = NUM_BUCKETS) -> int:
    """The same number for one literal id, so that a lookup can prune folders at planning time."""
    return int.from_bytes(hashlib.sha256(pid.encode("utf-8")).digest(), "big") % buckets


def label_width(buckets: int = NUM_BUCKETS) -> int:
    """Digits in a bucket label: one more than the largest bucket needs at round powers of ten."""
    if buckets >= 100_000:
        raise NotImplementedError("bucket labels are defined for fewer than 100,000 buckets")
    return max(2, len(str(buckets)))


def bucket_label(bucket_col: Column, buckets: int = NUM_BUCKETS) -> Column:
    return F.concat(F.lit("g"), F.lpad(bucket_col.cast("string"), label_width(buckets), "0"))


def is_test(bucket_col: Column, first_test: int = FIRST_TEST_BUCKET) -> Column:
    return bucket_col >= F.lit(first_test)


def folder(bucket_col: Column) -> Column:
    """Coarse storage folder of a bucket."""
    return F.floor(bucket_col / F.lit(BUCKETS_PER_FOLDER)).cast("int")
