"""Scalar column functions: hashes, run dates, typed conversion."""

from lakestar.functions.casting import convert, copy_mapped
from lakestar.functions.dates import RunContext, day_predicate, parse_day, parse_timestamp
from lakestar.functions.hashing import COMPAT, EXACT, hash_input, sha256_of

__all__ = [
    "COMPAT",
    "EXACT",
    "RunContext",
    "convert",
    "copy_mapped",
    "day_predicate",
    "hash_input",
    "parse_day",
    "parse_timestamp",
    "sha256_of",
]
