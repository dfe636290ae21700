"""Compare planned targets with reported results on Spark DataFrames."""

from plumbline.plans.compare import compare, year_change
from plumbline.plans.profiles import PROFILES, Profile

__all__ = ["PROFILES", "Profile", "compare", "year_change"]
