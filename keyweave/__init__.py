"""keyweave: combine messy tables on Spark and account for every key that falls out."""

from keyweave.functions.keys import Gazetteer
from keyweave.plans.runner import SourceTable, run_spec
from keyweave.session import build_session

__all__ = ["Gazetteer", "SourceTable", "build_session", "run_spec"]
