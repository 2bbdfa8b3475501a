"""planloom: declarative batch plans over Spark SQL."""

from planloom.plans import Plan, PlanError, Storage, Target, Transformation, plan_from_base64, plan_from_file
from planloom.runner import OpenPlan, open_plan, run_plan

__all__ = [
    "OpenPlan",
    "Plan",
    "PlanError",
    "Storage",
    "Target",
    "Transformation",
    "open_plan",
    "plan_from_base64",
    "plan_from_file",
    "run_plan",
]
