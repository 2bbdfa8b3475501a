"""Plan documents: model, loading, checking, masking of credentials."""

from planloom.plans.checks import check_plan
from planloom.plans.loaders import plan_from_base64, plan_from_file
from planloom.plans.model import Plan, PlanError, Storage, Target, Transformation

__all__ = [
    "Plan",
    "PlanError",
    "Storage",
    "Target",
    "Transformation",
    "check_plan",
    "plan_from_base64",
    "plan_from_file",
]
