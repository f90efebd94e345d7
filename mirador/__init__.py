"""Cohort building, treatment-effect models and their evaluation on Spark."""

from mirador.roles import Roles
from mirador.session import tune

__all__ = ["Roles", "tune"]
