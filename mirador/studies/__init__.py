"""Ready-made intensive-care cohorts over the clinical source tables, and the study chain."""

from mirador.studies.study import Study

__all__ = ["Study"]
