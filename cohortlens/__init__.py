"""Cohort analytics on Spark.

Composable ``DataFrame -> DataFrame`` operators for clinical cohorts held in
the OMOP common data model and for the letter-classification work built on
top of them: patient histories, cohort profiles, data-quality flags, dataset
building, score post-processing and classifier evaluation.
"""

from cohortlens.session import build_session, checkpoint_dir, bounded_broadcast

__all__ = ["build_session", "checkpoint_dir", "bounded_broadcast"]
