"""The corpus pipeline, under the name that the driver imports; its stages are in ``winnow.llm.pipeline``."""

from winnow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
