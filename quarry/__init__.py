"""quarry: passage retrieval and question answering as Spark jobs.

Public functions take and return DataFrames and never trigger actions,
except where a documented size check is part of the physical plan choice
(the broadcast question block of the k-NN operators).
"""

from quarry.session import build_session, scratch_path

__all__ = ["build_session", "scratch_path"]
