"""babelcask: labelled multilingual text on Spark.

Corpus assembly, language identification, language-conditioned sentiment
classification and evaluation, written as DataFrame plans.
"""

from babelcask.session import build_session, checkpoint_dir, cut_lineage

__all__ = ["build_session", "checkpoint_dir", "cut_lineage"]
