"""maieutic: the data side of fine-tuning and evaluating text models, on Spark.

Every public operator is a function ``DataFrame -> DataFrame`` (or ``Column ->
Column``) built from Spark's own expressions, so Catalyst can prune, push down
and fuse it, and it scales with the cluster.

Sub-packages
------------
functions  Column-level rules (text heuristics, array/label helpers).
operators  DataFrame operators (behaviour metrics, dialogue, sampling,
           tokens, span QA, pairwise comparison, loss).
sources    Readers and writers (tables, JSON / JSON Lines, prompt files,
           reports, metric logs).
streaming  Step-keyed metrics for Structured Streaming and the as-of attach.
plans      Named preprocessor registry, derived inputs and the query catalogue.
"""

from maieutic.session import checkpoint_dir, get_session

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
