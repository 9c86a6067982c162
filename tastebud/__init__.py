"""tastebud — Spark-native recommendation analytics.

Everything runs as Spark DataFrame / SQL plans: cleaning and temporal splits,
popularity, factor and text rankers, hybrid blending, cold-start cascades,
catalog search, intent extraction and ranking metrics.
"""

from tastebud.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
