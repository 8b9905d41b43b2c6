"""shelfspark: a Spark-native storefront catalog engine.

Fetched storefront pages arrive as a table (or a stream of files); every step
after the fetch -- link discovery and scoring, product extraction,
normalisation, merging, validation, category trees and exports -- is a
DataFrame job keyed by ``site`` so many sites run at once.
"""

from shelfspark.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
