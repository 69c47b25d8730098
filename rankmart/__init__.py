"""rankmart: leaderboard and market-share marts as plain Spark DataFrame jobs.

Every operator is ``DataFrame -> DataFrame`` (usable with ``df.transform``),
pure, and takes its reference time (``as_of``) as a parameter.
"""

from rankmart.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
