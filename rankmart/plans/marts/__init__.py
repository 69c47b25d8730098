"""The twelve marts on the source feeds' shapes (see ``rankmart.sources.feeds``).

Each builder is ``(DataFrames..., as_of, **params) -> DataFrame`` and uses the
fixed values in ``rankmart.fixed`` by default. Insight rows are separate
one-row DataFrames. All work is Spark expressions; no Python UDF.
"""

from rankmart.plans.marts.leaderboard import (  # noqa: F401
    leaderboard_scores, leaderboard_matrix, leaderboard_insight,
)
from rankmart.plans.marts.catalog import (  # noqa: F401
    context_families, context_buckets, context_insight, pricing, pricing_insight, capabilities,
)
from rankmart.plans.marts.timeline import (  # noqa: F401
    benchmark_models, timeline, flagship, timeline_sizes, timeline_insight,
)
from rankmart.plans.marts.hardware import (  # noqa: F401
    chip_counts, chip_dominance, chip_insight, gpu_map, gpu_stats, gpu_top_owners, gpu_country_counts, gpu_insight, gpu_region_counts,
)
from rankmart.plans.marts.hub import (  # noqa: F401
    downloads, downloads_insight, trending, trending_insight, modality_champions, modality_insight,
)
from rankmart.plans.marts.coding import (  # noqa: F401
    coding_leaderboard, coding_insight,
)
from rankmart.plans.marts.packages import (  # noqa: F401
    package_downloads,
)
