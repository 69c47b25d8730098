"""DataFrame -> DataFrame operators (use with ``df.transform``)."""

from rankmart.operators.dedup import first_by_aggregate, keep_first, number_duplicates, top_n  # noqa: F401
from rankmart.operators.lookup import (  # noqa: F401
    map_lookup, map_lookup_inverse, lookup, dim_frame, assert_rows, check_rows,
)
from rankmart.operators.rank import (  # noqa: F401
    best_per_entity, zscore_scores, rank_entities, rank_matrix, entity_matrix, pivot_ranked, mark_best,
)
from rankmart.operators.bucket import bucketize, bucket_counts  # noqa: F401
from rankmart.operators.decay import decayed_sum  # noqa: F401
from rankmart.operators.share import value_share, share_stats  # noqa: F401
from rankmart.operators.scale import minmax_expr, minmax_scale, log_minmax, group_median, impute_median  # noqa: F401
from rankmart.operators.timeline import append_missing, flagship_cut  # noqa: F401
from rankmart.operators.capability import capability_counts  # noqa: F401
from rankmart.operators.geo import jitter_columns, jitter_flagged, region_of  # noqa: F401
from rankmart.operators.skew import salted_join  # noqa: F401
