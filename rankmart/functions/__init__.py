"""Column-level helpers: every helper returns a native Spark Column (no UDFs)."""

from rankmart.operators.lookup import map_lookup, map_lookup_inverse  # noqa: F401

from rankmart.functions.text import (  # noqa: F401
    org_of, short_name, base_name, family_key_dated, family_key_tagged,
    family_key_suffix, classify_first, normalise_name, first_line,
)
from rankmart.functions.numeric import (  # noqa: F401
    to_double, nan_to_null, decay_weight, log_clip, clip_lower, hash_uniform, hash_jitter,
    trunc_to_long,
)
from rankmart.functions.dates import (  # noqa: F401
    iso_prefix_date, age_days, strict_date, epoch_utc_label,
)
from rankmart.functions.fmt import (  # noqa: F401
    short_number, short_tokens, truncate_label, rank_label,
)
