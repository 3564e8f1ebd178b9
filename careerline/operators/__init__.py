"""DataFrame -> DataFrame building blocks."""

from careerline.operators.comparison import (  # noqa: F401
    cohort_pairs,
    counts_up_to_point,
    head_to_head,
    ordered_list,
)
from careerline.operators.dedupe import keep_first  # noqa: F401
from careerline.operators.incremental import (  # noqa: F401
    apply_window,
    trailing_upsert,
    trailing_window,
)
from careerline.operators.local import local_frame  # noqa: F401
from careerline.operators.joins import BROADCAST_ROWS, as_role, small_side  # noqa: F401
from careerline.operators.ordering import with_positions  # noqa: F401
from careerline.operators.skew import heavy_hitters, hot_left_join, spread_left_join  # noqa: F401
from careerline.operators.unpivot import two_sided  # noqa: F401
from careerline.operators.windows import (  # noqa: F401
    best_per_group,
    last_per_group,
    running_totals,
)
