"""Plans: the marts (M1-M12) and the registered queries on the driver tables.

Importing this package registers every query (see ``registry``).
"""

from rankmart.plans import leaderboard, hub, hardware, catalog, timeline, feeds, landing, incremental, documents, scale  # noqa: F401
from rankmart.plans import insights  # noqa: F401,E402  (reads the queries registered above)
from rankmart.plans.registry import ORACLE, QUERIES  # noqa: F401
