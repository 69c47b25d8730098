"""Parameters of the registered queries, shared by the Spark side and the SQL oracle.

The source feeds are not available offline, so each mart's operators run on
an analogous driver table with domain maps given here (test-side parameters;
the reference's own maps live in ``rankmart.fixed``).
"""

# Leaderboard on events: entity = user-day, category from event type.
LB_CATEGORIES = {
    "Engage": ["click", "view"],
    "Purchase": ["purchase"],
    "Signup": ["signup"],
    "Error": ["error"],
}
LB_TOP_N = 8
LB_MIN_CATEGORIES = len(LB_CATEGORIES) - 1
LB_SCALE = 1.0

# Decayed downloads on lineitem: model id = nation/supplier, one row per line.
DD_AS_OF = "2001-11-05"
DD_EXCLUDED_ORGS = ["NATION_3", "NATION_7", "community"]
DD_DISPLAY = {"NATION_0": "Nation Zero", "NATION_1": "Nation One", "NATION_2": "Nation Two",
              "NATION_10": "Nation Ten"}
DD_TOP_N = 12
DD_DOWNLOADS_SCALE = 100

# Trending on orders: top 15 by total price in source order.
TR_AS_OF = "2001-08-02"
TR_TOP_N = 15

# Modality champions on events: tag list (the last tag has no data).
MC_TAGS = [("click", "Clicks"), ("view", "Views"), ("purchase", "Purchases"),
           ("signup", "Signups"), ("refund", "Refunds")]
MC_ORGS = {"user1": "First user", "user2": "Second user", "user42": "User 42"}

# Package downloads on events: trailing windows before as_of.
PK_AS_OF = "2024-01-31 00:00:00"
PK_DISPLAY = {"click": "Clicks", "view": "Views", "purchase": "Purchases"}
PK_COMPANY = {"click": "Engagement", "view": "Engagement", "purchase": "Revenue", "signup": "Growth"}
PK_PACKAGES = ["click", "view", "purchase", "signup", "error"]

# Chip share on customer/nation: maker = nation name.
CHIP_COUNTRY = {"NATION_0": "US", "NATION_1": "US", "NATION_2": "US",
                "NATION_3": "China", "NATION_4": "China", "NATION_5": "Japan"}
CHIP_TOP_N = 10

# Cluster map on supplier/nation/region: country = nation, owner = region name,
# coordinates = nation centroid (unknown for region 4), flag = negative balance.
GEO_REGION_MAP = {"NATION_0": "United States", "NATION_1": "China"}
GEO_EU = ["NATION_5", "NATION_6", "NATION_7", "NATION_8", "NATION_9", "NATION_10"]
GEO_NO_COORD_REGION = 4
GEO_OWNER_TOP_N = 3

# Price map on lineitem/part: org = brand, id = org/part-name-shipdate.
PR_AS_OF = "2001-11-05 00:00:00"
PR_ORGS = ["brand1", "brand2", "brand3", "brand4", "brand5", "brand6", "brand7", "brand8"]

# Context sizes on documents: variant ids from source/lang with a date or tag suffix.
CTX_EXCLUDE_IDS = ["src0/en"]

# Capability matrix on events: variant = user-day, inputs = types with value < 100,
# outputs = types with value >= 100, org = one of 12 user cohorts.
CAP_ORGS_N = 12
CAP_SPLIT = 100.0
CAP_SPEC = [("Vision", "input", "view"), ("Audio in", "input", "click"),
            ("Video in", "input", "purchase"), ("Files", "input", "signup"),
            ("Image gen", "output", "view"), ("Audio gen", "output", "purchase")]
CAP_ORG_NAMES = {"org0": "Cohort zero", "org1": "Cohort one", "org5": "Cohort five"}
CAP_TOP_N = 10

# Release timeline on orders/customer: A = dated orders of mapped segments,
# B = customers with their last order date and a prefix-rule org.
TL_MIN_DATE = "1997-01-01"
TL_ORG_MAP = {"AUTOMOBILE": "Motors", "BUILDING": "Build", "FURNITURE": "Home", "HOUSEHOLD": "Home"}
TL_PREFIX_RULES = [(["AUTO"], "Motors"), (["BUILD", "FURN"], "Build"), (["MACH"], "Machines")]
TL_FALLBACK_SIZE = 12.0
# the customer side is broadcast when it has at most this many rows (checked), else the join is salted

# Flagship variants on part/lineitem: model = "brand Noun Adjective".
FL_AS_OF = "2001-11-05"
FL_MONTHS = 6
FL_STRIP = [r"\s+Hot$", r"\s+Cold$", r"\s+Large$", r"\s+Small$", r"\s+Red$", r"\s+Blue$",
            r"\s+New$", r"\s+Old$"]
FL_TIERS = [("Large", 4), ("Hot", 4), ("Red", 3), ("Small", 1), ("Cold", 1), ("Old", 1)]

# Rule leaderboard on part: org by case-insensitive substring, first rule wins.
RL_RULES = [(["ring", "rod"], "Jewel Co"), (["bolt", "gear"], "Hardware Co"),
            (["hot", "cold"], "Thermal Co"), (["widget", "gizmo"], "Gadget Co")]
RL_TOP_N = 15

# Snapshot freshness on events: source = event type, fetched_at = ts.
SN_AS_OF = "2024-01-30 23:00:00"
SN_TTLS = {"click": 300, "view": 21600, "purchase": 86400, "signup": 86400, "error": 300}
SN_SOURCES = ["click", "view", "purchase", "signup", "error", "refund"]

# Feeds.
TOPK_LANG = "en"
TOPK_N = 200
PAGE_PATTERN = r"^https?://[^/]+/([a-z]{2})/([0-9]+)"

# Newest landing on pages: landed day by id, in dated folders. Publication: three refreshes of events.
LD_FIRST_DAY = "2024-03-01"
LD_DAYS = 30
PB_VERSIONS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00", "2024-01-31 00:00:00"]
PB_COHORTS = 7

# Incremental decayed totals on events.
IN_AS_OF = "2024-02-15"

# Drifting documents on events: pages of seven events; the category looked for is often absent. Package files of 40 events' span.
VA_EVENTS = 7
VA_CATEGORY = "view"
VA_PATTERN = r'(?s)id="leaderboard-data"[^>]*>\s*(.*?)\s*</script>'
QU_EVENTS = 200

# Rule table over part phrases; interval table over prices; sketches of visitors; heavy customers; freshness replay.
RT_RULES = 5000
RT_ADJECTIVES = ["small", "red", "blue", "hot", "old", "large", "new", "cold"]
RT_NOUNS = ["ring", "widget", "bolt", "gear", "gizmo", "plate", "rod", "cog"]
RT_TYPES = ["ECONOMY", "SMALL", "MEDIUM", "PROMO", "LARGE", "STANDARD"]
IV_INTERVALS = 10000
SK_RANGES = [("all", "2024-01-01", "2024-01-31"), ("first week", "2024-01-01", "2024-01-07"), ("one day", "2024-01-15", "2024-01-15"),
             ("last ten days", "2024-01-22", "2024-01-31")]
HH_TOP_N = 25
FR_CUTS = ["2000-01-01", "2024-01-08", "2024-01-16", "2024-01-24", "2100-01-01"]
