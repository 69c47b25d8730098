"""Fixed values.

These lists and maps must equal the source dashboard's values for the marts
to give the same answers. They are data, not logic: operators receive them as
parameters, so the same operators run with other domain maps (as the queries
on the driver tables do).
"""

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reference dashboard exactly)
# ---------------------------------------------------------------------------

# Leaderboard: benchmark categories in display order, each with its benchmarks.
CATEGORY_MAP = {
    "Math": ["MATH level 5", "OTIS Mock AIME 2024-2025"],
    "Code": ["WeirdML"],
    "Reasoning": ["ARC-AGI-2"],
    "Science": ["GPQA diamond"],
    "Common Sense": ["SimpleBench"],
}
LEADERBOARD_TOP_N = 8

# Price map: organisations kept.
TOP_ORGS = ["openai", "anthropic", "google", "meta-llama", "mistralai",
            "deepseek", "x-ai", "qwen"]
PRICE_CAP_PER_1M = 100.0
PRICE_MAX_AGE_SECONDS = 365 * 86400

# Decayed downloads: display names, excluded orgs, decay constants.
ORG_DISPLAY_NAMES = {
    "Qwen": "Qwen (Alibaba)",
    "meta-llama": "Meta",
    "openai-community": "OpenAI (community)",
    "openai": "OpenAI",
    "deepseek-ai": "DeepSeek",
    "nvidia": "NVIDIA",
    "microsoft": "Microsoft",
    "mistralai": "Mistral",
    "google": "Google",
    "facebook": "Meta (legacy)",
    "EleutherAI": "EleutherAI",
    "HuggingFaceTB": "HuggingFace",
}
DOWNLOADS_EXCLUDED_ORGS = ["trl-internal-testing", "dphn", "hmellor", "community"]
DECAY_K = 0.693
HALF_LIFE_DAYS = 60
MISSING_AGE_DAYS = 365
DOWNLOADS_TOP_N = 12

# Flagship filter: suffixes stripped in this order, then tier keywords in this order.
FAMILY_STRIP_PATTERNS = [
    r"\s*\(.*\)$",
    r"\s*-Codex-Max$", r"\s*-Codex$", r"\s+Codex$",
    r"\s+Instant$", r"\s+Fast$", r"\s*-Exp$",
    r"\s+Image.*$", r"\s+Thinking$",
    r"\s+Pro$", r"\s+Flash$",
]
TIER_KEYWORDS = [
    ("Pro", 4), ("Opus", 4),
    ("Sonnet", 3),
    ("Haiku", 1), ("Flash", 1), ("Fast", 1), ("Instant", 1),
    ("Codex", 1), ("Exp", 1),
]
DEFAULT_TIER = 2
FLAGSHIP_MONTHS = 6

# Release timeline: organisation consolidation (unmapped names are dropped).
TIMELINE_ORG_MAP = {
    "Google": "Google",
    "Google DeepMind": "Google",
    "Google Research": "Google",
    "Google Brain": "Google",
    "DeepMind": "Google",
    "Meta AI": "Meta",
    "Facebook AI Research": "Meta",
    "Facebook": "Meta",
    "OpenAI": "OpenAI",
    "Anthropic": "Anthropic",
    "Alibaba": "Alibaba",
    "Microsoft": "Microsoft",
    "DeepSeek": "DeepSeek",
    "xAI": "xAI",
    "Baidu": "Baidu",
    "ByteDance": "ByteDance",
    "NVIDIA": "NVIDIA",
    "Mistral AI": "Mistral",
    "Moonshot": "Moonshot",
    "Zhipu AI": "Zhipu AI",
    "MiniMax": "MiniMax",
}
TIMELINE_MIN_DATE = "2020-01-01"

# Benchmark-only models: organisation by case-sensitive name prefix, first rule wins.
BENCHMARK_ORG_PREFIXES = [
    (["GPT-", "o1", "o3", "o4"], "OpenAI"),
    (["Claude"], "Anthropic"),
    (["Gemini"], "Google"),
    (["Llama", "LLaMA"], "Meta"),
    (["DeepSeek"], "DeepSeek"),
    (["Qwen"], "Alibaba"),
    (["Kimi"], "Moonshot"),
    (["GLM"], "Zhipu AI"),
    (["MiniMax"], "MiniMax"),
    (["Mistral", "Magistral"], "Mistral"),
    (["Grok"], "xAI"),
]

# Chip makers: country of origin (unknown makers are "Other").
CHIP_MANUFACTURER_COUNTRY = {
    "NVIDIA": "US",
    "AMD": "US",
    "Intel": "US",
    "Google": "US",
    "Amazon AWS": "US",
    "Meta": "US",
    "Microsoft": "US",
    "Tesla": "US",
    "Huawei": "China",
    "Cambricon": "China",
    "Kunlunxin Baidu": "China",
    "MetaX": "China",
    "Iluvatar CoreX": "China",
    "Alibaba": "China",
    "Hygon": "China",
    "Biren": "China",
    "Moore Threads (Tencent)": "China",
    "Sunway": "China",
    "National University of Defense Technology": "China",
    "PEZY": "Japan",
}
CHIP_TOP_N = 10

# Context sizes: excluded ids, buckets (label, low, high), both ends inclusive.
CONTEXT_EXCLUDE_IDS = ["openrouter/auto"]
CONTEXT_BUCKETS = [
    ("≤ 8K", 0, 8_192),
    ("8–32K", 8_193, 32_768),
    ("32–128K", 32_769, 131_072),
    ("128–256K", 131_073, 262_144),
    ("256K–1M", 262_145, 1_048_576),
    ("> 1M", 1_048_577, None),
]
CONTEXT_VARIANT_TAGS = ["free", "extended", "beta", "nitro", "floor"]
BUCKET_EXAMPLES = 3
NO_EXAMPLES = "—"

# Cluster map: region rules (map first, then the European set, else "Other").
EU_COUNTRIES = [
    "France", "Germany", "Italy", "Netherlands", "Spain", "Sweden",
    "Finland", "Ireland", "Poland", "Denmark", "Belgium", "Austria",
    "Norway", "Switzerland", "Czech Republic", "Portugal", "Romania",
    "United Kingdom",
]
GPU_REGION_MAP = {
    "United States of America": "United States",
    "China": "China",
}
JITTER_SEED = 42
JITTER_LAT = 5.0
JITTER_LON = 8.0
ANONYMIZED_MARK = "anonymized"
OWNER_TOP_N = 5

# Capability matrix: display names and the six capabilities
# (column, modality array, modality value).
CAPABILITY_ORG_NAMES = {
    "openai": "OpenAI",
    "google": "Google",
    "qwen": "Qwen",
    "anthropic": "Anthropic",
    "mistralai": "Mistral",
    "meta-llama": "Meta",
    "z-ai": "Zhipu AI",
    "nvidia": "NVIDIA",
    "deepseek": "DeepSeek",
    "x-ai": "xAI",
}
CAPABILITY_SPEC = [
    ("Vision", "input", "image"),
    ("Audio in", "input", "audio"),
    ("Video in", "input", "video"),
    ("Files", "input", "file"),
    ("Image gen", "output", "image"),
    ("Audio gen", "output", "audio"),
]
CAPABILITY_TOP_N = 10

# Modality champions: pipeline tags and labels, org display names.
HF_MODALITY_TAGS = [
    ("text-to-image", "Images"),
    ("text-to-speech", "Voice"),
    ("text-to-video", "Video"),
    ("text-to-audio", "Music / Audio"),
    ("image-to-video", "Animation"),
    ("image-to-3d", "3D"),
    ("automatic-speech-recognition", "Transcription"),
]
MODALITY_ORG_NAMES = {
    "stabilityai": "Stability AI",
    "hexgrad": "Hexgrad",
    "Wan-AI": "Wan-AI",
    "facebook": "Meta",
    "lightx2v": "LightX2V",
    "microsoft": "Microsoft",
    "pyannote": "Pyannote",
}

# Coding leaderboard: organisation by case-insensitive substring, first rule wins.
SWEBENCH_ORG_PATTERNS = [
    (["Claude", "Anthropic"], "Anthropic"),
    (["GPT", "OpenAI", "o1", "o3", "o4"], "OpenAI"),
    (["Gemini", "Google"], "Google"),
    (["DeepSeek"], "DeepSeek"),
    (["Qwen", "Alibaba"], "Alibaba"),
    (["Llama", "Meta"], "Meta"),
    (["Mistral", "Codestral"], "Mistral"),
    (["MiniMax"], "MiniMax"),
    (["Grok", "xAI"], "xAI"),
]
SWEBENCH_CATEGORY = "bash-only"
SWEBENCH_TOP_N = 15
SWEBENCH_DATA_PATTERN = r'(?s)id="leaderboard-data"[^>]*>\s*(.*?)\s*</script>'

# Package downloads: packages, display names and company.
PYPI_PACKAGES = ["openai", "anthropic", "transformers", "google-generativeai",
                 "langchain", "together", "mistralai", "cohere", "replicate"]
PYPI_DISPLAY_NAMES = {
    "openai": "OpenAI",
    "anthropic": "Anthropic",
    "transformers": "HuggingFace (transformers)",
    "google-generativeai": "Google Gemini",
    "langchain": "LangChain",
    "together": "Together AI",
    "mistralai": "Mistral",
    "cohere": "Cohere",
    "replicate": "Replicate",
}
PYPI_COMPANY_MAP = {
    "openai": "OpenAI",
    "anthropic": "Anthropic",
    "transformers": "Other",
    "google-generativeai": "Google",
    "langchain": "Other",
    "together": "Other",
    "mistralai": "Mistral",
    "cohere": "Other",
    "replicate": "Other",
}

# Dated arena files.
ARENA_FILE_PATTERN = r"leaderboard_table_(\d{8})\.csv"

# Hub scans: remote top-k sizes.
HUB_TOP_MODELS = 200
HUB_TRENDING = 15
HUB_PIPELINE_TAG = "text-generation"

# Snapshot freshness (seconds) per source.
TTL_24H = 86400
TTL_6H = 21600
TTL_5MIN = 300
SOURCE_TTLS = {
    "benchmarks": TTL_24H,
    "notable": TTL_24H,
    "openrouter": TTL_5MIN,
    "hf_downloads": TTL_5MIN,
    "hf_trending": TTL_5MIN,
    "hf_modality": TTL_5MIN,
    "gpu_clusters": TTL_24H,
    "ml_hardware": TTL_24H,
    "swebench": TTL_6H,
    "pypi": TTL_24H,
    "lmarena": TTL_6H,
}

# Display formats.
LABEL_MAX_LEN = 22
ELLIPSIS = "…"

# Fallback texts.
UNKNOWN = "Unknown"
NOT_DISCLOSED = "Not disclosed"
OTHER = "Other"
COMMUNITY_ORG = "community"
NO_ORG = "—"

# Refresh status line (after the source label).
STATUS_FETCHING = "  ·  Fetching..."
STATUS_REFRESHED = "  ·  Last refreshed: "

# Insight sentences, as printf formats (Spark format_string / SQL printf).
INSIGHT_LEADERBOARD = ("%s leads overall, scoring highest in %s (%.1f%%). "
                       "%d models ranked from %d evaluated (%d had insufficient data).")
INSIGHT_PRICING = "%d models compared. Cheapest overall: %s ($%.2f prompt + $%.2f completion per 1M tokens)."
INSIGHT_DOWNLOADS = "%s leads with %s downloads across %d models in the top 200. Total across top 12 orgs: %s."
INSIGHT_TIMELINE = ("Since 2020, %s has released %d notable models — more than anyone else. "
                    "The largest training run recorded: %s by %s (%.1e FLOP).")
INSIGHT_TIMELINE_RECENT = " %d recent models are awaiting compute data."
INSIGHT_TIMELINE_NO_COMPUTE = "%s leads with %d notable models since 2020."
INSIGHT_CONTEXT = ("%d unique model families. The sweet spot is 32–128K tokens (%d models), "
                   "but %d models now exceed 1M tokens — led by %s at %s.")
INSIGHT_CHIPS = ("%s dominates with %d of %d registered AI chips (%.0f%%). "
                 "The hidden story: China has %d chip manufacturers (%d chips) vs %d for the US (%d chips).")
INSIGHT_GPU = ("%d GPU clusters across %d countries. China leads with %d clusters vs %d for the US. "
               "Total power: %,.0f MW. Biggest investors by H100 equivalents: %s.")
OWNER_MILLIONS = "%s (%,.1fM)"
OWNER_THOUSANDS = "%s (%,.0fK)"
INSIGHT_TRENDING = "#%d %s by %s leads with %s downloads."
INSIGHT_TRENDING_FRESHEST = " Freshest: %s (%d days old)."
INSIGHT_MODALITY = "Across %d AI modalities, %s's %s leads %s with %s downloads."
INSIGHT_CODING = "%s leads at %.1f%% of real GitHub issues resolved. %d of the top %d systems use open-source components."
