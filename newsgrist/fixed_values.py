"""Lists, patterns and defaults that results depend on."""

# Query parameters removed from a canonical url (compared in lower case).
TRACKING_PARAMS = [
    "utm_source",
    "utm_medium",
    "utm_campaign",
    "utm_term",
    "utm_content",
    "utm_id",
    "utm_reader",
    "utm_referrer",
    "fbclid",
    "gclid",
    "igshid",
    "msclkid",
    "twclid",
    "yclid",
    "mc_cid",
    "mc_eid",
    "_hsenc",
    "_hsmi",
]

# Tag-name prefixes that separate blocks: their tags become a space, others vanish.
BLOCK_TAGS = ["p", "div", "br", "hr", "li", "ul", "ol", "h[1-6]", "blockquote", "pre"]

# Punctuation that takes no space before it.
TIGHT_PUNCTUATION = ".,;:!?"

# Token shapes masked wherever they occur.
TOKEN_PATTERNS = [
    r"\b\d{8,10}:[A-Za-z0-9_-]{35}\b",
    r"\bghp_[A-Za-z0-9]{36}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{82}\b",
]
MASK = "***REDACTED***"
MIN_SECRET_LENGTH = 4

# Hours east of UTC of the zone names a feed date may carry.
ZONE_HOURS = {
    "UT": 0, "UTC": 0, "GMT": 0, "Z": 0,
    "AST": -4, "ADT": -3, "EST": -5, "EDT": -4, "CST": -6,
    "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7,
}

# Run defaults.
THRESHOLD = 3
TITLE_WEIGHT = 3
DESCRIPTION_WEIGHT = 1
CATEGORY_WEIGHT = 1
MAX_AGE_HOURS = 48
NOTIFICATION_LIMIT = 50
FEED_MAX_ITEMS = 30
STORY_MAX_ITEMS = 50
REPO_MAX_RESULTS = 20

# Message limits (code points).
MAX_MESSAGE_LENGTH = 4096
MAX_DESCRIPTION_LENGTH = 400
ELLIPSIS = "..."

# Default rule set: category -> keywords, both in rule order.
DEFAULT_RULES = {
    "AI": [
        "artificial intelligence", "artificial general intelligence", "generative ai",
        "generative artificial intelligence", "large language model",
        "large language models", "llm", "llms", "multimodal", "ai agent", "ai agents",
        "agentic ai", "foundation model", "foundation models", "text-to-image",
        "text-to-video", "speech recognition", "speech generation",
    ],
    "ML": [
        "machine learning", "deep learning", "neural network", "neural networks",
        "transformer", "transformers", "computer vision", "natural language processing",
        "nlp", "reinforcement learning", "fine-tuning", "embeddings",
    ],
    "Programming": [
        "python", "javascript", "typescript", "rust", "golang", "java", "c++", "c#", "php",
        "programming language", "compiler", "interpreter",
    ],
    "Software Development": [
        "software development", "software engineering", "developer tools",
        "developer experience", "framework", "frameworks", "library", "libraries", "sdk",
        "api", "ide", "code editor", "testing", "debugging", "version control",
    ],
    "Open Source": [
        "open source", "open-source", "open source software", "github", "gitlab",
        "self-hosted",
    ],
    "Cybersecurity": [
        "cybersecurity", "cyber security", "information security", "vulnerability",
        "vulnerabilities", "exploit", "exploits", "malware", "ransomware",
        "security research", "zero-day", "zero day", "authentication", "data breach",
    ],
    "Cloud / Infrastructure": [
        "cloud computing", "cloud infrastructure", "kubernetes", "docker", "container",
        "containers", "serverless", "infrastructure", "devops", "platform engineering",
        "observability", "distributed systems",
    ],
    "General Technology": [
        "technology", "computing", "software", "hardware", "processor", "cpu", "gpu",
        "semiconductor", "database", "operating system", "linux", "windows", "macos",
    ],
    "Gaming Technology": [
        "game engine", "game development", "graphics engine", "rendering", "unreal engine",
        "unity", "godot", "graphics processing", "game technology",
    ],
    "Research": [
        "research", "research paper", "academic paper", "arxiv", "benchmark", "dataset",
        "scientific computing",
    ],
}
