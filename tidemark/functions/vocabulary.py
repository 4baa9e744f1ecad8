"""Word lists, patterns, weights and limits that results depend on."""

# Enumerations of the data model.
OWNER_ROLES = ["solutions_architect", "account_executive"]
SOURCE_SYSTEMS = [
    "salesforce", "project_inventory", "usage_metrics", "careers_page", "ats_feed",
    "sitemap", "linkedin_api", "company_news", "manual",
]
SIGNAL_CATEGORIES = ["new_project", "consumption_growth", "it_hiring", "it_company_news"]
EVIDENCE_KINDS = ["project_record", "usage_metric", "job_posting", "company_article", "company_post"]
SEVERITIES = ["info", "warning", "critical"]
DIRECTIONS = ["expansion", "risk", "neutral"]
RUN_STATUSES = ["succeeded", "partial", "failed"]
DELIVERY_FAILURE = "slack_delivery_failed"

# Spellings of owner roles.
OWNER_ROLE_ALIASES = {
    "ae": "account_executive",
    "account_executive": "account_executive",
    "account executive": "account_executive",
    "sa": "solutions_architect",
    "solutions_architect": "solutions_architect",
    "solutions architect": "solutions_architect",
}

# Unit spellings, canonical unit and multiplier.
USAGE_UNITS = {
    "b": ("bytes", 1), "byte": ("bytes", 1), "bytes": ("bytes", 1),
    "kb": ("bytes", 1_000), "kilobyte": ("bytes", 1_000), "kilobytes": ("bytes", 1_000),
    "mb": ("bytes", 1_000_000), "megabyte": ("bytes", 1_000_000),
    "gb": ("bytes", 1_000_000_000), "gigabyte": ("bytes", 1_000_000_000),
    "request": ("requests", 1), "requests": ("requests", 1),
}

# Phrases that mark text as an instruction rather than data.
INSTRUCTION_PATTERNS = [
    r"(?i)ignore\s+(?:all\s+)?(?:previous|prior|above)\s+instructions?",
    r"(?i)(?:system|developer)\s+message\s*:",
    r"(?i)reveal\s+(?:your|the)\s+(?:prompt|instructions?)",
    r"(?i)disregard\s+the\s+(?:safety|classification)\s+rules?",
]

# Job taxonomy (label, terms, weight); terms match as substrings.
JOB_TAXONOMY = [
    ("software engineering", ["software", "backend", "front end", "frontend", "full stack", "fullstack", "web developer", "application engineer", "developer"], 35),
    ("platform and infrastructure", ["platform", "infrastructure", "sre", "site reliability", "devops", "cloud", "kubernetes", "systems engineer", "network engineer"], 35),
    ("data and AI", ["data engineer", "machine learning", "ml engineer", "artificial intelligence", " ai ", "analytics engineer", "data scientist"], 30),
    ("security", ["security engineer", "application security", "cybersecurity", "information security", "iam", "security"], 30),
    ("technical leadership", ["chief technology officer", " vp engineering", "engineering manager", "technical lead", "technology director"], 25),
    ("technical product", ["solutions architect", "technical program", "technical product", "developer experience", "developer relations", "technical support"], 20),
]
NON_IT_TERMS = [
    "recruiter", "recruiting", "human resources", "people operations", "marketing", "sales", "account executive",
    "customer success", "finance", "legal", "designer", "design", "content", "copywriter", "public relations",
]
JOB_RELEVANCE_MINIMUM = 20

# Company-news taxonomy (category, label, keywords, direction, severity).
NEWS_TAXONOMY = [
    ("web_modernization", "web modernization", ["website redesign", "web redesign", "modernize our website", "headless", "frontend rebuild", "web platform"], "expansion", "warning"),
    ("ai", "AI", ["artificial intelligence", "machine learning", "generative ai", "ai platform", "ai assistant", "llm"], "expansion", "warning"),
    ("cloud", "cloud", ["cloud migration", "cloud infrastructure", "cloud platform", "multi-cloud", "kubernetes", "serverless"], "expansion", "warning"),
    ("developer_experience", "developer experience", ["developer experience", "developer portal", "developer tooling", "internal developer platform", "software development kit", "sdk"], "expansion", "warning"),
    ("ecommerce", "ecommerce", ["e-commerce", "ecommerce", "online store", "checkout", "commerce platform", "digital storefront"], "expansion", "warning"),
    ("digital_launch", "digital launch", ["launches a digital", "digital product launch", "new mobile app", "new online service", "digital experience launch", "goes live online"], "expansion", "warning"),
    ("hiring", "IT hiring", ["hiring engineers", "engineering team", "technology hires", "software engineers", "platform engineers", "chief technology officer", "cto"], "expansion", "info"),
    ("platform_change", "platform change", ["infrastructure consolidation", "platform migration", "technology consolidation", "replace our platform", "deprecating", "data center exit", "vendor consolidation"], "risk", "warning"),
]

# Topics that make a first-party news item relevant.
TECHNOLOGY_TERMS = [
    "ai", "cloud", "cybersecurity", "data platform", "engineering", "infrastructure", "machine learning",
    "platform", "security", "software", "technology",
]

# Opportunity themes of news signals, first list that matches wins.
THEME_KEYWORDS = [
    ("ai", ["artificial intelligence", "machine learning", "generative ai", "ai platform", "ai assistant", "llm"]),
    ("cloud", ["cloud", "kubernetes", "serverless", "infrastructure"]),
    ("web-modernization", ["website", "web redesign", "frontend", "headless", "web platform"]),
    ("developer-experience", ["developer experience", "developer portal", "developer tooling", "sdk"]),
    ("ecommerce", ["e-commerce", "ecommerce", "checkout", "digital storefront"]),
    ("platform-change", ["platform migration", "vendor consolidation", "deprecating", "data center exit"]),
]
HIRING_THEME_WORDS = ["hiring", "engineer", "cto"]
CATEGORY_THEMES = {
    "new_project": "platform-adoption",
    "consumption_growth": "consumption-growth",
    "it_hiring": "it-hiring",
}

# Scores by severity.
SEVERITY_WEIGHT = {"info": 15, "warning": 30, "critical": 50}
SEVERITY_FACTOR = {"info": 0.45, "warning": 0.7, "critical": 1.0}
SEVERITY_RANK = {"critical": 3, "warning": 2, "info": 1}

# Words that are no part of a company name.
LEGAL_SUFFIXES = [
    "gmbh", "ag", "se", "sa", "inc", "ltd", "llc", "plc", "kg", "co", "corp", "bv", "nv", "ab", "as", "oy",
    "spa", "srl", "sarl", "group", "holding", "international",
]

# Hosts that never carry an account event.
EXCLUDED_HOSTS = ["linkedin.com", "exa.ai"]
LISTING_HOSTS = [
    "play.google.com", "apps.apple.com", "apkcombo.com", "apkpure.com", "apkmirror.com", "uptodown.com", "apk.support",
    "appbrain.com", "40407.com", "composio.dev", "zapier.com", "pipedream.com", "n8n.io", "make.com", "rapidapi.com",
    "apify.com", "mcp.so", "smithery.ai", "glama.ai", "pulsemcp.com",
]
REVIEW_HOSTS = ["trustpilot.com", "kununu.com", "glassdoor.com"]
APP_LISTING_TITLE = r"(?i)\bapk\b|apps on google play|on the app store"
HOMEPAGE_PATH_PART = "(?i)^[a-z]{2}([-_][a-z]{2}([-_][a-z]{3})?)?$"

# Query parameters that do not identify a page.
TRACKING_PARAMETERS = "(?i)^(utm_|fbclid$|gclid$|mc_)"
JOB_TRACKING_PARAMETERS = "(?i)^(utm_|ref$|source$|gh_)"

# What counts as a secret in log text.
SECRET_KEY = r"(?i)(?:authorization|api[-_]?key|credential|cookie|password|private[-_]?key|secret|token)"
RAW_KEY = r"(?i)(?:body|payload|raw|response|request)"
# length of a logged message
MESSAGE_CHARS = 500
REDACTIONS = [
    (r"(?i)\b(?:bearer|basic)\s+[A-Za-z0-9+/_=.-]+", "[REDACTED]"),
    (r"(?i)((?:[?&]|\b)(?:token|key|secret|password|signature|auth)\s*=\s*)[^&#\s]+", "$1[REDACTED]"),
    (r"(?i)\b(?:sk|pk|ghp|xox[baprs])-?[A-Za-z0-9_-]{12,}\b", "[REDACTED]"),
    (r"[\x00-\x1f\x7f]", " "),
]

# Delivered-id lines of a brief.
REPORTED_IDS_LINE = r"^\s*\**Reported signal IDs:\**\s*(.*)$"
REPORTED_ID = r"^[^\s,<>`*|]{1,128}$"
DELIVERED_STATUS = r"(?:^|\n)\**Status:\**\s*(?:Complete|Partial)\b"

# Limits.
MAX_COMPARISON_DAYS = 31
MAX_QUERY_DAYS = 366
MAX_OPPORTUNITIES = 5
MAX_DIGEST_ACCOUNTS = 3
MAX_ITEMS_PER_ACCOUNT = 10
NEWS_LOOKBACK_DAYS = 7
NEWS_MAX_EVENTS = 6
NEWS_JUDGE_BATCH = 10
NEWS_RETENTION_DAYS = 21
LEDGER_RETENTION_DAYS = 21
# days after the last use of a record, and after an account has left the scope
RECORD_RETENTION_DAYS = 90
SCOPE_RETENTION_DAYS = 30
LEDGER_IDS_PER_CALL = 100
BRIEF_ROW_LIMIT = 25
RETENTION_COUNTS = {
    "accounts": 1_000, "snapshots": 10_000, "observations": 50_000, "signals": 50_000, "runs": 1_000, "checkpoints": 10_000,
}
