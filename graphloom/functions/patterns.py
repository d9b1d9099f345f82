"""Names, patterns and numbers that results depend on. They are data, given as they must be."""

# Query parameters that a normalized URL drops.
TRACKING_PARAMS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid", "mc_cid", "mc_eid"]
# Hosts that must not be fetched.
BLOCKED_HOSTS = ["localhost", "127.0.0.1", "0.0.0.0", "::1", "metadata.google.internal", "169.254.169.254", "instance-data", "100.100.100.200"]
PRIVATE_HOST = r"^(10\.\d+|127\.\d+|0\.\d+|169\.254|192\.168|172\.(1[6-9]|2\d|3[01]))\.\d+\.\d+$"
# Prompt injection.
INJECTION = [
    r"ignore\s+(all\s+)?previous\s+instructions",
    r"disregard\s+(all\s+)?prior",
    r"you\s+are\s+now\s+(a|an)\s+",
    r"act\s+as\s+(a|an)\s+",
    r"pretend\s+you\s+are",
    r"system\s*:\s*",
    r"ADMIN\s*:",
    r"<\|system\|>",
    r"\[INST\]",
]
# Placeholder descriptions and summaries, series intros.
TEMPLATE_DESCRIPTION = [r"EntityType\.\w+", r"in the source content", r"is a EntityType"]
TEMPLATE_SUMMARY = [r"EntityType\.\w+", r"is a EntityType"]
SERIES_NAME = [r"Day \d+ of ", r"episode \d+", r"Part \d+ of "]
# OCR noise and screen recordings.
OCR_NOISE = [
    r"(?:like|follow|share|comment|save|subscribe|watch)\s+(?:this|more|now)",
    r"\d+[kKmM]?\s*(?:likes?|views?|followers?)",
    r"(?:instagram|facebook|youtube)\s*(?:reel|video|post)",
    r"(?:tap|click)\s+(?:here|link|bio)",
    r"(?:part|day)\s+\d+\s+(?:of|/\d+)",
    r"(?:link\s+in\s+bio|follow\s+for\s+more)",
    r"(?:check\s+out|visit)\s+(?:my|our|the)\s+(?:profile|page|link)",
    r"(?:drop\s+a?\s*(?:follow|like|comment))",
    r"(?:new\s+(?:video|reel|post)\s+every)",
    r"(?:thanks?\s+for\s+(?:watching|following|liking))",
    r"(?:dm\s+(?:me|us)\s+for)",
    r"(?:comment\s+(?:below|your|any))",
    r"(?:share\s+(?:this|with))",
    r"(?:save\s+(?:this|for\s+later))",
    r"(?:link\s+in\s+the\s+(?:bio|description|comments?))",
    r"(?:follow\s+(?:me|us|@)\w*)",
]
SCREEN_RECORDING = [
    r"(?:screen\s+recording|screencast|screen\s+capture)",
    r"(?:cursor|mouse|click(?:ed|ing)?)\s+(?:on|at|over)",
    r"(?:tab|window|browser)\s+(?:bar|tab|address)",
    r"(?:url|address)\s+bar\s+(?:shows?|displays?|reads?)",
    r"(?:type(?:ing)?|enter(?:ing)?)\s+(?:in|into)\s+(?:the|a|url|search)",
]
PLATFORMS = ["instagram", "facebook", "twitter", "youtube", "tiktok", "linkedin", "reddit", "pinterest", "snapchat", "whatsapp", "discord", "slack", "telegram", "signal", "wechat"]
GENERIC_TERMS = ["website", "web app", "mobile app", "landing page", "dashboard", "interface", "ui", "ux", "animations", "css", "html", "code", "editor", "browser", "screen", "button", "form", "modal", "header", "footer", "sidebar", "menu", "navigation", "project", "tool", "framework", "library", "platform", "app", "application", "software", "service", "api"]
# Misspelling -> name.
MISSPELLINGS = {
    "apprite": "appwrite", "appwite": "appwrite", "appright": "appwrite", "contra": "contract", "doker": "docker", "dockr": "docker", "reactjs": "react", "react.js": "react",
    "vuejs": "vue", "vue.js": "vue", "angualr": "angular", "nxtjs": "nextjs", "next.js": "nextjs", "tailwindcss": "tailwind", "postgrsql": "postgresql", "postgres": "postgresql",
    "mongdb": "mongodb", "mongo": "mongodb", "figma": "figma", "canva": "canva", "notion": "notion", "vercel": "vercel", "netlify": "netlify", "heroku": "heroku",
    "firebase": "firebase", "supabase": "supabase", "prisma": "prisma", "typeorm": "typeorm", "fastapi": "fastapi", "flask": "flask", "django": "django", "express": "express",
    "nodejs": "nodejs", "node.js": "nodejs", "typescript": "typescript", "javscript": "javascript", "javasript": "javascript", "python": "python", "rust": "rust", "golang": "go",
    "cplusplus": "cpp", "csharp": "csharp", "rubyonrails": "ruby on rails", "rails": "ruby on rails",
}
# Known domains, in order of precedence.
DOMAINS = ["github.com", "gitlab.com", "bitbucket.org", "vercel.com", "netlify.com", "heroku.com", "firebase.google.com", "supabase.com", "appwrite.io", "figma.com", "canva.com", "notion.so", "linear.app", "posthog.com", "mixpanel.com", "amplitude.com", "segment.com", "algolia.com", "elastic.co", "mongodb.com", "postgresql.org", "mysql.com", "redis.io", "docker.com", "kubernetes.io", "terraform.io", "aws.amazon.com", "azure.microsoft.com", "cloud.google.com"]
SUSPICIOUS_DOMAIN = [r"\.(in|co\.in|org\.in)$", r"[0-9]+\.com$", r"^[a-z]{2,}\d+\.com$"]
# Transcripts.
MUSIC_MARKERS = ["[music]", "[applause]", "[sound]", "[silence]", "[instrumental]", "[background music]"]
ACTION_VERBS = ["open", "click", "install", "run", "copy", "paste", "go to", "type", "select", "choose", "create", "set up"]
HINGLISH_MARKERS = ["hai ", "hain ", "kya ", "kaise ", "mein ", "tumhe ", "pata ", "hon ", "chahiye ", "yeh ", "woh ", "aur ", "lekin ", "kyunki ", "ab ", "jo ", "tum ", "hum ", "aap ", "se ", "ko ", "ka ", "ki "]
NOISE_LINES = [
    r"\d+[KkMm]?\s*likes?$", r"\d+\s*(comments?|replies?)$", r"Follow$", r"Following$", r"Message$", r"Share$", r"Save$", r"Add a comment", r"View all \d+", r"Reply",
    r"@\w+", r"\d+[KkMm]?\s*followers?$", r"\d+\s*posts?$", r"See more", r"Translate", r"Send via message", r"Copy link", r"QR code",
]
BOILERPLATE = r"(?i)cookie|privacy policy|terms of service|subscribe|newsletter"
# Keywords of each category, in order of precedence.
CATEGORY_KEYWORDS = {
    "app_development": ["android", "ios", "flutter", "react native", "swift", "kotlin", "mobile app"],
    "web_development": ["html", "css", "javascript", "react", "vue", "angular", "website", "frontend", "backend"],
    "ai_agent_upskilling": ["ai", "llm", "gpt", "claude", "agent", "machine learning", "deep learning"],
    "system_performance_enhance": ["docker", "kubernetes", "aws", "azure", "cloud", "server", "devops"],
    "life_lessons": ["mindset", "habit", "productivity", "motivation", "success", "failure"],
    "financial_advice": ["money", "invest", "trading", "stock", "crypto", "income", "profit"],
    "database_technology": ["sql", "mysql", "postgresql", "mongodb", "database", "redis"],
    "productivity": ["tool", "workflow", "automation", "shortcut", "efficiency", "todo"],
    "freelancing": ["client", "freelance", "remote", "upwork", "fiverr", "contract"],
    "marketing": ["seo", "social media", "content", "audience", "brand", "campaign"],
    "education_and_learning": ["tutorial", "course", "learn", "teach", "education", "training"],
    "ai_and_technology": ["tech", "software", "programming", "code", "developer", "coding"],
    "content_creation": ["video", "youtube", "editing", "premiere", "davinci", "after effects", "production"],
}
# HTTP errors.
TEMPORARY_STATUS, PERMANENT_STATUS, AUTH_STATUS = [408, 429, 500, 502, 503, 504], [400, 404, 410, 422], [401, 403, 407]
TEMPORARY_ERROR = ["timeout", "rate.?limit", "too many requests", "service unavailable", "gateway error"]
AUTH_ERROR = ["unauthorized", "forbidden", "login required", "access denied", "sign.?in"]
NETWORK_ERROR = ["connection refused", "dns", "network unreachable", "name or service not known"]
# Queries.
QUESTION_WORDS = ["how", "what", "why", "where", "when", "which"]
SEMANTIC_WORDS = ["similar", "like", "about", "related to", "concept"]
RELATION_WORDS = ["connect", "depend", "use", "call", "import", "inherit"]
# vector, fulltext and graph weights of each query class
WEIGHTS = {"lookup": (0.2, 0.7, 0.1), "semantic": (0.7, 0.2, 0.1), "relationship": (0.2, 0.1, 0.7), "balanced": (0.5, 0.3, 0.2)}
# Guides and projects.
PROJECT_INDICATORS = [r"build\s+(a|your|the)\s+", r"create\s+(a|your|the)\s+", r"project\s*:", r"app\s*:", r"repository\s*:", r"github\.com/"]
BUILD_WORDS = ["install", "npm", "clone", "setup", "run", "build", "deploy"]
TUTORIAL_WORDS = ["step", "how to", "tutorial", "guide", "instructions", "first", "then", "next", "finally", "copy", "paste", "click", "open", "go to", "visit"]
# Mentions.
PROGRESS_MARKER = [r"^day\s+\d+", r"^\d+/\d+$", r"^week\s+\d+", r"^part\s+\d+", r"^step\s+\d+", r"^level\s+\d+"]
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
# Task budgets: input tokens, output tokens; prices of 1000 tokens.
BUDGETS = {"extraction": (12000, 4000), "summary": (16000, 2000), "categorization": (4000, 1000), "validation": (8000, 1000), "classification": (2000, 500)}
PRICE_IN, PRICE_OUT = 0.00015, 0.0006
# Captions: what a login page shows in its first 200 characters, and what the feed around a post looks like.
LOGIN_MARKERS = ["Log in", "Password"]
FEED = [
    r"•\s*\nFollow",
    r"(?:Blood Soul|CLASH|Effects pack)",
    r"(?:Watch Story|𝐖𝐚𝐭𝐜𝐡 𝐒𝐭𝐨𝐫𝐲)",
    r"(?:Japanese|ジャンプ|サーブ|バレーボール)",
    r"(?:Free Certifications|Google & Microsoft)",
    r"(?:Automatic bridge in Minecraft)",
    r"(?:弥渡山歌|YANGYINYUE)",
    r"(?:Follow button kon)",
    r"(?:Surjit Bindrakhia|Lakk Tunoo)",
    r"(?:Lo aa gay|new trend)",
    r"·\s*[A-Z]",
    r"(?:trend|viral|fyp|explore)",
]
# Names of tools in a text, and the address of a video.
TOOL_NAMES = [r"(?:using|use|try|download)\s+([A-Z][a-zA-Z]+)", r"([A-Z][a-zA-Z]+)\s+(?:tool|software|app)"]
TEXT_URL = r"https?://[^\s<>\"]+"
VIDEO_URL = "https://www.youtube.com/watch?v="
# Search hits that are never kept: by host, by title.
HIT_HOSTS = ["google.com", "www.google.com", "accounts.google.com", "facebook.com", "www.facebook.com", "m.facebook.com", "twitter.com", "www.twitter.com", "x.com", "instagram.com", "www.instagram.com", "linkedin.com", "www.linkedin.com", "reddit.com", "www.reddit.com", "youtube.com", "www.youtube.com", "tiktok.com", "www.tiktok.com", "pinterest.com", "www.pinterest.com", "medium.com", "dev.to", "quora.com", "www.quora.com", "wikipedia.org", "en.wikipedia.org"]
HIT_TITLES = r"(sign.?in|log.?in|log.?on|sign.?up|register|create.?account|forgot.?password|cookie|privacy|terms.?of|sponsored|advertisement|ad\b|page.?not.?found|404|error|download.?now|install|upgrade|privacy.?policy|terms.?and.?conditions)"
# Hits about something else: by part of the address, by words of title or snippet.
OFF_TOPIC_DOMAINS = ["uidai.gov.in", "aadhaar", "heromotocorp.com", "hero.in", "bikewale.com", "bikedekho.com", "ktmindia.com", "ktm.com", "bajaj.com", "tvs.com", "scroll.in", "scrolller.com", "timesofindia.com", "hindustantimes.com", "ndtv.com", "news18.com", "republicworld.com", "wikipedia.org", "britannica.com", "amazon.com", "flipkart.com", "ebay.com", "myntra.com", "ajio.com", "facebook.com", "twitter.com", "instagram.com", "whatsapp.com", "wa.me", "linkedin.com", "reddit.com", "quora.com", "smartprix.com", "91mobiles.com", "gadgets360.com", "merriam-webster.com", "dictionary.com", "cambridge.org", "techcrunch.com", "theverge.com", "wired.com", "naukri.com", "indeed.com", "glassdoor.com"]
OFF_TOPIC_PATHS = ["/dictionary/", "/definition/", "/encyclopedia/", "/buy/", "/price/", "/shop/", "/news/", "/sports/", "/entertainment/"]
OFF_TOPIC_WORDS = ["motorcycle", "bike", "scooter", "vehicle", "automobile", "car", "price", "mileage", "on-road", "ex-showroom", "engine", "news", "article", "blog post", "opinion", "editorial", "recipe", "cooking", "food", "restaurant", "cricket", "football", "sports", "match", "movie", "film", "celebrity", "bollywood", "buy", "discount", "offer", "sale", "salary", "hiring", "job opening", "interview"]
# Hits that are no reference: by part of the address, by part of the title; names that are an address themselves.
NO_REFERENCE_DOMAINS = ["whatsapp.com", "wa.me", "facebook.com", "twitter.com", "instagram.com", "linkedin.com", "reddit.com", "quora.com", "myntra.com", "ajio.com", "amazon.com", "flipkart.com", "merriam-webster.com", "dictionary.com", "cambridge.org", "wikipedia.org", "britannica.com", "naukri.com", "indeed.com", "glassdoor.com", "timesofindia.com", "hindustantimes.com", "ndtv.com"]
NO_REFERENCE_TITLES = ["sign in", "log in", "login", "register", "privacy policy", "terms of service", "cookie", "advertisement"]
SITE_NAME = r"^[a-zA-Z0-9-]+\.(com|org|net|io|dev|app|co)$"
# Types of entities that have no site of their own.
SITELESS_TYPES = ["concept", "principle", "technique", "unknown"]
