"""Fixed values. These must stay as they are for results to agree; all are defaults of
job parameters and can be replaced by the caller."""

# --- transcript cleaning -----------------------------------------------------------
FILLER_TERMS = [
    "um", "uh", "er", "ah", "like", "you know", "i mean", "sort of", "kind of",
    "basically", "actually", "literally", "honestly", "so yeah", "right", "okay",
    "alright", "well",
]

SPONSOR_PATTERNS = [
    r"this video is sponsored by",
    r"thanks to our sponsor",
    r"check out the link in the description",
    r"use code \w+ for \d+% off",
    r"affiliate link",
    r"don't forget to like and subscribe",
    r"hit that notification bell",
    r"support us on patreon",
    r"merch available at",
    r"follow me on instagram",
    r"follow me on twitter",
    r"check out my website",
]

INTRO_OUTRO_PATTERNS = [
    r"^(?:hey|hi|hello) (?:everyone|guys|folks|friends)",
    r"welcome back to (?:my|the) channel",
    r"today (?:we're|i'm) going to (?:talk about|show you|discuss)",
    r"before we get started",
    r"that's it for today",
    r"thanks for watching",
    r"see you (?:next time|in the next video)",
    r"until next time",
]

DOMAIN_KEYWORDS = [
    "lavender", "lavandula", "tomato", "solanum", "rose", "rosa", "maple", "acer", "salvia",
    "sage", "mint", "mentha", "basil", "ocimum", "thyme", "thymus", "rosemary", "rosmarinus",
    "oregano", "origanum", "hosta", "hydrangea", "clematis", "geranium", "petunia", "dahlia",
    "tulip", "tulipa", "narcissus", "daffodil", "iris", "lily", "lilium", "peony", "paeonia",
    "delphinium", "fern", "ferns", "palm", "bamboo", "moss", "grass", "grasses", "succulent",
    "cactus", "plant", "planting", "prune", "pruning", "propagate", "propagating", "transplant",
    "transplanting", "sow", "sowing", "harvest", "harvesting", "water", "watering", "fertilize",
    "fertilizing", "mulch", "mulching", "deadhead", "deadheading", "divide", "dividing",
    "stake", "staking", "flower", "flowers", "flowering", "bloom", "blooms", "blooming", "leaf",
    "leaves", "foliage", "stem", "stems", "root", "roots", "seed", "seeds", "bulb", "bulbs",
    "cutting", "cuttings", "perennial", "annual", "biennial", "evergreen", "deciduous", "hardy",
    "tender", "drought-tolerant", "shade-loving", "sun-loving", "soil", "compost", "fertilizer",
    "nutrients", "drainage", "ph", "sunlight", "shade", "full sun", "partial shade", "moisture",
    "temperature", "hardiness", "zone", "climate", "season", "spring", "summer", "autumn",
    "fall", "winter", "frost", "garden", "bed", "border", "container", "pot", "greenhouse",
    "raised bed", "vegetable garden", "herb garden", "flower bed",
]

# --- entities -----------------------------------------------------------------------
TITLE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "from",
    "by", "of", "cm", "mm", "l", "litre", "liter", "inch", "pack", "set", "x", "uk", "eu",
    "us",
]
OFFER_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "with", "from",
    "by", "of", "cm", "mm", "l", "litre", "inch",
]
CLUSTER_STOP_WORDS = ["the", "and", "for", "with", "from", "pack", "set"]
AMBIGUOUS_NAMES = ["rose", "lily", "palm", "pine", "sage", "mint", "basil"]
DESCRIPTIVE_WORDS = [
    "this", "that", "beautiful", "lovely", "perfect", "best", "grows", "plant", "needs",
    "prefers", "loves", "thrives", "variety", "cultivar", "species", "type", "called",
    "named",
]
SPECIFICS_PATTERN = r"\d+|tall|short|wide|narrow|red|blue|purple|yellow|white|green"
VAGUE_PATTERN = r"this one|that thing|some kind|you know|sort of"
KNOWN_GENERA = [
    "Lavandula", "Salvia", "Rosa", "Helenium", "Brassica", "Solanum", "Acer", "Prunus",
    "Malus", "Heuchera", "Hosta", "Sedum", "Echinacea", "Rudbeckia", "Allium", "Narcissus",
    "Tulipa", "Dahlia", "Paeonia", "Hydrangea", "Clematis", "Geranium",
]
COMMERCE_CATEGORIES = [
    "PLANT", "TOOL", "MATERIAL", "STRUCTURE", "SEED", "BOOK", "COURSE", "EVENT", "SERVICE",
    "OTHER",
]
HIGH_VALUE_COMMERCE = ["PLANT", "TOOL", "SEED", "BOOK", "COURSE"]
TAXONOMY_ALIASES = {
    "gardening": "gardening", "garden": "gardening",
    "startup": "startup", "startups": "startup", "technology": "startup", "tech": "startup",
    "ai": "startup", "saas": "startup", "crypto": "startup", "cryptocurrency": "startup",
    "software": "startup", "developer": "startup", "coding": "startup", "fintech": "startup",
    "blockchain": "startup",
}

# --- seasons ------------------------------------------------------------------------
SEASON_PATTERNS = [
    ("spring", "spring|springtime|early spring|late spring|spring season"),
    ("summer", "summer|summertime|early summer|mid summer|late summer|summer season"),
    ("autumn", "autumn|autumnal|fall season"),
    ("fall", "fall|falling leaves"),
    ("winter", "winter|wintertime|early winter|late winter|winter season"),
]
MONTH_PATTERNS = [
    (1, "january|jan"), (2, "february|feb"), (3, "march|mar"), (4, "april|apr"), (5, "may"),
    (6, "june|jun"), (7, "july|jul"), (8, "august|aug"), (9, "september|sept|sep"),
    (10, "october|oct"), (11, "november|nov"), (12, "december|dec"),
]
MONTH_NAMES = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September",
    "October", "November", "December",
]
REGION_PATTERNS = [
    ("UK", "uk|united kingdom|britain|british|england|scotland|wales", "northern"),
    ("USA", "usa|united states|america|american", "northern"),
    ("Europe", "europe|european", "northern"),
    ("Australia", "australia|australian|aussie", "southern"),
    ("Mediterranean", "mediterranean", None),
    ("Tropical", "tropical|tropics", None),
    ("Temperate", "temperate", None),
    ("Northern Hemisphere", "northern hemisphere", "northern"),
    ("Southern Hemisphere", "southern hemisphere", "southern"),
]
ZONE_PATTERN = r"(?:zone|hardiness zone|usda zone|growing zone)\s+(?:[0-9]{1,2}[a-b]?)"
WEATHER_PATTERNS = [
    ("frost", "frost|frosted|frosty|freezing|freeze"),
    ("heat", "heat|hot|scorching|sweltering|heatwave"),
    ("drought", "drought|dry|arid|water shortage"),
    ("wet", "wet|rain|rainy|damp|moisture|waterlogged"),
]
YEAR_ROUND_PATTERN = "year.round|all year|anytime|any time|throughout the year"
SOUTHERN_REGIONS = ["AU", "NZ", "ZA", "BR", "AR", "CL"]

# --- category potential -------------------------------------------------------------
PURCHASE_WORDS = [
    "buy", "purchase", "order", "best", "review", "recommend", "quality", "durable",
    "professional", "essential", "kit",
]
LEARNING_WORDS = [
    "how to", "tutorial", "guide", "learn", "master", "technique", "method", "step",
    "beginner", "start", "basics", "advanced",
]
BEGINNER_WORDS = ["basic", "start", "beginner", "first", "simple", "easy", "plant", "water", "soil"]
INTERMEDIATE_WORDS = ["grow", "care", "maintain", "feed", "prune", "transplant", "design"]
ADVANCED_WORDS = ["propagate", "graft", "hybrid", "breed", "expert", "master", "professional"]
HIGH_VALUE_WORDS = [
    "tool", "equipment", "kit", "system", "device", "machine", "greenhouse", "raised bed",
    "irrigation", "automation",
]
EVERGREEN_WORDS = [
    "houseplant", "indoor", "care", "maintenance", "pest", "disease", "soil", "compost",
    "water", "light", "propagation", "pruning",
]

# --- channels, programs, calendar ----------------------------------------------------
CRITERION_WEIGHTS = {
    "published_books": 0.15, "editorial_vetting": 0.1, "media_presence": 0.15,
    "professional_credentials": 0.2, "institutional_affiliation": 0.15,
    "ethical_alignment": 0.1, "production_quality": 0.15,
}
REGION_RULES = [  # (bucket, substrings, whole names), first hit wins
    ("UK", ["united kingdom", "uk"], ["england", "scotland", "wales"]),
    ("EU", ["germany", "france", "netherlands", "belgium", "spain", "italy", "ireland",
            "denmark", "sweden", "finland", "austria", "portugal", "poland", "czech",
            "hungary", "romania", "greece"], []),
    ("NA", ["united states", "usa", "canada"], []),
    ("AU", ["australia", "new zealand"], []),
]
EVENT_CATEGORY_RULES = [  # (field, any of these words, categories)
    ("event", ["flower", "show"], ["Ornamental Plants", "Garden Design"]),
    ("event", ["seed", "sow"], ["Seeds", "Propagation"]),
    ("event", ["harvest", "fruit"], ["Garden Tools", "Storage"]),
    ("event", ["winter", "frost"], ["Garden Protection", "Fleece"]),
    ("event", ["spring", "plant"], ["Bulbs", "Compost"]),
    ("plant", ["rose", "tulip", "peony"], ["Ornamental Plants"]),
    ("plant", ["tomato", "bean", "potato"], ["Vegetable Seeds", "Grow Your Own"]),
    ("plant", ["apple", "pear", "berry"], ["Fruit Trees", "Soft Fruit"]),
    ("plant", ["herb", "basil", "mint"], ["Herbs"]),
]
SEASON_COLORS = {
    "spring": "#10b981", "summer": "#f59e0b", "autumn": "#ef4444", "winter": "#3b82f6",
}
HIGH_PRIORITY_COLOR = "#8b5cf6"
DEFAULT_COLOR = "#6b7280"
PROMOTION_MULTIPLIERS = {"sale": 2.0, "seasonal": 1.5, "holiday": 1.8, "flash-deal": 2.5}

# --- metering -----------------------------------------------------------------------
RATE_LIMITS = [("per_minute", 60, 30), ("per_hour", 3600, 500), ("per_day", 86400, 5000)]
TOOL_PRICES = {
    "analyze_video": 0.02, "analyze_video:deep": 0.05, "get_commercial_entities": 0.005,
    "get_monetization_opportunities": 0.01, "get_audience_insights": 0.01,
    "discover_content_gaps": 0.02, "batch_analyze": 0.015, "discover_opportunities": 0.02,
    "scan_affiliate_programs": 0.01, "assess_channel_authority": 0.01,
    "map_category_affinity": 0.01, "track_category_lifecycle": 0.005,
    "get_seasonal_calendar": 0.005,
}
FREE_CALLS_PER_DAY = 5
BUDGET = {"per_request": 0.01, "daily": 0.50, "monthly": 10.00, "alert": 0.80}
TOKEN_BUCKET = {"rate": 5.0, "daily_quota": 10000}
TOKEN_COST = {"input": 0.15e-6, "output": 0.6e-6, "output_tokens": 150}

# --- program relevance ----------------------------------------------------------------
PROGRAM_KEYWORDS = {
    "plants": ["plant", "plants", "nursery", "nurseries", "flower", "flowers", "shrub", "tree",
               "bulb", "perennial", "annual", "succulent", "cactus", "fern", "palm", "orchid",
               "rose", "tulip", "hedge", "climber", "vine"],
    "seeds": ["seed", "seeds", "seedling", "germination", "propagation", "sowing"],
    "tools": ["garden tool", "gardening tool", "secateur", "pruner", "shears", "spade", "fork",
              "trowel", "hoe", "rake", "wheelbarrow", "lawnmower", "lawn mower", "strimmer",
              "chainsaw", "loppers"],
    "materials": ["compost", "fertilizer", "fertiliser", "mulch", "soil", "peat", "bark",
                  "gravel", "membrane", "fleece", "netting", "pot", "planter", "raised bed",
                  "grow bag"],
    "books": ["gardening book", "garden book", "horticulture book", "botanical book"],
    "courses": ["gardening course", "horticulture course", "RHS", "master gardener"],
    "events": ["garden show", "flower show", "chelsea", "hampton court", "tatton"],
    "general": ["garden", "gardening", "horticulture", "botanical", "allotment", "greenhouse",
                "polytunnel", "conservatory", "landscape", "landscaping"],
}
HYBRID_PRESETS = {"aggressive-cost-saving": (70, 30), "balanced": (80, 20), "quality-first": (90, 10)}
