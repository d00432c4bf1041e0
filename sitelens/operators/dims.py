"""Dimension tables: word lists, indicators, lexicons, schema trends.

All of them are small and of fixed size (asserted in tests), so joins against
them are broadcast with a proven bound.  The lists themselves are fixed values
that must equal the reference's for equal results; they are stated plainly and
in their natural order below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------
# Fixed values (must equal the reference's word lists; natural order).
# ----------------------------------------------------------------------------

STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "as", "is", "was", "are", "were", "been",
    "be", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "shall", "can", "need",
    "this", "that", "these", "those", "i", "you", "he", "she", "it",
    "we", "they", "what", "which", "who", "when", "where", "why", "how",
    "all", "each", "every", "both", "few", "more", "most", "other",
    "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "just", "also", "now", "here", "there",
    "then", "once", "any", "about", "into", "through", "during",
    "before", "after", "above", "below", "between", "under", "again",
    "further", "because", "if", "else", "until", "while", "our", "your",
]

# business type -> (enum ordinal, schema.org class)
BUSINESS_TYPES = [
    ("Unknown", 0, "Organization"),
    ("Service", 1, "ProfessionalService"),
    ("Ecommerce", 2, "Store"),
    ("Blog", 3, "Blog"),
    ("Portfolio", 4, "Person"),
    ("SaaS", 5, "SoftwareApplication"),
    ("LocalBusiness", 6, "LocalBusiness"),
    ("Restaurant", 7, "Restaurant"),
    ("Agency", 8, "Organization"),
    ("NonProfit", 9, "NGO"),
    ("Education", 10, "EducationalOrganization"),
    ("Healthcare", 11, "MedicalOrganization"),
    ("RealEstate", 12, "RealEstateAgent"),
    ("Technology", 13, "TechArticle"),
]

INDICATORS = {
    "Ecommerce": [
        "cart", "checkout", "buy", "shop", "store", "product", "price",
        "add to cart", "purchase", "order", "shipping", "payment",
        "catalog", "inventory", "sale", "discount", "coupon",
    ],
    "SaaS": [
        "saas", "software", "platform", "dashboard", "api", "integration",
        "subscription", "trial", "demo", "features", "pricing", "plans",
        "enterprise", "startup", "cloud", "automation", "workflow",
    ],
    "Blog": [
        "blog", "article", "post", "author", "published", "read more",
        "comments", "tags", "category", "archive", "recent posts",
    ],
    "Portfolio": [
        "portfolio", "projects", "work", "case study", "client",
        "designer", "developer", "freelance", "hire me", "about me",
    ],
    "Service": [
        "service", "consulting", "solutions", "expertise", "professional",
        "team", "approach", "methodology", "process", "engagement",
        "migration", "assessment", "audit", "implementation",
    ],
    "Agency": [
        "agency", "creative", "marketing", "branding", "campaigns",
        "clients", "results", "strategy", "digital", "media",
    ],
    "LocalBusiness": [
        "location", "address", "hours", "visit us", "directions",
        "local", "near", "store hours", "call us", "contact",
    ],
    "Restaurant": [
        "menu", "restaurant", "dining", "reservation", "food",
        "cuisine", "chef", "table", "delivery", "takeout", "order online",
    ],
    "Education": [
        "course", "learn", "student", "teacher", "education",
        "training", "curriculum", "enroll", "class", "lesson",
        "certification", "degree", "workshop",
    ],
    "Healthcare": [
        "health", "medical", "doctor", "patient", "clinic",
        "hospital", "treatment", "appointment", "care", "wellness",
        "diagnosis", "symptoms", "therapy",
    ],
    "RealEstate": [
        "property", "real estate", "home", "house", "apartment",
        "listing", "rent", "sale", "mortgage", "agent", "broker",
        "bedroom", "bathroom", "sqft",
    ],
    "Technology": [
        "technology", "tech", "innovation", "engineering", "development",
        "infrastructure", "security", "data", "ai", "machine learning",
        "blockchain", "cloud computing", "devops",
    ],
    "NonProfit": [
        "nonprofit", "charity", "donate", "volunteer", "mission",
        "cause", "foundation", "community", "impact", "support",
    ],
}

POSITIVE_WORDS = [
    "amazing", "awesome", "best", "brilliant", "excellent", "exceptional",
    "fantastic", "great", "incredible", "outstanding", "perfect", "remarkable",
    "stunning", "superb", "wonderful", "beautiful", "elegant", "impressive",
    "innovative", "professional", "quality", "reliable", "successful", "trusted",
    "valuable", "premium", "exclusive", "leading", "proven", "guaranteed",
    "certified", "award-winning", "top-rated", "highly-rated", "recommended",
    "popular", "favorite", "loved", "easy", "simple", "fast", "quick", "instant",
    "free", "save", "discount", "affordable", "efficient", "effective",
    "powerful", "advanced", "modern", "cutting-edge", "revolutionary",
]

NEGATIVE_WORDS = [
    "bad", "terrible", "awful", "horrible", "poor", "worst", "disappointing",
    "frustrating", "annoying", "difficult", "complicated", "confusing",
    "expensive", "overpriced", "slow", "broken", "failed", "error", "problem",
    "issue", "bug", "crash", "spam", "scam", "fake", "cheap", "low-quality",
    "unreliable", "risky", "dangerous", "harmful", "boring", "ugly", "outdated",
]

POWER_WORDS = [
    "now", "today", "instant", "immediately", "hurry", "limited", "deadline",
    "last-chance", "don't-miss", "act-now", "urgent",
    "exclusive", "premium", "vip", "members-only", "insider", "secret",
    "limited-edition", "rare", "unique", "special",
    "guaranteed", "proven", "certified", "official", "authentic", "verified",
    "trusted", "secure", "safe", "protected", "backed",
    "free", "bonus", "save", "discount", "deal", "bargain", "value", "worth",
    "affordable", "budget-friendly",
    "results", "success", "achieve", "transform", "improve", "boost", "increase",
    "maximize", "optimize", "accelerate",
]

EMOTIONAL_TRIGGERS = [
    "don't-miss", "limited-time", "exclusive", "last-chance", "ending-soon",
    "discover", "reveal", "secret", "hidden", "surprising", "unexpected",
    "little-known", "insider",
    "proven", "guaranteed", "backed", "certified", "official", "trusted",
    "dream", "imagine", "achieve", "unlock", "transform", "revolutionize",
    "popular", "trending", "best-selling", "top-rated", "award-winning",
    "recommended", "loved",
]

# schema type, trend score (f32 in the reference), rich snippets, applicable
# business types, description -- in declared order
SCHEMA_TRENDS = [
    ("FAQPage", 0.95, True, ["Service", "SaaS", "Ecommerce", "Healthcare", "Education"],
     "FAQ rich results are appearing more frequently in SERPs"),
    ("HowTo", 0.90, True, ["Service", "Education", "Blog"],
     "How-to rich results with step-by-step instructions"),
    ("Product", 0.92, True, ["Ecommerce"],
     "Product rich results with price, availability, reviews"),
    ("Review", 0.88, True, ["Ecommerce", "Service", "LocalBusiness", "Restaurant"],
     "Star ratings in search results dramatically increase CTR"),
    ("LocalBusiness", 0.85, True, ["LocalBusiness", "Restaurant", "Healthcare"],
     "Local business info in maps and search"),
    ("Organization", 0.80, True, ["Service", "SaaS", "Agency", "Technology"],
     "Knowledge panel for brand recognition"),
    ("SoftwareApplication", 0.82, True, ["SaaS", "Technology"],
     "Software rich results with ratings and pricing"),
    ("Article", 0.75, True, ["Blog", "Education"],
     "Article rich results for news and blog content"),
    ("BreadcrumbList", 0.70, True, ["Ecommerce", "Service", "Blog"],
     "Breadcrumb navigation in search results"),
    ("VideoObject", 0.85, True, ["Education", "Blog", "Service"],
     "Video thumbnails and duration in search results"),
    ("Event", 0.72, True, ["LocalBusiness", "Education", "NonProfit"],
     "Event rich results with dates and locations"),
    ("Course", 0.78, True, ["Education", "SaaS"],
     "Course rich results for educational content"),
]

# ----------------------------------------------------------------------------
# DataFrame builders (tiny, literal, broadcastable)
# ----------------------------------------------------------------------------

LEXICON_LISTS = [
    ("positive", POSITIVE_WORDS),
    ("negative", NEGATIVE_WORDS),
    ("power", POWER_WORDS),
    ("emotional", EMOTIONAL_TRIGGERS),
]


def stop_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STOP_WORDS], "word string")


def business_types(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BUSINESS_TYPES, "business_type string, ordinal int, schema_type string")


def indicator_rows() -> list[tuple[str, int, str]]:
    """(business type, its ordinal, indicator) of every indicator."""
    ordinal = {name: o for name, o, _ in BUSINESS_TYPES}
    return [(t, ordinal[t], ind) for t, inds in INDICATORS.items() for ind in inds]


def indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(indicator_rows(), "business_type string, ordinal int, indicator string")


def lexicon(spark: SparkSession) -> DataFrame:
    rows = [(name, w) for name, words in LEXICON_LISTS for w in words]
    return spark.createDataFrame(rows, "list string, word string")


def schema_trends(spark: SparkSession) -> DataFrame:
    """One row per (schema, applicable business type); ``trend_ord`` keeps declared order."""
    rows = [
        (i, s, float(score), rich, t, desc)
        for i, (s, score, rich, types, desc) in enumerate(SCHEMA_TRENDS)
        for t in types
    ]
    return spark.createDataFrame(
        rows,
        "trend_ord int, schema_type string, trend_score double, has_rich_snippets boolean, "
        "business_type string, description string",
    )


def small(df: DataFrame) -> DataFrame:
    """Broadcast hint for the literal dimensions above (fixed, tiny row counts)."""
    return F.broadcast(df)
